"""Density clustering of points in memory: a hierarchy over mutual reachability distances and its most persistent clusters."""

from __future__ import annotations

import numpy as np

from driftclust.operators.forest import AGAIN, Forest, exact, nearest, search

#: In a single cluster, how far out in medians a point is noise.
STRAY = 1.4


def reduce(vectors: np.ndarray, components: int) -> np.ndarray:
    """Principal components at length 1, three times ``components`` of them; small samples and few components stay as they are.

    Stands in for a neighbour embedding, which no library here offers: discovery needs only that dense groups stay dense.
    """
    n, dim = vectors.shape
    wanted = min(3 * components, dim)
    if components < 2 or n < max(50, 3 * components) or wanted >= dim:
        return vectors
    x = vectors.astype(np.float64)
    x -= x.mean(axis=0)
    return projected(vectors, principal_axes(x.T @ x, components))


def principal_axes(squares: np.ndarray, components: int) -> np.ndarray:
    """The first axes, three times ``components``, of sums of squares and products around the mean."""
    _, axes = np.linalg.eigh(squares)
    return axes[:, ::-1][:, : 3 * components]


def projected(vectors: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Vectors on axes, at length 1."""
    y = vectors.astype(np.float64) @ axes
    length = np.linalg.norm(y, axis=1, keepdims=True)
    return np.divide(y, length, out=np.zeros_like(y), where=length > 0).astype(np.float32)


def neighbours(n: int, min_cluster_size: int, min_samples: int) -> int:
    """Which nearest of ``n`` points, itself counted, gives a point's core distance."""
    return max(1, min(min_samples, min_cluster_size, n))


def core_distances(x: np.ndarray, k: int, block: int = 512, first: int = 0, last: int | None = None) -> np.ndarray:
    """Distance of each point, of those from ``first`` to before ``last``, to its k-th nearest, itself counted."""
    square = (x * x).sum(axis=1)
    last = len(x) if last is None else min(last, len(x))
    out = np.empty(max(last - first, 0))
    for at in range(first, last, block):
        to = min(at + block, last)
        d = square[at:to, None] + square[None, :] - 2 * x[at:to] @ x.T
        out[at - first : to - first] = np.sqrt(np.maximum(np.partition(d, k - 1, axis=1)[:, k - 1], 0))
    return out


def spanning_tree(x: np.ndarray, k: int, near: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Edges (a, b, weight), by rising weight, of the minimum spanning tree under max(core a, core b, distance); equal weights go by distance, then by rows.
    ``x`` is ``exact``; ``near`` is what ``nearest`` finds, where it is known."""
    forest = Forest.first(*(nearest(x, k) if near is None else near), k)
    while True:
        pos, limit = forest.grow()
        if not len(pos):
            return forest.rooted()
        forest.listed(pos, *search(x, pos, limit, forest.core, forest.comp, AGAIN), limit)


def merge_tree(edges: np.ndarray, n: int) -> list[tuple[int, int, float, int]]:
    """Merges (left, right, distance, size) by rising distance; merge i makes node n + i."""
    parent, size = list(range(2 * n)), [1] * n + [0] * n
    out = []

    def top(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i, e in enumerate(edges[np.argsort(edges[:, 2], kind="stable")]):
        a, b = top(int(e[0])), top(int(e[1]))
        parent[a] = parent[b] = n + i
        size[n + i] = size[a] + size[b]
        out.append((a, b, float(e[2]), size[n + i]))
    return out


def density_labels(vectors: np.ndarray, min_cluster_size: int, min_samples: int, near: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A label for each row, -1 for noise.

    A cluster is a branch of the merge tree that keeps ``min_cluster_size`` points; its stability is the sum over its points of
    how far in 1 / distance they stay in it, and of nested clusters the most stable ones are taken. The whole as a single cluster is
    taken only where nothing else is found, without the points that leave it at over STRAY times the median distance. Fewer rows than
    ``min_cluster_size`` are noise. ``near``: what ``nearest`` finds, where it is known; the vectors are ``exact`` then.
    """
    n = len(vectors)
    if n < max(2, min_cluster_size):
        return np.full(n, -1)
    x = exact(vectors) if near is None else vectors
    return tree_labels(merge_tree(spanning_tree(x, neighbours(n, min_cluster_size, min_samples), near), n), n, min_cluster_size)


def tree_labels(merges: list[tuple[int, int, float, int]], n: int, min_cluster_size: int) -> np.ndarray:
    """The labels of ``density_labels`` from the merges of ``n`` rows: numbered by their first rows, the same for any of the least spanning trees."""

    def points(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            a = stack.pop()
            if a < n:
                out.append(a)
            else:
                stack += merges[a - n][:2]
        return out

    def parts(node: int) -> list[int]:
        """What meets at the node's distance: merges at the same distance are one, whatever order they came in."""
        distance, out, stack = merges[node - n][2], [], [node]
        while stack:
            for a in merges[stack.pop() - n][:2]:
                (stack if a >= n and merges[a - n][2] == distance else out).append(a)
        return out

    weight = lambda a: 1 if a < n else merges[a - n][3]
    parent, birth, stability, fallen = [-1], [0.0], [0.0], [[]]  # by cluster; fallen: points
    left_at = np.zeros(n)  # the distance at which a point falls out of its cluster
    stack = [(2 * n - 2, 0)]
    while stack:
        node, cluster = stack.pop()
        if node < n:
            fallen[cluster].append(node)
            continue
        distance = merges[node - n][2]
        at = 1 / distance if distance > 0 else 1e12
        sides = parts(node)
        big = sum(weight(a) >= min_cluster_size for a in sides)
        for a in sides:
            if big > 1 and weight(a) >= min_cluster_size:
                stability[cluster] += (at - birth[cluster]) * weight(a)
                parent.append(cluster), birth.append(at), stability.append(0.0), fallen.append([])
                stack.append((a, len(parent) - 1))
            elif weight(a) >= min_cluster_size:
                stack.append((a, cluster))
            else:
                gone = points(a)
                stability[cluster] += (at - birth[cluster]) * len(gone)
                fallen[cluster] += gone
                left_at[gone] = distance
    taken = [False] * len(parent)
    below = [0.0] * len(parent)
    has = [False] * len(parent)
    for c in range(len(parent) - 1, 0, -1):
        taken[c] = not has[c] or stability[c] >= below[c]
        below[parent[c]] += stability[c] if taken[c] else below[c]
        has[parent[c]] = True
    if len(parent) == 1:
        taken[0] = True
    labels, number = np.full(n, -1), 0
    owner = [-1] * len(parent)
    for c in range(len(parent)):  # parents come first
        if c and owner[parent[c]] >= 0:
            owner[c] = owner[parent[c]]
        elif taken[c]:
            owner[c] = number
            number += 1
        if owner[c] >= 0:
            labels[fallen[c]] = owner[c]
    if len(parent) == 1:
        labels[left_at > STRAY * np.median(left_at)] = -1
    rows = np.flatnonzero(labels >= 0)
    _, first, number_of = np.unique(labels[rows], return_index=True, return_inverse=True)
    labels[rows] = np.argsort(np.argsort(first))[number_of]
    return labels
