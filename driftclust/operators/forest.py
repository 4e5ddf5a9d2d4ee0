"""Spanning trees by reachability of points in memory or in parts: exact distances, lists of nearest points, and the forest that grows from them."""

from __future__ import annotations

import io

import numpy as np

#: Points that seek together, and points that they are held against at once.
SEEKERS, HOMES = 1024, 4096
#: Nearest points that the first search lists for each point, and those that later ones do.
LISTED, AGAIN = 16, 4
#: Rows and columns of a matrix of distances.
_ROWS, _COLUMNS = 128, 4096


def quantum(longest: float) -> float:
    """A power of two such that products of coordinates in its multiples, and sums of them, are exact: distances then don't depend on who sums them how, and
    equal ones are equal. ``longest``: the greatest length of a vector; lengths around 1 have the same."""
    return 2.0 ** ((int(np.ceil(np.log2(1.1 * longest))) if longest > 0 else 0) - 24)


def exact(vectors: np.ndarray, unit: float | None = None) -> np.ndarray:
    """Vectors in multiples of ``unit``, by default of what their lengths ask for; single precision holds them too."""
    x = np.ascontiguousarray(vectors, np.float64)
    unit = quantum(float(np.sqrt((x * x).sum(axis=1)).max(initial=0))) if unit is None else unit
    return np.rint(x / unit) * unit


class Lists:
    """For each of some points the ``most`` nearest others outside of its component, by reachability, distance and position, as others pass by."""

    def __init__(self, x: np.ndarray, core: np.ndarray, comp: np.ndarray, limit: np.ndarray, most: int):
        self.left = np.column_stack([x, (x * x).sum(axis=1), np.ones(len(x))])
        self.core, self.comp, self.limit, self.most = core, comp, limit.copy(), most
        self.w, self.d = np.full((len(x), most), np.inf), np.full((len(x), most), np.inf)
        self.q = np.full((len(x), most), np.iinfo(np.int64).max)

    def meet(self, first: int, x: np.ndarray, core: np.ndarray, comp: np.ndarray) -> None:
        """Hold the points against others, whose positions begin with ``first``."""
        right = np.ascontiguousarray(np.column_stack([-2 * x, np.ones(len(x)), (x * x).sum(axis=1)]).T)
        for at in range(0, len(self.left), _ROWS):
            rows = slice(at, at + _ROWS)
            for of in range(0, len(x), _COLUMNS):
                self._block(rows, first + of, right[:, of : of + _COLUMNS], core[of : of + _COLUMNS], comp[of : of + _COLUMNS])

    def _block(self, rows: slice, first: int, right: np.ndarray, core: np.ndarray, comp: np.ndarray) -> None:
        d = self.left[rows] @ right
        near = d <= self.limit[rows, None]
        near &= self.comp[rows, None] != comp
        hits = np.flatnonzero(near)
        if not len(hits):
            return
        most = self.most
        if len(hits) > 8 * most * len(d) and d.shape[1] > most:
            w = np.maximum(d, self.core[rows, None])
            np.maximum(w, core, out=w)
            w[~near] = np.inf
            near &= w <= np.partition(w, most - 1, axis=1)[:, most - 1, None]
            hits = np.flatnonzero(near)
        row, col = np.divmod(hits, d.shape[1])
        dist = d.ravel()[hits]
        reach = np.maximum(np.maximum(dist, self.core[rows][row]), core[col])
        keep = reach <= self.limit[rows][row]
        row, col, dist, reach = row[keep], col[keep], dist[keep], reach[keep]
        touched, local = np.unique(row, return_inverse=True)
        if not len(touched):
            return
        held = touched + rows.start
        who = np.concatenate([np.repeat(np.arange(len(touched)), most), local])
        w, dd, q = (np.concatenate([a[held].ravel(), b]) for a, b in ((self.w, reach), (self.d, dist), (self.q, col + first)))
        order = np.lexsort((q, dd, w, who))
        begin = np.searchsorted(who[order], np.arange(len(touched)))
        best = order[(begin[:, None] + np.arange(most)).ravel()].reshape(-1, most)
        self.w[held], self.d[held], self.q[held] = w[best], dd[best], q[best]
        self.limit[held] = np.minimum(self.limit[held], self.w[held, -1])


class Forest:
    """The spanning forest so far: components, edges, and for each point what is known of its nearest points outside of its component.

    ``p``, ``q``, ``w``, ``d`` are listed pairs in the order of p, then w, d, q; what isn't listed of a point comes at (``far_w``, ``far_d``) at the least. A component's
    least edge in the order of w, d and positions belongs to the only spanning tree that is least in that order, so it is taken where no unlisted one can be less.
    """

    FIELDS = ("core", "comp", "far_w", "far_d", "p", "q", "w", "d", "edges")

    def __init__(self, **fields: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, fields[name])

    @classmethod
    def first(cls, d: np.ndarray, q: np.ndarray, k: int) -> Forest:
        """From the nearest others of all points, by distance; ``k`` as in ``core_distances``."""
        n, most = d.shape
        core = d[:, k - 2].copy() if k > 1 else np.zeros(n)
        p, at = np.repeat(np.arange(n), most), d.ravel()
        q = q.ravel()
        real = np.isfinite(at)
        p, q, at = p[real], q[real], at[real]
        w = np.maximum(np.maximum(at, core[p]), core[q])
        far = d[:, -1]  # infinite where a point has no others
        known = (w < far[p]) | ((w == far[p]) & (at < far[p]))
        p, q, w, at = p[known], q[known], w[known], at[known]
        order = np.lexsort((q, at, w, p))
        return cls(core=core, comp=np.arange(n), far_w=far.copy(), far_d=far.copy(), p=p[order], q=q[order], w=w[order], d=at[order], edges=np.empty((0, 4)))

    def listed(self, pos: np.ndarray, w: np.ndarray, d: np.ndarray, q: np.ndarray, limit: np.ndarray) -> None:
        """Take over what a later search found for points that had nothing listed; beyond ``limit`` it didn't look."""
        full = np.isfinite(w[:, -1])
        self.far_w[pos], self.far_d[pos] = np.where(full, w[:, -1], limit), np.where(full, d[:, -1], np.inf)
        real = np.isfinite(w.ravel())
        p = np.concatenate([self.p, np.repeat(pos, w.shape[1])[real]])
        q, w, d = np.concatenate([self.q, q.ravel()[real]]), np.concatenate([self.w, w.ravel()[real]]), np.concatenate([self.d, d.ravel()[real]])
        order = np.lexsort((q, d, w, p))
        self.p, self.q, self.w, self.d = p[order], q[order], w[order], d[order]

    def _least(self) -> tuple[np.ndarray, ...]:
        """(components, lo, hi, w, d) of the least listed edge of each component that has one, and which points have nothing listed but more to find."""
        out = self.comp[self.p] != self.comp[self.q]
        self.p, self.q, self.w, self.d = self.p[out], self.q[out], self.w[out], self.d[out]
        head = np.flatnonzero(np.r_[True, self.p[1:] != self.p[:-1]]) if len(self.p) else np.empty(0, np.int64)
        p, q, w, d = self.p[head], self.q[head], self.w[head], self.d[head]
        lo, hi, of = np.minimum(p, q), np.maximum(p, q), self.comp[p]
        order = np.lexsort((hi, lo, d, w, of))
        order = order[np.r_[True, of[order][1:] != of[order][:-1]]] if len(order) else order
        blocked = np.isfinite(self.far_w)
        blocked[p] = False
        return of[order], lo[order], hi[order], w[order], d[order], blocked

    def grow(self) -> tuple[np.ndarray, np.ndarray]:
        """Take all edges that are certain. (positions, limits) of the points that must seek again then: none when the tree is whole."""
        n = len(self.comp)
        while True:
            of, lo, hi, w, d, blocked = self._least()
            blocked = np.flatnonzero(blocked)
            least_w, least_d = np.full(n, np.inf), np.full(n, np.inf)
            least_w[of], least_d[of] = w, d
            mine = self.comp[blocked]
            may = (self.far_w[blocked] < least_w[mine]) | ((self.far_w[blocked] == least_w[mine]) & (self.far_d[blocked] <= least_d[mine]))
            unsure = np.zeros(n, bool)
            unsure[mine[may]] = True
            sure = ~unsure[of]
            if not sure.any():
                break
            of, lo, hi, w, d = of[sure], lo[sure], hi[sure], w[sure], d[sure]
            into = np.arange(n)
            into[of] = np.where(self.comp[lo] == of, self.comp[hi], self.comp[lo])
            both = (into[into] == np.arange(n)) & (np.arange(n) < into)
            into[both] = np.flatnonzero(both)
            while not np.array_equal(into[into], into):
                into = into[into]
            self.comp = into[self.comp]
            edges = np.unique(np.column_stack([lo, hi, w, d]), axis=0)
            self.edges = np.concatenate([self.edges, edges])
        if len(self.edges) >= n - 1:
            return np.empty(0, np.int64), np.empty(0)
        seek = blocked[may]
        mine = self.comp[seek]
        seek = seek[mine != np.argmax(np.bincount(self.comp))]  # the others' edges reach it
        return seek, least_w[self.comp[seek]]

    def rooted(self) -> np.ndarray:
        """Edges (parent, child, reach) of the tree from point 0, in their order."""
        e = self.edges[np.lexsort((self.edges[:, 1], self.edges[:, 0], self.edges[:, 3], self.edges[:, 2]))]
        a, b = e[:, 0].astype(np.int64), e[:, 1].astype(np.int64)
        ends, others = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.argsort(ends, kind="stable")
        others, begin = others[order].tolist(), np.searchsorted(ends[order], np.arange(len(self.comp) + 1)).tolist()
        parent, stack = np.full(len(self.comp), -1), [0]
        while stack:
            now = stack.pop()
            for to in others[begin[now] : begin[now + 1]]:
                if to != parent[now]:
                    parent[to] = now
                    stack.append(to)
        down = parent[b] == a
        return np.column_stack([np.where(down, a, b), np.where(down, b, a), np.sqrt(e[:, 2])])

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.FIELDS})
        return out.getvalue()

    @classmethod
    def unpacked(cls, state: bytes) -> Forest:
        return cls(**np.load(io.BytesIO(state)))


def search(x: np.ndarray, pos: np.ndarray, limit: np.ndarray, core: np.ndarray, comp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(w, d, q): the lists of the points ``pos`` of ``x``, all in memory; ``core`` and ``comp`` are those of all points."""
    found = []
    for at in range(0, len(pos), SEEKERS):
        own = pos[at : at + SEEKERS]
        lists = Lists(x[own], core[own], comp[own], limit[at : at + SEEKERS], most)
        for of in range(0, len(x), HOMES):
            lists.meet(of, x[of : of + HOMES], core[of : of + HOMES], comp[of : of + HOMES])
        found.append((lists.w, lists.d, lists.q))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def nearest(x: np.ndarray, k: int, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(d, q): squared distances and positions of the points nearest to those from ``first`` to before ``last``."""
    pos = np.arange(first, len(x) if last is None else min(last, len(x)))
    return search(x, pos, np.full(len(pos), np.inf), np.zeros(len(x)), np.arange(len(x)), max(LISTED, k - 1))[1:]
