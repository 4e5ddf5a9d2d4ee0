"""Embedders: a registry of text models, and signed feature hashing that needs none."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import chain
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftclust.functions.text import pairs_of, trigrams_of, words_of
from driftclust.session import spread


class Embedder(Protocol):
    """Unit vectors of texts. ``model_id`` is stored with each vector; vectors of two models are never compared."""

    @property
    def model_id(self) -> str: ...

    def embed(self, texts: list[str]) -> np.ndarray: ...


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows at length 1 in float32; zero rows stay; a single vector is one row."""
    matrix = np.atleast_2d(np.asarray(matrix, np.float64))
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0).astype(np.float32)


class SignedPlaces:
    """Features hashed to a signed coordinate: bit 0 of a feature's number is the sign, the rest modulo the dimension the place. Words are
    remembered with their trigrams, up to REMEMBERED of them, and so are pairs."""

    REMEMBERED = 1 << 17

    def __init__(self, dim: int, number: Callable[[str], int]):
        self.dim, self._number = dim, number
        self._words: dict[str, tuple[int, ...]] = {}
        self._pairs: dict[str, int] = {}

    def _code(self, feature: str) -> int:
        value = self._number(feature)
        return (value >> 1) % self.dim * 2 + (value & 1)

    def vector(self, text: str | None) -> np.ndarray:
        """The sum of the features of a text: a coordinate gains 1 or loses 1 with each."""
        words = words_of(text)
        known, pairs = self._words, self._pairs
        for held in (known, pairs):
            if len(held) > self.REMEMBERED:
                held.clear()
        for word in [w for w in set(words) if w not in known]:
            known[word] = (self._code(word), *map(self._code, trigrams_of(word)))
        joined = list(pairs_of(words))
        for pair in [x for x in set(joined) if x not in pairs]:
            pairs[pair] = self._code(pair)
        codes = np.fromiter(chain(chain.from_iterable(map(known.__getitem__, words)), map(pairs.__getitem__, joined)), np.int64)
        return np.bincount(codes, minlength=2 * self.dim).reshape(self.dim, 2) @ np.array([-1, 1])


def _by_blake2b(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")


def _by_md5(feature: str) -> int:
    return int(hashlib.md5(feature.encode(), usedforsecurity=False).hexdigest()[:15], 16)


class HashingEmbedder:
    """Signed feature hashing by 64-bit BLAKE2b digests, read little-endian, at length 1."""

    def __init__(self, dim: int = 256):
        if dim < 1:
            raise ValueError("the dimension must be positive")
        self.dim, self._places = dim, SignedPlaces(dim, _by_blake2b)

    @property
    def model_id(self) -> str:
        return f"hashing:{self.dim}"

    def embed(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, self.dim), np.float32)
        return unit_rows(np.stack([self._places.vector(text) for text in texts]))


def _hashing(model: str, _: str | None) -> Embedder:
    return HashingEmbedder(int(model or 256))


def _absent(package: str, load: Callable[[str, str | None], Embedder]) -> Callable[[str, str | None], Embedder]:
    def make(model: str, folder: str | None) -> Embedder:
        try:
            return load(model, folder)
        except ImportError as e:
            raise ImportError(f"this embedder needs the package {package}") from e

    return make


class _Model:
    """An embedder around a function of texts."""

    def __init__(self, model_id: str, run: Callable[[list[str]], np.ndarray]):
        self.model_id, self._run = model_id, run

    def embed(self, texts: list[str]) -> np.ndarray:
        return unit_rows(self._run(texts))


def _fastembed(model: str, folder: str | None) -> Embedder:
    from fastembed import TextEmbedding

    m = TextEmbedding(model, cache_dir=folder)
    return _Model(f"fastembed:{model}", lambda texts: np.stack(list(m.embed(texts))))


def _model2vec(model: str, folder: str | None) -> Embedder:
    from model2vec import StaticModel

    m = StaticModel.from_pretrained(folder or model)
    return _Model(f"model2vec:{model}", lambda texts: m.encode(texts))


def _sentence_transformers(model: str, folder: str | None) -> Embedder:
    from sentence_transformers import SentenceTransformer

    m = SentenceTransformer(model, cache_folder=folder)
    return _Model(f"sentence-transformers:{model}", lambda texts: m.encode(texts))


BACKENDS: dict[str, Callable[[str, str | None], Embedder]] = {
    "hashing": _hashing,
    "fastembed": _absent("fastembed", _fastembed),
    "model2vec": _absent("model2vec", _model2vec),
    "sentence-transformers": _absent("sentence-transformers", _sentence_transformers),
    "st": _absent("sentence-transformers", _sentence_transformers),
}


def make_embedder(name: str, folder: str | None = None) -> Embedder:
    """An embedder from ``backend:model``."""
    backend, _, model = name.partition(":")
    if backend not in BACKENDS:
        raise ValueError(f"unknown embedder {backend!r}; known: {', '.join(sorted(BACKENDS))}")
    return BACKENDS[backend](model, folder)


def embed_column(text: Column, make: Callable[[], Embedder], batch: int = 64) -> Column:
    """Vectors of a text column; the embedder is made once for each task and gets ``batch`` texts at a time."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            texts = part.fillna("").tolist()
            rows: list[np.ndarray] = []
            for at in range(0, len(texts), batch):
                rows.extend(model.embed(texts[at : at + batch]))
            yield pd.Series(rows, dtype=object)

    return run(text)


#: Texts whose dense sums a task holds at once.
SUMMED = 512


def _sums(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Of texts in their batches ids and sums of features by md5, some SUMMED at a time."""
    places = SignedPlaces(dim, _by_md5)
    for batch in batches:
        for at in range(0, batch.num_rows, SUMMED):
            part = batch.slice(at, SUMMED)
            yield part.column(0), np.stack([places.vector(text.as_py()) for text in part.column(1)])


def hashed_features(docs: DataFrame, id_column: str = "doc_id", dim: int = 256) -> DataFrame:
    """(id, slot, value): signed feature hashing by md5 as sparse rows that aren't zero, a text's sums made where the text is."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sums in _sums(batches, dim):
            row, slot = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(slot.astype(np.int64)), pa.array(sums[row, slot].astype(np.int64))], [id_column, "slot", "value"])

    return spread(docs.select(id_column, "text")).mapInArrow(run, f"`{id_column}` {kind}, slot long, value long")


def used_coordinates(docs: DataFrame, dims: tuple[int, ...], id_column: str = "doc_id") -> DataFrame:
    """(id, nonzero_<dim>...): how many coordinates of ``hashed_features`` each dimension uses for a text. Features are hashed once, to the least common
    multiple of the dimensions, and folded to each. Texts that use none in some dimension are left out."""
    kind = docs.schema[id_column].dataType.simpleString()
    names = [f"nonzero_{dim}" for dim in dims]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sums in _sums(batches, math.lcm(*dims)):
            used = [np.count_nonzero(sums.reshape(len(sums), -1, dim).sum(1), axis=1) for dim in dims]
            some = pa.array(np.all(used, axis=0))
            yield pa.RecordBatch.from_arrays([x.filter(some) for x in (ids, *(pa.array(u, pa.int64()) for u in used))], [id_column, *names])

    return spread(docs.select(id_column, "text")).mapInArrow(run, f"`{id_column}` {kind}, " + ", ".join(f"{n} long" for n in names))
