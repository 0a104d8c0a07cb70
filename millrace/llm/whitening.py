"""Whitening of embeddings from an exact integer scatter matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.staging import discard, staged
from millrace.llm.vectors import integer_vectors, matrices

#: Longs are taken apart into balanced limbs of 16 bits; differences of limbs are at most 2^16, so sums of this many products are exact in a double.
_LIMB, _LIMBS, _EXACT_ROWS = 16, 4, 1 << 19
_SUMS, _COUNT = -1, -2


class Model(NamedTuple):
    """What the vectors of one length were fitted to: n distinct vectors, their exact sums, the leading components."""

    n: int
    sums: list[int]
    components: np.ndarray  # a column each, of unit length
    eigenvalues: np.ndarray
    explained: list[float | None]
    usable: np.ndarray  # whether an eigenvalue is above rounding
    identity_error: float | None


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """x = sum of limb_k * 2^(16 k), every limb but the last between -2^15 and 2^15 - 1."""
    out = []
    for _ in range(_LIMBS - 1):
        out.append(((x + 0x8000) & 0xFFFF) - 0x8000)
        x = (x >> _LIMB) + ((x >> (_LIMB - 1)) & 1)
    return [*out, x]


class _Scatter:
    """Exact sums and cross-products of vectors less a shift, by power of 2^16, as longs."""

    def __init__(self, shift: np.ndarray) -> None:
        self.d, self.shift = len(shift), _limbs(shift)
        self.clear()

    def clear(self) -> None:
        self.n, self.bound = 0, 0
        self.sums: dict[int, np.ndarray] = {}
        self.cross: dict[int, np.ndarray] = {}

    def add(self, x: np.ndarray) -> Iterator[tuple]:
        for at in range(0, len(x), _EXACT_ROWS):
            part = x[at : at + _EXACT_ROWS]
            with np.errstate(over="ignore"):
                apart = [(p, (a - b).astype("f8")) for p, (a, b) in enumerate(zip(_limbs(part), self.shift))]
            apart = [(p, a) for p, a in apart if a.any()]
            bound = _LIMBS * len(part) << 34
            if self.bound + bound >= 1 << 62:
                yield from self.rows()
            self.n, self.bound = self.n + len(part), self.bound + bound
            for p, a in apart:
                self.sums[p] = self.sums.get(p, 0) + a.sum(0).astype("i8")
                for q, b in apart:
                    self.cross[p + q] = self.cross.get(p + q, 0) + (a.T @ b).astype("i8")

    def rows(self) -> Iterator[tuple]:
        """(d, i, power, values): for i >= 0 the products of entry i with entries i, i + 1, ..., for _SUMS the sums."""
        if self.n:
            yield self.d, _COUNT, 0, [self.n]
            for p, values in self.sums.items():
                yield self.d, _SUMS, p, values
            for p, matrix in self.cross.items():
                for i in range(self.d):
                    yield self.d, i, p, matrix[i, i:]
        self.clear()


_PARTIAL = pa.schema([("d", pa.int32()), ("i", pa.int32()), ("power", pa.int32()), ("v", pa.list_(pa.int64()))])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[-1])
        if n >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _scatter(vectors: DataFrame) -> dict[int, tuple[int, list[int], list[list[int]], list[int]]]:
    """By length d: n, the sums and cross-products of the vectors less the shift, and the shift. Only these d * d numbers reach
    the driver; Spark adds the tasks' longs as decimals of 38 digits."""
    shifts = {r["d"]: np.array(r["x"], "i8") for r in vectors.groupBy(F.size("x").alias("d")).agg(F.min("x").alias("x")).collect()}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, _Scatter] = {}

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for _, x in matrices(batch):
                    d = x.shape[1]
                    if d not in own:
                        own[d] = _Scatter(shifts[d])
                    yield from own[d].add(x)
            for s in own.values():
                yield from s.rows()

        yield from _batches(rows(), _PARTIAL)

    parts = vectors.mapInArrow(partial, "d int, i int, power int, v array<bigint>").select("d", "i", "power", F.posexplode("v").alias("j", "v"))
    found: dict[int, tuple] = {d: ([0], [0] * d, [[0] * d for _ in range(d)], [int(c) for c in s]) for d, s in shifts.items()}
    for r in parts.groupBy("d", "i", "j", "power").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).toLocalIterator():
        n, sums, cross, _ = found[r["d"]]
        value = int(r["v"]) << _LIMB * r["power"]
        if r["i"] == _COUNT:
            n[0] += value
        elif r["i"] == _SUMS:
            sums[r["j"]] += value
        else:
            cross[r["i"]][r["i"] + r["j"]] += value
    return {d: (n[0], sums, cross, shift) for d, (n, sums, cross, shift) in found.items()}


def _decomposed(n: int, sums: list[int], cross: list[list[int]], shift: list[int], components: int) -> Model:
    """n * X'X - SS' in whole numbers, divided once by n * n, then eigh. Components point to where their largest entry is
    positive. The shift changes the sums alone."""
    d = len(sums)
    v = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            v[i, j] = v[j, i] = (n * cross[i][j] - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(v)
    k = min(components, d)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    trace = math.fsum(v.diagonal())
    explained = [max(0.0, float(e)) / trace if trace > 0 else None for e in values]
    return Model(n, [s + n * t for s, t in zip(sums, shift)], vectors, values, explained, values > d * np.finfo(float).eps * max(values[0], 0), None)


def _deviations(x: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S as doubles, each rounded once, and its exact sum of squares."""
    largest = m.n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, m.sums), default=0)
    whole = (x if largest < 1 << 62 else x.astype(object)) * m.n - np.array(m.sums, "i8" if largest < 1 << 62 else object)
    exact = whole if len(m.sums) * largest * largest < 1 << 63 else whole.astype(object)
    return whole.astype("f8"), (exact * exact).sum(1)


def _whitened(deviation: np.ndarray, m: Model) -> np.ndarray:
    return deviation / m.n @ m.components / np.sqrt(np.where(m.usable, m.eigenvalues, 1.0))


def fit(vectors: DataFrame, components: int = 4) -> dict[int, Model]:
    """The leading components of vectors (x: distinct arrays of longs, as integer_vectors gives them), by their length.

    A first pass adds up sums and cross-products exactly (longs in limbs, arbitrary precision where they are joined), a
    second measures the covariance of the whitened vectors. Vectors of length 0 have no model; an empty table has none.
    """
    models = {d: _decomposed(*found, components) for d, found in _scatter(vectors.filter("size(x) > 0")).items()}
    schema = pa.schema([("d", pa.int32()), ("v", pa.list_(pa.float64()))])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list] = {}
        for batch in batches:
            for _, x in matrices(batch):
                if m := models.get(x.shape[1]):
                    w = _whitened(_deviations(x, m)[0], m)
                    had = own.setdefault(x.shape[1], [0.0, 0.0])
                    own[x.shape[1]] = [had[0] + w.sum(0), had[1] + w.T @ w]
        yield from _batches(((d, [*s, *c.ravel()]) for d, (s, c) in own.items()), schema)

    totals: dict[int, dict[int, float]] = {}
    for r in vectors.mapInArrow(partial, "d int, v array<double>").select("d", F.posexplode("v")).groupBy("d", "pos").agg(F.sum("col").alias("v")).collect():
        totals.setdefault(r["d"], {})[r["pos"]] = r["v"]
    for d, sums in totals.items():
        m, k = models[d], len(models[d].eigenvalues)
        flat = np.array([sums[p] for p in range(k + k * k)])
        mean, second = flat[:k] / m.n, flat[k:].reshape(k, k) / m.n
        off = np.abs(second - np.outer(mean, mean) - np.eye(k))[np.ix_(m.usable, m.usable)]
        models[d] = m._replace(identity_error=float(off.max()) if off.size else None)
    return models


def transform(vectors: DataFrame, models: dict[int, Model], key_type: str = "long") -> DataFrame:
    """Every row of vectors (id, x) by every component of its length's model: the whitened entry, null where the component's
    eigenvalue is zero but for rounding. deviation is null where it doesn't fit a long; deviation_text always has it."""
    names = ["id", "component", "n", "deviation", "deviation_text", "whitened", "explained", "identity_error"]
    types = [None, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for at, x in matrices(batch):
                if not (m := models.get(x.shape[1])):
                    continue
                k = len(m.eigenvalues)
                deviation, squares = _deviations(x, m)
                fits = [int(s) if s < 1 << 63 else None for s in squares]
                w = _whitened(deviation, m)
                each = lambda v: [y for y in v for _ in range(k)]
                usable, n = np.tile(m.usable, len(x)), len(x) * k
                columns = [ids.take(pa.array(np.repeat(at, k))), np.tile(np.arange(1, k + 1), len(x)), [m.n] * n, each(fits), each(map(str, squares)), pa.array(w.ravel(), mask=~usable), m.explained * len(x), [m.identity_error] * n]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names)

    return vectors.mapInArrow(rows, f"id {key_type}, component int, n long, deviation long, deviation_text string, whitened double, explained double, identity_error double")


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """Whitens every row of an embedding table on the leading components of its distinct integer vectors.

    Rows whose vector is null, empty or holds null or non-finite entries give no rows; null keys and repeated rows are
    whitened each; vectors of several lengths are fitted by length; an empty table gives no rows; other columns, whatever
    their names, are ignored. Returns one row per vector and component, as transform does, with the key under its own name.
    """
    kind = dict(rows.dtypes)[key]
    vectors = integer_vectors(rows, key, vector, scale)
    distinct = staged(vectors.select("x").distinct(), "whitening")
    models = fit(distinct, components)
    discard(distinct)
    return transform(vectors, models, kind).withColumnRenamed("id", key)
