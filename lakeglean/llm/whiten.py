"""Embedding whitening: float32 eigenvectors of an exact covariance, refined in higher precision.

Entries become integers, so every sum is exact and independent of how rows are dealt out. Spark finds the distinct vectors,
sums them, and sums the products of their entries less the rounded mean (the rest of the centring is exact arithmetic of
whole numbers on the driver, which holds one d x d matrix, whatever the number of rows).

The eigenvectors start as those of the float32 matrix. Each round of Ogita and Aishima's iteration is a few matrix products
in extended precision and about doubles the right digits; pairs of eigenvalues closer than the error of the round allows
are clusters, whose subspace is solved again by itself, shifted to its own middle, so that the next round can part them.

Edge cases: rows whose vector is null, or holds a null, NaN or infinite entry, are left out; of vectors of several lengths
those of the length most distinct vectors have are kept (of equally many the longest); an entry past 2^53 / 64 counts as
that; repeated vectors fit once and each row gets its result; a null id keeps its row; components without variance (fewer
distinct vectors than dimensions) have explained 0 and a null whitened value, and identity_error is over the others; a
deviation past 64 bits is null; an empty table gives no rows; extra columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import cut
from .common import record_batch

SCALE, SHIFT = 64, 1_000_000
#: Components that are returned at most.
COMPONENTS = 16
#: Largest absolute whole number of an entry.
MOST = float(1 << 53)
#: Vectors that are multiplied together.
BLOCK = 4096
HIGH = np.longdouble

CODED = pa.schema([("vec_id", pa.int64()), ("d", pa.int32()), ("x", pa.binary())])


def coded(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, d, x) of the usable rows; x: floor(64 c) of the d entries as int16, or as int64 where one does not fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            d = pc.fill_null(pc.list_value_length(v), 0).to_numpy().astype(np.int32)
            row, c = np.repeat(np.arange(len(v)), d), pc.fill_null(v.flatten(), float("nan")).to_numpy()
            left_out = np.bincount(row, ~np.isfinite(c), len(v)) + v.is_null().to_numpy(zero_copy_only=False) > 0
            y = np.clip(np.floor(SCALE * np.where(left_out[row], 0, c)), -MOST, MOST)
            wide = np.bincount(row, np.abs(y) >= 32768, len(v)) > 0
            for kind, chosen in (("<i2", ~left_out & ~wide), ("<i8", ~left_out & wide)):
                own = d[chosen]
                ends = np.concatenate([[0], np.cumsum(own)]).astype(np.int32) * np.dtype(kind).itemsize
                x = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(y[chosen[row]].astype(kind).tobytes())])
                yield record_batch({"vec_id": batch.column("vec_id").filter(pa.array(chosen)), "d": own, "x": x}, CODED)

    own = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return own.mapInArrow(run, "vec_id long, d int, x binary")


def decoded(x: list[bytes], d: int) -> np.ndarray:
    """(len(x), d) whole numbers."""
    if all(len(raw) == 2 * d for raw in x):
        return np.frombuffer(b"".join(x), "<i2").reshape(len(x), d).astype(np.int64)
    out = np.empty((len(x), d), np.int64)
    for i, raw in enumerate(x):
        out[i] = np.frombuffer(raw, "<i2" if len(raw) == 2 * d else "<i8")
    return out


def blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for s in range(0, batch.num_rows, BLOCK):
            part = batch.slice(s, BLOCK)
            yield part, decoded(part.column("x").to_pylist(), d)


def exact_products(y: np.ndarray) -> np.ndarray:
    """y^T y in whole numbers: by floating-point products where they are exact, else number by number."""
    most = float(np.abs(y).max(initial=0))
    if most * most * len(y) < 2**53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    big = y.astype(object)
    return big.T @ big


PART = pa.schema([("part", pa.int32()), ("sums", pa.binary())])
#: Numbers of a table that travel together, and tasks that first add up each part of it.
PART_NUMBERS, ADDERS = 1 << 14, 16
#: A whole number travels as three limbs of so many bits, the last one signed.
LIMB = 40


def table_sum(fit: DataFrame, numbers: int, kind: str, of: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum of the tasks' tables of so many numbers of dtype kind, as bytes in parts: added in some tasks for each part, then in one, one table to the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = of(batches).astype(kind, copy=False)
        starts = range(0, numbers, PART_NUMBERS)
        yield record_batch({"part": list(range(len(starts))), "sums": [table[s : s + PART_NUMBERS].tobytes() for s in starts]}, PART)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, raw in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                found[p] = found.get(p, 0) + np.frombuffer(raw, kind)
        yield record_batch({"part": list(found), "sums": [v.tobytes() for v in found.values()]}, PART)

    schema, out = "part int, sums binary", np.zeros(numbers, kind)
    sums = fit.select("x").mapInArrow(partial, schema).repartition("part", F.spark_partition_id() % ADDERS).mapInArrow(add, schema)
    for r in sums.repartition("part").mapInArrow(add, schema).collect():
        out[r.part * PART_NUMBERS :][:PART_NUMBERS] += np.frombuffer(r.sums, kind)
    return out


def exact_sum(fit: DataFrame, numbers: int, of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]) -> list[int]:
    """The sum of all whole-number tables that `of` makes of the rows of fit."""

    def limbs(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total: np.ndarray = np.zeros(numbers, object)
        for got in of(batches):
            total = total + got.ravel()
        mask = (1 << LIMB) - 1
        return np.concatenate([total & mask, (total >> LIMB) & mask, total >> 2 * LIMB])

    found = table_sum(fit, 3 * numbers, "<i8", limbs).reshape(3, numbers).tolist()
    return [a + (b << LIMB) + (c << 2 * LIMB) for a, b, c in zip(*found, strict=True)]


def covariance(fit: DataFrame, d: int, n: int) -> tuple[list[int], np.ndarray]:
    """Sums of floor(64 c) by dimension, and the covariance over the n rows of fit in extended precision."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, y in blocks(batches, d):
            most = int(np.abs(y).max(initial=0))
            yield (y if most * len(y) < 2**62 else y.astype(object)).sum(0)

    total = exact_sum(fit, d, sums)
    middle = np.array([(2 * t + n) // (2 * n) for t in total], np.int64)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, y in blocks(batches, d):
            yield exact_products(y - middle)

    p, rest = exact_sum(fit, d * d, products), [t - n * int(m) for t, m in zip(total, middle, strict=True)]
    v = np.zeros((d, d), HIGH)
    for i in range(d):
        for j in range(i, d):
            exact = Fraction(n * p[i * d + j] - rest[i] * rest[j], n * n)
            high = float(exact)
            v[i, j] = v[j, i] = HIGH(high) + HIGH(float(exact - Fraction(high)))
    return total, v


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Places of two or more ascending values with no gap larger than `gap` between neighbours."""
    order = np.argsort(values, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(values[order]) > gap) + 1)
    return [p for p in parts if len(p) > 1]


def symmetric(m: np.ndarray) -> np.ndarray:
    return (m + m.T) / 2


def refined(a: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix in extended precision, from those of its float32 rounding."""
    d = len(a)
    scale = np.abs(a).max() if d else HIGH(0)
    if not scale:
        return np.zeros(d, HIGH), np.eye(d, dtype=HIGH)
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(HIGH)
    norm = np.abs(a).sum(1).max()
    eye, tiny = np.eye(d, dtype=HIGH), np.finfo(HIGH).eps * d
    values = np.diag(x.T @ a @ x)
    for _ in range(rounds):
        r, s = eye - symmetric(x.T @ x), symmetric(x.T @ (a @ x))
        values = np.diag(s) / (1 - np.diag(r))
        error = np.sqrt(((s - np.diag(values)) ** 2).sum())
        gap = 2 * (error + norm * np.sqrt((r * r).sum()))
        apart = values[None, :] - values[:, None]
        near = np.abs(apart) <= gap
        step = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, apart))
        x = x + x @ step
        for c in clusters(values, gap):
            y = x[:, c]
            shifted = y.T @ (a @ y - y * values[c].mean())
            size = np.abs(shifted).max()
            if size > tiny * norm:  # else equal to the last digit: any basis will do
                x[:, c] = y @ np.linalg.eigh((symmetric(shifted) / size).astype(np.float64))[1].astype(HIGH)
        if np.abs(step).max() <= 64 * tiny:
            break
    x = x + x @ (eye - symmetric(x.T @ x)) / 2
    x = x / np.sqrt((x * x).sum(0))
    values = (x * (a @ x)).sum(0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    return values[order] * scale, x * np.where(np.take_along_axis(x, np.abs(x).argmax(0)[None], 0) < 0, -1, 1)


@dataclass
class Whitening:
    """Of n distinct vectors with `sums` of floor(64 c): unit `vectors` (d, k) and their eigenvalues; `explained` of the trace."""

    n: int
    d: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n y - sums, exact: int64 where it fits, else Python numbers."""
        fits = (float(np.abs(y).max(initial=0)) + max((abs(s) for s in self.sums), default=0) / self.n) * self.n < 2**62
        return self.n * y - np.array(self.sums, np.int64) if fits else self.n * y.astype(object) - np.array(self.sums, object)

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        """(rows, k); NaN for components without variance."""
        live = self.values > 0
        out = np.full((len(centred), len(self.values)), np.nan)
        out[:, live] = (centred.astype(np.float64) / self.n) @ (self.vectors[:, live] / np.sqrt(self.values[live]))
        return out

    def deviation(self, centred: np.ndarray) -> list[int | None]:
        if centred.dtype != object and float(np.abs(centred).max(initial=0)) ** 2 * max(self.d, 1) < 2**62:
            return (centred * centred).sum(1).tolist()
        totals = [sum(int(v) ** 2 for v in row) for row in centred]
        return [t if t < 2**63 else None for t in totals]


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened vectors of fit, less the identity, over components with variance."""
    k = int((model.values > 0).sum())
    if not k:
        return 0.0

    def products(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((k + 1, k))  # the last row: plain sums
        for _, y in blocks(batches, model.d):
            w = model.whiten(model.centred(y))[:, :k]
            total += np.vstack([w.T @ w, w.sum(0)])
        return total.ravel()

    found = table_sum(fit, (k + 1) * k, "<f8", products).reshape(k + 1, k)
    mean = found[-1] / model.n
    return float(np.abs(found[:-1] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def train(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening | None:
    """The whitening of the distinct usable vectors; None where there are none."""
    fit = cut(coded(df, id_col, vector_col).select("d", "x").distinct())
    lengths = fit.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).head()
    if lengths is None:
        return None
    d, n = lengths["d"], lengths["count"]
    fit = fit.where(F.col("d") == d)
    sums, v = covariance(fit, d, n)
    values, vectors = refined(v)
    trace = np.trace(v)
    values = np.where(values > values[:1].sum() * 1e-15 * max(d, 1), values, 0)[:components]
    explained = values / trace if trace else np.zeros(len(values))
    model = Whitening(n, d, sums, values.astype(np.float64), vectors[:, :components].astype(np.float64), explained.astype(np.float64))
    model.identity_error = identity_error(fit, model)
    return model


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
ROWS = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def whiten(df: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each usable vector of the model's length and each component."""
    if model is None:
        return df.sparkSession.createDataFrame([], SCHEMA)
    sent, k = df.sparkSession.sparkContext.broadcast(model), len(model.values)  # d x k numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for part, y in blocks(batches, m.d):
            centred, rows = m.centred(y), len(y)
            w = m.whiten(centred).ravel()
            yield record_batch(
                {
                    "vec_id": part.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))), "component": np.tile(np.arange(1, k + 1), rows), "n": np.full(rows * k, m.n),
                    "deviation": pa.array(m.deviation(centred), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))), "whitened": pa.array(w, mask=np.isnan(w)),
                    "explained": np.tile(m.explained, rows), "identity_error": np.full(rows * k, m.identity_error),
                },
                ROWS,
            )

    return coded(df, id_col, vector_col).where(F.col("d") == model.d).mapInArrow(run, SCHEMA)
