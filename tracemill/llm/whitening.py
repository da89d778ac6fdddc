"""Whitening of embeddings by a covariance in double-double arithmetic.

Vectors become integers on a fixed grid, so their count and sums are exact.  Each task centres its rows by the exact
mean (held as a high and a low double) and adds their outer products with error-free sums and products; the high and
low parts of all tasks are merged the same way, in two levels.  What reaches the driver is one d by d matrix: its
eigenvectors come from the tridiagonal form by divide and conquer, which is what ``numpy.linalg.eigh`` runs (LAPACK
``syevd``).  The rows are then projected where they lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tracemill.llm.store import discard, stored

#: Rows whose outer products are made at a time, and groups of tasks whose matrices are merged first.
BLOCK, LANES = 1024, 64
#: The grid: x = floor(SCALE * c) + SHIFT; entries beyond +-LIMIT on the grid are set to it.
SCALE, SHIFT, LIMIT = 64.0, 1_000_000, 1 << 40

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a, b) -> Pair:
    """The rounded sum and its error, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a) -> Pair:
    """A double as the sum of two of 26 bits."""
    c = 134217729.0 * a
    high = c - (c - a)
    return high, a - high


def two_product(a, b, a_halves: Pair, b_halves: Pair) -> Pair:
    """The rounded product and its error, exactly."""
    p = a * b
    (ah, al), (bh, bl) = a_halves, b_halves
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add_pairs(a: Pair, b: Pair) -> Pair:
    """Sum of two double-double numbers."""
    s, e = two_sum(a[0], b[0])
    e = e + (a[1] + b[1])
    high = s + e
    return high, e - (high - s)


def fold(pair: Pair) -> Pair:
    """Sum over the first axis in double-double, halves onto halves."""
    while (n := len(pair[0])) > 1:
        half = n // 2
        rest = (pair[0][2 * half :], pair[1][2 * half :])
        pair = add_pairs((pair[0][:half], pair[1][:half]), (pair[0][half : 2 * half], pair[1][half : 2 * half]))
        if len(rest[0]):
            pair = tuple(np.concatenate([x, y]) for x, y in zip(pair, rest, strict=True))
    return pair[0][0], pair[1][0]


class Outer:
    """The running sum of the outer products of double-double rows: upper triangle, row by row."""

    def __init__(self, d: int):
        self.d, self.rows = d, [(np.zeros(d - i), np.zeros(d - i)) for i in range(d)]

    def add(self, high: np.ndarray, low: np.ndarray) -> None:
        for at in range(0, len(high), BLOCK):
            h, l = high[at : at + BLOCK], low[at : at + BLOCK]
            hh, hl = halves(h)
            for i in range(self.d):
                one = slice(i, i + 1)
                p, e = two_product(h[:, one], h[:, i:], (hh[:, one], hl[:, one]), (hh[:, i:], hl[:, i:]))
                e += h[:, one] * l[:, i:] + l[:, one] * h[:, i:]
                self.rows[i] = add_pairs(self.rows[i], fold((p, e)))


PARTIAL = "i int, lane int, high array<double>, low array<double>"


def _doubles(lists: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tolist() for x in lists], pa.list_(pa.float64()))


def _merge(table: pa.Table) -> pa.Table:
    """One row of the matrix from those of many tasks."""
    high, low = (np.array(table.column(k).to_pylist(), np.float64) for k in ("high", "low"))
    made = fold((high, low))
    return pa.table([table.column("i").slice(0, 1), table.column("lane").slice(0, 1), _doubles([made[0]]), _doubles([made[1]])], names=["i", "lane", "high", "low"])


def outer_sum(vectors: DataFrame, rows: Callable[[pa.RecordBatch], Pair], d: int) -> Pair:
    """The d by d sum of the outer products of the ``rows`` of every batch, as high and low parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Outer(d)
        for batch in batches:
            total.add(*rows(batch))
        lane = TaskContext.get().partitionId() % LANES
        columns = [pa.array(range(d), pa.int32()), pa.array([lane] * d, pa.int32()), _doubles([r[0] for r in total.rows]), _doubles([r[1] for r in total.rows])]
        yield pa.RecordBatch.from_arrays(columns, ["i", "lane", "high", "low"])

    parts = vectors.mapInArrow(run, PARTIAL)
    merged = parts.groupBy("i", "lane").applyInArrow(_merge, PARTIAL).groupBy("i").applyInArrow(_merge, PARTIAL)
    high, low = np.zeros((d, d)), np.zeros((d, d))
    for r in merged.collect():  # d rows
        high[r["i"], r["i"] :], low[r["i"], r["i"] :] = r["high"], r["low"]
    lower = np.tril_indices(d, -1)
    high[lower], low[lower] = high.T[lower], low.T[lower]
    return high, low


def on_grid(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which vectors are whole and finite, their lengths, and the entries of those on the grid, one after another."""
    n = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column).cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    edge = np.concatenate(([0], np.cumsum(n)))
    wrong = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    ok = (n > 0) & (wrong[edge[1:]] == wrong[edge[:-1]])
    return ok, n, np.clip(np.floor(SCALE * flat[np.repeat(ok, n)]), -LIMIT, LIMIT).astype(np.int64) + SHIFT


def whole(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of length d that are whole and finite, and their vectors on the grid."""
    ok, n, x = on_grid(column)
    x = x[np.repeat(n[ok] == d, n[ok])]
    return ok & (n == d), x.reshape(-1, d)


@dataclass
class Fit:
    """The exact mean of the fit list, its leading components (as rows) and their eigenvalues."""

    n: int
    sums: np.ndarray
    mean: Pair
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> Pair:
        """x - S/n as high and low doubles."""
        s, e = two_sum(x.astype(np.float64), -self.mean[0])
        e = e - self.mean[1]
        high = s + e
        return high, e - (high - s)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        high, low = self.centred(x)
        return (high @ self.components.T + low @ self.components.T) / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n*x - S)^2; null where one is no long."""
        off = np.abs(x.astype(np.float64) * self.n - self.sums.astype(np.float64)).max(initial=0)
        if off * off * x.shape[1] < 2.0**62 and float(np.abs(self.sums).max(initial=0)) < 2.0**62:
            return ((self.n * x - self.sums) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * int(a) - int(s)) ** 2 for a, s in zip(row, self.sums.tolist(), strict=True)) for row in x]
        return [v if v < 1 << 63 else None for v in exact]


MOMENTS = "d int, n long, sums array<decimal(20,0)>"


def _moments(vectors: DataFrame) -> tuple[int, int, list[int]] | None:
    """The commonest length (of equally common ones the greater), the vectors that have it and their exact sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            ok, n, x = on_grid(batch.column(1))
            for d in np.unique(n[ok]).tolist():
                rows = x[np.repeat(n[ok] == d, n[ok])].reshape(-1, d)
                count, sums = held.setdefault(d, [0, [0] * d])
                held[d] = [count + len(rows), [a + b for a, b in zip(sums, rows.sum(axis=0).tolist(), strict=True)]]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.decimal128(20, 0))]
        values = [list(held), [c for c, _ in held.values()], [s for _, s in held.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["d", "n", "sums"])

    parts = stored(vectors.mapInArrow(run, MOMENTS))
    most = parts.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return None
    by_place = parts.where(F.col("d") == most["d"]).select(F.posexplode("sums").alias("place", "s")).groupBy("place").agg(F.sum("s").alias("s"))
    sums = [int(r["s"]) for r in by_place.orderBy("place").collect()]  # one for each dimension
    discard(parts)
    return most["d"], most["n"], sums


def fit(vectors: DataFrame, most: int = 32) -> Fit | None:
    """The whitening of all whole vectors of ``vectors`` (id, vector); None if there are none."""
    found = _moments(vectors)
    if found is None:
        return None
    d, n, sums = found
    high = [s / n for s in sums]
    low = [float(Fraction(s, n) - Fraction(h)) for s, h in zip(sums, high, strict=True)]
    made = Fit(n, np.array(sums, np.int64), (np.array(high), np.array(low)), np.zeros((0, d)), np.zeros(0), np.zeros(0))
    total_high, total_low = outer_sum(vectors, lambda batch: made.centred(whole(batch.column(1), d)[1]), d)
    covariance = (total_high + total_low) / n
    values, columns = np.linalg.eigh(covariance)
    values, rows = values[::-1], columns.T[::-1]
    trace = float(np.trace(covariance))
    k = min(most, int((values > trace * d * np.finfo(float).eps).sum()))
    rows = rows[:k] * np.where(np.take_along_axis(rows[:k], np.abs(rows[:k]).argmax(axis=1)[:, None], axis=1) < 0, -1.0, 1.0)
    fitted = Fit(n, made.sums, made.mean, np.ascontiguousarray(rows), values[:k].copy(), values[:k] / trace if trace else values[:k])
    if k:

        def with_one(batch: pa.RecordBatch) -> Pair:
            w = fitted.whitened(whole(batch.column(1), d)[1])
            w = np.column_stack([w, np.ones(len(w))])
            return w, np.zeros_like(w)

        high2, low2 = outer_sum(vectors, with_one, k + 1)
        mean = (high2[:k, k] + low2[:k, k]) / n
        fitted.identity_error = float(np.abs((high2[:k, :k] + low2[:k, :k]) / n - np.outer(mean, mean) - np.eye(k)).max())
    return fitted


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, most: int = 32, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each whole vector and component up to ``most``: its whitened coordinate and what goes with it.

    Vectors that are null or empty or hold null or non-finite entries are dropped; so are those whose length is not the
    commonest (of equally common lengths the greatest counts).  Defined cases: null and repeated ids and repeated rows stay
    rows of their own and all count in the fit; directions without variance, beyond rounding, have no component, so a
    single vector or equal vectors give no rows, as no rows do; entries beyond 2^40 on the grid count as that;
    ``deviation`` is null where it is no long; other columns are ignored.  The covariance is centred before
    multiplying; the whitened rows are centred by the same mean, and what rounding leaves is taken off their covariance.
    Each pass reads the vectors where they lie; matrices of d by d, one a task, are all that is moved.
    """
    vectors = rows.select(F.col(vec_id).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"))
    fitted = fit(vectors, most)
    if fitted is None or not len(fitted.values):
        return vectors.sparkSession.createDataFrame([], RESULT)
    d, k = fitted.components.shape[1], len(fitted.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, x = whole(batch.column(1), d)
            if not len(x):
                continue
            w, off = fitted.whitened(x), pa.array(fitted.deviation(x), pa.int64())
            owner = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [
                batch.column(0).filter(pa.array(ok)).take(owner),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * k, fitted.n)),
                off.take(owner),
                pa.array(w.reshape(-1)),
                pa.array(np.tile(fitted.explained, len(x))),
                pa.array(np.full(len(x) * k, fitted.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    return vectors.mapInArrow(run, RESULT)
