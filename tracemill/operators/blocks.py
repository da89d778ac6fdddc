"""Nearest neighbours by blocks of vectors: numpy on pairs of blocks, and what each pair of blocks leaves is merged.

Vectors are packed into blocks of about ``BLOCK`` rows by a hash, whatever their ids.  A pair of blocks is one row for
a task, which keeps only the best of it; so the rows that are moved are those of the blocks, once for each block on
the other side, and k a query for each block that it meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tracemill.operators.store import stored

#: Vectors in a block; differences of vectors held at a time.
BLOCK, STEP = 1024, 1 << 21


def packed(rows: DataFrame, ident: str, vector: str, block: int = BLOCK) -> DataFrame:
    """(block, ids, vectors): every row whose vector is not null, in blocks of about ``block`` rows; written.

    All vectors have one length; an entry that is null counts as not a number, and such a vector has no neighbours.
    """
    whole = rows.where(F.col(vector).isNotNull()).select(F.col(ident).alias("i"), F.col(vector).cast("array<double>").alias("v"))
    placed = stored(whole.withColumn("at", F.xxhash64(F.monotonically_increasing_id())))
    n = max(1, -(-placed.count() // block))
    return stored(placed.groupBy(F.pmod("at", F.lit(n)).alias("block")).agg(F.collect_list(F.struct("i", "v")).alias("x")).select("block", F.col("x.i").alias("ids"), F.col("x.v").alias("vectors")))


def _matrix(column: pa.Array, row: int) -> np.ndarray:
    vectors = column[row].values
    flat = pc.list_flatten(vectors).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by differences, some rows at a time."""
    out, step = np.empty((len(a), len(b))), max(1, STEP // max(1, b.size))
    for i in range(0, len(a), step):
        d = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.einsum("ijk,ijk->ij", d, d)
    return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    norm = lambda m: np.maximum(np.sqrt(np.einsum("ij,ij->i", m, m)), 1e-12)
    return (a @ b.T) / norm(a)[:, None] / norm(b)[None, :]


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every block of one side with every block of the other."""
    a = left.select(F.col("ids").alias("a"), F.col("vectors").alias("x"))
    b = right.select(F.col("ids").alias("b"), F.col("vectors").alias("y"))
    return a.join(b, F.lit(True))


def _of_pairs(left: DataFrame, right: DataFrame, made: Callable[[pa.Array, np.ndarray, pa.Array, np.ndarray], list], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                columns = made(batch.column(0)[k].values, _matrix(batch.column(1), k), batch.column(2)[k].values, _matrix(batch.column(3), k))
                yield pa.RecordBatch.from_arrays(columns, names)

    return _pairs(left, right).mapInArrow(run, schema)


def nearest_in_blocks(queries: DataFrame, references: DataFrame, k: int) -> DataFrame:
    """(query_id, reference_id, distance, k) of ``packed`` vectors: the k nearest references of every query, ties by id.

    A reference with the query's own id counts like any other; distances that are not numbers have no place.
    """
    kind = dict(queries.dtypes)["ids"][6:-1]

    def best(a: pa.Array, x: np.ndarray, b: pa.Array, y: np.ndarray) -> list:
        order = pc.sort_indices(b).to_numpy()  # a stable sort by distance then breaks ties by id
        d = square_distances(x, y[order])
        first = np.argsort(np.where(np.isnan(d), np.inf, d), axis=1, kind="stable")[:, :k]
        near = np.take_along_axis(d, first, axis=1)
        owner, flat = np.repeat(np.arange(len(x)), first.shape[1]), near.reshape(-1)
        ok = ~np.isnan(flat)
        return [a.take(pa.array(owner[ok])), b.take(pa.array(order[first.reshape(-1)[ok]])), pa.array(flat[ok])]

    found = _of_pairs(queries, references, best, f"query_id {kind}, reference_id {dict(references.dtypes)['ids'][6:-1]}, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "reference_id")  # limited to k in each task before its shuffle
    return found.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k)


def mutual_in_blocks(left: DataFrame, right: DataFrame, minimum: float) -> DataFrame:
    """(left_id, right_id, cosine) of ``packed`` vectors: pairs that are each other's best match, ties by id."""
    kinds = [dict(t.dtypes)["ids"][6:-1] for t in (left, right)]

    def best(a: pa.Array, x: np.ndarray, b: pa.Array, y: np.ndarray) -> list:
        rows, columns = pc.sort_indices(a).to_numpy(), pc.sort_indices(b).to_numpy()
        c = np.nan_to_num(cosines(x[rows], y[columns]), nan=-np.inf)
        of_left, of_right = c.argmax(axis=1), c.argmax(axis=0)  # the first of equal ones has the least id
        i = np.concatenate([np.arange(len(rows)), of_right])
        j = np.concatenate([of_left, np.arange(len(columns))])
        return [pa.array(np.arange(len(i)) < len(rows)), a.take(pa.array(rows[i])), b.take(pa.array(columns[j])), pa.array(c[i, j])]

    found = _of_pairs(left, right, best, f"of_left boolean, left_id {kinds[0]}, right_id {kinds[1]}, cosine double")
    top = lambda own, other: F.min(F.struct((-F.col("cosine")).alias("c"), other)).alias("b")  # noqa: E731, ARG005
    lefts = found.where("of_left").groupBy("left_id").agg(top("left_id", "right_id")).select("left_id", F.col("b.right_id").alias("right_id"), (-F.col("b.c")).alias("cosine"))
    rights = found.where("not of_left").groupBy("right_id").agg(top("right_id", "left_id")).select("right_id", F.col("b.left_id").alias("left_id"))
    return lefts.join(rights, ["left_id", "right_id"]).where(F.col("cosine") >= minimum).select("left_id", "right_id", "cosine")
