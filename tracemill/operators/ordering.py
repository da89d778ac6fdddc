"""Deterministic order, splits, shards and quotas by hash."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Leading hex digits of a digest that make the buckets of a global rank.
BUCKET_DIGITS = 3
SEPARATORS = {"colon": ":", "pipe": "|"}


def payload(seed: int, ident: Column, style: str = "colon") -> Column:
    """What is hashed: ``seed:id``, ``seed|id`` or the canonical JSON ``[seed,"id"]``."""
    text = ident.cast("string")
    if style == "json":
        quoted = F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
        return F.concat(F.lit(f"[{seed},"), quoted, F.lit("]"))
    return F.concat(F.lit(f"{seed}{SEPARATORS[style]}"), text)


def digest(seed: int, ident: Column, style: str = "colon") -> Column:
    return F.sha2(payload(seed, ident, style), 256)


def global_rank(df: DataFrame, key: str, *ties: str, name: str = "rank") -> DataFrame:
    """0-based rank over all rows by a hexadecimal digest column, without a window over all rows.

    Rows are ranked inside buckets of the leading digits (evenly filled, as digests are), and the
    bucket sizes, at most 16**BUCKET_DIGITS rows, give the offsets.
    """
    bucket = F.substring(key, 1, BUCKET_DIGITS)
    sizes = df.groupBy(bucket.alias("__b")).agg(F.count("*").alias("__n"))
    offsets = sizes.withColumn("__o", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inside = df.withColumn("__b", bucket)
    ranked = inside.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(key, *ties)) - 1)
    return ranked.join(F.broadcast(offsets), "__b").withColumn(name, (F.col("__r") + F.col("__o")).cast("long")).drop("__b", "__r", "__o")


def split_by_counts(df: DataFrame, ident: str, counts: dict[str, int], seed: int, style: str = "colon") -> DataFrame:
    """Rows with ``split``: the first so many by hash order for each name; the rest have none."""
    ranked = global_rank(df.withColumn("__d", digest(seed, F.col(ident), style)), "__d", ident)
    out, upto = F.lit(None).cast("string"), sum(counts.values())
    for name, n in reversed(list(counts.items())):
        out = F.when(F.col("rank") < upto, F.lit(name)).otherwise(out)
        upto -= n
    return ranked.withColumn("split", out).drop("__d")


def hash_shard(ident: Column, n: int) -> Column:
    """First eight digest bytes, big-endian, modulo n."""
    first = F.conv(F.substring(F.sha2(ident.cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(first, F.lit(n).cast("decimal(20,0)")).cast("long")


def stream_seed(seed: int, ident: Column) -> Column:
    """First four digest bytes, little-endian."""
    d = digest(seed, ident)
    return F.conv(F.concat(*(F.substring(d, i, 2) for i in (7, 5, 3, 1))), 16, 10).cast("long")


def ratio_by_hash(ident: Column, ratios: list[float], seed: int) -> Column:
    """A ratio by hash modulo their number."""
    first = F.conv(F.substring(digest(seed, ident), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.element_at(F.array(*map(F.lit, ratios)), (F.pmod(first, F.lit(len(ratios)).cast("decimal(20,0)")) + 1).cast("int"))


def balanced_ratios(df: DataFrame, ident: str, ratios: list[float], seed: int) -> DataFrame:
    """Ratios in turn along the hash order, so their numbers differ by one at most."""
    ranked = global_rank(df.withColumn("__d", digest(seed, F.col(ident))), "__d", ident)
    return ranked.withColumn("ratio", F.element_at(F.array(*map(F.lit, ratios)), (F.col("rank") % len(ratios) + 1).cast("int"))).drop("__d")


def ordinal_shard(df: DataFrame, ordinal: str, n: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.col(ordinal), F.lit(n)).cast("long"))


def bottom_k(df: DataFrame, priority: Column, k: int, *ties: str) -> DataFrame:
    """The k rows of least priority, in that order."""
    return df.withColumn("priority", priority).orderBy("priority", *ties).limit(k)


def lowest_group_pick(df: DataFrame, group: str, score: str, ident: str, groups: int, seed: int) -> DataFrame:
    """Per group, the hash-first member of its lowest-scoring part of ``1/groups``."""
    w = Window.partitionBy(group)
    ranked = df.withColumns(
        {"__r": F.row_number().over(w.orderBy(score, F.col(ident).cast("string"))), "__n": F.count("*").over(w), "__d": digest(seed, F.col(ident), "pipe")}
    )
    low = ranked.where(F.col("__r") <= F.greatest(F.lit(1), F.ceil(F.col("__n") / groups)))
    first = low.withColumn("__k", F.row_number().over(w.orderBy("__d", ident)))
    return first.where("__k = 1").drop("__r", "__n", "__d", "__k")


# The odd multipliers of the 64-bit priority.
TRACE, POSITION, TOKEN = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
SEED, LAYER, SPLIT = 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0x94D049BB133111EB
FINISH = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))


def mixed_priority(trace, position, token, seed: int, layer: int, split: int) -> np.ndarray:
    """Unsigned 64-bit priorities, arithmetic modulo 2**64."""
    term = lambda v, m: np.asarray(v).astype(np.uint64) * np.uint64(m)
    constant = (seed * SEED ^ (layer + 1) * LAYER ^ (split + 1) * SPLIT) & ((1 << 64) - 1)
    x = term(trace, TRACE) ^ term(position, POSITION) ^ term(token, TOKEN) ^ np.uint64(constant)
    for shift, factor in FINISH:
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def priority(trace: Column, position: Column, token: Column, seed: int, layer: int = 0, split: int = 0) -> Column:
    """The priority as a long that sorts like the unsigned value (top bit flipped)."""

    @F.pandas_udf("long")
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        x = mixed_priority(a.to_numpy(), b.to_numpy(), c.to_numpy(), seed, layer, split)
        return pd.Series((x ^ np.uint64(1 << 63)).view(np.int64))

    zero = F.lit(0).cast("long")
    return run(*(F.coalesce(x.cast("long"), zero) for x in (trace, position, token)))


def water_filled(df: DataFrame, trace: str, capacity: str, target: int, seed: int) -> DataFrame:
    """Quotas that are as equal as capacities allow and sum to ``target``; what cannot be divided goes by priority.

    The level is found on the histogram of capacities; only that level and the remainder come to
    the driver.
    """
    rows = df.select(F.col(trace).alias("trace"), F.col(capacity).cast("long").alias("capacity"))
    if rows.where("capacity < 0").count():
        raise ValueError("capacities are not negative")
    counts = rows.groupBy("capacity").agg(F.count("*").alias("n"))
    w = Window.orderBy("capacity")
    at = counts.select(
        "capacity",
        F.coalesce(F.sum(F.col("capacity") * F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"),
        F.sum("n").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("left"),
        F.coalesce(F.lag("capacity").over(w), F.lit(0)).alias("floor"),
    )
    # within one step of the histogram the total is below + left * level
    level = F.floor((F.lit(target) - F.col("below")) / F.col("left")).cast("long")
    steps = at.select(F.least("capacity", level).alias("level"), "floor").where("level >= floor")
    top = steps.agg(F.max("level")).first()[0]
    if target <= 0 or top is None or rows.agg(F.sum("capacity")).first()[0] < target:
        raise ValueError("the capacities do not cover a positive target")
    filled = rows.withColumn("quota", F.least(F.col("capacity"), F.lit(top)))
    rest = target - filled.agg(F.sum("quota")).first()[0]
    zero = F.lit(0)
    more = filled.where(F.col("capacity") > F.col("quota")).withColumn("p", priority(F.col("trace"), zero, zero, seed)).orderBy("p", "trace").limit(int(rest))
    extra = more.select("trace", F.lit(1).alias("one"))
    return filled.join(extra, "trace", "left").select("trace", "capacity", (F.col("quota") + F.coalesce("one", F.lit(0))).alias("quota"))


def quota_positions(quotas: DataFrame, seed: int, layer: int = 0, split: int = 0) -> DataFrame:
    """The ``quota`` positions of least priority of each trace of (trace, capacity, quota), as rows."""
    every = quotas.where("quota > 0").withColumn("position", F.explode(F.sequence(F.lit(0).cast("long"), F.col("capacity") - 1)))
    ranked = every.withColumn("p", priority(F.col("trace"), F.col("position"), F.lit(0), seed, layer, split))
    w = Window.partitionBy("trace").orderBy("p", "position")
    return ranked.withColumn("r", F.row_number().over(w)).where("r <= quota").select("trace", "position")


def exact_holdout(sizes: list[int], target: int) -> list[int]:
    """Indices of components, in the given order, whose sizes sum to ``target``; the first way found is kept."""
    best: dict[int, tuple[int, int] | None] = {0: None}
    for i, size in enumerate(sizes):
        for total in sorted(best, reverse=True):
            new = total + size
            if new <= target and new not in best:
                best[new] = (total, i)
        if target in best:
            break
    if target not in best:
        raise ValueError("no choice of whole components has this size")
    chosen, at = [], target
    while best[at] is not None:
        at, i = best[at]
        chosen.append(i)
    return sorted(chosen)


def tail_size(n, fraction: float = 0.2):
    """Members of a tail: at least one."""
    return max(1, math.ceil(n * fraction))
