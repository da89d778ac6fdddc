"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracemill.operators.store import discard, stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Edges (u, v), u > v.  Large: larger neighbours of u go to the least of u and its neighbours; small: the smaller ones and u do."""
    if small:
        around = edges
    else:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    near = around.join(least, "u")
    if small:
        made = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        made = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return made.where("u != v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): each node of an edge with the smallest node that it reaches.

    ``edges`` has two columns of one ordered type; self-loops, repeats and either direction are
    fine, edges with a null end are left out.  Every round is written to the shared folder, and
    only two aggregates of the edges (their number and a hash sum) come to the driver.  Both
    stars keep the number of edges, so no step grows, and a hub is combined before its shuffle.
    """
    a, b = edges.columns
    now = stored(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    seen = mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        old, now = now, stored(_star(_star(now, small=False), small=True))
        discard(old)
        if (new := mark(now)) == seen:
            break
        seen = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
