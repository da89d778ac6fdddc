"""Running extremes over ranks of families of any size, in two levels.

The rows of all families are range-partitioned by (family, value), so that a large family fills many ranges and ties
of one value as many as they need.  Each range counts its rows and takes its extreme; those few numbers, summed
and combined over the ranges before, are all that a range needs to know of the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracemill.operators.store import stored


def ranked_ranges(df: DataFrame, value: str, families: tuple[str, ...] | list[str]) -> DataFrame:
    """``df`` with ``__family``, ``__range``, ``__rank`` (from 1, by value, ties in any order) and ``__size`` of its family.

    The ranges are written once, so that ranks and all that is made of them are of one order.
    """
    family = F.to_json(F.struct(*families), {"ignoreNullFields": "false"}) if families else F.lit("")
    marked = df.withColumns({"__family": family, "__tie": F.monotonically_increasing_id()})
    order = ["__family", value, "__tie"]
    ranged = stored(marked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()))
    counts = ranged.groupBy("__family", "__range").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy("__family").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__family", "__range", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"), F.sum("__n").over(Window.partitionBy("__family")).alias("__size"))
    inside = F.row_number().over(Window.partitionBy("__family", "__range").orderBy(value, "__tie"))
    return ranged.withColumn("__rank", inside).join(offsets, ["__family", "__range"]).withColumn("__rank", F.col("__rank") + F.col("__ahead")).drop("__tie", "__ahead")


def running_extreme(ranked: DataFrame, step: Column, greatest: bool, name: str) -> DataFrame:
    """``ranked`` rows with the greatest ``step`` of their family up to their rank, or the least one from their rank on."""
    pick, both = (F.max, F.greatest) if greatest else (F.min, F.least)
    rows = ranked.withColumn("__step", step)
    turn = (lambda c: F.asc(c)) if greatest else (lambda c: F.desc(c))
    before = Window.partitionBy("__family").orderBy(turn("__range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("__family", "__range").agg(pick("__step").alias("__e")).select("__family", "__range", pick("__e").over(before).alias("__carry"))
    own = pick("__step").over(Window.partitionBy("__family", "__range").orderBy(turn("__rank")).rowsBetween(Window.unboundedPreceding, 0))
    done = rows.withColumn("__own", own).join(carried, ["__family", "__range"])
    return done.withColumn(name, both("__own", "__carry")).drop("__step", "__own", "__carry")  # a null carry is passed over


def adjusted(df: DataFrame, p: str, families: tuple[str, ...], name: str, step: Callable[[Column, Column, Column], Column], greatest: bool) -> DataFrame:
    """``df`` with an adjusted p-value: the running extreme of ``step(size, rank, p)``, at most 1.

    Null and NaN p-values do not count in their family and get 1; equal ones get equal values.
    """
    counts = F.col(p).isNotNull() & ~F.isnan(p)
    ranked = ranked_ranges(df.where(counts), p, families)
    run = running_extreme(ranked, step(F.col("__size"), F.col("__rank"), F.col(p)), greatest, name)
    valid = run.select(*df.columns, F.least(F.lit(1.0), F.col(name)).alias(name))
    return valid.unionByName(df.where(~counts).select(*df.columns, F.lit(1.0).alias(name)))
