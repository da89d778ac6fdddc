"""Lookup joins, paired arms, common support, neighbours, overlays, set checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracemill.operators.blocks import mutual_in_blocks, nearest_in_blocks, packed


def lookup(facts: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join by a key that the table must have once: a missing or repeated key fails the query."""
    unique = table.groupBy(key).agg(F.count("*").alias("__n"), *(F.first(c).alias(c) for c in table.columns if c != key))
    joined = facts.join(unique, key, "left")
    ok = F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("key without one row: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))
    return joined.where(ok).drop("__n")


def lookup_violations(facts: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """(rule, key): keys that the table lacks or repeats."""
    missing = facts.select(key).distinct().join(table, key, "left_anti").select(F.lit("missing").alias("rule"), F.col(key).alias("key"))
    twice = table.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("rule"), F.col(key).alias("key"))
    return missing.unionByName(twice)


def paired(rows: DataFrame, arm: str, left, right, on: list[str], value: str) -> DataFrame:
    """left_value, right_value and effect of two arms on their common keys.  Arms are joined by merging: packed, one looks small enough to be sent through the driver."""
    side = lambda a, name: rows.where(F.col(arm) == a).select(*on, F.col(value).alias(name))
    return side(left, "left_value").join(side(right, "right_value").hint("merge"), on).withColumn("effect", F.col("left_value") - F.col("right_value"))


def support_differences(rows: DataFrame, arm: str, on: list[str]) -> DataFrame:
    """Keys that some arm lacks: (key columns, arm).

    Keys with all arms are told by their number of arms alone; the arms are named only for the others.
    """
    cells = rows.select(*on, arm).distinct()
    number = cells.agg(F.count_distinct(arm).alias("arms"))  # one row
    short = cells.groupBy(*on).agg(F.count(arm).alias("have")).join(number, F.col("have") < F.col("arms")).select(*on)
    return short.join(cells.select(arm).distinct(), F.lit(True)).join(cells, [*on, arm], "left_anti")


def common_support(rows: DataFrame, key: str, method: str, methods: list[str]) -> DataFrame:
    """Every key with its number of methods, those missing, and whether it is in the common support."""
    every = F.array(*map(F.lit, methods))
    have = rows.where(F.col(method).isin(methods)).groupBy(key).agg(F.array_sort(F.collect_set(method)).alias("have"))
    out = rows.select(key).distinct().join(have, key, "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    missing = F.array_sort(F.array_except(every, "have"))
    return out.select(key, F.size("have").alias("methods"), missing.alias("missing_methods"), (F.size("have") == len(methods)).alias("common"))


def nearest(queries: DataFrame, references: DataFrame, ident: str, vector: str, k: int) -> DataFrame:
    """(query_id, reference_id, distance, k): the k nearest references of every query by squared distance, ties by id."""
    return nearest_in_blocks(packed(queries, ident, vector), packed(references, ident, vector), k)


def z_scored(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, over their population deviation (0: left as differences)."""
    s = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    return df.withColumns({c: (F.col(c) - F.lit(s[f"m_{c}"])) / F.lit(s[f"s_{c}"] or 1.0) for c in columns})


def activation_correlations(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs`` (left_id, right_id, ...) with the correlation of their values (id, key, value) over the keys of both, 0 if one is constant."""
    a, b = left.toDF("left_id", "__k", "__x"), right.toDF("right_id", "__k", "__y")
    c = F.covar_pop("__x", "__y") / (F.stddev_pop("__x") * F.stddev_pop("__y"))
    r = pairs.select("left_id", "right_id").join(a, "left_id").join(b, ["right_id", "__k"]).groupBy("left_id", "right_id").agg(
        F.when((F.stddev_pop("__x") > 0) & (F.stddev_pop("__y") > 0), c).otherwise(0.0).alias("correlation")
    )
    return pairs.join(r, ["left_id", "right_id"], "left").withColumn("correlation", F.coalesce("correlation", F.lit(0.0)))


def stable_matches(pairs: DataFrame, left: DataFrame, right: DataFrame, minimum: float) -> DataFrame:
    """The mutual matches whose values correlate by ``minimum`` at least."""
    return activation_correlations(pairs, left, right).where(F.col("correlation") >= minimum)


def mutual_nearest(left: DataFrame, right: DataFrame, ident: str, vector: str, minimum: float) -> DataFrame:
    """(left_id, right_id, cosine): pairs that are each other's best match, ties by id."""
    return mutual_in_blocks(packed(left, ident, vector), packed(right, ident, vector), minimum)


def triangles(ab: DataFrame, ac: DataFrame, bc: DataFrame) -> DataFrame:
    """(a, b, c) for which all three matches agree; each table has two columns."""
    return ab.toDF("a", "b").join(ac.toDF("a", "c"), "a").join(bc.toDF("b", "c"), ["b", "c"]).select("a", "b", "c")


def replaced(original: DataFrame, replacements: DataFrame, key: str, ids: str, capped: str) -> DataFrame:
    """Capped rows take the replacement's ids, which must go on from their own; others stay.  ``prefix_ok`` tells."""
    r = replacements.select(key, F.col(ids).alias("__new"))
    joined = original.join(r, key, "left")
    new = F.col(capped) & F.col("__new").isNotNull()
    kept = F.slice("__new", F.lit(1), F.size(ids)) == F.col(ids)
    return joined.withColumns({"prefix_ok": ~new | kept, ids: F.when(new, F.col("__new")).otherwise(F.col(ids)), "replaced": new}).drop("__new")


def overlay(original: DataFrame, reviewed: DataFrame, on: list[str], grade: str) -> DataFrame:
    """The reviewed grade where all bound columns are equal (nulls too); the old one stays as legacy."""
    r = reviewed.select(*(F.col(c).alias(f"__{c}") for c in on), F.col(grade).alias("__grade")).distinct()
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on))
    joined = original.join(r, same, "left")
    return joined.select(*(c for c in original.columns if c != grade), F.col(grade).alias(f"legacy_{grade}"), F.coalesce("__grade", grade).alias(grade), F.col("__grade").isNotNull().alias("is_reviewed"))


def matched_control(specs: DataFrame, controls: DataFrame, on: list[str], count: str, ident: str) -> DataFrame:
    """For every spec a control of equal ``on``, one of equal count preferred, then the smallest id."""
    c = controls.select(*on, F.col(count).alias("__count"), F.col(ident).alias("control"))
    w = Window.partitionBy(*on, ident).orderBy((F.col("__count") != F.col(count)).cast("int"), "control")
    return specs.join(c, on).withColumn("k", F.row_number().over(w)).where("k = 1").select(*specs.columns, "control")


def parents(rows: DataFrame, candidates: DataFrame, key: str, ident: str) -> DataFrame:
    """How many candidates share a row's key: none, one or ambiguous, and their ids in order."""
    c = candidates.groupBy(key).agg(F.array_sort(F.collect_list(ident)).alias("parents"))
    n = F.coalesce(F.size("parents"), F.lit(0))
    status = F.when(F.col("parents").isNull(), "none").when(n == 1, "one").otherwise("ambiguous")
    return rows.join(c, key, "left").withColumn("status", status)


def wanted_positions(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tokens at the wanted (trace, position)."""
    return tokens.join(wanted.select("trace_id", "position").distinct(), ["trace_id", "position"], "left_semi")


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, key) of keys that only one side has: no row if the sets are equal."""
    only = lambda a, b, side: a.select(key).distinct().join(b, key, "left_anti").select(F.lit(side).alias("side"), F.col(key).alias("key"))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def multiset_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows with their surplus on the left (positive) or right: none if the multisets are equal."""
    columns = left.columns
    every = left.withColumn("__n", F.lit(1)).unionByName(right.withColumn("__n", F.lit(-1)))
    return every.groupBy(*columns).agg(F.sum("__n").alias("surplus")).where("surplus != 0")


def concatenated(parts: list[DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """All rows with their round, and the keys that occur in several rows."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.withColumn("round", F.lit(i)) for i, p in enumerate(parts)))
    return out, out.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
