"""Constraint queries: each returns the rows that violate it."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from tracemill.operators.store import stored


def grid_violations(rows: DataFrame, problem: str, index: str, expected: list[int]) -> DataFrame:
    """(rule, problem, index): expected but missing, not expected, or repeated."""
    seen = rows.groupBy(problem, index).agg(F.count("*").alias("n"))
    kind = dict(rows.dtypes)[index]
    every = rows.select(problem).distinct().withColumn(index, F.explode(F.array(*(F.lit(e).cast(kind) for e in expected))))
    tag = lambda df, rule: df.select(F.lit(rule).alias("rule"), problem, index)
    missing = tag(every.join(seen, [problem, index], "left_anti"), "missing")
    return missing.unionByName(tag(seen.join(every, [problem, index], "left_anti"), "unexpected")).unionByName(tag(seen.where("n > 1"), "duplicate"))


def gaps(rows: DataFrame, group: str, index: str, first: int = 0) -> DataFrame:
    """Groups whose indices are not first, first + 1, ..."""
    s = rows.groupBy(group).agg(F.min(index).alias("least"), F.max(index).alias("largest"), F.countDistinct(index).alias("n"))
    return s.where(~((F.col("least") == first) & (F.col("largest") == F.col("n") + first - 1)))


def rule_violations(rows: DataFrame, key: str, rules: dict) -> DataFrame:
    """(rule, key) of rows for which a rule does not hold; a null counts as not holding."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return rows.select(F.explode(broken).alias("rule"), F.col(key).alias("key"))


def decision_violations(cases: DataFrame, decisions: DataFrame, key: str, decision: str, allowed: list[str]) -> DataFrame:
    """(rule, key): cases without a decision, decisions without a case, repeated and invalid ones."""
    tag = lambda df, rule: df.select(F.lit(rule).alias("rule"), F.col(key).alias("key"))
    out = tag(cases.join(decisions, key, "left_anti"), "missing").unionByName(tag(decisions.join(cases, key, "left_anti"), "unknown"))
    twice = decisions.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return out.unionByName(tag(twice, "duplicate")).unionByName(tag(decisions.where(~F.coalesce(F.col(decision).isin(allowed), F.lit(False))), "invalid"))


def order_violations(left: DataFrame, right: DataFrame, ordinal: str, key: str) -> DataFrame:
    """Ordinals at which two sequences differ or one ends."""
    a, b = left.select(ordinal, F.col(key).alias("left_key")), right.select(ordinal, F.col(key).alias("right_key"))
    return a.join(b, ordinal, "full_outer").where(~F.col("left_key").eqNullSafe(F.col("right_key")))


def region_violations(rows: DataFrame, key: str, regions: str, total: str) -> DataFrame:
    """Rows whose region counts do not sum to their tokens."""
    s = F.aggregate(F.map_values(regions), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.where(~F.coalesce(s == F.col(total), F.lit(False))).select(key, s.alias("regions"), total)


def overlaps(roles: dict[str, DataFrame], key: str) -> DataFrame:
    """(left, right, key) of keys in two roles that should be apart."""
    out = None
    for (a, x), (b, y) in combinations(roles.items(), 2):
        both = x.select(key).intersect(y.select(key)).select(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(key).alias("key"))
        out = both if out is None else out.unionByName(both)
    return out


def unreachable(markers: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Markers (path) that no chain of (parent, path) edges reaches from the roots."""
    reached, links = stored(roots.select("path").distinct()), edges.select("parent", "path").distinct()
    new = reached
    while not new.isEmpty():  # a step for each link of the longest chain
        ahead = links.join(new.withColumnRenamed("path", "parent"), "parent", "left_semi").select("path").distinct()
        new = stored(ahead.join(reached, "path", "left_anti"))
        reached = reached.unionByName(new)
    return markers.join(reached, "path", "left_anti")


def topology_violations(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(key, parent) whose parent is not an earlier node; nodes have key and ordinal."""
    p = nodes.select(F.col("key").alias("parent"), F.col("ordinal").alias("before"))
    return parents.join(nodes, "key").join(p, "parent", "left").where("before is null or before >= ordinal").select("key", "parent")
