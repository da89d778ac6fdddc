"""Queries of answer text, overlays, budgets and joins of features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import budget, grading, pairing as pr
from tracemill.plans.catalog import query
from tracemill.plans.fixtures import table, view

TEXT = """ans AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'x #### ' || CAST(o_custkey AS VARCHAR) || '.50' WHEN 1 THEN 'so \\boxed{' || CAST(o_custkey AS VARCHAR) || '}'
WHEN 2 THEN 'Answer: $' || CAST(o_custkey AS VARCHAR) || '.' ELSE 'none' END AS t FROM orders)"""


def _answers(spark, d):
    k, n = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("x #### "), n, F.lit(".50")))
        .when(k % 4 == 1, F.concat(F.lit("so \\boxed{"), n, F.lit("}")))
        .when(k % 4 == 2, F.concat(F.lit("Answer: $"), n, F.lit(".")))
        .otherwise("none")
    )
    return table(spark, d, "orders").select(k.alias("k"), text.alias("t"))


RAW = "CASE k % 4 WHEN 0 THEN regexp_extract(t, '#### (.*)', 1) WHEN 1 THEN regexp_extract(t, 'boxed\\{(.*)\\}', 1) WHEN 2 THEN regexp_extract(t, '\\$(.*)\\.', 1) END"


@query("sx1_final_answer", f"WITH {TEXT} SELECT k, {RAW} AS answer FROM ans")
def _sx1(spark, d):
    return _answers(spark, d).select("k", grading.final_answer(F.col("t")).alias("answer"))


@query("sx2_normal_answer", f"WITH {TEXT} SELECT k, regexp_replace({RAW}, '\\.50$', '.5') AS answer FROM ans")
def _sx2(spark, d):
    return _answers(spark, d).select("k", grading.normal_answer(grading.final_answer(F.col("t"))).alias("answer"))


@query("sx3_verified", f"WITH {TEXT} SELECT k, k % 4 IN (1, 2) AND regexp_extract(t, '[0-9]+', 0) = '7' OR k % 4 = 3 AND false AS ok FROM ans")
def _sx3(spark, d):
    return _answers(spark, d).select("k", grading.verified(grading.final_answer(F.col("t")), F.lit("7.0")).alias("ok"))


@query("tg5_boxed_correct", f"WITH {TEXT} SELECT k, k % 4 = 1 AND regexp_extract(t, '[0-9]+', 0) = '7' AS ok FROM ans")
def _tg5(spark, d):
    return _answers(spark, d).select("k", grading.boxed_correct(F.col("t"), F.lit("7")).alias("ok"))


@query(
    "j12_overlay",
    """SELECT o_orderkey, o_orderstatus AS legacy_o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 'R' ELSE o_orderstatus END AS o_orderstatus, o_orderkey % 3 = 0 AS is_reviewed FROM orders""",
)
def _j12(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return pr.overlay(o, o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("R")), ["o_orderkey"], "o_orderstatus")


@query(
    "j10_triangles_all",
    "WITH e AS (SELECT c_nationkey AS n, c_custkey // 75 AS g, c_custkey AS k FROM customer) SELECT x.k AS a, y.k AS b, z.k AS c FROM e x JOIN e y ON x.n = y.n AND x.g = y.g AND x.k % 3 = 0 AND y.k % 3 = 1 JOIN e z ON z.n = x.n AND z.g = x.g AND z.k % 3 = 2",
)
def _j10_all(spark, d):
    """All customers: a match is one of the same nation and of the same 75 keys, so that the result grows with the table."""
    return _triangles(table(spark, d, "customer").select(F.col("c_nationkey").alias("n"), F.expr("c_custkey div 75").alias("g"), F.col("c_custkey").alias("k")), "n", "g")


def _triangles(e, *by):
    side = lambda m, name: e.where(F.col("k") % 3 == m).withColumnRenamed("k", name)
    pair = lambda x, y: side(x, "x").join(side(y, "y"), list(by)).select("x", "y")
    return pr.triangles(pair(0, 1), pair(0, 2), pair(1, 2))


@query("j16_wanted_positions", "SELECT trace_id, position, token_id FROM feature_events WHERE position % 5 = 0")
def _j16(spark, d):
    e = view(spark, d, "feature_events").select("trace_id", "position", "token_id")
    return pr.wanted_positions(e, e.where("position % 5 = 0"))


@query(
    "bs8_cap_view",
    "SELECT trace_id, CAST(least(coalesce(min(position) FILTER (WHERE token_id = 6), 1000000), 20, count(*)) AS INT) AS tokens, count(*) >= 20 AND coalesce(min(position) FILTER (WHERE token_id = 6), 1000000) >= 20 AS hit FROM feature_events GROUP BY 1",
)
def _bs8(spark, d):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("position", "token_id"))), lambda x: x.token_id.cast("int"))
    t = view(spark, d, "feature_events").groupBy("trace_id").agg(ids.alias("ids"))
    return t.select("trace_id", budget.cap_view(F.col("ids"), 20, 6).alias("v")).select("trace_id", "v.tokens", "v.hit")


@query("bs1_schedules")
def _bs1(spark, d):
    from tracemill.operators.select import quantile_bands

    return budget.schedules(quantile_bands(view(spark, d, "traces")).select("problem_id", "trace_id", "solution_token_count", "length_rank"), 7)


@query("bs7_run_matrix", "SELECT a, b FROM (VALUES ('x'), ('y')) t(a), (VALUES ('1'), ('2'), ('3')) u(b)")
def _bs7(spark, d):
    return budget.run_matrix(spark, {"a": ["x", "y"], "b": [1, 2, 3]})
