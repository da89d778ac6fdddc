"""Queries over predictions, events, vectors and grids, with SQL for an independent engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import aggregate as ag, audit as au, pairing as pr, sources as src, stats as st
from tracemill.plans.catalog import query, r6
from tracemill.plans.fixtures import table, view

# Summaries


@query(
    "ag1_prediction_summary",
    "SELECT cell, count(*) AS n, CAST(sum(CAST(is_correct AS INT)) AS BIGINT) AS correct, round(avg(CAST(is_correct AS INT)), 6) AS accuracy, round(avg(output_token_count), 6) AS mean_tokens FROM predictions GROUP BY 1",
)
def _ag1(spark, d):
    return r6(ag.prediction_summary(view(spark, d, "predictions"), "cell"))


@query(
    "ag2_arm_summary",
    """SELECT cell, count(*) AS seeds, round(avg(a), 6) AS accuracy, round(stddev_samp(a), 6) AS accuracy_sd, round(avg(t), 6) AS mean_tokens
FROM (SELECT cell, seed, avg(CAST(is_correct AS INT)) AS a, avg(output_token_count) AS t FROM predictions GROUP BY 1, 2) GROUP BY 1""",
)
def _ag2(spark, d):
    return r6(ag.arm_summary(view(spark, d, "predictions"), "cell", "seed"))


@query(
    "ag3_condition_summary",
    """SELECT cell, count(*) AS n, round(1e6 * sum(CAST(is_correct AS INT)) / sum(output_token_count), 6) AS correct_per_million,
round(coalesce(avg(output_token_count) FILTER (WHERE is_correct), 'Infinity'::DOUBLE), 6) AS tokens_when_correct, round(avg(output_token_count / 50), 6) AS mean_ratio, round(max(output_token_count / 50), 6) AS max_ratio FROM predictions GROUP BY 1""",
)
def _ag3(spark, d):
    return r6(ag.condition_summary(view(spark, d, "predictions"), "cell", "is_correct", "output_token_count", F.col("output_token_count") / 50))


@query(
    "ag4_cap_summary",
    """SELECT cell, seed, count(*) AS n, round(avg(CAST(is_correct AS INT)), 6) AS accuracy, round(avg(CAST(output_token_count >= 50 AS INT)), 6) AS cap_rate, round(avg(output_token_count), 6) AS mean_tokens FROM predictions GROUP BY 1, 2""",
)
def _ag4(spark, d):
    p = view(spark, d, "predictions").withColumn("hit", F.col("output_token_count") >= 50)
    return r6(ag.cap_summary(p, "cell", "seed", "is_correct", "output_token_count", "hit"))


@query("ag5_constant", "SELECT cell, min(seed) AS v, min(seed) = max(seed) AS constant FROM predictions GROUP BY 1")
def _ag5(spark, d):
    p = view(spark, d, "predictions")
    return ag.constant_attached(p.select("cell").distinct(), p.select("cell", F.col("seed").alias("v")), "cell", "v")


@query("ag7_counters", "SELECT 'lang' AS counter, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2")
def _ag7(spark, d):
    return ag.counters(table(spark, d, "documents"), "lang", "source")


SUMS = """sums AS (SELECT trace_id, feature_id, sum(activation) AS mass, count(*) AS n, coalesce(sum(activation) FILTER (WHERE position < 8), 0) AS early FROM feature_events GROUP BY 1, 2)"""


@query(
    "ag8_feature_sums",
    f"WITH {SUMS} SELECT trace_id, feature_id, round(mass, 6) AS mass, n AS count, round(early, 6) AS early_mass, round(mass / length, 6) AS mean_activation, round(n / length, 6) AS frequency, round(early / least(length, 8), 6) AS early_mean FROM sums JOIN lengths USING (trace_id)",
)
def _ag8(spark, d):
    return r6(ag.feature_sums(view(spark, d, "feature_events"), view(spark, d, "lengths"), 8))


@query("ag9_masses", "SELECT feature_id, token_id, count(*) AS token_mass, round(sum(activation), 6) AS activation_mass FROM feature_events GROUP BY 1, 2")
def _ag9(spark, d):
    return r6(ag.masses(view(spark, d, "feature_events"), "feature_id", "token_id"))


@query(
    "ag10_bin_means",
    """WITH e AS (SELECT feature_id, least(4, CAST(floor(position * 5 / length) AS BIGINT)) AS bin, sum(activation) AS mass FROM feature_events JOIN lengths USING (trace_id) GROUP BY 1, 2),
t AS (SELECT least(4, CAST(floor(p * 5 / length) AS BIGINT)) AS bin, count(*) AS tokens FROM (SELECT length, unnest(generate_series(0, length - 1)) AS p FROM lengths) GROUP BY 1),
g AS (SELECT feature_id, CAST(b AS BIGINT) AS bin FROM (SELECT DISTINCT feature_id FROM feature_events), (SELECT unnest(generate_series(0, 4)) AS b))
SELECT feature_id, bin, coalesce(tokens, 0) AS tokens, round(coalesce(mass / greatest(tokens, 1), 0), 6) AS mean FROM g LEFT JOIN t USING (bin) LEFT JOIN e USING (feature_id, bin)""",
)
def _ag10(spark, d):
    return r6(ag.bin_means(view(spark, d, "feature_events"), view(spark, d, "lengths"), 5))


@query(
    "ag12_region_shares",
    """WITH r AS (SELECT feature_id, coalesce(sum(activation) FILTER (WHERE token_id < 3), 0) AS body, coalesce(sum(activation) FILTER (WHERE token_id >= 3), 0) AS suffix FROM feature_events GROUP BY 1)
SELECT feature_id, round(body, 6) AS body, round(suffix, 6) AS suffix, round(body / (body + suffix), 6) AS body_share, round(suffix / (body + suffix), 6) AS suffix_share FROM r""",
)
def _ag12(spark, d):
    e = view(spark, d, "feature_events").withColumn("region", F.when(F.col("token_id") < 3, "body").otherwise("suffix"))
    return r6(ag.region_shares(e, "region", ["body", "suffix"]))


@query(
    "ag13_association",
    "SELECT feature_id, token_id, t.n, round(mass / t.n, 6) AS mean FROM (SELECT feature_id, token_id, sum(activation) AS mass FROM feature_events GROUP BY 1, 2) JOIN (SELECT token_id, count(*) AS n FROM feature_events GROUP BY 1 HAVING count(*) >= 10) t USING (token_id)",
)
def _ag13(spark, d):
    e = view(spark, d, "feature_events")
    return r6(ag.lexical_association(e, e, 10))


@query(
    "ag14_batch_costs",
    "SELECT cell, count(*) AS batches, CAST(sum(s) AS BIGINT) AS seconds, round(sum(s) / sum(r), 6) AS seconds_per_row FROM (SELECT cell, seed, max(output_token_count) AS s, count(*) AS r FROM predictions GROUP BY 1, 2) GROUP BY 1",
)
def _ag14(spark, d):
    return r6(ag.batch_costs(view(spark, d, "predictions"), "seed", "cell", "output_token_count"))


@query("ag15_normalisation")
def _ag15(spark, d):
    return ag.normalisation(table(spark, d, "embeddings"), "embedding")


@query(
    "ag11_reconstruction",
    """WITH x AS (SELECT unnest(embedding)::DOUBLE AS a, generate_subscripts(embedding, 1) AS d FROM embeddings), s AS (SELECT d, sum((a - round(a, 1)) * (a - round(a, 1))) AS e, var_pop(a) * count(*) AS v, count(*) AS n FROM x GROUP BY 1)
SELECT round(sum(e) / sum(n), 6) AS mse, round(1 - sum(e) / sum(v), 6) AS explained FROM s""",
)
def _ag11(spark, d):
    e = table(spark, d, "embeddings").withColumn("rebuilt", F.transform("embedding", lambda v: F.round(v.cast("double"), 1)))
    return r6(ag.reconstruction(e, "embedding", "rebuilt"))


@query(
    "ag16_contribution",
    "SELECT length > 60 AS long, count(*) AS traces, round(min(f), 6) AS least, round(max(f), 6) AS largest, round(avg(f), 6) AS mean FROM (SELECT length, coalesce(n, 0) / length AS f FROM lengths LEFT JOIN (SELECT trace_id, count(*) AS n FROM feature_events WHERE position % 3 = 0 GROUP BY 1) USING (trace_id)) GROUP BY 1",
)
def _ag16(spark, d):
    n = view(spark, d, "lengths").withColumn("long", F.col("length") > 60)
    return r6(ag.contribution(n, view(spark, d, "feature_events").where("position % 3 = 0"), "long"))


@query(
    "ag19_rank_surprisal",
    "SELECT vec_id, round(list_avg([least(abs(x) * 10, 5) for x in embedding::DOUBLE[]]) / greatest(list_avg([abs(x) for x in embedding::DOUBLE[]]), 1e-12), 6) AS rsr FROM embeddings",
)
def _ag19(spark, d):
    v = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return r6(table(spark, d, "embeddings").select("vec_id", ag.rank_surprisal(F.transform(v, lambda x: -x), F.transform(v, lambda x: x * 10), 5.0).alias("rsr")))


@query(
    "ag21_group_gradient",
    "SELECT cell, seed, problem_id, round(l / sum(l) OVER w * (2 * r - sum(l * r) OVER w / sum(l) OVER w), 6) AS g_hat FROM (SELECT *, output_token_count::DOUBLE AS l, (problem_id % 10)::DOUBLE AS r FROM predictions) WINDOW w AS (PARTITION BY cell, seed)",
)
def _ag21(spark, d):
    p = view(spark, d, "predictions").withColumns({"l": F.col("output_token_count").cast("double"), "r": (F.col("problem_id") % 10).cast("double"), "g": F.concat_ws("/", "cell", "seed")})
    return r6(ag.group_gradient(p, "g", "l", "r").select("cell", "seed", "problem_id", "g_hat"))


@query(
    "ag22_weighted_loss",
    "SELECT round(sum(lw) / sum(w), 6) AS token_mean, round(avg(lw / w), 6) AS sequence_mean FROM (SELECT trace_id, sum(activation * token_id) AS lw, sum(token_id) AS w FROM feature_events GROUP BY 1) WHERE w > 0",
)
def _ag22(spark, d):
    return r6(ag.weighted_loss(view(spark, d, "feature_events"), "trace_id", "activation", "token_id"))


# Pairing

TWO = "two AS (SELECT x.seed, x.problem_id, x.output_token_count AS left_value, y.output_token_count AS right_value FROM predictions x JOIN predictions y USING (seed, problem_id) WHERE x.cell = 'AF' AND y.cell = 'RF')"


@query("j3_paired", f"WITH {TWO} SELECT *, left_value - right_value AS effect FROM two")
def _j3(spark, d):
    return pr.paired(view(spark, d, "predictions"), "cell", "AF", "RF", ["seed", "problem_id"], "output_token_count")


@query("j6_support_differences", "SELECT k.problem_id, c.cell FROM (SELECT DISTINCT problem_id FROM predictions) k, (SELECT DISTINCT cell FROM predictions) c WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.problem_id = k.problem_id AND p.cell = c.cell)")
def _j6(spark, d):
    return pr.support_differences(view(spark, d, "predictions"), "cell", ["problem_id"])


@query(
    "j5_common_support",
    """WITH h AS (SELECT problem_id, list_sort(list(DISTINCT condition)) AS have FROM traces WHERE is_correct GROUP BY 1)
SELECT problem_id, CAST(len(coalesce(have, [])) AS INT) AS methods, list_filter(['de', 'en', 'es', 'fr'], lambda x: NOT list_contains(coalesce(have, []), x)) AS missing_methods, len(coalesce(have, [])) = 4 AS common
FROM (SELECT DISTINCT problem_id FROM traces WHERE is_correct) LEFT JOIN h USING (problem_id)""",
)
def _j5(spark, d):
    return pr.common_support(view(spark, d, "traces").where("is_correct"), "problem_id", "condition", ["de", "en", "es", "fr"])


@query("j1_lookup", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _j1(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return pr.lookup(o, table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").select("o_orderkey", "c_name")


@query("j1_violations", "SELECT 'missing' AS rule, l_orderkey AS key FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 > 0) GROUP BY 2")
def _j1v(spark, d):
    n = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return pr.lookup_violations(n, table(spark, d, "orders").where("o_orderkey % 50 > 0"), "o_orderkey")


@query(
    "j8_nearest",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 100 = 0),
d AS (SELECT q.vec_id AS query_id, v.vec_id AS reference_id, list_sum([x * x for x in list_transform(list_zip(q.e, v.e), lambda p: p[1] - p[2])]) AS distance FROM q, v)
SELECT query_id, reference_id, round(distance, 6) AS distance, k FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, reference_id) AS k FROM d) WHERE k <= 8""",
)
def _j8(spark, d):
    e = table(spark, d, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    return r6(pr.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "e", 8))


@query(
    "j9_mutual_nearest",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT l.vec_id AS left_id, r.vec_id AS right_id, list_cosine_similarity(l.e, r.e) AS c FROM v l JOIN v r ON l.vec_id % 2 = 0 AND r.vec_id % 2 = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY c DESC, right_id) AS x, row_number() OVER (PARTITION BY right_id ORDER BY c DESC, left_id) AS y FROM s)
SELECT left_id, right_id, round(c, 6) AS cosine FROM b WHERE x = 1 AND y = 1 AND c >= 0.2""",
)
def _j9(spark, d):
    e = table(spark, d, "embeddings")
    return r6(pr.mutual_nearest(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "vec_id", "embedding", 0.2))


@query(
    "j9_stable_matches",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT l.vec_id AS left_id, r.vec_id AS right_id, l.e AS x, r.e AS y, list_cosine_similarity(l.e, r.e) AS c FROM v l JOIN v r ON l.vec_id % 2 = 0 AND r.vec_id % 2 = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY c DESC, right_id) AS p, row_number() OVER (PARTITION BY right_id ORDER BY c DESC, left_id) AS q FROM s),
k AS (SELECT left_id, right_id, c, corr(i, j) AS r FROM (SELECT left_id, right_id, c, unnest(x) AS i, unnest(y) AS j FROM b WHERE p = 1 AND q = 1 AND c >= 0.2) GROUP BY ALL)
SELECT left_id, right_id, round(c, 6) AS cosine, round(r, 6) AS correlation FROM k WHERE r >= 0.3""",
)
def _j9_stable(spark, d):
    """Mutual matches whose entries correlate."""
    e = table(spark, d, "embeddings")
    left, right = e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1")
    values = lambda t: t.select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")))
    return r6(pr.stable_matches(pr.mutual_nearest(left, right, "vec_id", "embedding", 0.2), values(left), values(right), 0.3))


@query(
    "j14_parents",
    "SELECT doc_id, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'one' ELSE 'ambiguous' END AS status FROM documents LEFT JOIN (SELECT text, count(DISTINCT doc_id) AS n FROM documents WHERE doc_id % 3 = 0 GROUP BY 1) USING (text)",
)
def _j14(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text")
    return pr.parents(t, t.where("doc_id % 3 = 0").select("text", F.col("doc_id").alias("i")), "text", "i").select("doc_id", "status")


@query("so3_set_differences", "SELECT 'left' AS side, x AS key FROM (SELECT c_custkey AS x FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'right', x FROM (SELECT o_custkey AS x FROM orders EXCEPT SELECT c_custkey FROM customer)")
def _so3(spark, d):
    return pr.set_differences(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("so5_multiset_differences", "SELECT cell, CAST(sum(CASE WHEN seed < 4 THEN 1 ELSE -1 END) AS BIGINT) AS surplus FROM predictions GROUP BY 1 HAVING sum(CASE WHEN seed < 4 THEN 1 ELSE -1 END) <> 0")
def _so5(spark, d):
    p = view(spark, d, "predictions")
    return pr.multiset_differences(p.where("seed < 4").select("cell"), p.where("seed >= 4").select("cell"))


# Filters, sources, audits


@query(
    "io12_conversation_pairs",
    "SELECT conv_id, question, answer FROM (SELECT conv_id, max(text) FILTER (WHERE r = 1) AS question, max(text) FILTER (WHERE r = 2) AS answer, count(*) AS n, bool_and((r = 1 AND role = 'user') OR (r = 2 AND role = 'assistant')) AS ok FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY 1) WHERE n = 2 AND ok",
)
def _io12(spark, d):
    return src.conversation_pairs(table(spark, d, "conversations"))


@query(
    "pf2_reference_screen",
    r"""SELECT doc_id, list_filter([CASE WHEN trim(text) = '' THEN 'missing_question' END, CASE WHEN regexp_matches(text, '\b(?:prove|proof|show\s+that|demonstrate\s+that)\b', 'i') THEN 'proof_wording_review' END,
CASE WHEN regexp_matches(text, '\b(?:diagram|figure|image|illustration)\b|\[asy\]|<img|!\[', 'i') THEN 'visual_dependency_review' END, CASE WHEN regexp_matches(text, '[\x{3400}-\x{9fff}]') THEN 'cjk_text_review' END], lambda x: x IS NOT NULL) AS flags FROM documents""",
)
def _pf2(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", src.screen_flags(F.col("text")).alias("flags"))


@query(
    "pf4_failed_filters",
    "SELECT cell, seed, problem_id, list_filter([CASE WHEN output_token_count < 30 THEN 'short' END, CASE WHEN NOT is_correct THEN 'wrong' END], lambda x: x IS NOT NULL) AS failed_filters FROM predictions",
)
def _pf4(spark, d):
    return src.failed_filters(view(spark, d, "predictions"), {"short": F.col("output_token_count") < 30, "wrong": ~F.col("is_correct")}).select("cell", "seed", "problem_id", "failed_filters")


@query(
    "au1_grid_violations",
    """WITH o AS (SELECT problem_id, candidate_index, count(*) AS n FROM grid GROUP BY 1, 2), e AS (SELECT p.problem_id, k.candidate_index FROM (SELECT DISTINCT problem_id FROM grid) p, (SELECT DISTINCT candidate_index FROM grid WHERE candidate_index <= 3) k)
SELECT 'missing' AS rule, problem_id, candidate_index FROM (SELECT * FROM e EXCEPT SELECT problem_id, candidate_index FROM o) UNION ALL SELECT 'unexpected', problem_id, candidate_index FROM (SELECT problem_id, candidate_index FROM o EXCEPT SELECT * FROM e)
UNION ALL SELECT 'duplicate', problem_id, candidate_index FROM o WHERE n > 1""",
)
def _au1(spark, d):
    return au.grid_violations(view(spark, d, "grid"), "problem_id", "candidate_index", [1, 2, 3])


@query(
    "au2_contiguity",
    "SELECT problem_id, min(candidate_index) AS least, max(candidate_index) AS largest, count(DISTINCT candidate_index) AS n FROM grid GROUP BY 1 HAVING NOT (min(candidate_index) = 1 AND max(candidate_index) = count(DISTINCT candidate_index))",
)
def _au2(spark, d):
    return au.gaps(view(spark, d, "grid"), "problem_id", "candidate_index", 1)


@query("au10_role_overlaps", "SELECT 'a' AS left, 'b' AS right, x AS key FROM (SELECT o_custkey AS x FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1)")
def _au10(spark, d):
    o = table(spark, d, "orders").withColumn("k", F.col("o_custkey"))
    return au.overlaps({"a": o.where("o_orderkey % 2 = 0"), "b": o.where("o_orderkey % 2 = 1")}, "k")


# Statistics

PV = "pv AS (SELECT feature_id, token_id, (count(*) % 97) / 97.0::DOUBLE AS p FROM feature_events GROUP BY 1, 2)"


def _pv(spark, d):
    return view(spark, d, "feature_events").groupBy("feature_id", "token_id").agg(((F.count("*") % 97) / 97.0).alias("p"))


@query(
    "st6_holm",
    f"""WITH {PV}, r AS (SELECT *, count(*) OVER (PARTITION BY feature_id) AS m, row_number() OVER (PARTITION BY feature_id ORDER BY p) AS r FROM pv)
SELECT feature_id, token_id, round(max(least(1, (m - r + 1) * p)) OVER (PARTITION BY feature_id ORDER BY r), 6) AS p_holm FROM r""",
)
def _st6(spark, d):
    return r6(st.holm(_pv(spark, d), "p", "feature_id").groupBy("feature_id", "token_id").agg(F.max("p_holm").alias("p_holm")))


@query(
    "st8_benjamini_hochberg",
    f"""WITH {PV}, r AS (SELECT *, count(*) OVER (PARTITION BY feature_id) AS m, row_number() OVER (PARTITION BY feature_id ORDER BY p) AS r FROM pv)
SELECT feature_id, token_id, round(least(1, min(m * p / r) OVER (PARTITION BY feature_id ORDER BY r DESC)), 6) AS q_value FROM r""",
)
def _st8(spark, d):
    return r6(st.benjamini_hochberg(_pv(spark, d), "p", "feature_id").select("feature_id", "token_id", "q_value"))


@query(
    "st10_spearman",
    """WITH g AS (SELECT cell || '/' || seed AS g, output_token_count AS x, problem_id % 17 AS y FROM predictions),
r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry FROM g)
SELECT g, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1 HAVING count(*) >= 3 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0""",
)
def _st10(spark, d):
    p = view(spark, d, "predictions").select(F.concat_ws("/", "cell", "seed").alias("g"), F.col("output_token_count").alias("x"), (F.col("problem_id") % 17).alias("y"))
    return r6(st.spearman(p, "g", "x", "y"))


@query("st18_seed_groups", "SELECT cell, count(*) AS n, round(avg(a), 6) AS mean, round(stddev_samp(a), 6) AS sd, round(avg(a) - 4.3026527299 * stddev_samp(a) / sqrt(count(*)), 6) AS low, round(avg(a) + 4.3026527299 * stddev_samp(a) / sqrt(count(*)), 6) AS high FROM (SELECT cell, seed % 3 AS g, avg(output_token_count) AS a FROM predictions GROUP BY 1, 2) GROUP BY 1")
def _st18_groups(spark, d):
    """All seeds, in three groups: as many as the interval's critical value is for."""
    p = view(spark, d, "predictions").groupBy("cell", (F.col("seed") % 3).alias("g")).agg(F.avg("output_token_count").alias("effect"))
    return r6(st.seed_interval(p, "cell"))


def _effects(spark, d):
    p = view(spark, d, "predictions")
    return pr.paired(p, "cell", "AF", "RF", ["seed", "problem_id"], "output_token_count").withColumn("arm", F.lit("AF-RF"))


def crossed_sql(cells: str, samples: int, interpolated: bool = False) -> str:
    """Crossed resamples of ``cells`` (g, seed, problem, x): draws (g, draw, mean) and ends (g, low, high, p), from the same digests."""
    low, high = max(0, int(0.025 * samples) - 1), min(samples - 1, int(0.975 * samples))
    ends = "quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high" if interpolated else f"max(mean) FILTER (k = {low}) AS low, max(mean) FILTER (k = {high}) AS high"
    side = lambda n, c: f"""{n} AS (SELECT g, {c}, row_number() OVER (PARTITION BY g ORDER BY {c}) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM (SELECT DISTINCT g, {c} FROM cells)),
{n}x AS (SELECT g, draw, CAST('0x' || substr(sha256('7:{n}:' || draw || ':' || i), 1, 15) AS BIGINT) % n AS i, count(*) AS times FROM (SELECT g, i, n, unnest(generate_series(0, {samples - 1})) AS draw FROM {n}) GROUP BY ALL)"""  # noqa: E731
    return f"""cells AS ({cells}), {side("p", "problem")}, {side("s", "seed")},
draws AS (SELECT cells.g AS g, px.draw AS draw, sum(x * px.times * sx.times) / (any_value(p.n) * any_value(s.n)) AS mean FROM cells JOIN p USING (g, problem) JOIN s USING (g, seed) JOIN px ON px.g = cells.g AND px.i = p.i JOIN sx ON sx.g = cells.g AND sx.i = s.i AND sx.draw = px.draw GROUP BY ALL),
ends AS (SELECT g, {ends}, least(1.0, 2 * least(avg((mean <= 0)::INT), avg((mean >= 0)::INT))) AS p FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY mean) - 1 AS k FROM draws) GROUP BY g),
whole AS (SELECT g, avg(x) AS estimate, count(DISTINCT problem) AS problems, count(DISTINCT seed) AS seeds FROM cells GROUP BY g)"""


EFFECTS = "SELECT 'AF-RF' AS g, x.seed, x.problem_id AS problem, x.output_token_count - y.output_token_count AS x FROM predictions x JOIN predictions y ON x.cell = 'AF' AND y.cell = 'RF' AND x.seed = y.seed AND x.problem_id = y.problem_id"


@query("st1_crossed_bootstrap", f"WITH {crossed_sql(EFFECTS, 300)} SELECT g AS arm, round(estimate, 6) AS estimate, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p, problems, seeds FROM whole JOIN ends USING (g)")
def _st1(spark, d):
    return r6(st.crossed_bootstrap(_effects(spark, d), ["arm"], "seed", "problem_id", "effect", 300, 7))


@query("st3_interpolated", f"WITH {crossed_sql(EFFECTS, 120, True)} SELECT g AS arm, round(low, 6) AS low, round(high, 6) AS high FROM ends")
def _st3(spark, d):
    return r6(st.crossed_bootstrap(_effects(spark, d), ["arm"], "seed", "problem_id", "effect", 120, 7, interpolated=True).select("arm", "low", "high"))


# One family of all line items: many ties, and p-values that are missing or no numbers
FAMILY = """f AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 50 = 7 THEN 'NaN'::DOUBLE WHEN l_suppkey % 50 = 8 THEN NULL ELSE ((l_partkey * 31 + l_suppkey * 7) % 5003 + 1) / 7.3e7 END AS p FROM lineitem),
r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p) AS r FROM f WHERE p IS NOT NULL AND NOT isnan(p))"""


def _family(spark, d):
    odd = F.col("l_suppkey") % 50
    p = F.when(odd == 7, F.lit(float("nan"))).when(odd != 8, ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 7) % 5003 + 1) / 7.3e7)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", p.alias("p"))


@query(
    "st7_holm_of_all",
    f"""WITH {FAMILY} SELECT l_orderkey, l_linenumber, round(least(1.0, max((m - r + 1) * p) OVER (ORDER BY r)), 6) AS p_holm FROM r
UNION ALL SELECT l_orderkey, l_linenumber, 1.0 FROM f WHERE p IS NULL OR isnan(p)""",
)
def _st7(spark, d):
    return r6(st.holm(_family(spark, d), "p").select("l_orderkey", "l_linenumber", "p_holm"))


@query(
    "st8_rates_of_all",
    f"""WITH {FAMILY} SELECT l_orderkey, l_linenumber, round(least(1.0, min(m * p / r) OVER (ORDER BY r DESC)), 6) AS q_value FROM r
UNION ALL SELECT l_orderkey, l_linenumber, 1.0 FROM f WHERE p IS NULL OR isnan(p)""",
)
def _st8_all(spark, d):
    return r6(st.benjamini_hochberg(_family(spark, d), "p").select("l_orderkey", "l_linenumber", "q_value"))


@query(
    "st2_hash_bootstrap",
    f"""WITH {TWO}, e AS (SELECT seed, left_value - right_value AS x, row_number() OVER (PARTITION BY seed ORDER BY problem_id) - 1 AS i, count(*) OVER (PARTITION BY seed) AS n FROM two),
a AS (SELECT seed, n, i, unnest(generate_series(0, 19)) AS draw FROM e), p AS (SELECT seed, draw, CAST('0x' || substr(sha256('7:' || draw || ':' || i), 1, 15) AS BIGINT) % n AS i FROM a)
SELECT seed, draw, round(avg(x), 6) AS mean FROM p JOIN e USING (seed, i) GROUP BY 1, 2""",
)
def _st2(spark, d):
    return r6(st.hash_bootstrap(_effects(spark, d), ["seed"], "problem_id", "effect", 20, 7))


MCNEMAR = "CASE WHEN w + l = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(generate_series(0, least(w, l)), lambda i: exp(lgamma(w + l + 1) - lgamma(i + 1) - lgamma(w + l - i + 1) - (w + l) * ln(2))))) END"


@query(
    "st5_mcnemar",
    f"""WITH c AS (SELECT x.seed, count(*) FILTER (WHERE x.is_correct AND NOT y.is_correct) AS w, count(*) FILTER (WHERE NOT x.is_correct AND y.is_correct) AS l FROM predictions x JOIN predictions y ON x.cell = 'AF' AND y.cell = 'RF' AND x.seed = y.seed AND x.problem_id = y.problem_id GROUP BY 1)
SELECT seed, w AS wins, l AS losses, round({MCNEMAR}, 6) AS p FROM c""",
)
def _st5(spark, d):
    p = pr.paired(view(spark, d, "predictions").withColumn("v", F.col("is_correct").cast("int")), "cell", "AF", "RF", ["seed", "problem_id"], "v")
    return r6(st.mcnemar_table(p.withColumns({"left_value": F.col("left_value") == 1, "right_value": F.col("right_value") == 1}), "seed"))


@query("st9_paired_features")
def _st9(spark, d):
    e = view(spark, d, "feature_events").select("feature_id", F.col("trace_id").alias("problem_id"), F.when(F.col("position") < 10, "short").otherwise("long").alias("label"), F.col("activation").alias("value"))
    return r6(st.paired_features(e))


@query(
    "st17_contrasts",
    "SELECT seed, problem_id, CAST(sum(output_token_count * CASE cell WHEN 'AF' THEN 1.0 WHEN 'NF' THEN -0.5 ELSE -0.5 END) AS DOUBLE) AS effect FROM predictions WHERE cell IN ('AF', 'NF', 'RF') GROUP BY 1, 2 HAVING count(*) = 3",
)
def _st17(spark, d):
    return st.contrasts(view(spark, d, "predictions"), {"AF": 1.0, "NF": -0.5, "RF": -0.5}, "cell", ["seed", "problem_id"], "output_token_count")


@query("st22_gate", "SELECT true AS present, bool_and(e > 10 AND e - 1 > 10) AS passed FROM (SELECT cell, avg(output_token_count) AS e FROM predictions WHERE cell IN ('AF', 'RF') GROUP BY 1)")
def _st22(spark, d):
    p = view(spark, d, "predictions").groupBy("cell").agg(F.avg("output_token_count").alias("e")).withColumn("low", F.col("e") - 1)
    return st.gate(p, ["AF", "RF"], "cell", "e", "low", 10.0)


@query(
    "st24_sparse_change",
    """WITH b AS (SELECT trace_id, token_id, max(activation) AS v FROM feature_events WHERE position < 8 GROUP BY 1, 2), a AS (SELECT trace_id, token_id, max(activation) AS v FROM feature_events WHERE position >= 8 GROUP BY 1, 2),
x AS (SELECT trace_id, token_id, coalesce(b.v, 0) AS p, coalesce(a.v, 0) AS q FROM b FULL JOIN a USING (trace_id, token_id))
SELECT trace_id, count(*) FILTER (WHERE p > 0) AS before, count(*) FILTER (WHERE q > 0) AS after, count(*) FILTER (WHERE p <= 0 AND q > 0) AS entered, count(*) FILTER (WHERE p > 0 AND q <= 0) AS left,
round(coalesce(count(*) FILTER (WHERE p > 0 AND q > 0) / nullif(count(*) FILTER (WHERE p > 0 OR q > 0), 0), 1), 6) AS jaccard, round(coalesce(sum(abs(p - q)) FILTER (WHERE token_id = 1), 0), 6) AS target_change, round(coalesce(sum(abs(p - q)) FILTER (WHERE token_id <> 1), 0), 6) AS other_change
FROM x GROUP BY 1""",
)
def _st24(spark, d):
    e = view(spark, d, "feature_events")
    part = lambda w: e.where(w).groupBy("trace_id", "token_id").agg(F.max("activation").alias("v"))
    return r6(st.sparse_change(part("position < 8"), part("position >= 8"), "trace_id", "token_id", "v", [1]))
