"""Queries of the relational operators over the driver tables, with SQL for an independent engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracemill.functions import text as tx
from tracemill.operators import aggregate as ag, dedup as dd, ordering as od, pairing as pr, select as sl
from tracemill.plans.fixtures import sql, table, view

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = sql(oracle)
        return f

    return put


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places."""
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


SPACES = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
KEY = f"trim(regexp_replace(solution, '{SPACES}+', ' ', 'g'))"
UNIQUE = f"""uc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY problem_id, {KEY} ORDER BY candidate_index, CAST(trace_id AS VARCHAR)) AS rr
  FROM traces WHERE is_correct AND {KEY} <> '') WHERE rr = 1)"""
ORDER = "solution_token_count, candidate_index, CAST(trace_id AS VARCHAR)"


@query("dd1_unique_correct", f"WITH {UNIQUE} SELECT problem_id, trace_id, solution_token_count FROM uc")
def _dd1(spark, d):
    return sl.unique_correct(view(spark, d, "traces")).select("problem_id", "trace_id", "solution_token_count")


@query(
    "dd2_unique_uncapped",
    f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY problem_id, regexp_replace(solution, '^{SPACES}+|{SPACES}+$', '', 'g') ORDER BY candidate_index) AS rr
  FROM traces WHERE is_correct AND NOT hit_max_new_tokens AND regexp_replace(solution, '^{SPACES}+|{SPACES}+$', '', 'g') <> '')
SELECT problem_id, trace_id, row_number() OVER (PARTITION BY problem_id ORDER BY {ORDER}) - 1 AS position FROM k WHERE rr = 1""",
)
def _dd2(spark, d):
    return sl.unique_correct_uncapped(view(spark, d, "traces")).select("problem_id", "trace_id", "position")


BANDS = f"""{UNIQUE}, ranked AS (SELECT *, count(*) OVER p AS n, row_number() OVER (PARTITION BY problem_id ORDER BY {ORDER}) AS r,
  quantile_cont(solution_token_count, 0.5) OVER p AS middle FROM uc WINDOW p AS (PARTITION BY problem_id)),
banded AS (SELECT *, CASE WHEN r <= greatest(1, ceil(n * 0.2::DOUBLE)) THEN 'short' WHEN r > n - greatest(1, ceil(n * 0.2::DOUBLE)) THEN 'long' END AS part FROM ranked WHERE n >= 4),
goals AS (SELECT *, quantile_cont(solution_token_count, 0.5) OVER (PARTITION BY problem_id, part) AS goal FROM banded),
each AS (SELECT problem_id, trace_id, candidate_index, solution_token_count, r, n, 'medium' AS length_rank, abs(solution_token_count - middle) AS gap, 0 AS turn FROM goals
  UNION ALL SELECT problem_id, trace_id, candidate_index, solution_token_count, r, n, part, abs(solution_token_count - goal),
    CASE part WHEN 'short' THEN -solution_token_count ELSE solution_token_count END FROM goals WHERE part IS NOT NULL),
picked AS (SELECT *, row_number() OVER (PARTITION BY problem_id, length_rank ORDER BY gap, turn, {ORDER}) AS k FROM each),
bands AS (SELECT problem_id, trace_id, solution_token_count, length_rank, r - 1 AS rank, n AS eligible, r = 1 OR r = n AS absolute_extreme FROM picked WHERE k = 1)"""


@query("w1_quantile_bands", f"WITH {BANDS} SELECT * FROM bands")
def w1(spark, d):
    return sl.quantile_bands(view(spark, d, "traces"))


@query("w2_dropped_problems", f"WITH {BANDS} SELECT DISTINCT problem_id FROM traces WHERE problem_id NOT IN (SELECT problem_id FROM bands)")
def _w2(spark, d):
    t = view(spark, d, "traces")
    return sl.dropped_problems(t, sl.quantile_bands(t))


@query(
    "ag6_selected_summary",
    f"""WITH {BANDS} SELECT length_rank, count(*) AS n, round(avg(solution_token_count), 6) AS mean_tokens,
round(quantile_cont(solution_token_count, 0.5), 6) AS median_tokens, count(*) FILTER (WHERE absolute_extreme) AS extremes FROM bands GROUP BY 1""",
)
def ag6(spark, d):
    return r6(ag.selected_summary(w1(spark, d), "length_rank", "solution_token_count", "absolute_extreme"))


LABELS = f"""ranked AS (SELECT *, count(*) OVER (PARTITION BY problem_id, is_correct) AS n, row_number() OVER (PARTITION BY problem_id, is_correct ORDER BY {ORDER}) - 1 AS r,
  count(*) FILTER (WHERE is_correct) OVER (PARTITION BY problem_id) AS correct FROM traces),
parted AS (SELECT *, CASE WHEN NOT is_correct THEN 'incorrect' WHEN r < greatest(1, ceil(n * 0.2::DOUBLE)) THEN 'short'
  WHEN r >= n - greatest(1, ceil(n * 0.2::DOUBLE)) THEN 'long' ELSE 'other_correct' END AS part FROM ranked WHERE correct >= 4),
labelled AS (SELECT problem_id, trace_id, CASE WHEN part = 'other_correct' AND row_number() OVER (PARTITION BY problem_id, part ORDER BY abs(r - (n - 1) / 2.0), {ORDER}) = 1
  THEN 'medium' ELSE part END AS label FROM parted)"""


@query("w3_length_labels", f"WITH {LABELS} SELECT * FROM labelled")
def _w3(spark, d):
    return sl.length_labels(view(spark, d, "traces"))


SPLITS = {"train": 10, "dev": 5, "test": 3}
SPLIT_SQL = """(SELECT problem_id, CASE WHEN k <= 10 THEN 'train' WHEN k <= 15 THEN 'dev' WHEN k <= 18 THEN 'test' END AS split
  FROM (SELECT problem_id, row_number() OVER (ORDER BY sha256('7:' || problem_id), problem_id) AS k FROM (SELECT DISTINCT problem_id FROM traces)))"""


@query("w4_mixed_corpus", f"WITH {LABELS} SELECT split, label, count(*) AS n FROM labelled JOIN {SPLIT_SQL} USING (problem_id) GROUP BY 1, 2")
def _w4(spark, d):
    t = view(spark, d, "traces")
    split = od.split_by_counts(t.select("problem_id").distinct(), "problem_id", SPLITS, 7).select("problem_id", "split")
    return sl.length_labels(t).join(split, "problem_id").groupBy("split", "label").agg(F.count("*").alias("n"))


@query(
    "w5_four_roles",
    """WITH r AS (SELECT problem_id, trace_id, solution_token_count AS c, CAST(trace_id AS VARCHAR) AS i, count(*) OVER p AS n, row_number() OVER (PARTITION BY problem_id ORDER BY solution_token_count, CAST(trace_id AS VARCHAR)) - 1 AS r,
  quantile_cont(solution_token_count, 0.5) OVER p AS middle, sha256('7|' || trace_id) AS d FROM traces WINDOW p AS (PARTITION BY problem_id)),
t AS (SELECT *, greatest(1, ceil(n * 0.2::DOUBLE)) AS tail FROM r WHERE n >= 4),
a AS (SELECT *, CASE WHEN r = floor(tail / 2) THEN 'quantile_short' WHEN r = n - tail + floor((tail - 1) / 2) THEN 'quantile_long' END AS s FROM t),
b AS (SELECT *, CASE WHEN s IS NULL AND row_number() OVER (PARTITION BY problem_id, s IS NULL ORDER BY abs(c - middle), i) = 1 THEN 'median' ELSE s END AS m FROM a),
e AS (SELECT *, CASE WHEN m IS NULL AND row_number() OVER (PARTITION BY problem_id, m IS NULL ORDER BY d, i) = 1 THEN 'deterministic_random' ELSE m END AS role FROM b)
SELECT problem_id, trace_id, role FROM e WHERE role IS NOT NULL""",
)
def _w5(spark, d):
    return sl.four_roles(view(spark, d, "traces"), 7)


@query(
    "w6_policies",
    """SELECT problem_id, 'absolute_shortest' AS policy, arg_min(trace_id, (solution_token_count, trace_id)) AS trace_id, CAST(min(solution_token_count) AS DOUBLE) AS score FROM traces GROUP BY 1
UNION ALL SELECT problem_id, 'longest', arg_max(trace_id, (solution_token_count, trace_id)), max(solution_token_count) FROM traces GROUP BY 1
UNION ALL SELECT problem_id, 'first', min(trace_id), min(candidate_index) FROM traces GROUP BY 1""",
)
def _w6(spark, d):
    return sl.policies(view(spark, d, "traces"), {"absolute_shortest": "solution_token_count", "first": "candidate_index"}, {"longest": "solution_token_count"})


@query(
    "w7_shortest_correct",
    f"SELECT problem_id, condition, trace_id, solution_token_count FROM (SELECT *, row_number() OVER (PARTITION BY problem_id, condition ORDER BY {ORDER}) AS k FROM traces WHERE is_correct) WHERE k = 1",
)
def _w7(spark, d):
    return sl.shortest_correct(view(spark, d, "traces"), "problem_id", "condition")


@query("w7_coverage", "SELECT chosen, count(*) AS groups FROM (SELECT problem_id, count(*) FILTER (WHERE is_correct) AS chosen FROM traces GROUP BY 1) GROUP BY 1")
def _w7c(spark, d):
    t = view(spark, d, "traces")
    return sl.coverage(t.where("is_correct"), t, "problem_id")


@query(
    "w8_rank_with_ties",
    """SELECT cell, seed, problem_id, least(rank() OVER (PARTITION BY cell, seed ORDER BY output_token_count DESC) + (count(*) OVER (PARTITION BY cell, seed, output_token_count) - 1) / 2.0, 50.0)::DOUBLE AS rank
FROM predictions""",
)
def _w8(spark, d):
    p = view(spark, d, "predictions").withColumn("g", F.concat_ws("/", "cell", "seed"))
    return sl.rank_with_ties(p, "g", "output_token_count", True, 50.0).select("cell", "seed", "problem_id", F.col("rank").cast("double").alias("rank"))


@query(
    "w9_top_contexts",
    "SELECT feature_id, trace_id, position, k FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY activation DESC, trace_id, position) AS k FROM feature_events) WHERE k <= 20",
)
def _w9(spark, d):
    return sl.top_contexts(view(spark, d, "feature_events"), ["feature_id"], "activation", 20, "trace_id", "position").select("feature_id", "trace_id", "position", "k")


@query(
    "w10_top_shares",
    """SELECT feature_id, token_id, round(mass, 6) AS mass, k, round(share, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY mass DESC, token_id) AS k,
mass / greatest(sum(mass) OVER (PARTITION BY feature_id), 1e-12) AS share FROM (SELECT feature_id, token_id, sum(activation) AS mass FROM feature_events GROUP BY 1, 2)) WHERE k <= 3""",
)
def _w10(spark, d):
    return r6(sl.top_shares(view(spark, d, "feature_events"), ["feature_id"], "token_id", "activation", 3))


@query("w11_occurrences", "SELECT problem_id, trace_id, row_number() OVER (PARTITION BY problem_id ORDER BY trace_id) - 1 AS occurrence_index FROM traces")
def _w11(spark, d):
    return sl.occurrences(view(spark, d, "traces"), "problem_id", "trace_id").select("problem_id", "trace_id", "occurrence_index")


@query(
    "w12_nested_sets",
    f"""WITH {UNIQUE}, r AS (SELECT problem_id, trace_id, row_number() OVER (PARTITION BY problem_id ORDER BY {ORDER}) AS r FROM uc), ks(k) AS (VALUES (1), (2), (4))
SELECT problem_id, trace_id, k, 'distinct' AS kind, r AS copy FROM r JOIN ks ON r <= k
UNION ALL SELECT problem_id, trace_id, k, 'repeat', unnest(generate_series(1, k)) FROM r, ks WHERE r = 1""",
)
def _w12(spark, d):
    return sl.first_distinct_and_repeats(sl.unique_correct(view(spark, d, "traces")))


POINTS = "pts AS (SELECT cell AS family, seed AS strength, avg(output_token_count) AS tokens, avg(CAST(is_correct AS INT)) AS accuracy FROM predictions GROUP BY 1, 2)"


def _points(spark, d):
    p = view(spark, d, "predictions")
    return p.groupBy(F.col("cell").alias("family"), F.col("seed").alias("strength")).agg(F.avg("output_token_count").alias("tokens"), F.avg(F.col("is_correct").cast("int")).alias("accuracy"))


@query(
    "w13_operating_points",
    f"WITH {POINTS} SELECT family, strength, round(tokens, 6) AS tokens, round(accuracy, 6) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY round(tokens, 9), strength) AS k FROM pts WHERE accuracy >= 0.3) WHERE k = 1",
)
def _w13(spark, d):
    return r6(sl.operating_point(_points(spark, d), "family", F.col("accuracy") >= 0.3, F.round("tokens", 9), "strength"))


@query(
    "w14_strengths",
    f"WITH {POINTS} SELECT family, strength, eligible FROM (SELECT *, accuracy > 0.9 AS eligible, row_number() OVER (PARTITION BY family ORDER BY accuracy > 0.9 DESC, round(tokens, 9), strength) AS k FROM pts) WHERE k = 1",
)
def _w14(spark, d):
    return sl.strength_with_fallback(_points(spark, d), "family", F.col("accuracy") > 0.9, F.round("tokens", 9), "strength").select("family", "strength", "eligible")


@query(
    "w15_common_cap",
    f"WITH {POINTS} SELECT min(strength) AS strength FROM (SELECT strength FROM pts GROUP BY 1 HAVING bool_and(accuracy > 0.2) AND count(DISTINCT family) = (SELECT count(DISTINCT family) FROM pts))",
)
def _w15(spark, d):
    p = _points(spark, d)
    return sl.common_cap(p, "strength", "family", F.col("accuracy") > 0.2, p.select("family").distinct().count())


@query("w16_largest_step", f"WITH {POINTS} SELECT max(strength) AS strength FROM pts WHERE accuracy > 0.2 AND tokens < 60")
def _w16(spark, d):
    return sl.largest_passing(_points(spark, d), "strength", (F.col("accuracy") > 0.2) & (F.col("tokens") < 60))


FEATURES = "feats AS (SELECT token_id AS feature_id, CASE WHEN token_id % 2 = 0 THEN 'short' ELSE 'long' END AS direction, round(avg(activation), 9) AS score FROM feature_events GROUP BY 1)"


@query(
    "w17_discovery",
    f"WITH {FEATURES} SELECT feature_id, direction, passes, k FROM (SELECT *, score > 50 AS passes, row_number() OVER (PARTITION BY direction ORDER BY score > 50 DESC, score DESC, feature_id) AS k FROM feats) WHERE k <= 2",
)
def _w17(spark, d):
    e = view(spark, d, "feature_events").groupBy(F.col("token_id").alias("feature_id")).agg(F.round(F.avg("activation"), 9).alias("score"))
    f = e.withColumn("direction", F.when(F.col("feature_id") % 2 == 0, "short").otherwise("long"))
    return sl.discovery(f, 2, F.col("score") > 50, "score").select("feature_id", "direction", "passes", "k")


@query("w18_paired_only", f"WITH {LABELS} SELECT problem_id, trace_id, label FROM labelled WHERE problem_id IN (SELECT problem_id FROM labelled WHERE label = 'short' INTERSECT SELECT problem_id FROM labelled WHERE label = 'long')")
def _w18(spark, d):
    return sl.paired_only(sl.length_labels(view(spark, d, "traces")), "problem_id", "label", ("short", "long"))


@query(
    "w19_pool_shortfalls",
    f"WITH {UNIQUE} SELECT problem_id, n, 15 - n AS missing FROM (SELECT t.problem_id, count(DISTINCT uc.trace_id) AS n FROM traces t LEFT JOIN uc USING (problem_id) GROUP BY 1) WHERE n < 15",
)
def _w19(spark, d):
    t = view(spark, d, "traces")
    return sl.pool_shortfalls(sl.unique_correct(t), t, 15)


# Order, splits, shards


def _hash_split(style: str, text: str):
    @query(
        f"hs_split_{style}",
        f"SELECT doc_id, k - 1 AS rank, CASE WHEN k <= 300 THEN 'train' WHEN k <= 400 THEN 'dev' WHEN k <= 500 THEN 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256({text}), doc_id) AS k FROM documents)",
    )
    def _run(spark, d):
        return od.split_by_counts(table(spark, d, "documents").select("doc_id"), "doc_id", {"train": 300, "dev": 100, "test": 100}, 11, style)


_hash_split("colon", "'11:' || doc_id")
_hash_split("pipe", "'11|' || doc_id")
_hash_split("json", "'[11,\"' || doc_id || '\"]'")


@query(
    "hs4_hash_shard",
    "SELECT doc_id, CAST(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS UBIGINT) % 7 AS BIGINT) AS shard FROM documents",
)
def _hs4(spark, d):
    return table(spark, d, "documents").select("doc_id", od.hash_shard(F.col("doc_id"), 7).alias("shard"))


@query("hs5_ordinal_shard", "SELECT doc_id, doc_id % 5 AS shard FROM documents")
def _hs5(spark, d):
    return od.ordinal_shard(table(spark, d, "documents").select("doc_id"), "doc_id", 5)


@query(
    "hs6_stream_seed",
    "SELECT doc_id, CAST(CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS UBIGINT) AS BIGINT) AS stream_seed FROM (SELECT doc_id, sha256('3:' || doc_id) AS h FROM documents)",
)
def _hs6(spark, d):
    return table(spark, d, "documents").select("doc_id", od.stream_seed(3, F.col("doc_id")).alias("stream_seed"))


@query("hs8_training_order", "SELECT problem_id, trace_id, row_number() OVER (ORDER BY sha256('5:' || problem_id || ':' || candidate_index), trace_id) - 1 AS rank FROM traces")
def _hs8(spark, d):
    t = view(spark, d, "traces").withColumn("h", F.sha2(F.concat_ws(":", F.lit("5"), "problem_id", "candidate_index"), 256))
    return od.global_rank(t, "h", "trace_id").select("problem_id", "trace_id", "rank")


@query(
    "hs11_balanced_ratios",
    "SELECT doc_id, CAST(CASE (row_number() OVER (ORDER BY sha256('9:' || doc_id), doc_id) - 1) % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.7 ELSE 0.9 END AS DOUBLE) AS ratio FROM documents",
)
def _hs11(spark, d):
    return od.balanced_ratios(table(spark, d, "documents").select("doc_id"), "doc_id", [0.5, 0.7, 0.9], 9).select("doc_id", "ratio")


@query(
    "hs11_hash_ratios",
    "SELECT doc_id, CAST(CASE CAST('0x' || substr(sha256('9:' || doc_id), 1, 16) AS UBIGINT) % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.7 ELSE 0.9 END AS DOUBLE) AS ratio FROM documents",
)
def _hs11b(spark, d):
    return table(spark, d, "documents").select("doc_id", od.ratio_by_hash(F.col("doc_id"), [0.5, 0.7, 0.9], 9).alias("ratio"))


@query("hs12_water_filled")
def _hs12(spark, d):
    n = view(spark, d, "lengths")
    return od.water_filled(n, "trace_id", "length", n.agg(F.sum("length")).first()[0] // 2, 4)


@query("hs13_quota_positions")
def _hs13(spark, d):
    return od.quota_positions(_hs12(spark, d), 4)


@query("hs15_bottom_k", "SELECT doc_id, sha256('2:' || doc_id) AS priority FROM documents ORDER BY 2, 1 LIMIT 64")
def _hs15(spark, d):
    return od.bottom_k(table(spark, d, "documents").select("doc_id"), od.digest(2, F.col("doc_id")), 64, "doc_id")


@query("hs16_quality_sample", "SELECT doc_id FROM documents ORDER BY sha256('[6,\"' || doc_id || '\"]'), doc_id LIMIT 30")
def _hs16(spark, d):
    return od.bottom_k(table(spark, d, "documents").select("doc_id"), od.digest(6, F.col("doc_id"), "json"), 30, "doc_id").select("doc_id")


@query(
    "hs18_lowest_group",
    """SELECT problem_id, trace_id FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY sha256('8|' || trace_id), trace_id) AS k
FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY solution_token_count, CAST(trace_id AS VARCHAR)) AS r, count(*) OVER (PARTITION BY problem_id) AS n FROM traces)
WHERE r <= greatest(1, ceil(n / 5))) WHERE k = 1""",
)
def _hs18(spark, d):
    return od.lowest_group_pick(view(spark, d, "traces"), "problem_id", "solution_token_count", "trace_id", 5, 8).select("problem_id", "trace_id")


# Keys, duplicates, near matches, components

QKEY = f"trim(regexp_replace(lower(text), '{SPACES}+', ' ', 'g'))"


@query("dd3_text_key", f"SELECT doc_id, sha256(trim(regexp_replace(text, '{SPACES}+', ' ', 'g'))) AS key FROM documents")
def _dd3(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(tx.text_key(F.col("text")), 256).alias("key"))


@query("dd4_question_key")
def _dd4(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(tx.question_key(F.col("text")), 256).alias("key"))


@query("dd5_instruction_free", "SELECT doc_id, CASE WHEN text IS NOT NULL THEN true END AS same FROM documents")
def _dd5(spark, d):
    asked = F.concat(F.lit("  return your final response within \\boxed{}. "), F.col("text"))
    return table(spark, d, "documents").select("doc_id", (tx.question_key(tx.instruction_free(asked)) == tx.question_key(F.col("text"))).alias("same"))


@query("dd6_number_masked", f"SELECT page_id, trim(regexp_replace(regexp_replace(url, '[0-9]+(?:\\.[0-9]+)?', '<NUM>', 'g'), '{SPACES}+', ' ', 'g')) AS masked FROM pages")
def _dd6(spark, d):
    return table(spark, d, "pages").select("page_id", tx.number_masked(F.col("url")).alias("masked"))


UNIT_RE = r"\\[a-z]+|[a-z]+|[0-9]+(?:\.[0-9]+)?|[^\p{L}\p{N}_\s]"
SHINGLES = f"""units AS (SELECT doc_id, regexp_extract_all({QKEY}, '{UNIT_RE}') AS u FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(u[i:i + 4], ' ') AS s FROM (SELECT doc_id, u, unnest(generate_series(1, greatest(1, len(u) - 4))) AS i FROM units)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
near AS (SELECT a, b, c / (x.n + y.n - c)::DOUBLE AS jaccard FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM sh p JOIN sh q USING (s) WHERE p.doc_id <> q.doc_id GROUP BY 1, 2)
  JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE c / (x.n + y.n - c)::DOUBLE >= 0.8)"""


@query("dd7_shingle_counts", f"WITH {SHINGLES} SELECT doc_id, n FROM size")
def _dd7(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tx.shingles(tx.plain_question_key(F.col("text")))).cast("long").alias("n"))


def _questions(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("problem_id"), F.col("text").alias("question"), F.col("doc_id").alias("ordinal"))


@query("j7_near_matches", f"WITH {SHINGLES} SELECT a AS query_id, b AS reference_id, round(jaccard, 6) AS jaccard FROM near")
def _j7(spark, d):
    q = _questions(spark, d)
    return r6(dd.near_matches(q, q, key=tx.plain_question_key))


COMPONENTS = f"""WITH RECURSIVE {SHINGLES}, reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
comp AS (SELECT doc_id, least(doc_id, coalesce(min(b), doc_id)) AS component FROM documents LEFT JOIN reach ON a = doc_id GROUP BY 1)"""


@query("dd10_components", f"{COMPONENTS} SELECT doc_id AS problem_id, component FROM comp")
def dd10(spark, d):
    q = _questions(spark, d)
    return dd.component_ids(q, dd.near_edges(q, key=tx.plain_question_key), "problem_id")


@query(
    "dd12_holdouts",
    f"{COMPONENTS} SELECT doc_id AS problem_id, component, component IN (SELECT component FROM comp WHERE doc_id % 10 = 0) AS held_out FROM comp",
)
def _dd12(spark, d):
    return dd.propagated_holdouts(dd10(spark, d), _questions(spark, d).where("problem_id % 10 = 0"), "problem_id")


@query("dd13_undirected", f"WITH {SHINGLES} SELECT DISTINCT least(a, b) AS left, greatest(a, b) AS right FROM near")
def _dd13(spark, d):
    q = _questions(spark, d)
    return dd.undirected(dd.near_matches(q, q, key=tx.plain_question_key), "query_id", "reference_id")


@query("dd8_retained", f"SELECT doc_id, first_value(doc_id) OVER (PARTITION BY {QKEY} ORDER BY doc_id) AS retained FROM documents")
def _dd8(spark, d):
    return dd.retained(table(spark, d, "documents").select("doc_id", "text"), F.sha2(tx.plain_question_key(F.col("text")), 256), "doc_id").select("doc_id", "retained")


@query(
    "dd9_duplicate_groups",
    f"SELECT sha256({QKEY}) AS key, count(*) AS n, min(doc_id) AS first_id, count(DISTINCT source) AS answers, count(DISTINCT source) > 1 AS conflict FROM documents GROUP BY {QKEY} HAVING count(*) > 1",
)
def _dd9(spark, d):
    return dd.duplicate_groups(table(spark, d, "documents"), F.sha2(tx.plain_question_key(F.col("text")), 256), "doc_id", F.col("source"))


@query("dd11_isolated")
def _dd11(spark, d):
    q = _questions(spark, d)
    kept, gone = dd.isolate(q, table(spark, d, "benchmark").select(F.col("item_id").alias("problem_id"), F.col("text").alias("question")), 7)
    return kept.select("problem_id", F.lit("kept").alias("reason")).unionByName(gone)


@query("dd14_prescreened", f"SELECT doc_id FROM documents WHERE NOT contains(text, '@') AND doc_id NOT IN (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {QKEY} ORDER BY doc_id) AS r FROM documents) WHERE r > 1)")
def _dd14(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    flagged = docs.withColumn("flags", F.array_compact(F.array(F.when(F.contains("text", F.lit("@")), F.lit("mail")))))
    repeats = dd.retained(docs, F.sha2(tx.plain_question_key(F.col("text")), 256), "doc_id").where("doc_id != retained")
    return dd.prescreened(flagged, "doc_id", repeats).select("doc_id")


@query("j2_exact_overlap", f"WITH k AS (SELECT doc_id, {QKEY} AS k FROM documents) SELECT x.doc_id AS query_id, y.doc_id AS reference_id FROM k x JOIN k y USING (k)")
def _j2(spark, d):
    q = _questions(spark, d)
    return dd.exact_overlap(q, q, key=tx.plain_question_key)
