"""Queries of graders, prompts, cohorts, grids and gates, with SQL for an independent engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import text as tx
from tracemill.operators import aggregate as ag, answers as an, audit as au, cohort as co, gates as ga, pairing as pr, prompts as pm, select as sl, sources as src, stats as st
from tracemill.plans.catalog import BANDS, QKEY, query, r6
from tracemill.plans.catalog_facts import crossed_sql
from tracemill.plans.fixtures import table, view

# Graders: forms of answers around the customer of an order


def _forms(spark, d, *forms: str):
    """(k, n, t): a text for each order, form k modulo their number, N standing for the customer's key."""
    k, n = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    text = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        text = F.when(k % len(forms) == i, F.replace(F.lit(f), F.lit("N"), n)).otherwise(text)
    return table(spark, d, "orders").select(k.alias("k"), n.alias("n"), text.alias("t"))


def _case(values: list[str], column: str) -> str:
    return "CASE k " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + f" END AS {column}"


def _from(count: int) -> str:
    return f"FROM (SELECT o_orderkey, o_orderkey % {count} AS k, CAST(o_custkey AS VARCHAR) AS n FROM orders)"


HEADINGS = ("take 3\nFinal Answer: **$N**", "Answer: N or 5", "so \\fbox{N}", "none N", "### Answer: N.5 kg", "x\nanswer : \\box{N}")


@query(
    "sx5_heading_answer",
    "SELECT o_orderkey AS k, " + _case(["n", "NULL", "n", "NULL", "n || '.5'", "n"], "answer") + ", "
    + _case(["'heading'", "'ambiguous_answer_suffix'", "'final_box'", "'missing_final_answer'", "'heading'", "'heading'"], "status") + " " + _from(6),
)
def _sx5(spark, d):
    got = an.column_of(an.heading_answer, "answer string, status string")
    return _forms(spark, d, *HEADINGS).select("k", got("t").alias("x")).select("k", "x.*")


QUANTITIES = ("Answer: $N apples, 3 left", "ok\n#### N", "Answer: N or 5", "Answer: N - 3", "Answer:", "Answer: nothing", "it is N", "Answer: x \\boxed{N} 4", "answer: N and not 7")
RULES = ("first_explicit_answer_quantity", "first_explicit_answer_quantity", "explicit_numeric_alternatives", "non_scalar_answer_expression", "empty_answer_line", "missing_answer_quantity", "missing_final_answer", "final_box", "first_explicit_answer_quantity")


@query(
    "sx6_explicit_quantity",
    "SELECT o_orderkey AS k, " + _case(["n", "n", *["NULL"] * 5, "n", "n"], "answer") + ", " + _case([f"'{r}'" for r in RULES], "status") + " " + _from(9),
)
def _sx6(spark, d):
    got = an.column_of(an.explicit_quantity, "answer string, status string")
    return _forms(spark, d, *QUANTITIES).select("k", got("t").alias("x")).select("k", "x.*")


@query(
    "sx7_triage",
    "SELECT o_orderkey AS k, " + _case(["CASE WHEN n = '3' THEN 'automatic' ELSE 'needs_review' END", "'automatic'", *["'needs_review'"] * 2, "'invalid'", *["'needs_review'"] * 2, "'automatic'", "'needs_review'"], "status") + ", "
    + _case(["CASE WHEN n = '3' THEN 'single_distinct_quantity_in_answer_sentence' ELSE 'prose_with_multiple_quantities' END", "'single_distinct_quantity_in_answer_sentence'", "'explicit_numeric_alternatives'", "'non_scalar_answer_expression'", "'empty_answer_line'", "'nonnumeric_answer_sentence'", "'unmarked_conclusion'", "'final_box'", "'prose_with_multiple_quantities'"], "rule") + " " + _from(9),
)
def _sx7(spark, d):
    return _forms(spark, d, *QUANTITIES).select("k", an.triaged("t").alias("x")).select("k", "x.status", "x.rule")


@query("sx8_quantity_grades", "SELECT o_orderkey AS k, " + _case(["n = '7'", "n = '7'", *["false"] * 5, "n = '7'", "n = '7'"], "ok") + " " + _from(9))
def _sx8(spark, d):
    return _forms(spark, d, *QUANTITIES).select("k", an.quantity_grades("t", F.lit("7.0")).alias("x")).select("k", F.col("x.is_correct").alias("ok"))


TYPED = [  # reference, prediction, question, whether right; from 1 to 1 or down to 0 both intervals are empty
    ("(1,N]", "\\boxed{(1, N]}", "interval", "true"), ("(1,N)", "\\boxed{(1,N]}", "interval", "n IN ('0', '1')"), ("(1,2]\\cup(2,1N)", "x \\boxed{(1,1N)}", "domain", "true"),
    ("101_2", "\\boxed{101_{2}}", "in base 2", "true"), ("N.50", "\\boxed{N.5}", "", "true"), ("\\frac{N}{2}", "\\boxed{N/2}", "", "true"), ("N", "answer N", "", "false"),
    ("(N,2,3)", "\\boxed{(N,2,4)}", "", "false"), ("B", "\\boxed{\\text{(b)}}", "which option", "true"), ("12:30", "\\boxed{12:30}", "what time", "true"), ("N", "\\boxed{N,1}", "", "false"),
]


@query("tg1_typed_grades", "SELECT o_orderkey AS k, " + _case([t[3] for t in TYPED], "ok") + " " + _from(len(TYPED)))
def _tg1(spark, d):
    parts = [_forms(spark, d, *(t[i] for t in TYPED)).select("k", F.col("t").alias(name)) for i, name in enumerate(("gold", "said", "asked"))]
    rows = parts[0].join(parts[1], "k").join(parts[2], "k")
    return rows.select("k", an.typed_grades("said", "gold", F.lit(""), "asked").alias("x")).select("k", F.col("x.is_correct").alias("ok"))


@query(
    "tg7_grade_changes",
    """SELECT 'is_correct' AS field, CASE WHEN is_correct THEN 'true' ELSE 'false' END AS old, CASE WHEN output_token_count > 40 THEN 'true' ELSE 'false' END AS new, count(*) AS n FROM predictions WHERE is_correct <> (output_token_count > 40) GROUP BY ALL
UNION ALL SELECT 'output_token_count', CAST(output_token_count AS VARCHAR), NULL, count(*) FROM predictions WHERE output_token_count % 10 = 0 GROUP BY ALL""",
)
def _tg7(spark, d):
    p = view(spark, d, "predictions").withColumn("id", F.concat_ws("/", "cell", "seed", "problem_id"))
    new = p.withColumns({"is_correct": F.col("output_token_count") > 40, "output_token_count": F.when(F.col("output_token_count") % 10 != 0, F.col("output_token_count"))})
    return an.grade_changes(p, new, "id", ["is_correct", "output_token_count"])


@query(
    "tg7_regraded",
    """SELECT o_orderkey, o_custkey = 7 AS is_correct, o_orderstatus AS old, sha256('{"is_correct":"' || o_orderstatus || '","o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || '}') AS parent FROM orders""",
)
def _tg7_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("is_correct"))
    done = an.regraded(o, {"is_correct": F.col("o_custkey") == 7}, "o_orderkey")
    return done.select("o_orderkey", "is_correct", F.col("historical_grading.is_correct").alias("old"), F.col("historical_grading.parent_row_sha256").alias("parent"))


# Prompts and structure

STRUCTURED = ("Difficulty: Easy\nAnalysis: N\n**Difficulty**: HARD", "Problem Decomposition N\nSolution: 4", "reflection **: N", "plain N")


@query(
    "sx11_structure",
    "SELECT o_orderkey AS k, " + ", ".join(_case(v, c) for c, v in {
        "difficulty": ["'hard'", "NULL", "NULL", "NULL"], "has_analysis": ["true", "false", "false", "false"], "has_reflection": ["false", "false", "true", "false"],
        "has_decomposition": ["false", "true", "false", "false"], "has_solution": ["false", "true", "false", "false"]}.items()) + " " + _from(4),
)
def _sx11(spark, d):
    return _forms(spark, d, *STRUCTURED).select("k", pm.structure(F.col("t")).alias("x")).select("k", "x.*")


@query(
    "sx12_prompts",
    """SELECT doc_id, sha256('Problem:' || chr(10) || text || chr(10) || chr(10) || 'Solve the problem and end with a line in the form: Answer: <final answer>.') AS student,
sha256('Think.' || chr(10) || text || '<|eot_id|>0.5<|eot_id|>') AS half, sha256('Q ' || text || CASE WHEN lang = 'en' THEN chr(10) || 'One letter.' ELSE '' END || '?') AS evaluation,
sha256(lang || chr(10) || chr(10) || 'The final answer is: $\\boxed{' || source || '}$') AS completion FROM documents""",
)
def _sx12(spark, d):
    t, h = F.col("text"), lambda c: F.sha2(c, 256)
    choice = pm.choice_question(F.when(F.col("lang") == "en", "choice").otherwise("symbolic"))
    return table(spark, d, "documents").select(
        "doc_id", h(pm.student_prompt(t)).alias("student"), h(pm.ratio_prompt(t, 0.5, "Think.")).alias("half"),
        h(pm.evaluation_prompt(t, choice, "One letter.", "Q {question}?")).alias("evaluation"), h(pm.ratio_completion(F.concat(F.lit("\n "), "lang"), F.col("source"))).alias("completion"),
    )


@query(
    "ag17_operation_count",
    r"SELECT page_id, CAST(len(regexp_extract_all(lower(html), '\+|-|\*|/|=|\bplus\b|\bminus\b|\btimes\b|\bdivid(?:e|ed)\b')) AS BIGINT) AS n FROM pages",
)
def _ag17(spark, d):
    return table(spark, d, "pages").select("page_id", tx.operation_count(F.col("html")).alias("n"))


# Screens

SOLVED = ("so \\boxed{N}", "\\boxed{1} and \\fbox{\\frac{1}{N}}", "no box N", "open \\boxed{N")


@query(
    "pf3_reference_flags",
    "SELECT o_orderkey AS k, " + _case(["[]::VARCHAR[]", "['multiple_reference_boxes', 'percentage_context']", "['no_reference_box', 'radix_context_without_typed_metadata']", "['unresolved_nested_or_unbalanced_box', 'multiple_answer_request', 'textual_reference_answer']"], "flags") + " " + _from(4),
)
def _pf3(spark, d):
    rows = _forms(spark, d, *SOLVED)
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("k") % 4 + 1).cast("int"))
    question, answer = pick("What is it?", "Which percentage?", "Write in binary.", "Find all roots."), pick("1", "2", "3", "five")
    return rows.select("k", co.reference_flags(question, answer, F.col("t"), F.lit("symbolic")).alias("flags"))


@query(
    "pf2_reference_flags",
    r"""SELECT doc_id, list_filter([CASE WHEN trim(text) = '' THEN 'missing_question' END, CASE WHEN doc_id % 3 > 0 THEN 'missing_reference' END,
CASE WHEN regexp_matches(text, '\b(?:prove|proof|show\s+that|demonstrate\s+that)\b', 'i') THEN 'proof_wording_review' END,
CASE WHEN regexp_matches(text, '\b(?:diagram|figure|image|illustration)\b|\[asy\]|<img|!\[', 'i') THEN 'visual_dependency_review' END, CASE WHEN regexp_matches(text, '[\x{3400}-\x{9fff}]') THEN 'cjk_text_review' END,
CASE WHEN doc_id % 6 > 0 THEN 'missing_or_empty_reference_box' END], lambda x: x IS NOT NULL) AS flags FROM documents""",
)
def _pf2(spark, d):
    i = F.col("doc_id")
    reference = F.when(i % 6 == 0, "\\boxed{4}").when(i % 3 == 0, "four").when(i % 3 == 1, " ")
    return table(spark, d, "documents").select("doc_id", src.screen_flags(F.col("text"), reference).alias("flags"))


@query("pf1_analysis_rows", "SELECT trace_id, problem_id FROM traces WHERE is_correct AND condition IN ('en', 'de') AND candidate_index % 3 IN (0, 1)")
def _pf1(spark, d):
    t = view(spark, d, "traces").withColumns({"corpus_index": F.col("trace_id"), "analysis_length_label": F.col("condition"), "question_split": (F.col("candidate_index") % 3).cast("string")})
    return co.analysis_rows(t, ["en", "de"], ["0", "1"]).select("trace_id", "problem_id")


@query("pf8_nested", "SELECT o_orderkey, o_custkey AS v FROM orders")
def _pf8(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.struct(F.struct(F.col("o_custkey").alias("c")).alias("b")).alias("a"))
    return o.select("o_orderkey", co.nested(o, "a.b.c").alias("v"))


# Cohorts


@query(
    "hs10_roles",
    """WITH d AS (SELECT doc_id, doc_id % 50 = 0 AS kept, sha256('[7,"dev",["' || doc_id || '"]]') AS x, sha256('[7,"test",["' || doc_id || '"]]') AS y FROM documents),
a AS (SELECT *, NOT kept AND row_number() OVER (PARTITION BY kept ORDER BY x, doc_id) <= 40 AS dev FROM d),
b AS (SELECT *, NOT kept AND NOT dev AND row_number() OVER (PARTITION BY kept, dev ORDER BY y, doc_id) <= 60 AS test FROM a)
SELECT CAST(doc_id AS VARCHAR) AS problem_id, CASE WHEN kept THEN 'dap_development_reserved' WHEN dev THEN 'dev' WHEN test THEN 'test' ELSE 'student_pool' END AS role FROM b""",
)
def _hs10(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("problem_id"), F.col("doc_id").alias("component"))
    return co.assign_roles(rows, rows.where("component % 50 = 0"), {"dev": 40, "test": 60}, 7)


@query("hs17_seeded_choice", "SELECT problem_id, arg_min(trace_id, sha256('7|' || problem_id || '|' || trace_id)) AS trace_id FROM traces WHERE is_correct GROUP BY 1")
def _hs17(spark, d):
    return co.seeded_choice(view(spark, d, "traces"), 7).select("problem_id", "trace_id")


ANCHORS = f"x AS (SELECT doc_id, {QKEY} AS k, CASE WHEN doc_id % 11 > 0 THEN lang END AS a FROM documents), y AS (SELECT k, count(*) AS n, count(DISTINCT a) AS kinds, min(a) AS a, count(*) FILTER (WHERE a IS NULL) AS void FROM x WHERE doc_id % 3 = 0 GROUP BY 1)"


@query(
    "j15_anchored",
    f"""WITH {ANCHORS} SELECT doc_id AS problem_id, coalesce(n, 0) AS anchors, CASE WHEN n IS NULL THEN 'no_anchor' WHEN x.a IS NULL THEN 'missing_answer' WHEN kinds = 1 AND y.a = x.a AND void = 0 THEN 'anchor_agrees' ELSE 'anchor_conflict' END AS status FROM x LEFT JOIN y USING (k)""",
)
def _j15(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("problem_id"), F.col("text").alias("question"), F.when(F.col("doc_id") % 11 > 0, F.col("lang")).alias("answer"))
    return co.anchored(docs, docs.where("problem_id % 3 = 0"), tx.plain_question_key)


@query("j15_self_agreement", f"WITH {ANCHORS} SELECT sha256(k) AS key, count(*) AS n, count(DISTINCT a) AS answers, count(DISTINCT a) = 1 AND count(a) = count(*) AS agrees FROM x GROUP BY k HAVING count(*) > 1")
def _j15_self(spark, d):
    docs = table(spark, d, "documents").select(F.col("text").alias("question"), F.when(F.col("doc_id") % 11 > 0, F.col("lang")).alias("answer"))
    return co.self_agreement(docs, lambda c: F.sha2(tx.plain_question_key(c), 256))


@query(
    "bs10_bindings",
    """WITH m AS (SELECT p.doc_id AS pair_id, count(a.doc_id) AS matches, min(a.doc_id) AS sole FROM documents p LEFT JOIN documents a ON a.doc_id % 5 > 0 AND a.source = p.source AND a.text = p.text AND a.lang = p.lang AND a.n_chars = p.n_chars GROUP BY 1)
SELECT pair_id, CASE WHEN matches = 1 THEN sole END AS attempt_id, matches FROM m""",
)
def _bs10(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("problem_id"), "text", F.col("lang").alias("answer"), F.col("n_chars").alias("token_count"))
    return co.calibration_bindings(docs.withColumnRenamed("doc_id", "pair_id"), docs.withColumnRenamed("doc_id", "attempt_id").withColumn("eligible", F.col("attempt_id") % 5 > 0))


OFF = "(problem_id % 10 = 3 AND seed = 2)"


@query(
    "au3_cells_off_grid",
    f"""WITH r AS (SELECT problem_id, cell, seed FROM predictions WHERE NOT {OFF} UNION ALL SELECT problem_id, cell, seed FROM predictions WHERE seed = 5 AND problem_id % 25 = 0),
g AS (SELECT * FROM (SELECT DISTINCT problem_id FROM predictions) a, (SELECT DISTINCT cell FROM predictions) b, (SELECT unnest([1, 2, 3, 4, 5, 6])::BIGINT AS seed) c)
SELECT 'missing' AS rule, problem_id, cell, seed FROM (SELECT * FROM g EXCEPT SELECT * FROM r) UNION ALL SELECT 'unexpected', problem_id, cell, seed FROM (SELECT * FROM r EXCEPT SELECT * FROM g)
UNION ALL SELECT 'duplicate', problem_id, cell, seed FROM r GROUP BY 2, 3, 4 HAVING count(*) > 1""",
)
def _au3(spark, d):
    p = view(spark, d, "predictions").select("problem_id", "cell", "seed")
    rows = p.where(f"NOT {OFF}").unionByName(p.where("seed = 5 AND problem_id % 25 = 0"))
    return co.cells_off_grid(rows, {"problem_id": p.select("problem_id").distinct(), "cell": p.select("cell").distinct(), "seed": spark.range(1, 7).withColumnRenamed("id", "seed")})


@query("au3_cohort_sizes", "WITH w(lang, expected) AS (VALUES ('en', 1), ('xx', 2)), h AS (SELECT lang, count(DISTINCT doc_id) AS found FROM documents GROUP BY 1) SELECT lang, coalesce(expected, 0)::BIGINT AS expected, coalesce(found, 0) AS found FROM w FULL JOIN h USING (lang) WHERE coalesce(expected, 0) <> coalesce(found, 0)")
def _au3_sizes(spark, d):
    return co.cohort_sizes(table(spark, d, "documents").select("lang", F.col("doc_id").alias("problem_id")), "lang", {"en": 1, "xx": 2})


@query(
    "au5_probe_violations",
    """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 3 AS dose, CASE WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE o_orderstatus END AS text, CASE WHEN o_orderkey % 5 > 0 THEN 'Answer: 1' ELSE 'no' END AS response FROM orders)
SELECT 'missing' AS rule, id FROM o, (SELECT unnest([0, 1])::BIGINT AS e) WHERE dose <> e UNION ALL SELECT 'unexpected', id FROM o WHERE dose = 2
UNION ALL SELECT 'source', id FROM o WHERE id % 7 = 0 UNION ALL SELECT 'unreadable', id FROM o WHERE id % 5 = 0""",
)
def _au5(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("dose"), F.col("o_orderstatus").alias("text"))
    rows = o.withColumns({"text": F.when(F.col("id") % 7 == 0, "changed").otherwise(F.col("text")), "response": F.when(F.col("id") % 5 > 0, "Answer: 1").otherwise("no")})
    axes = {"id": o.select("id"), "dose": spark.range(2).withColumnRenamed("id", "dose")}
    return co.probe_violations(rows, axes, o, "id", "text", "Answer: [0-9]")


@query("au6_decisions", "SELECT CASE WHEN doc_id % 4 = 0 THEN 'missing' WHEN doc_id % 4 = 1 AND doc_id % 8 = 1 THEN 'invalid' ELSE 'duplicate' END AS rule, doc_id AS key FROM documents WHERE doc_id % 4 = 0 OR doc_id % 8 = 1 OR doc_id % 4 = 3")
def _au6(spark, d):
    c = table(spark, d, "documents").select("doc_id")
    once = c.where("doc_id % 4 > 0").withColumn("decision", F.when(F.col("doc_id") % 8 == 1, "maybe").otherwise("yes"))
    return au.decision_violations(c, once.unionByName(once.where("doc_id % 4 = 3")), "doc_id", "decision", ["yes", "no"])


@query("so1_repeated_keys", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 3 = 0) GROUP BY 1 HAVING count(*) > 1")
def _so1(spark, d):
    t = table(spark, d, "documents").select("doc_id")
    return pr.concatenated([t.where("doc_id % 2 = 0"), t.where("doc_id % 3 = 0")], "doc_id")[1]


@query(
    "so3_key_differences",
    "SELECT 'left' AS side, doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'right', doc_id FROM labels WHERE doc_id % 2 = 1 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) GROUP BY 2",
)
def _so3(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    only = pr.set_differences(docs, labels, "doc_id").where("side = 'left'")
    return only.unionByName(pr.set_differences(docs.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1"), "doc_id").where("side = 'right'"))


@query("j6_support_gaps", "SELECT k.user_id AS problem_id, c.event_type AS cell FROM (SELECT DISTINCT user_id FROM events) k, (SELECT DISTINCT event_type FROM events) c WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = k.user_id AND p.event_type = c.event_type AND p.event_id % 9 = 0)")
def _j6(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("problem_id"), F.col("event_type").alias("cell"), "event_id")
    axes = {"problem_id": e.select("problem_id").distinct(), "cell": e.select("cell").distinct()}
    return co.cells_off_grid(e.where("event_id % 9 = 0"), axes).where("rule = 'missing'").select("problem_id", "cell")


@query("w2_dropped_pairs", f"WITH p AS (SELECT problem_id || '/' || condition || '/' || (trace_id % 5) AS problem_id, is_correct, solution, candidate_index, trace_id FROM traces) SELECT problem_id FROM p GROUP BY 1 HAVING count(DISTINCT CASE WHEN is_correct AND {BANDS.split('PARTITION BY problem_id, ')[1].split(' ORDER BY')[0]} <> '' THEN {BANDS.split('PARTITION BY problem_id, ')[1].split(' ORDER BY')[0]} END) < 4")
def _w2(spark, d):
    t = view(spark, d, "traces").withColumn("problem_id", F.concat_ws("/", "problem_id", "condition", F.col("trace_id") % 5))
    return sl.dropped_problems(t, sl.quantile_bands(t))


# Inference

RANKED = "ranked AS (SELECT g, m, (rank() OVER (PARTITION BY g, m ORDER BY x) + count(*) OVER (PARTITION BY g, m, x) / 2.0) AS rx, (rank() OVER (PARTITION BY g, m ORDER BY y) + count(*) OVER (PARTITION BY g, m, y) / 2.0) AS ry FROM pts)"


def _metrics(spark, d):
    p = view(spark, d, "predictions")
    return p.select(F.concat_ws("/", "cell", "seed").alias("g"), "output_token_count", (F.col("problem_id") % 17).alias("a"), (F.col("problem_id") % 5).alias("b"))


@query(
    "st11_rank_summary",
    f"""WITH pts AS (SELECT cell || '/' || seed AS g, m, output_token_count AS x, CASE m WHEN 'first' THEN problem_id % 17 ELSE problem_id % 5 END AS y FROM predictions, (VALUES ('first'), ('second')) t(m)), {RANKED},
r AS (SELECT g, m, corr(rx, ry) AS rho, count(*) AS n, stddev_pop(rx) AS sx, stddev_pop(ry) AS sy FROM ranked GROUP BY 1, 2)
SELECT m AS metric, round(avg(rho), 6) AS mean_rho, count(*) AS questions FROM r WHERE n >= 3 AND sx > 0 AND sy > 0 GROUP BY 1""",
)
def _st11(spark, d):
    return r6(ga.rank_summary(ga.rank_metrics(_metrics(spark, d), "g", "output_token_count", {"first": "a", "second": "b"})))


@query(
    "st11_rank_contrasts",
    f"""WITH pts AS (SELECT cell || '/' || seed AS g, m, output_token_count AS x, CASE m WHEN 'first' THEN problem_id % 17 ELSE problem_id % 5 END AS y FROM predictions, (VALUES ('first'), ('second')) t(m)), {RANKED},
r AS (SELECT g, m, corr(rx, ry) AS rho FROM ranked GROUP BY 1, 2 HAVING count(*) >= 3 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0),
e AS (SELECT g, a.rho - b.rho AS x, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM r a JOIN r b USING (g) WHERE a.m = 'first' AND b.m = 'second'),
k AS (SELECT draw, CAST('0x' || substr(sha256('7:' || draw || ':' || i), 1, 15) AS BIGINT) % n AS i FROM (SELECT i, n, unnest(generate_series(0, 199)) AS draw FROM e)),
means AS (SELECT draw, avg(x) AS mean FROM k JOIN e USING (i) GROUP BY 1), placed AS (SELECT mean, row_number() OVER (ORDER BY mean) - 1 AS k FROM means),
ends AS (SELECT max(mean) FILTER (k = 4) AS low, max(mean) FILTER (k = 195) AS high, least(1.0, 2 * least(avg((mean <= 0)::INT), avg((mean >= 0)::INT))) AS p FROM placed)
SELECT 'first' AS left, 'second' AS right, round((SELECT avg(x) FROM e), 6) AS estimate, (SELECT count(*) FROM e) AS questions, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p, round(p, 6) AS p_holm, low > 0 AND p < 0.05 AS passed FROM ends""",
)
def _st11_contrasts(spark, d):
    return r6(ga.rank_contrasts(ga.rank_metrics(_metrics(spark, d), "g", "output_token_count", {"first": "a", "second": "b"}), "g", "first", ["second"], 200, 7))


@query(
    "st13_residualised",
    "WITH f AS (SELECT regr_slope(output_token_count, seed) AS b, regr_intercept(output_token_count, seed) AS a FROM predictions WHERE problem_id % 2 = 0) SELECT cell, seed, problem_id, round(output_token_count - a - b * seed, 4) AS v FROM predictions, f",
)
def _st13(spark, d):
    p = view(spark, d, "predictions").select("cell", "seed", "problem_id", F.col("output_token_count").cast("double").alias("v"))
    return ga.residualised(p, ["v"], ["seed"], "problem_id % 2 = 0").withColumn("v", F.round("v", 4))


MCNEMAR = "CASE WHEN w + l = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(generate_series(0, least(w, l)), lambda i: exp(lgamma(w + l + 1) - lgamma(i + 1) - lgamma(w + l - i + 1) - (w + l) * ln(2))))) END"
SPLIT = "c AS (SELECT x.seed, count(*) AS n, avg(x.is_correct::INT - y.is_correct::INT) AS m, count(*) FILTER (WHERE x.is_correct AND NOT y.is_correct) AS w, count(*) FILTER (WHERE NOT x.is_correct AND y.is_correct) AS l FROM predictions x JOIN predictions y ON x.cell = 'AF' AND y.cell = 'RF' AND x.seed = y.seed AND x.problem_id = y.problem_id GROUP BY 1)"


def _pairs(spark, d):
    p = pr.paired(view(spark, d, "predictions").withColumn("v", F.col("is_correct").cast("int")), "cell", "AF", "RF", ["seed", "problem_id"], "v")
    return p.select(F.col("seed").cast("string").alias("metric"), (F.col("left_value") == 1).alias("left_value"), (F.col("right_value") == 1).alias("right_value"))


@query("st5_mcnemar_exact", f"WITH {SPLIT} SELECT CAST(seed AS VARCHAR) AS metric, w AS wins, l AS losses, round({MCNEMAR}, 6) AS p FROM c")
def _st5(spark, d):
    return r6(st.mcnemar_table(_pairs(spark, d), "metric"))


@query(
    "st16_confirmation",
    f"""WITH {SPLIT}, t AS (SELECT CAST(seed AS VARCHAR) AS metric, n, m, {MCNEMAR} AS p FROM c), o AS (SELECT *, row_number() OVER (ORDER BY p, metric) AS r, count(*) OVER () AS k FROM t)
SELECT metric, n, round(m, 6) AS mean_difference, round(p, 6) AS p, round(max(least(1.0, (k - r + 1) * p)) OVER (ORDER BY r), 6) AS p_holm FROM o""",
)
def _st16(spark, d):
    pairs = _pairs(spark, d)
    return r6(ga.confirmation_tests(pairs, "metric", [str(s) for s in range(1, 8)]))


@query(
    "st9_effects",
    """WITH per AS (SELECT feature_id, trace_id, avg(activation) FILTER (WHERE position < 10) - avg(activation) FILTER (WHERE position >= 10) AS x FROM feature_events GROUP BY 1, 2), s AS (SELECT feature_id, count(x) AS questions, avg(x) AS effect, stddev_samp(x) AS sd FROM per GROUP BY 1)
SELECT feature_id, questions, round(effect, 6) AS effect, round(sd, 6) AS sd, round(effect / sd, 6) AS d, round(effect / sd * sqrt(questions), 6) AS t FROM s""",
)
def _st9(spark, d):
    e = view(spark, d, "feature_events").select("feature_id", F.col("trace_id").alias("problem_id"), F.when(F.col("position") < 10, "short").otherwise("long").alias("label"), F.col("activation").alias("value"))
    return r6(st.paired_features(e).select("feature_id", "questions", "effect", "sd", "d", "t"))


@query(
    "st15_arms",
    "SELECT cell, arm, count(*) AS seeds, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd FROM (SELECT cell, problem_id % 4 AS arm, seed, avg(output_token_count) AS m FROM predictions GROUP BY 1, 2, 3) GROUP BY 1, 2",
)
def _st15(spark, d):
    return r6(ga.cell_arms(view(spark, d, "predictions").withColumn("arm", F.col("problem_id") % 4), ["cell"], "arm", "seed", "output_token_count"))


TOKENS = "SELECT CAST(x.problem_id % 3 AS VARCHAR) AS g, x.seed, x.problem_id AS problem, x.output_token_count - y.output_token_count AS x FROM predictions x JOIN predictions y ON x.cell = 'AF' AND y.cell = 'RF' AND x.seed = y.seed AND x.problem_id = y.problem_id"


@query(
    "st15_contrasts",
    f"""WITH {crossed_sql(TOKENS, 300)}, h AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p) AS r FROM ends)
SELECT 'tokens' AS family, g AS contrast, round(estimate, 6) AS estimate, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p, problems, seeds, round(least(1.0, max((m - r + 1) * p) OVER (ORDER BY r)), 6) AS p_holm FROM whole JOIN h USING (g)""",
)
def _st15_contrasts(spark, d):
    p = pr.paired(view(spark, d, "predictions"), "cell", "AF", "RF", ["seed", "problem_id"], "output_token_count")
    cells = p.select(F.lit("tokens").alias("family"), (F.col("problem_id") % 3).cast("string").alias("contrast"), "seed", "problem_id", "effect")
    return r6(ga.cell_contrasts(cells, ["family"], "contrast", "seed", "problem_id", "effect", 300, 7))


@query(
    "st19_sign_agreement",
    "SELECT cell, seed, round(avg(CAST((output_token_count - 35 >= 0) = (problem_id - 50 >= 0) AS INT)), 6) AS sign_agreement, round(quantile_cont(abs(output_token_count - 35 - problem_id + 50) / greatest(abs(output_token_count - 35), 1.0), 0.5), 6) AS median_error FROM predictions GROUP BY 1, 2",
)
def _st19(spark, d):
    p = view(spark, d, "predictions").select("cell", "seed", "problem_id", (F.col("output_token_count") - 35).alias("a"), (F.col("problem_id") - 50).alias("b"))
    return r6(ga.step_calibration(p, "cell", "seed", "problem_id", "a", "b", 1.0).select("cell", "seed", "sign_agreement", "median_error"))


@query(
    "st23_engagement",
    "WITH m AS (SELECT cell, avg(output_token_count) AS mean FROM predictions GROUP BY 1), l AS (SELECT min(mean) AS low FROM m) SELECT cell, round(mean, 6) AS mean, cell <> 'AF' AS reproduced, round(mean / low, 6) AS fold, cell <> 'AF' AND mean / low <= 1.01 AS passed FROM m, l",
)
def _st23(spark, d):
    p = view(spark, d, "predictions")
    said = p.groupBy("cell").agg(F.avg("output_token_count").alias("mean")).withColumn("mean", F.when(F.col("cell") == "AF", F.col("mean") + 1).otherwise(F.col("mean")))
    return r6(ga.engagement_gate(p, said, "cell", "output_token_count", 1.01))


@query(
    "ag15_normalised",
    "WITH x AS (SELECT unnest(embedding)::DOUBLE AS a, generate_subscripts(embedding, 1) AS d FROM embeddings), s AS (SELECT d, avg(a) AS m, var_pop(a) AS v FROM x GROUP BY 1) SELECT list(round(m, 6) ORDER BY d) AS mean, round(sqrt(count(*) / sum(v)), 6) AS scale FROM s",
)
def _ag15(spark, d):
    n = ag.normalisation(table(spark, d, "embeddings"), "embedding")
    return n.select(F.transform("mean", lambda v: F.round(v, 6)).alias("mean"), F.round("scale", 6).alias("scale"))


@query("hs9_exact_holdout", "SELECT doc_id AS component FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('[3,\"held\",[\"' || doc_id || '\"]]'), doc_id) AS r FROM documents) WHERE r <= 75")
def _hs9(spark, d):
    c = table(spark, d, "documents").select(F.col("doc_id").alias("component"), F.array(F.col("doc_id").cast("string")).alias("members"))
    return co.take_components(c, 75, 3, "held")
