"""Queries of typed and reviewed answers, quantities, steps and regions of text, with SQL for an independent engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tracemill.operators import aggregate as ag, answers as an, audit as au, candidates as cd, layouts as ly, lineage as ln, pairing as pr, regions as rg, stats as st, variants as va
from tracemill.operators.store import scratch
from tracemill.plans.catalog import query, r6
from tracemill.plans.fixtures import table
from tracemill.streaming.batches import ChunkAppend, RunningCounts

# Answers made of the numbers of every line item: q, n, s are its quantity, its number and its supplier, odd says whether
# its part divides by three.  Letters in braces stand for numbers; the SQL decides by arithmetic of its own.

NUMBERS = """items AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS n, l_suppkey AS s,
CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS odd, (l_orderkey + l_linenumber) % {forms} AS form FROM lineitem)"""


def _items(spark, d, forms: int):
    items = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_suppkey").alias("s"),
        F.when(F.col("l_partkey") % 3 == 0, 1).otherwise(0).alias("odd"),
    )
    return items.withColumn("form", (F.col("l_orderkey") + F.col("l_linenumber")) % forms)


def _written(template: str) -> Column:
    """A template with <expression> parts evaluated as SQL over the numbers."""
    parts = []
    for i, piece in enumerate(template.replace(">", "<").split("<")):
        parts.append(F.expr(piece).cast("string") if i % 2 else F.lit(piece))
    return F.concat(*parts)


def _chosen(templates: list[str]) -> Column:
    return F.coalesce(*(F.when(F.col("form") == i, _written(t)) for i, t in enumerate(templates)))


def _decided(decisions: list[str], as_: str = "ok") -> str:
    return "CASE form " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(decisions)) + f" END AS {as_}"


RADICALS = [  # reference, answer, whether they are equal
    (r"\sqrt{<q*q*n + odd>}", r"<q>\sqrt{<n>}", "odd = 0"),
    (r"\frac{<q>}{\sqrt{<n>}}", r"\frac{<q>\sqrt{<n>}}{<n + odd>}", "odd = 0"),
    (r"\frac{1}{\sqrt{<n + 1>}-\sqrt{<n>}}", r"\sqrt{<n + 1>}<if(odd = 1, '-', '+')>\sqrt{<n>}", "odd = 0"),
    (r"(1+\sqrt{<n>})^2", r"<n + 1 + odd>+2\sqrt{<n>}", "odd = 0"),
    (r"\sqrt{<n>}", "<q>", "n = q * q"),
    (r"\sqrt{<q>}+\sqrt{<n>}", r"\sqrt{<q + n>}", "false"),
    (r"\left(<q>\sqrt{<n>},\dfrac{<n>}{<s + 1>}\right)", r"(\sqrt{<q*q*n>}, <n + odd>/<s + 1>)", "odd = 0"),
    (r"[\sqrt{<n>},\infty)", r"[\sqrt{<n>},\sqrt{<n + q>})\cup[\sqrt{<n + q + odd>},\infty)", "odd = 0"),
]


@query("tg2_radicals", f"WITH {NUMBERS.format(forms=len(RADICALS))} SELECT l_orderkey, l_linenumber, " + _decided([r[2] for r in RADICALS]) + " FROM items")
def _tg2(spark, d):
    rows = _items(spark, d, len(RADICALS)).withColumns({"gold": _chosen([r[0] for r in RADICALS]), "said": F.concat(F.lit("so \\boxed{"), _chosen([r[1] for r in RADICALS]), F.lit("}"))})
    return rows.select("l_orderkey", "l_linenumber", an.typed_grades("said", "gold", F.lit(""), F.lit("")).is_correct.alias("ok"))


LISTS = [  # reference, answer, question, whether they are equal; lists of several numbers, in any order unless asked
    ("<q>,<n>,<s>", "<n>,<q>,<s>", "", "true"),
    ("<q>,<n>,<s>", "<q>,<q>,<n>", "", "list_sort([q, n, s]) = list_sort([q, q, n])"),
    ("<q>,-<q>", r"\pm <q + odd>", "", "odd = 0"),
    (r"\{<n>,<q>\}", r"x=<q>, x=<2*n>/2", "", "true"),
    ("<q>,<n>", "<q>", "", "false"),
    ("<s>,<q>", "<q>.0,,<s>", "", "false"),
]


@query("tg3_lists", f"WITH {NUMBERS.format(forms=len(LISTS))} SELECT l_orderkey, l_linenumber, " + _decided([r[3] for r in LISTS]) + ", " + _decided([*["'graded'"] * 5, "'grading_error'"], "status") + " FROM items")
def _tg3(spark, d):
    rows = _items(spark, d, len(LISTS)).withColumns({"gold": _chosen([r[0] for r in LISTS]), "said": F.concat(F.lit("\\boxed{"), _chosen([r[1] for r in LISTS]), F.lit("}"))})
    grade = an.typed_grades("said", "gold", F.lit("olympiadbench"), F.lit(""), F.lit("Numerical"), F.lit("true"))
    return rows.select("l_orderkey", "l_linenumber", grade.is_correct.alias("ok"), grade.status.alias("status"))


PAIRS = [  # lists of pairs: reference, answer, question
    ("(<q>,<n>),(<s>,1)", "(<s>,1),(<q>,<n>)", "Find all pairs.", "true"),
    ("(<q>,<n>),(<s>,1)", "(<s>,1),(<q>,<n>)", "Find all pairs in increasing order.", "q = s AND n = 1"),
    ("(<q>,<n>),(<s>,1)", "(<q>,<n>),(<s>,<1 + odd>)", "in order", "odd = 0"),
]


@query("tg3_pairs", f"WITH {NUMBERS.format(forms=len(PAIRS))} SELECT l_orderkey, l_linenumber, " + _decided([r[3] for r in PAIRS]) + " FROM items")
def _tg3_pairs(spark, d):
    pick = lambda i: _chosen([r[i] for r in PAIRS])
    rows = _items(spark, d, len(PAIRS)).withColumns({"gold": pick(0), "said": F.concat(F.lit("\\boxed{"), pick(1), F.lit("}")), "asked": pick(2)})
    return rows.select("l_orderkey", "l_linenumber", an.typed_grades("said", "gold", F.lit(""), "asked").is_correct.alias("ok"))


REVIEWED = [  # definition, answer, whether it is right, status
    ({"values": ["30"], "mode": "single", "kind": "percentage"}, r"\frac{<q>}{100}=<q>\%", "q = 30", "'graded'"),
    ({"values": ["7", r"\frac{15}{2}"], "mode": "any", "kind": "symbolic"}, r"\frac{<q>}{2}", "q IN (14, 15)", "'graded'"),
    ({"values": ["1", "2"], "mode": "all", "kind": "symbolic"}, "<n>,<q>", "list_sort([n, q]) = [1, 2]", "'graded'"),
    ({"values": ["10"], "mode": "single", "kind": "periodic", "period": "36"}, "<s>^\\circ", "s % 36 = 10", "'graded'"),
    ({"values": ["5"], "mode": "single", "kind": "symbolic", "units": {"km": ["kilometers", "kilometres"]}}, r"<n>\text{ <if(odd = 1, 'miles', 'kilometers')>}", "n = 5 AND odd = 0", "CASE odd WHEN 1 THEN 'grading_error' ELSE 'graded' END"),
    ({"values": ["3:05 pm"], "mode": "single", "kind": "clock"}, r"<n>:05\text{ <if(odd = 1, 'a', 'p')>.m.}", "n = 3 AND odd = 0", "'graded'"),
    ({"values": ["(1,2)"], "mode": "any", "kind": "vector"}, r"\begin{pmatrix}<n>\\<q>\end{pmatrix}", "n = 1 AND q = 2", "'graded'"),
    ({"values": ["1", "2"], "mode": "any", "kind": "symbolic"}, "<n>, <n + odd>", "false", "'several_values'"),
    ({"values": ["4"], "mode": "single", "kind": "symbolic"}, "<n>, <2*n>/2, <n>.0", "n = 4", "'graded'"),
    ({"values": ["1", "2"], "mode": "all", "kind": "symbolic", "ordered": True}, "<n>,<n + 1 - odd>", "n = 1 AND odd = 0", "'graded'"),
]


@query("tg4_reviewed", f"WITH {NUMBERS.format(forms=len(REVIEWED))} SELECT l_orderkey, l_linenumber, " + _decided([r[2] for r in REVIEWED]) + ", " + _decided([r[3] for r in REVIEWED], "status") + " FROM items")
def _tg4(spark, d):
    grades = an.reviewed_grades({str(i): r[0] for i, r in enumerate(REVIEWED)})
    said = F.concat(F.lit("\\boxed{"), _chosen([r[1] for r in REVIEWED]), F.lit("}"))
    rows = _items(spark, d, len(REVIEWED)).withColumn("grade", grades(said, F.col("form").cast("string")))
    return rows.select("l_orderkey", "l_linenumber", F.col("grade.is_correct").alias("ok"), F.col("grade.status").alias("status"))


LOWEST = "CASE WHEN {0} % {1} = 0 THEN CAST({0} // {1} AS VARCHAR) ELSE ({0} // gcd({0}, {1})) || '/' || ({1} // gcd({0}, {1})) END"
QUANTITIES = [  # kind, answer, its value in one spelling (null: it is not of its kind), status
    ("clock", "<n>:<lpad(q, 2, '0')> <if(odd = 1, 'p', 'a')>.m.", "CAST((n % 12 + 12 * odd) * 3600 + q * 60 AS VARCHAR)", "'read'"),
    ("clock", "<q>:05", "CASE WHEN q < 24 THEN CAST((CASE WHEN q BETWEEN 1 AND 12 THEN q % 12 + 12 ELSE q END) * 3600 + 300 AS VARCHAR) END", "CASE WHEN q < 24 THEN 'read' ELSE 'not_of_kind' END"),
    ("percentage", "<q> percentage points", "CAST(q AS VARCHAR)", "'read'"),
    ("percentage", r"\frac{<q>}{<100 + odd>}=<q>\%", "CASE odd WHEN 0 THEN CAST(q AS VARCHAR) END", "CASE odd WHEN 0 THEN 'read' ELSE 'not_of_kind' END"),
    ("vector", r"-\begin{bmatrix}<q> & <n>\end{bmatrix}", "concat('-', q, ';-', n)", "'read'"),
    ("vector", r"\langle <q>,\frac{<n>}{<s + 1>}\rangle", "concat(q, ';', " + LOWEST.format("n", "(s + 1)") + ")", "'read'"),
    ("vector", r"\begin{pmatrix}<q> & <n>\\1 & 2\end{pmatrix}", "NULL", "'not_of_kind'"),
    ("degree", r"<q>.5^\circ", LOWEST.format("(2 * q + 1)", "2"), "'read'"),
    ("symbolic", r"$<s>\,\text{kilometres}$", "concat(s, ' km')", "'read'"),
    ("symbolic", "<s> bananas", "concat(s, 'bananas')", "'unparsed'"),
    ("symbolic", r"<q>\cdot 10^{<n>}", "concat(q, repeat('0', CAST(n AS INT)))", "'read'"),
]


@query("sx16_quantities", f"WITH {NUMBERS.format(forms=len(QUANTITIES))} SELECT l_orderkey, l_linenumber, " + _decided([r[3] for r in QUANTITIES], "status") + ", " + _decided([r[2] for r in QUANTITIES], "value") + " FROM items")
def _sx16(spark, d):
    values = an.quantity_values({"km": ["kilometers", "kilometres"]}, meridiem="pm")
    kind = _chosen([r[0] for r in QUANTITIES])
    rows = _items(spark, d, len(QUANTITIES)).withColumn("x", values(_chosen([r[1] for r in QUANTITIES]), kind))
    return rows.select("l_orderkey", "l_linenumber", "x.status", "x.value")


# Variants and steps

WORKED = """worked AS (SELECT doc_id, text, n_chars % 97 AS a, doc_id % 13 AS b, (n_chars % 97) * (doc_id % 13) AS c,
(n_chars % 97) * (doc_id % 13) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS shown FROM documents WHERE NOT contains(text, '####')),
plain AS (SELECT *, regexp_replace(text, '<<[^<>]*>>', '', 'g') || chr(10) || 'So ' || a || '*' || b || '=' AS lead FROM worked),
made AS (SELECT *, lead || shown || '.' || chr(10) AS body, c || '' AS gold, left(shown || '', -1) || ((right(shown || '', 1)::BIGINT + 1) % 10) AS wrong FROM plain),
v AS (SELECT doc_id, 'reference' AS variant, body || 'Answer: ' || gold AS said, 0 AS lost, NULL AS start, NULL AS replacement, 8 + length(body) + length(gold) AS size FROM made
UNION ALL SELECT doc_id, 'result_marker', body || 'Result: ' || gold, 5, NULL, NULL, 8 + length(body) + length(gold) FROM made
UNION ALL SELECT doc_id, 'no_marker', body || gold, 8, NULL, NULL, 8 + length(body) + length(gold) FROM made
UNION ALL SELECT doc_id, 'neutral_note', 'The label in this note is Entry.' || chr(10) || body || 'Answer: ' || gold, 0, NULL, NULL, 8 + length(body) + length(gold) FROM made
UNION ALL SELECT doc_id, 'answer_note', 'The label in this note is Answer.' || chr(10) || body || 'Answer: ' || gold, 0, NULL, NULL, 8 + length(body) + length(gold) FROM made
UNION ALL SELECT doc_id, 'wrong_calculation', lead || wrong || '.' || chr(10) || 'Answer: ' || gold, 1, length(lead), wrong, 8 + length(body) + length(gold) FROM made WHERE shown = c)"""


@query("sx15_variants", f"WITH {WORKED} SELECT doc_id, variant, sha256(said) AS text_sha256, size - lost AS kept_chars, CAST(start AS INT) AS start, replacement FROM v")
def _sx15(spark, d):
    docs = table(spark, d, "documents").withColumns({"a": F.col("n_chars") % 97, "b": F.col("doc_id") % 13})
    shown = F.col("a") * F.col("b") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    worked = F.concat("text", F.lit("\nSo "), "a", F.lit("*"), "b", F.lit("=<<"), "a", F.lit("*"), "b", F.lit("="), shown, F.lit(">>"), shown, F.lit(".\n#### "), F.col("a") * F.col("b"))
    made = va.reference_variants(docs.select("doc_id", worked.alias("worked")), "worked")
    same = F.filter("alignment", lambda x: x.operation == "equal")
    kept = F.aggregate(same, F.lit(0), lambda n, x: n + x.base_end - x.base_start)
    return made.select("doc_id", "variant", F.sha2("text", 256).alias("text_sha256"), kept.cast("long").alias("kept_chars"), "mutation.start", "mutation.replacement")


@query("sx10_steps")
def _sx10(spark, d):
    """Steps of every document with an answer put behind it; tested against the plain function."""
    docs = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("\nAnswer: "), "n_chars").alias("text"))
    return va.step_rows(docs.withColumn("offsets", rg.places(F.col("text"))), "text", "offsets").drop("text", "offsets")


# Regions and spans

TOKENS = r"""pieces AS (SELECT doc_id, unnest(p) AS piece, unnest(generate_series(1, len(p))) AS nth FROM (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r]+[ \t\n\r]*|^[ \t\n\r]+') AS p FROM documents)),
words AS (SELECT doc_id, nth, rtrim(piece, ' ' || chr(9) || chr(10) || chr(13)) AS token,
  coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM pieces),
tokens AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1 AS position, start, start + length(token) AS stop, token FROM words WHERE token <> '')"""
MARKER = "[0-9]{2,}[^0-9]{1,30}"


@query(
    "sx9_region_masks",
    rf"""WITH {TOKENS}, heads AS (SELECT doc_id, regexp_matches(text, '{MARKER}') AS there, length(regexp_extract(text, '\A((?s:.*?))({MARKER})', 1)) AS a, length(regexp_extract(text, '\A((?s:.*?))({MARKER})', 2)) AS n FROM documents)
SELECT doc_id, count(*) FILTER (NOT there OR stop <= a) AS n_body, count(*) FILTER (there AND stop > a AND start < a + n) AS n_marker, count(*) FILTER (there AND stop > a AND start >= a + n) AS n_suffix
FROM tokens JOIN heads USING (doc_id) GROUP BY doc_id""",
)
def _sx9(spark, d):
    docs = table(spark, d, "documents").select("doc_id", rg.places(F.col("text")).alias("tokens"), rg.first_span(F.col("text"), MARKER).alias("span"))
    masks = docs.where(F.size("tokens") > 0).select("doc_id", rg.regions(F.col("tokens"), F.col("span")).alias("r"))
    return masks.select("doc_id", *(F.size(F.array_remove(F.transform("r", lambda r: r != F.lit(i)), True)).cast("long").alias(n) for i, n in enumerate(("n_body", "n_marker", "n_suffix"))))


@query("sx9_covered_tokens", rf"WITH {TOKENS} SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (regexp_matches(token, '[0-9]')) AS n_covered FROM tokens GROUP BY doc_id")
def _sx9_cover(spark, d):
    """Tokens that overlap a run of digits, by the sweep; the SQL asks which tokens hold a digit."""
    docs = table(spark, d, "documents").select("doc_id", rg.places(F.col("text")).alias("tokens"), rg.places(F.col("text"), "[0-9]+").alias("spans"))
    found = docs.where(F.size("tokens") > 0).select("doc_id", rg.covered("tokens", "spans").alias("c"))
    return found.select("doc_id", F.size("c").cast("long").alias("n_tokens"), F.size(F.filter("c", lambda c: c)).cast("long").alias("n_covered"))


@query(
    "pf5_eligible_positions",
    rf"""WITH {TOKENS}, heads AS (SELECT doc_id, CASE WHEN regexp_matches(text, '{MARKER}') THEN length(regexp_extract(text, '\A((?s:.*?))({MARKER})', 1)) END AS a FROM documents),
ok AS (SELECT doc_id, position, count(*) OVER (PARTITION BY doc_id) AS n, (a IS NULL OR stop <= a) AND NOT contains(token, chr(92)) AND regexp_matches(token, '[\p{{L}}\p{{N}}]')
  AND NOT list_has_any(regexp_extract_all(lower(token), '[a-z]+'), ['the', 'and', 'die', 'und']) AS fit FROM tokens LEFT JOIN heads USING (doc_id))
SELECT doc_id, position FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS r FROM ok WHERE fit AND position < n - 5 AND position < 400) WHERE r <= 64""",
)
def _pf5(spark, d):
    text = F.col("text")
    docs = table(spark, d, "documents").select("doc_id", rg.places(text).alias("tokens"), rg.words(text).alias("said"), rg.first_span(text, MARKER).alias("span"))
    fit = rg.eligible_positions(F.col("tokens"), F.col("said"), F.col("span"), ["the", "and", "die", "und"], tail=5, most=400, count=64)
    return docs.select("doc_id", F.explode(fit).alias("position")).withColumn("position", F.col("position").cast("long"))


# Streams, shards, layouts


@query("s217_running_counts", "SELECT event_type, count(*) AS n, CAST(sum(event_id % 1000) AS BIGINT) AS total FROM events GROUP BY event_type")
def _s217(spark, d):
    """Counters of all events, read as a stream that is stopped half-way and goes on from its checkpoint."""
    base = scratch(spark)
    events = table(spark, d, "events").select("event_id", "event_type")
    for half in range(2):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == half).repartition(3).write.mode("append").parquet(f"{base}/landed")
        counts = RunningCounts(f"{base}/counts", ["event_type"], {"total": "event_id % 1000"})  # a new one, as after a restart
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/landed")
        stream.writeStream.foreachBatch(counts).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    return counts.now(spark)


@query("s217_chunks", "SELECT CAST((row_number() OVER (ORDER BY event_id) - 1) // 4096 AS BIGINT) AS chunk, event_id FROM events")
def _s217_chunks(spark, d):
    """All events appended batch by batch to chunks of 4,096, numbered through."""
    base = scratch(spark)
    events = table(spark, d, "events").select("event_id").repartitionByRange(4, "event_id")
    keep = ChunkAppend(f"{base}/chunks", ["event_id"], 4096)
    cuts = events.select(F.expr("approx_percentile(event_id, array(0.25, 0.5, 0.75))").alias("q")).first()["q"] or [0]
    bounds = [None, *sorted(set(cuts)), None]
    for batch, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        inside = F.lit(True) if low is None else F.col("event_id") > low
        keep(events.where(inside if high is None else inside & (F.col("event_id") <= high)), batch)
    return keep.now(spark).select("chunk", "event_id")


@query("io11_shard_union", "SELECT CAST(l_linenumber AS VARCHAR) AS shard, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1")
def _io11(spark, d):
    """All line items written as shards with a manifest, verified, and read as one table."""
    root = scratch(spark)
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("q"), "l_linenumber")
    ln.write_shards(rows, root, F.col("l_linenumber"), '{"by": "line number"}')
    return ln.shard_union(spark, root, '{"by": "line number"}').groupBy("shard").agg(F.count("*").alias("n"), F.sum("q").alias("quantity"))


LAYOUTS = {  # five tables as five sources: (index, layout)
    "documents": ("doc_id", ly.Layout(question=("$.text",), answer=(("$.source", "as_is"),), unique_id="$.doc_id", scope={"$.lang": "en"})),
    "benchmark": ("item_id", ly.Layout(question=("$.text",), answer=(("$.item_id", "as_is"),))),
    "conversations": ("conv_id", ly.Layout(question=("$.role", "$.text"), answer=(("$.none", "as_is"), ("$.turn", "as_is")), details={"role": "$.role"})),
    "pages": ("page_id", ly.Layout(question=("$.url",), answer=(("$.html", "final_answer"), ("$.page_id", "as_is")), reference="$.url")),
    "part": ("p_partkey", ly.Layout(question=("$.p_name",), answer=(("$.p_brand", "as_is"),), absent=("$.p_comment",), details={"size": "$.p_size"})),
}
RAW = {  # question, answer, reason and, of pages, their own answer is asked for by its form only
    "documents": ("text", "source", "CASE WHEN lang IS DISTINCT FROM 'en' THEN 'outside_scope' END"),
    "benchmark": ("text", "CAST(item_id AS VARCHAR)", "NULL"),
    "conversations": ("concat_ws(chr(10), role, text)", "CAST(turn AS VARCHAR)", "NULL"),
    "part": ("p_name", "p_brand", "NULL"),
}


def _io6_sql() -> str:
    parts = []
    for name, (q, a, why) in RAW.items():
        i = LAYOUTS[name][0]
        blank = f"CASE WHEN regexp_matches(coalesce({q}, ''), '^\\s*$') THEN 'missing_question' WHEN regexp_matches(coalesce({a}, ''), '^\\s*$') THEN 'missing_answer' END"
        parts.append(f"SELECT '{name}' AS dataset, CAST({i} AS BIGINT) AS source_index, printf('{name}-%05d', {i}) AS problem_id, sha256(coalesce({q}, '')) AS question_sha256, CASE WHEN NOT regexp_matches({a}, '^\\s*$') THEN {a} END AS answer, coalesce({why}, {blank}) AS rejected FROM {name}")
    return " UNION ALL ".join(parts)


@query("io6_layouts", _io6_sql())
def _io6(spark, d):
    """Four tables of different layouts as records; rows out of scope keep their reason."""
    raw = lambda n, i: table(spark, d, n).select(F.col(i).alias("source_index"), F.to_json(F.struct("*")).alias("row"))
    made = ly.union_of_layouts({n: (raw(n, i), layout) for n, (i, layout) in LAYOUTS.items() if n in RAW})
    return made.select("dataset", "source_index", "problem_id", F.sha2("question", 256).alias("question_sha256"), "answer", "rejected")


@query(
    "io6_page_layout",
    "SELECT CAST(page_id AS BIGINT) AS source_index, url AS question, url AS reference_solution, CASE WHEN regexp_matches(coalesce(url, ''), '^\\s*$') THEN 'missing_question' END AS rejected FROM pages",
)
def _io6_pages(spark, d):
    """Web pages as a fifth layout: the answer marked in the page, else its number."""
    i, layout = LAYOUTS["pages"]
    raw = table(spark, d, "pages").select(F.col(i).alias("source_index"), F.to_json(F.struct("*")).alias("row"))
    return ly.adapted(raw, "pages", layout).select("source_index", "question", "reference_solution", "rejected")


# Regression within groups


@query(
    "st12_fixed_effects",
    """WITH r AS (SELECT l_returnflag || l_linestatus AS family, l_suppkey AS g, l_extendedprice AS y, l_quantity AS x, l_discount * 100 AS z FROM lineitem),
d AS (SELECT family, g, y - avg(y) OVER w AS y, x - avg(x) OVER w AS x, z - avg(z) OVER w AS z, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY family, g)),
s AS (SELECT family, sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz, sum(x * y) AS xy, sum(z * y) AS zy, count(*) AS n, count(DISTINCT g) AS c FROM d WHERE n > 1 GROUP BY family),
b AS (SELECT *, xx * zz - xz * xz AS det, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS b1, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS b2 FROM s),
u AS (SELECT family, g, sum(x * (y - b1 * x - b2 * z)) AS u1, sum(z * (y - b1 * x - b2 * z)) AS u2, sum((y - b1 * x - b2 * z) ** 2) AS rest FROM d JOIN (SELECT family, b1, b2 FROM b) USING (family) WHERE d.n > 1 GROUP BY ALL),
m AS (SELECT family, sum(u1 * u1) AS m11, sum(u1 * u2) AS m12, sum(u2 * u2) AS m22, sum(rest) AS rest FROM u GROUP BY family),
q AS (SELECT family, count(DISTINCT g) AS questions FROM r GROUP BY family),
e AS (SELECT *, c / (c - 1) * (n - 1) / (n - 2) / (det * det) AS k FROM b JOIN m USING (family) JOIN q USING (family))
SELECT family, 'quantity' AS predictor, round(b1, 5) AS beta, round(sqrt(k * (zz * zz * m11 - 2 * zz * xz * m12 + xz * xz * m22)), 5) AS se_clustered, round(sqrt(zz / det * rest / (n - 2)), 5) AS se_naive, n AS observations, questions, c AS clusters, 2 AS rank FROM e
UNION ALL SELECT family, 'discount', round(b2, 5), round(sqrt(k * (xz * xz * m11 - 2 * xx * xz * m12 + xx * xx * m22)), 5), round(sqrt(xx / det * rest / (n - 2)), 5), n, questions, c, 2 FROM e""",
)
def _st12(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("family"), F.col("l_suppkey").alias("g"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("quantity"), (F.col("l_discount") * 100).alias("discount"))
    fitted = st.fixed_effect_table(rows, ["family"], "g", "y", ["quantity", "discount"])
    return fitted.select("family", "predictor", *(F.round(c, 5).alias(c) for c in ("beta", "se_clustered", "se_naive")), "observations", "questions", "clusters", "rank")


# Audits of candidates: three arms of four candidates for every document, some of them corrupted by the document's number

POOL = cd.Plan(("a", "b", "c"), initial=2, round_size=2, most=8, seed=5, end=31, cap=6)
CORRUPTED = [  # remainder of 50, rule, arm, index
    (1, "missing", "b", 2), (2, "duplicate", "a", 0), (3, "random_stream", "c", 3), (4, "identity", "a", 1), (5, "token_boundary", "b", 0), (6, "unfinished", "a", 2),
    (7, "token_accounts", "c", 1), (8, "unexpected", "a", 99), (9, "incomplete_round", None, 3),
]


def _text(x) -> str:
    return "NULL" if x is None else f"'{x}'"


@query(
    "au1_candidate_faults",
    " UNION ALL ".join(f"SELECT '{rule}' AS rule, CAST(doc_id AS VARCHAR) AS problem_id, CAST({_text(a)} AS VARCHAR) AS condition, CAST({i} AS INT) AS candidate_index FROM documents WHERE doc_id % 50 = {k}" for k, rule, a, i in CORRUPTED),
)
def _au1_faults(spark, d):
    """Every injected fault of the pool, and nothing else."""
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("problem_id"), F.sha2("text", 256).alias("question"), F.col("source").alias("answer"))
    arm, i, k = F.col("condition"), F.col("candidate_index"), F.col("doc_id") % 50
    at = lambda r, a, n: (k == r) & (arm == a) & (i == n)
    cells = docs.withColumn("condition", F.explode(F.array(*map(F.lit, "abc")))).withColumn("candidate_index", F.explode(F.when((k == 8) & (arm == "a"), F.array(*map(F.lit, (0, 1, 2, 3, 99)))).when((k == 2) & (arm == "a"), F.array(*map(F.lit, (0, 0, 1, 2, 3)))).otherwise(F.array(*map(F.lit, range(4))))))
    cells = cells.where(~at(1, "b", 2) & ~((k == 9) & (i == 3)))
    tokens = F.when(at(5, "b", 0), F.array(*map(F.lit, (2, 31, 3, 4, 5, 6)))).when(at(6, "a", 2), F.array(F.lit(2), F.lit(3))).when(i % 2 == 1, F.array(*map(F.lit, (2, 3, 31)))).otherwise(F.array(*map(F.lit, range(2, 8))))
    rows = cells.withColumn("token_ids", tokens).withColumn("ended", F.element_at("token_ids", -1) == 31)
    rows = rows.select(
        "problem_id", "condition", "candidate_index", F.when(at(4, "a", 1), "other").otherwise(F.col("question")).alias("question"), F.col("answer").alias("gold_answer"),
        (cd.expected_stream(5, i, F.col("problem_id")) + at(3, "c", 3).cast("int")).alias("seed"), "token_ids", F.size("token_ids").alias("output_token_count"),
        (F.size("token_ids") - F.col("ended").cast("int") + at(7, "c", 1).cast("int")).alias("generated_tokens"), (~F.col("ended")).alias("hit_max_new_tokens"),
    )
    return cd.candidate_faults(rows, docs.select("problem_id", "question", "answer"), POOL)


# Operators of pairs, records and audits that no other query applies


@query(
    "j11_replaced",
    """WITH o AS (SELECT o_orderkey, [o_orderkey % 5, o_custkey % 3] AS ids, o_orderkey % 4 = 0 AS capped, o_orderkey % 8 IN (0, 1) AS there, o_orderkey % 16 <> 0 AS goes_on FROM orders)
SELECT o_orderkey, capped AND there AS replaced, NOT (capped AND there) OR goes_on AS prefix_ok,
array_to_string(CASE WHEN capped AND there THEN CASE WHEN goes_on THEN list_append(ids, 7) ELSE [9, 9, 9] END ELSE ids END, ',') AS ids FROM o""",
)
def _j11(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", F.array(k % 5, F.col("o_custkey") % 3).alias("ids"), (k % 4 == 0).alias("capped"))
    longer = F.when(k % 16 != 0, F.concat("ids", F.array(F.lit(7).cast("long")))).otherwise(F.array(*[F.lit(9).cast("long")] * 3))
    done = pr.replaced(rows, rows.where((k % 8).isin(0, 1)).select("o_orderkey", longer.alias("ids")), "o_orderkey", "ids", "capped")
    return done.select("o_orderkey", "replaced", "prefix_ok", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(
    "j13_matched_control",
    """SELECT id, control FROM (SELECT c_custkey AS id, n_nationkey AS control, row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN n_nationkey % 7 = c_custkey % 7 THEN 0 ELSE 1 END, n_nationkey) AS r
FROM customer JOIN nation ON c_nationkey % 5 = n_nationkey % 5) WHERE r = 1""",
)
def _j13(spark, d):
    specs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 5).alias("block"), (F.col("c_custkey") % 7).alias("size"))
    controls = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 5).alias("block"), (F.col("n_nationkey") % 7).alias("size"))
    return pr.matched_control(specs, controls, ["block"], "size", "id").select("id", "control")


@query("ag18_surface_records", "SELECT l_orderkey, l_linenumber, round(ln(greatest(1, l_quantity - 10)), 6) AS log_length, round(l_tax, 6) AS student_nll FROM lineitem")
def _ag18(spark, d):
    rows = table(spark, d, "lineitem").withColumns({"completion_tokens": F.col("l_quantity") - 10, "student_loss_mean": F.col("l_tax")})
    return r6(ag.surface_record(rows).select("l_orderkey", "l_linenumber", "log_length", "student_nll"))


@query("ag20_blend", "SELECT l_orderkey, l_linenumber, round(0.25 * l_tax + 0.75 * l_discount, 6) AS score FROM lineitem")
def _ag20(spark, d):
    return r6(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ag.blend(F.col("l_tax"), F.col("l_discount"), 0.25).alias("score")))


@query("st20_safe_correlation", "SELECT l_orderkey, round(CASE WHEN stddev_pop(l_quantity) > 0 AND stddev_pop(l_linenumber) > 0 THEN corr(l_quantity, l_linenumber) ELSE 0.0 END, 6) + 0.0 AS r FROM lineitem GROUP BY 1")
def _st20(spark, d):
    return r6(table(spark, d, "lineitem").groupBy("l_orderkey").agg(st.safe_correlation("l_quantity", "l_linenumber").alias("r"))).withColumn("r", F.col("r") + 0.0)


@query(
    "au4_region_violations",
    "SELECT l_orderkey * 10 + l_linenumber AS key, CAST(l_quantity AS BIGINT) + l_linenumber AS regions, CAST(l_quantity AS BIGINT) + l_linenumber + 1 AS total FROM lineitem WHERE l_partkey % 7 = 0",
)
def _au4(spark, d):
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("key"), F.create_map(F.lit("body"), q, F.lit("suffix"), n).alias("by_region"), (q + n + (F.col("l_partkey") % 7 == 0).cast("int")).alias("total"))
    return au.region_violations(rows, "key", "by_region", "total")


@query(
    "au7_order_violations",
    "SELECT o_orderkey AS ordinal, o_custkey AS left_key, CASE WHEN o_orderkey % 100 = 3 THEN o_custkey + 1 END AS right_key FROM orders WHERE o_orderkey % 100 IN (3, 5)",
)
def _au7(spark, d):
    left = table(spark, d, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_custkey").alias("key"))
    right = left.where("ordinal % 100 != 5").withColumn("key", F.when(F.col("ordinal") % 100 == 3, F.col("key") + 1).otherwise(F.col("key")))
    return au.order_violations(left, right, "ordinal", "key")
