import random
import re

from pyspark.sql import functions as F

from tracemill.operators import answers as an, regions as rg, variants as va

TEXTS = {
    1: "one  two\n\tthree \nAnswer: 42 tail", 2: None, 3: "", 4: " \n\t ", 5: "  lead", 6: "no heading here", 7: "Answer: first", 8: "\U0001f600 é Answer x\nfinal  answer : 7\nANSWER: 8",
    9: "word " * 20_000 + "Answer: 1", 10: "a\\b c1 the-cat the . , 9\nanswer: x",
}


def words(text):
    return [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^ \t\n\r]+", text or "")]


def docs(spark):
    return spark.createDataFrame([(k, t, 0, "x") for k, t in TEXTS.items()], "id long, text string, start int, region string")


def test_words_and_their_places(spark):
    got = docs(spark).select("id", rg.places(F.col("text")).alias("p"), rg.words(F.col("text")).alias("w")).collect()
    for r in got:
        assert r["p"] == (None if TEXTS[r["id"]] is None else [(a, b) for a, b, _ in words(TEXTS[r["id"]])])
        assert r["w"] == (None if TEXTS[r["id"]] is None else [w for *_, w in words(TEXTS[r["id"]])])
    assert docs(spark).limit(0).select(rg.places(F.col("text"))).count() == 0


def heading(text):
    return re.search(rg.HEADING, text or "", re.ASCII)


def test_first_heading(spark):
    got = docs(spark).select("id", rg.first_span(F.col("text"), rg.HEADING).alias("x")).collect()
    assert {r["id"]: r["x"] and tuple(r["x"]) for r in got} == {k: (m.start(), m.end()) if (m := heading(t)) else None for k, t in TEXTS.items()}
    one = docs(spark).select("id", rg.first_span(F.col("text"), "Answer:", r"\n").alias("x")).where("id = 1 or id = 7")
    assert [r["x"] for r in one.orderBy("id").collect()] == [(TEXTS[1].index("Answer"), TEXTS[1].index("Answer") + 7), None]


def test_regions(spark):
    text = F.col("text")
    for r in docs(spark).select("id", rg.regions(rg.places(text), rg.first_span(text, rg.HEADING)).alias("r")).collect():
        m = heading(TEXTS[r["id"]])
        want = [0 if m is None or b <= m.start() else 1 if a < m.end() else 2 for a, b, _ in words(TEXTS[r["id"]])]
        assert r["r"] == (None if TEXTS[r["id"]] is None else want)


def test_cover_by_many_spans(spark):
    pick = random.Random(2)
    rows = [(-1, None, [(0, 1)]), (-2, [(0, 3)], None), (-3, [], []), (-4, [(2, 5)], [(5, 9), (0, 2)]), (-5, [(2, 5)], [(3, 3)])]
    for k in range(30):
        tokens, at = [], 0
        for _ in range(pick.randint(0, 25)):
            a = at + pick.randint(0, 3)
            at = a + pick.randint(1, 4)
            tokens.append((a, at))
        rows.append((k, tokens, [(a, a + pick.randint(0, 12)) for a in (pick.randint(0, 60) for _ in range(pick.randint(0, 6)))] * pick.randint(1, 2)))
    pairs = "array<struct<start:int,end:int>>"
    got = spark.createDataFrame(rows, f"id long, t {pairs}, s {pairs}").select("id", rg.covered("t", "s").alias("c")).collect()
    assert {r["id"]: r["c"] for r in got} == {k: t if t is None else [any(x < b and y > a for x, y in s or []) for a, b in t] for k, t, s in rows}


def test_eligible_positions(spark):
    text = F.col("text")
    for body in (False, True):
        fit = rg.eligible_positions(rg.places(text), rg.words(text), rg.first_span(text, rg.HEADING), ["the"], tail=1, most=50, count=6, of_body=body)
        for r in docs(spark).select("id", fit.alias("p")).collect():
            t = TEXTS[r["id"]]
            m, every = heading(t), words(t)
            before = [m is None or b <= m.start() for _, b, _ in every]
            last = (sum(before) if body else len(every)) - 1
            want = [i for i, (_, _, w) in enumerate(every) if before[i] and i < last and i < 50 and "\\" not in w and any(c.isalnum() for c in w) and "the" not in re.findall("[a-z]+", w.lower())]
            assert (r["p"] or []) == want[:6]


def test_steps_of_documents(spark):
    """The steps of whole documents are those of the plain function."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.concat("text", F.lit("\nAnswer: 1")).alias("text"))
    got = sorted(tuple(r) for r in va.step_rows(rows.withColumn("o", rg.places(F.col("text"))), "text", "o").drop("text", "o").collect())
    want = [(r["doc_id"], *s) for r in rows.collect() for s in an.reasoning_steps(r["text"], [w[:2] for w in words(r["text"])])]
    assert got == sorted(want)
