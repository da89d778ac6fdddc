import random

from pyspark.sql import functions as F

from tracemill.llm import lines

SCHEMA = "doc_id long, text string, h string, doc int, n_dropped int"


def brute(rows, least=20, documents=3):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(lines.BLANKS))
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(doc)
    last = {k: max(d, key=lambda x: (x is not None, x or 0)) for k, d in holders.items() if len(d) >= documents}
    made = []
    for doc, text in rows:
        said = (text or "").split("\n")
        kept = [x for x in said if key(x) not in last or last[key(x)] == doc]
        made.append((doc, len(said), len(said) - len(kept), "\n".join(kept)))
    return sorted(made, key=str)


def found(docs, **how):
    rows = lines.drop_shared_lines(docs, **how).collect()
    for r in rows:  # the bitmap's runs are whole, in order and apart
        ends = [(x["at"], x["at"] + x["n"]) for x in r["dropped"]]
        assert sum(b - a for a, b in ends) == r["n_dropped"] and all(x[1] < y[0] for x, y in zip(ends, ends[1:]))
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in rows), key=str)


def made(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 7, 5) for i, t in rows], SCHEMA).repartition(parts)


def test_against_brute_force(spark):
    pick = random.Random(4)
    pool = ["a shared line of some length", "  A Shared Line OF some length\t", "Ünïcode Zeilen sind auch dabei ÄÖ", "short", "", "twenty code points!!!", "\x0b line with odd blanks and words\r"]
    rows = []
    for k in range(120):
        said = [pick.choice(pool) if pick.random() < 0.6 else f"own line {pick.random()} of document" for _ in range(pick.randint(0, 8))]
        rows.append((pick.choice([k, k, k, k // 2, None]), pick.choice(["\n".join(said)] * 5 + [None, "", "\n\n"])))
    rows += rows[:10]
    assert found(made(spark, rows)) == brute(rows)
    assert found(made(spark, rows), documents=2, least=5) == brute(rows, 5, 2)


def test_one_key_in_a_third_of_all_rows(spark):
    """The hot key fills several ranges, and is decided across them."""
    rows = [(k, "\n".join(["the one line that everybody has"] * 5 + [f"a line of its own, number {k}-{j}" for j in range(6)])) for k in range(600)]
    docs = made(spark, rows, 8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(docs) == brute(rows)
        ranged = lines._lines(lines._named(docs, "doc_id", "text"), 20).repartitionByRange("h", "g", F.col("doc").desc_nulls_last(), "pos")
        held = ranged.select("h", F.spark_partition_id().alias("range")).groupBy("h").agg(F.count("*").alias("n"), F.count_distinct("range").alias("ranges"))
        hot = held.orderBy(F.desc("n")).first()
        assert hot["n"] == 3000 and hot["ranges"] > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_few_documents_and_ties(spark):
    two = [(1, "this line stands in two documents"), (2, "this line stands in two documents"), (2, "this line stands in two documents")]
    assert found(made(spark, two)) == brute(two) and all(r[2] == 0 for r in brute(two))
    nulls = [(None, "this line stands in three of them")] * 2 + [(1, "this line stands in three of them"), (-5, "This line stands in three of them\nx\nTHIS line stands in three of them ")]
    assert found(made(spark, nulls)) == brute(nulls)
    assert [r[2] for r in brute(nulls)] == [2, 0, 1, 1]


def test_long_text_and_no_rows(spark):
    long = "\n".join(["a line that is repeated in here"] * 40_000 + ["x" * 500_000])
    rows = [(1, long), (2, long), (3, "a line that is repeated in here")]
    assert found(made(spark, rows)) == brute(rows)
    assert found(made(spark, rows).limit(0)) == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
