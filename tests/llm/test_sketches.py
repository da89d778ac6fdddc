import hashlib
import random

from pyspark.sql import functions as F

from tracemill.llm import sketches

SCHEMA = "doc_id long, text string, place string"


def plain(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: -(1 << 64) if r[0] is None else r[0], reverse=True)
    dice = lambda a, b: 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))
    lines = lambda t: {x for x in t.split("\n") if x}
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), round(dice(lines(t), lines(new)), 9), round(dice(lines(t), lines(after)), 9)))
    return sorted(out, key=str)


def test_against_sets(spark):
    pick = random.Random(2)
    line = lambda: "".join(pick.choice("abé 😀") for _ in range(pick.randint(0, 12)))
    rows = [(i * 3, "\n".join(line() for _ in range(pick.choice([0, 1, 5, 30, 150])))) for i in range(60)]
    rows += [(500, None), (501, ""), (None, "a\nb"), (502, "\n".join(map(str, range(4000)))), (503, "\n".join(map(str, range(2000, 6000)))), (504, rows[5][1])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = sketches.fingerprint_edits(df).collect()
    seen = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got), key=str)
    assert seen == plain(rows)
    by = {r["doc_id"]: r["fingerprint"] for r in got}
    assert by[504] == by[15] and len(set(by.values())) > 50 and len(by[15]) == sketches.CELLS * 28
    assert sketches.fingerprint_edits(df.limit(0)).count() == 0
    one = sketches.fingerprint_edits(df.where("doc_id = 503")).first()
    assert one["near_next"] == 1.0


def test_peeling_recovers_the_digests(spark):
    rows = [(k, list(range(k)), list(range(k // 2, k + 3))) for k in (0, 1, 9, 40, 700)]
    df = spark.createDataFrame(rows, "k int, l array<long>, r array<long>").select(
        "k", *(F.transform(c, lambda x: F.xxhash64(x)).alias(n) for c, n in (("l", "left"), ("r", "right")))
    )
    got = sketches.differences(df, "k").groupBy("k").agg(F.flatten(F.collect_list("plus")).alias("p"), F.flatten(F.collect_list("minus")).alias("m"))
    want = {r["k"]: (set(r["left"]) - set(r["right"]), set(r["right"]) - set(r["left"])) for r in df.collect()}
    for r in got.collect():
        assert (set(r["p"]), set(r["m"])) == want[r["k"]] and len(r["p"]) == len(want[r["k"]][0])
