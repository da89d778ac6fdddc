from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tracemill.operators import answers as an, variants as va

WORKED = "Half is 48/2 = <<48/2=24>>24. Then 1,000+24=<<1000+24=1024>>1,024.\n#### 72"


def spelled(a, b, steps):
    return "".join(a[s[1] : s[2]] for s in steps), "".join(b[s[3] : s[4]] for s in steps)


@given(st.text("ab\n", max_size=12), st.text("ab\n", max_size=12))
@settings(max_examples=300, deadline=None)
def test_matching_is_longest(a, b):
    steps = va.matching(a, b)
    assert spelled(a, b, steps) == (a, b)
    assert all(a[s[1] : s[2]] == b[s[3] : s[4]] for s in steps if s[0] == "equal") and all(x[0] != y[0] for x, y in zip(steps, steps[1:]))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert sum(s[2] - s[1] for s in steps if s[0] == "equal") == best[-1][-1]


def test_variants_of_a_worked_answer():
    made = {v[0]: v for v in va.variants(WORKED)}
    base, bad = made["reference"][1], made["wrong_calculation"]
    assert base == "Half is 48/2 = 24. Then 1,000+24=1,024.\nAnswer: 72" and bad[1] == base.replace("= 24", "= 25", 1)
    assert bad[4] == ("48/2", "24", "25", 15, 17) and bad[1][15:17] == "25" and not bad[5]
    assert made["result_marker"][1] == base.replace("Answer", "Result") and made["no_marker"][1] == base.replace("Answer: ", "")
    assert made["neutral_note"][1].replace("Entry.", "Answer.", 1) == made["answer_note"][1]
    for v in made.values():
        assert spelled(base, v[1], v[3]) == (base, v[1])
    assert made["reference"][3] == [("equal", 0, len(base), 0, len(base))]


def test_only_exact_calculations_are_changed():
    wrong = lambda body: va.wrong_calculation(body)
    assert wrong("2+2=<<2+2=5>>5.") is None and wrong("2+2=<<2+2=4>> 4") is None and wrong("1/0=<<1/0=0>>0") is None and wrong("none") is None
    assert wrong("x=<<x=1>>1 a <<2+2=5>>5 b <<(1+2)*3.5=10.5>>10.5 c")[1:] == ("(1+2)*3.5", "10.5", 10, "10.6")
    assert wrong("<<9+0=9>>9")[0] == "0" and wrong("<<__import__('os')=1>>1") is None
    assert wrong("a <<1+1=2>>2 b <<3=3>>3 c")[0] == "a 3 b 3 c"


def test_rows(spark):
    rows = spark.createDataFrame([(1, WORKED), (2, None), (3, "no delimiter"), (4, "a #### b #### c"), (5, "####"), (6, WORKED)], "id long, answer string")
    got = va.reference_variants(rows, "answer").groupBy("id").agg(F.count("*").alias("n"), F.count("mutation").alias("m")).collect()
    assert {(r["id"], r["n"], r["m"]) for r in got} == {(1, 6, 1), (5, 5, 0), (6, 6, 1)}
    assert va.reference_variants(rows.limit(0), "answer").count() == 0


def test_steps_as_rows(spark):
    text = "One two three four. Five six seven eight.\nshort\nNine ten eleven twelve\nAnswer: 4"
    offsets, at = [], 0
    for w in text.split():
        at = text.index(w, at)
        offsets.append((at, at + len(w)))
        at += len(w)
    rows = [(1, text, offsets), (2, None, []), (3, "no answer", [(0, 2)]), (4, "Answer: 1", None)]
    df = spark.createDataFrame(rows, "id long, text string, o array<struct<start:int,end:int>>")
    got = [tuple(r) for r in va.step_rows(df, "text", "o", 4).orderBy("id", "index").drop("text", "o").collect()]
    assert got == [(1, *s) for s in an.reasoning_steps(text, offsets, 4)]
