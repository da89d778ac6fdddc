from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tracemill.operators import answers as an, budget, cohort as co, gates as ga, grading as gr, pairing as pr


@pytest.mark.parametrize(
    ("text", "want"),
    [("a \\boxed{3} b \\fbox{ x{\\{}y }", "x{\\{}y"), ("\\box{3}", None), ("\\fboxed{3}", None), ("\\boxed{3", None), (None, None), ("\\boxed {2}", "2")],
)
def test_last_box(text, want):
    assert gr.last_box(text) == want


@pytest.mark.parametrize(
    ("text", "want"), [("1,2;3", ["1", "2", "3"]), ("(1,2), [3,4)", ["(1,2)", "[3,4)"]), (r"1\,000, 2", [r"1\,000", "2"]), (r"\{1,2\},3", [r"\{1,2\}", "3"]), (r"a\\,b", [r"a\\", "b"])]
)
def test_split_outside(text, want):
    assert gr.split_outside(text) == want


@pytest.mark.parametrize("text", ["(1,2", "1)", "1,,2", "1,", ""])
def test_split_outside_rejects(text):
    with pytest.raises(ValueError):
        gr.split_outside(text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Answer: 1,250 miles", ("1,250", "first_explicit_answer_quantity")), ("#### 12", ("12", "first_explicit_answer_quantity")), ("Answer: 3 to 5", (None, "non_scalar_answer_expression")),
        ("Answer: 3 or $5", (None, "explicit_numeric_alternatives")), ("Answer:\n\n 1.5e3 x", ("1.5e3", "first_explicit_answer_quantity")), ("Answer: 1 2/3", ("1", "first_explicit_answer_quantity")),
        ("Answer: x2", (None, "missing_answer_quantity")), (None, (None, "missing_final_answer")), ("**Answer**: 2 / 3", ("2 / 3", "first_explicit_answer_quantity")),
    ],
)
def test_explicit_quantity(text, want):
    assert an.explicit_quantity(text) == want


def test_triage_and_truncation(spark):
    assert an.triage("  ") == ("invalid", None, "empty_response", None)
    assert an.triage("Answer: 4, that is 4.0")[:3] == ("automatic", "4", "single_distinct_quantity_in_answer_sentence")
    assert an.triage("Answer: not 4")[2] == "prose_with_multiple_quantities"
    rows = [("we go on", True), ("we go on", False), ("the answer is 4", True), ("\\boxed{4}", True), ("", True), (None, True), ("we go on", None)]
    df = spark.createDataFrame(rows, "t string, c boolean")
    assert [r[0] for r in df.select(an.truncated_without_answer(F.col("t"), F.col("c"))).collect()] == [True, False, False, False, False, False, False]


@pytest.mark.parametrize(
    ("gold", "said", "asked", "want"),
    [
        ("(1,3]", "(1,2]\\cup(2,3]", "interval", True), ("(1,3)", "(1,2)\\cup(2,3)", "interval", False), ("[1,2]", "[1,2]\\cup\\{2\\}", "", True), ("(-\\infty,0)", "(-\\infty,0)", "", True),
        ("(1,2)", "(1,2]", "domain", False), ("(1,2)", "(1.0,4/2)", "", True), ("\\frac{1}{2}", "0.5", "", True), ("1.5e3", "1500", "", True), ("C", "(c)", "which letter", True),
        ("1F_{16}", "1f", "hexadecimal", True), ("1F_{16}", "1f_8", "hexadecimal", False), ("09:05", "9:05", "time", True), ("09:05", "25:05", "time", False), ("(1,2),(3,4)", "(3,4),(1,2)", "", True),
        ("(1,2),(3,4)", "(3,4),(1,2)", "in increasing order", False), ("x+1", "x + 1", "", True), ("x+1", "1+x", "", False), ("\\sqrt{2}", "2", "", False),
    ],
)
def test_typed_grades(gold, said, asked, want):
    assert an.typed_grade(f"so \\boxed{{{said}}}", an.compile_spec(gold, question=asked))[0] is want


def test_tolerances_and_lists():
    near = {"gsm8k_hard": ("0.01", "0.001"), "olympiadbench": ("0.1", "0")}
    hard = lambda gold, said: an.typed_grade(f"\\boxed{{{said}}}", an.compile_spec(gold, "gsm8k_hard", tolerances=near))[0]
    assert hard("2.5", "2.505") and not hard("2.5", "2.6") and not hard("2", "2.001")
    many = an.compile_spec("1,2", "olympiadbench", answer_type="Numerical", multiple=True, tolerances=near)
    assert an.typed_grade("\\boxed{x=2.05,1}", many)[0] and not an.typed_grade("\\boxed{1,1}", many)[0]
    assert an.typed_grade("\\boxed{\\pm 2}", an.compile_spec("2,-2", "olympiadbench", answer_type="Numerical", multiple=True))[0]
    assert an.typed_grade("no box", many)[1] == "missing_final_box" and an.typed_grade("\\boxed{1,,2}", many)[1] == "grading_error"


def test_reviewed_definitions():
    said = lambda text, values, mode, kind="symbolic", **more: an.reviewed_grade(f"\\boxed{{{text}}}", an.validate_definition(values, mode, kind, **more), mode)[:2]
    assert said("4, 4.0", ["4"], "single") == (True, "graded") and said("4,5", ["4"], "single") == (False, "graded")
    assert said("5", ["4", "5"], "any") == (True, "graded") and said("4,5", ["4", "5"], "any") == (False, "several_values")
    assert said("2,1", ["1", "2"], "all") == (True, "graded") and said("2,1", ["1", "2"], "all", ordered=True) == (False, "graded")
    assert said("30\\%", ["30"], "single", "percentage")[0] and said("45^\\circ", ["45"], "single", "degree")[0] and said("370", ["10"], "single", "periodic", period="360")[0]
    assert said("5\\text{ km}", ["5"], "single", units={"km": ["kilometers"]})[0] and not said("5 miles", ["5"], "single", units={"km": []})[0]
    assert said("\\text{New  York}", ["new york"], "single", "text")[0] and said("(1,2)", ["(1,2)"], "single", "vector")[0]
    for bad in ((["1", "2"], "single", "symbolic"), ([], "any", "symbolic"), (["1"], "best", "symbolic"), (["1"], "any", "periodic"), (["zz top"], "all", "clock")):
        with pytest.raises(ValueError):
            an.validate_definition(*bad)
    assert an.number("2\\cdot10^{3}") == Fraction(2000)


def test_regrading_is_done_once(spark):
    done = an.regraded(spark.createDataFrame([(1, True)], "id long, ok boolean"), {"ok": F.lit(False)}, "id")
    assert done.first()["historical_grading"]["ok"] is True and done.first()["ok"] is False
    with pytest.raises(ValueError):
        an.regraded(done, {"ok": F.lit(True)}, "id")


def test_steps(spark):
    text = "One two three four. Five six seven eight.\nshort\nNine ten eleven twelve\nAnswer: 4"
    offsets, at = [], 0
    for w in text.split():
        at = text.index(w, at)
        offsets.append((at, at + len(w)))
        at += len(w)
    steps = an.reasoning_steps(text, offsets, 4)
    assert [text[a:b].split()[0] for _, a, b, *_ in steps] == ["One", "Five", "Nine", "Answer:"] and [s[5] for s in steps] == [False, False, False, True]
    assert [s[3:5] for s in steps] == [(0, 4), (4, 9), (9, 13), (13, 15)]
    with pytest.raises(ValueError):
        an.reasoning_steps("no mark here", [(0, 2)], 2)
    df = spark.createDataFrame([("t", text, [{"start": a, "end": b} for a, b in offsets])], "id string, text string, o array<struct<start:int,end:int>>")
    assert [r["token_start"] for r in an.step_table(df, "id", "text", "o", 4).orderBy("index").collect()] == [0, 4, 9, 13]


def test_step_budget_ties_and_weights(spark):
    assert budget.best_steps([4, 5], [1.0, 1.0], 5, 0.2) == [1] and budget.best_steps([5, 5], [1.0, 1.0], 5, 0.0) == [0]
    df = spark.createDataFrame([(6, [(0, 2, False), (2, 3, False), (3, 5, True)])], "n int, s array<struct<start:int,end:int,is_answer:boolean>>")
    assert df.select(budget.step_weights(F.col("n"), F.col("s"), 4.0)).first()[0] == [1.0, 1.0, 2.0, 1.0, 1.0, 0.0]
    bad = spark.createDataFrame([("t", 0, 3, 1.0, 10)], "trace_id string, index long, tokens long, score double, target long")
    with pytest.raises(Exception, match="no whole steps"):
        budget.step_choice(bad, 0.1).collect()


def test_roles_keep_components_whole(spark):
    sizes = [3, 1, 2, 5, 1, 4, 2, 2]
    rows = [(f"p{c}_{k}", c) for c, n in enumerate(sizes) for k in range(n)]
    df = spark.createDataFrame(rows, "problem_id string, component long")
    got = {r["problem_id"]: r["role"] for r in co.assign_roles(df, df.where("problem_id = 'p0_1'"), {"dev": 6, "test": 4}, 1).collect()}
    assert len(got) == len(rows) and all(got[f"p0_{k}"] == "dap_development_reserved" for k in range(3))
    assert sum(r == "dev" for r in got.values()) == 6 and sum(r == "test" for r in got.values()) == 4
    assert all(len({got[f"p{c}_{k}"] for k in range(n)}) == 1 for c, n in enumerate(sizes))
    with pytest.raises(ValueError):
        co.assign_roles(df, df.limit(0), {"dev": 100}, 1)


def test_feature_gate(spark):
    columns = "feature_id long, clean_d double, adjusted_d double, early_d double, clean_p double, adjusted_p double, early_p double, clean_q double, adjusted_q double, prevalence double"
    row = lambda i, d, **k: (i, d, d, d, 0.001, 0.002, 0.01, k.get("q", 0.01), 0.01, k.get("prevalence", 0.5))
    dev = spark.createDataFrame([row(1, 0.9), row(2, -0.8), row(3, 0.7), row(4, 0.6), row(5, 0.9, q=0.2), row(6, 0.9, prevalence=0.001), row(7, 0.1)], columns)
    test = spark.createDataFrame([row(1, 0.5), row(2, 0.5), row(3, 0.05), row(4, 0.5), row(5, 0.5), row(6, 0.5), row(7, 0.5)], columns)
    shares = spark.createDataFrame([(1, 0.1), (2, 0.9), (3, 0.1), (4, 0.1)], "feature_id long, share double")
    got = {r["feature_id"]: (r["direction"], r["reasons"], r["passed"]) for r in ga.feature_gate(dev, test, shares, 2).collect()}
    assert got == {
        1: ("short", [], True), 3: ("short", ["confirmation_direction_or_effect"], False),
        2: ("long", ["confirmation_direction_or_effect", "early_replication", "single_token_concentration"], False),
    }


def test_confirmation_by_signs_and_counts(spark):
    rows = [("hit", float(k < 9), 0.0) for k in range(10)] + [("length", float(k), 0.0) for k in range(1, 6)] + [("length", None, 1.0)]
    got = {r["metric"]: r for r in ga.confirmation_tests(spark.createDataFrame(rows, "metric string, left_value double, right_value double"), "metric", ["hit"]).collect()}
    assert got["hit"]["p"] == pytest.approx(2 / 2**9) and got["length"]["p"] == pytest.approx(2 / 32) and got["length"]["n"] == 5
    assert got["hit"]["p_holm"] == pytest.approx(4 / 2**9) and got["length"]["p_holm"] == pytest.approx(2 / 32)


def test_step_calibration(spark):
    rows = [("r", s, k, float(k * (1 if s < 3 else -1)), float(k)) for s in (1, 2, 3) for k in range(1, 6)]
    got = {r["step"]: r for r in ga.step_calibration(spark.createDataFrame(rows, "r string, step int, k int, a double, p double"), "r", "step", "k", "a", "p").collect()}
    assert got[1]["adjacent_rho"] is None and got[2]["adjacent_rho"] == pytest.approx(1) and got[3]["adjacent_rho"] == pytest.approx(-1)
    assert got[1]["sign_agreement"] == 1 and got[3]["sign_agreement"] == 0 and got[3]["median_error"] == 2


def test_stable_matches(spark):
    pairs = spark.createDataFrame([(1, 10, 0.9), (2, 20, 0.8), (3, 30, 0.8)], "left_id long, right_id long, cosine double")
    left = spark.createDataFrame([(i, k, float(k)) for i in (1, 2, 3) for k in range(4)], "id long, k long, v double")
    right = spark.createDataFrame([(i, k, float(s * k)) for i, s in ((10, 2), (20, -1), (30, 0)) for k in range(4)], "id long, k long, v double")
    assert [r["left_id"] for r in pr.stable_matches(pairs, left, right, 0.5).collect()] == [1]
