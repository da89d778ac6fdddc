from pyspark.sql import functions as F

from tracemill.operators import dedup, grading, ordering, select, stats

TRACE = "problem_id string, trace_id long, candidate_index int, solution string, solution_token_count long, is_correct boolean, hit_max_new_tokens boolean"


def traces(spark, tokens, problem="p", **more):
    rows = [(problem, i, i, f"text {i}", t, True, False) for i, t in enumerate(tokens)]
    return spark.createDataFrame(rows, TRACE)


def test_bands_of_ten(spark):
    got = {r["length_rank"]: r for r in select.quantile_bands(traces(spark, [10 * (i + 1) for i in range(10)])).collect()}
    assert {k: r["solution_token_count"] for k, r in got.items()} == {"short": 20, "medium": 50, "long": 90}
    assert not any(r["absolute_extreme"] for r in got.values())


def test_few_correct_problems_are_dropped(spark):
    t = traces(spark, [1, 2, 3])
    assert select.quantile_bands(t).count() == 0
    assert [r["problem_id"] for r in select.dropped_problems(t, select.quantile_bands(t)).collect()] == ["p"]


def test_roles_are_distinct(spark):
    for tokens, short, long in (([10 * (i + 1) for i in range(10)], 20, 90), ([5, 5, 5, 5], 5, 5)):
        t = traces(spark, tokens)
        got = select.four_roles(t, 7).join(t, "trace_id").collect()
        by = {r["role"]: r["solution_token_count"] for r in got}
        assert len({r["trace_id"] for r in got}) == 4 and by["quantile_short"] == short and by["quantile_long"] == long


def test_unique_keeps_the_first_of_equal_texts(spark):
    rows = [("p", 1, 0, " a  b", 3, True, False), ("p", 2, 1, "a b", 3, True, False), ("p", 3, 2, " ", 1, True, False), ("p", 4, 3, None, 1, True, False), ("p", 5, 4, "c", 1, False, False)]
    assert [r["trace_id"] for r in select.unique_correct(spark.createDataFrame(rows, TRACE)).collect()] == [1]


def test_water_filling(spark):
    got = {r["trace"]: r["quota"] for r in ordering.water_filled(spark.createDataFrame([(0, 2), (1, 10), (2, 10), (3, 10)], "t long, c long"), "t", "c", 20, 3).collect()}
    assert got[0] == 2 and sum(got.values()) == 20 and max(got.values()) - min(v for k, v in got.items() if k) <= 1


def test_exact_holdout():
    sizes = [2, 2, 1, 1, 3]
    assert sum(sizes[i] for i in ordering.exact_holdout(sizes, 4)) == 4


def test_components_and_near_matches(spark):
    pairs = spark.createDataFrame([("b", "c"), ("a", "b")], "l string, r string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    assert {r["id"]: r["component"] for r in dedup.component_ids(nodes, pairs, "id").collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}
    q = spark.createDataFrame([(1, "one two three four five six"), (2, "One two  three four five six"), (3, "other words"), (4, ""), (5, "")], "problem_id long, question string")
    got = {(r["query_id"], r["reference_id"]) for r in dedup.near_matches(q, q).collect()}
    assert got == {(1, 2), (2, 1), (4, 5), (5, 4)}


def test_adjusted_p_values(spark):
    df = spark.createDataFrame([(1, 0.03), (2, 0.001), (3, 0.02), (4, 0.8), (5, None)], "i int, p double")
    h = {r["i"]: round(r["p_holm"], 6) for r in stats.holm(df, "p").collect()}
    assert h == {2: 0.004, 3: 0.06, 1: 0.06, 4: 0.8, 5: 1.0}
    q = {r["i"]: round(r["q_value"], 6) for r in stats.benjamini_hochberg(df, "p").collect()}
    assert q == {2: 0.004, 3: 0.04, 1: 0.04, 4: 0.8, 5: 1.0}


def test_exact_tests():
    assert stats.mcnemar(0, 0) == 1 and abs(stats.mcnemar(8, 2) - 0.109375) < 1e-12
    assert stats.sign_test([1, 1, 1], 10, 0) == 0.25 and stats.sign_test([], 10, 0) == 1
    assert abs(stats.t_two_sided(2.228138852, 10) - 0.05) < 1e-9


def test_paired_effect(spark):
    rows = [(1, "q1", "short", 3.0), (1, "q1", "short", 5.0), (1, "q1", "long", 1.0), (1, "q2", "short", 4.0), (1, "q2", "long", 2.0)]
    got = stats.paired_features(spark.createDataFrame(rows, "feature_id int, problem_id string, label string, value double")).first()
    assert got["questions"] == 2 and got["effect"] == 2.5


def test_fixed_effects(spark):
    rows = [(g, 2.0 * x - 1.5 * z + o, float(x), float(z)) for g, o in ((1, 10), (2, -7), (3, 3)) for x, z in ((0, 0), (1, 0), (0, 1), (2, 3))] + [(9, 5.0, 1.0, 1.0)]
    got = stats.fixed_effects(spark.createDataFrame(rows, "g int, y double, x double, z double"), "g", "y", ["x", "z"])
    assert abs(got["beta"]["x"] - 2) < 1e-9 and abs(got["beta"]["z"] + 1.5) < 1e-9 and got["questions"] == 4 and got["clusters"] == 3


def test_answers(spark):
    cases = [("so #### 1,234.50.", "1234.5"), (r"thus \boxed{07}", "7"), ("Answer: -0.0", "0"), ("Final answer = $x + Y$", "x+y"), ("#### 3\n\\boxed{4}", "3"), ("none", None)]
    df = spark.createDataFrame(cases, "t string, want string")
    got = df.select("want", grading.normal_answer(grading.final_answer(F.col("t"))).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    assert grading.grade(r"\boxed{\frac{1}{2}}", "0.5") == (True, "graded") and grading.grade(r"\boxed{1", "1") == (False, "missing_box")
    assert grading.grade(r"\boxed{(1, 2)}", "(1,2)") == (True, "graded") and grading.grade(r"\boxed{x^2}", "5") == (False, "unparsed")
    assert grading.equal(r"\{2, 1\}", r"\{1,2\}", "set") and grading.equal("[1,2)", "[1,2]", "interval") is False and grading.equal("1:30 pm", "13:30", "clock")
