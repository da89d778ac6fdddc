import json

from tracemill.operators import layouts as ly

WORKED = ly.Layout(question=("$.question",), answer=(("$.answer", "final_answer"),), reference="$.answer")
CHOICE = ly.Layout(question=("$.question", "$.options"), answer=(("$.correct", "as_is"),), reference="$.rationale")
SCOPED = ly.Layout(
    question=("$.q",), answer=(("$.final[0]", "as_is"),), reference="$.solution", unique_id="$.id", scope={"$.modality": "Text-only", "$.meta.language": "English"}, absent=("$.image_1", "$.image_2"),
    details={"answer_type": "$.type", "tolerance": "$.error"},
)
BOXED = ly.Layout(question=("$.problem",), answer=(("$.answer", "as_is"), ("$.solution", "box")), reference="$.solution")


def adapted(spark, layout, rows):
    texts = [(i, r if r is None or isinstance(r, str) else json.dumps(r), "x", "y") for i, r in enumerate(rows)]
    df = spark.createDataFrame(texts, "source_index long, row string, v string, rejected string")
    return {r["source_index"]: r for r in ly.adapted(df, "set", layout).collect()}


def test_worked_and_boxed_answers(spark):
    got = adapted(spark, WORKED, [{"question": "q?", "answer": "so 4 #### 1,234."}, {"question": " ", "answer": "#### 1"}, {"question": "q?", "answer": "none"}, {"question": "q?"}])
    assert (got[0]["problem_id"], got[0]["question"], got[0]["answer"], got[0]["reference_solution"], got[0]["rejected"]) == ("set-00000", "q?", "1,234", "so 4 #### 1,234.", None)
    assert [got[i]["rejected"] for i in (1, 2, 3)] == ["missing_question", "missing_answer", "missing_answer"]
    got = adapted(spark, BOXED, [{"problem": "p", "solution": r"\boxed{\frac{1}{2}}", "answer": None}, {"problem": "p", "solution": r"\boxed{3}", "answer": " 4"}, {"problem": "p", "solution": "x", "answer": ""}])
    assert [got[i]["answer"] for i in range(3)] == [r"\frac{1}{2}", " 4", None] and got[2]["rejected"] == "missing_answer"


def test_lists_and_numbers(spark):
    got = adapted(spark, CHOICE, [{"question": "q", "options": ["A) 1", "B) 2"], "correct": "B"}, {"question": "q", "options": [], "correct": 7.5}])
    assert (got[0]["question"], got[0]["answer"], got[0]["reference_solution"]) == ("q\nA) 1\nB) 2", "B", None)
    assert got[1]["question"].rstrip("\n") == "q" and got[1]["answer"] == "7.5"


def test_scope(spark):
    fit = {"q": "q", "final": ["3", "4"], "solution": "s", "id": 12, "modality": "Text-only", "meta": {"language": "English"}, "image_1": None, "type": "Numerical", "error": 0.1}
    got = adapted(spark, SCOPED, [fit, fit | {"modality": "Multimodal"}, fit | {"meta": {}}, fit | {"image_2": "data"}, fit | {"final": []}, fit | {"image_1": ""}, fit | {"q": None}])
    assert [got[i]["rejected"] for i in range(7)] == [None, "outside_scope", "outside_scope", "unexpected_content", "missing_answer", None, "missing_question"]
    assert (got[0]["answer"], got[0]["source_unique_id"], got[0]["details"]) == ("3", "12", {"answer_type": "Numerical", "tolerance": "0.1"})


def test_malformed_rows_keep_their_place(spark):
    got = adapted(spark, WORKED, ['{"question": ', None, "[1]", "7", "null", '{"question": "q", "answer": "#### 1"}'])
    assert [got[i]["rejected"] for i in range(6)] == ["malformed"] * 5 + [None] and [got[i]["problem_id"] for i in (0, 5)] == ["set-00000", "set-00005"]
    both = ly.union_of_layouts({n: (spark.createDataFrame([(0, "{}")], "source_index long, row string"), layout) for n, layout in (("a", WORKED), ("b", SCOPED))})
    assert {(r["dataset"], r["rejected"]) for r in both.collect()} == {("a", "missing_question"), ("b", "outside_scope")}
