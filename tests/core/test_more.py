import pytest
from pyspark.sql import functions as F

from tracemill.operators import audit, budget, lineage, ordering, pairing
from tracemill.streaming.reservoir import BottomK


def test_greedy_passes_over_what_does_not_fit():
    rows = [{"problem_id": i, "trace_id": i, "n": n} for i, n in enumerate([5, 9, 3, 2])]
    assert [r["n"] for r in budget.greedy_subset(rows, 10, "n")] == [5, 3, 2]
    got = budget.repeated_schedule(rows, 40, "n", 1, "s")
    assert 38 < sum(r["n"] for r in got) <= 40


def test_fold_equals_loop(spark):
    df = spark.createDataFrame([([{"n": n} for n in (5, 9, 3, 2)], 10)], "rows array<struct<n:long>>, target long")
    assert df.select(budget.fitting_fold(F.col("rows"), F.col("target"), "n").alias("k")).first()["k"] == [0, 2, 3]


def test_schedules(spark):
    rows = [(f"p{i}", 10 * i + k, 4 + 3 * k + i, arm) for i in range(5) for k, arm in enumerate(("short", "medium", "long"))]
    df = spark.createDataFrame(rows, "problem_id string, trace_id long, solution_token_count long, length_rank string")
    got = budget.schedules(df, 3).groupBy("regime", "length_rank").agg(F.sum("tokens").alias("t")).collect()
    most = max(r["t"] for r in got if r["regime"] == "equal_rows")
    assert all(r["t"] <= most for r in got) and len(got) == 9


def test_step_choice():
    assert budget.best_steps([5, 5, 10], [1.0, 2.0, 2.5], 10, 0.0) == [0, 1]
    assert budget.best_steps([3], [1.0], 10, 0.1) is None


def test_cap_view(spark):
    df = spark.createDataFrame([([2, 3, 31],)], "ids array<int>")
    a, b = df.select(budget.cap_view(F.col("ids"), 2, 31).alias("a"), budget.cap_view(F.col("ids"), 3, 31).alias("b")).first()
    assert a["hit"] and not b["hit"] and b["ids"] == [2, 3]


def test_audits(spark):
    rows = spark.createDataFrame([("p", 0), ("p", 0), ("p", 2), ("q", 0), ("q", 1)], "problem_id string, i int")
    got = {tuple(r) for r in audit.grid_violations(rows, "problem_id", "i", [0, 1]).collect()}
    assert got == {("missing", "p", 1), ("unexpected", "p", 2), ("duplicate", "p", 0)}
    nodes = spark.createDataFrame([("a", 0), ("b", 1)], "key string, ordinal int")
    assert audit.topology_violations(nodes, spark.createDataFrame([("a", "b"), ("b", "a")], "key string, parent string")).collect()[0]["key"] == "a"
    m = spark.createDataFrame([("x",), ("y",), ("z",)], "path string")
    e = spark.createDataFrame([("x", "y"), ("y", "x")], "parent string, path string")
    assert [r["path"] for r in audit.unreachable(m, e, m.where("path = 'x'")).collect()] == ["z"]


def test_lookup_fails_on_missing_and_repeated_keys(spark):
    facts, table = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert pairing.lookup(facts, table, "k").count() == 2
    for bad in (table.where("k = 1"), table.unionByName(table)):
        with pytest.raises(Exception, match="key without one row"):
            pairing.lookup(facts, bad, "k").collect()


def test_seal_finds_a_change(tmp_path):
    f = tmp_path / "a"
    f.write_text("x")
    lineage.seal(str(tmp_path / "seal"), [str(f)])
    assert lineage.broken(str(tmp_path / "seal")) == []
    f.write_text("y")
    assert lineage.broken(str(tmp_path / "seal")) == [str(f)]


def test_stream_reservoir_equals_batch(spark):
    df = spark.range(200).withColumn("p", ordering.digest(1, F.col("id")))
    keep = BottomK(10, "p", "id")
    for i, part in enumerate(df.randomSplit([1.0, 1.0, 1.0], 4)):
        keep(part, i)
        keep(part, i)
    got = [r["id"] for r in spark.read.parquet(keep.path).orderBy("p").collect()]
    assert got == [r["id"] for r in df.orderBy("p").limit(10).collect()]
