from itertools import product
from statistics import mean, stdev

import pytest

import __spark_entry__ as entry
from tracemill.operators import dedup


def test_triangles_of_all_customers(spark, tmp_path):
    rows = [(k, k * 7 % 5) for k in range(1, 1200)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey long").write.parquet(str(tmp_path / "customer.parquet"))
    got = sorted(map(tuple, entry.queries()["j10_triangles_all"](spark, str(tmp_path)).collect()))
    places: dict = {}
    for k, n in rows:
        places.setdefault((n, k // 75), ([], [], []))[k % 3].append(k)
    assert got == sorted(t for sides in places.values() for t in product(*sides))
    assert len({k for t in got for k in t}) == len(rows)


def test_matches_under_compatibility_and_folding(spark):
    schema = "problem_id string, question string, ordinal long"
    words = "die grosse strasse ist offen und der fisch schwimmt im wasser"
    wide = "".join(chr(ord(c) + 0xFEE0) if c != " " else c for c in words)
    folded = words.replace("ss", "\u00df", 1).replace("fi", "\ufb01")
    train = spark.createDataFrame([("a", words, 0), ("b", wide, 1), ("c", folded, 2), ("d", "ganz andere worte stehen hier drin", 3)], schema)
    near = {(r["query_id"], r["reference_id"]) for r in dedup.near_matches(train, train).collect()}
    assert near == {(x, y) for x, y in product("abc", "abc") if x != y}
    assert dedup.exact_overlap(train, train).count() == 10
    kept, gone = dedup.isolate(train, train.where("problem_id = 'b'"), 7)
    assert [r["problem_id"] for r in kept.collect()] == ["d"]
    assert {(r["problem_id"], r["reason"]) for r in gone.collect()} == {(i, "history_test_or_duplicate_exact") for i in "abc"}


def test_intervals_of_all_seeds(spark, tmp_path):
    rows = [("A", "F", seed, supplier, 0.0, float(seed * seed + supplier)) for seed in range(1, 8) for supplier in range(4)]
    schema = "l_returnflag string, l_linestatus string, l_linenumber int, l_suppkey long, l_discount double, l_quantity double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    (got,) = entry.queries()["st18_seed_groups"](spark, str(tmp_path)).collect()
    groups = [mean(r[5] for r in rows if r[2] % 3 == g) for g in range(3)]
    half = 4.3026527299 * stdev(groups) / 3**0.5
    assert got["n"] == 3 and [got["mean"], got["sd"]] == pytest.approx([mean(groups), stdev(groups)], abs=1e-5)
    assert [got["low"], got["high"]] == pytest.approx([mean(groups) - half, mean(groups) + half], abs=1e-5)
