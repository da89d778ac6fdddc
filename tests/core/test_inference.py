import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.operators import pairing, scan, stats


def plain(ps, up):
    """Holm or Benjamini-Hochberg in plain Python."""
    good = [i for i, p in enumerate(ps) if p is not None and not math.isnan(p)]
    order, m = sorted(good, key=lambda i: ps[i]), len(good)
    out, run = [1.0] * len(ps), 1.0 if up else 0.0
    if up:
        for r in range(m, 0, -1):
            run = min(run, m * ps[order[r - 1]] / r)
            out[order[r - 1]] = min(1.0, run)
    else:
        for r in range(1, m + 1):
            run = max(run, (m - r + 1) * ps[order[r - 1]])
            out[order[r - 1]] = min(1.0, run)
    return out


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_adjustments_over_many_ranges(spark, many_ranges):
    pick = random.Random(8)
    rows = [(k, None if pick.random() < 0.05 else math.nan if pick.random() < 0.05 else pick.choice([0.5, 1e-5, pick.random() ** 4]), pick.choice(["a", "a", "a", "b", None]), 1) for k in range(900)]
    rows += [(1000 + k, 1e-4, "a", 1) for k in range(500)]  # one value fills several ranges
    df = spark.createDataFrame(rows, "k long, p double, f string, __n int").repartition(7)
    ranks = scan.ranked_ranges(df.where("p is not null and not isnan(p)"), "p", ("f",))
    assert ranks.where("f = 'a'").select("__range").distinct().count() > 1
    for f, up, name in ((stats.holm, False, "p_holm"), (stats.benjamini_hochberg, True, "q_value")):
        one = {r["k"]: r[name] for r in f(df, "p").collect()}
        assert np.allclose([one[r[0]] for r in rows], plain([r[1] for r in rows], up), rtol=1e-12)
        by = {r["k"]: r[name] for r in f(df, "p", "f").collect()}
        for family in ("a", "b", None):
            own = [r for r in rows if r[2] == family]
            assert np.allclose([by[r[0]] for r in own], plain([r[1] for r in own], up), rtol=1e-12)
    assert stats.holm(df.limit(0), "p").count() == 0


def test_mcnemar_of_many_pairs():
    for w, l in ((0, 0), (8, 2), (5, 5), (0, 40), (1, 1), (300, 250)):
        n, k = w + l, min(w, l)
        exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
        assert stats.mcnemar(w, l) == pytest.approx(exact, rel=1e-10)
    assert stats.mcnemar(500_500, 499_500) == pytest.approx(2 * 0.5 * math.erfc((1000 - 1) / 1000 / math.sqrt(2)), rel=1e-4)


def test_crossed_draws_are_not_broadcast(spark):
    """Rows by draw look to Spark as few as those they are exploded from."""
    rows = spark.range(4000).select((F.col("id") % 2).alias("c"), (F.floor(F.col("id") / 2) % 4).alias("s"), F.floor(F.col("id") / 8).alias("q"), F.col("id").cast("double").alias("e"))
    draws = stats.crossed_draws(rows, ["c"], "s", "q", "e", 50, 3)
    assert len(draws.collect()) == 100
    lines = draws._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    assert any("Generate" in line for line in lines)
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            below = []
            for other in lines[k + 1 :]:
                if len(other) - len(other.lstrip(" :+-")) <= depth:
                    break
                below.append(other)
            assert not any("Generate" in x for x in below)


def test_cells_and_arms_are_not_broadcast(spark):
    """Packed, they look small enough; joined by merging, they do not pass through the driver."""
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("arm"), (F.floor(F.col("id") / 2) % 4).alias("s"), F.floor(F.col("id") / 8).alias("q"), F.col("id").alias("v"))
    cells = pairing.paired(rows, "arm", "a", "b", ["s", "q"], "v").withColumn("c", F.floor(F.col("q") % 2))
    draws = stats.crossed_draws(cells, ["c"], "s", "q", "effect", 50, 3)
    assert [r["mean"] for r in draws.collect()] == [-1.0] * 100
    lines = draws._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    assert any("SortMergeJoin" in line for line in lines) and not any("BroadcastHashJoin" in line for line in lines)


def test_effects_are_worked_out_once(spark, tmp_path):
    source = str(tmp_path / "effects")
    spark.range(40).select(F.lit("a").alias("c"), (F.col("id") % 4).alias("s"), F.floor(F.col("id") / 4).alias("q"), F.col("id").alias("e")).write.parquet(source)
    got = stats.crossed_bootstrap(spark.read.parquet(source), ["c"], "s", "q", "e", 20, 3)
    assert got.first()["estimate"] == 19.5 and not any(source in x for x in got.inputFiles())


def test_null_seeds_are_told(spark):
    cells = [("x", s, q, 1.0) for s in (0, None) for q in range(2)]
    with pytest.raises(Exception, match="seeds differ in their problems"):
        stats.crossed_bootstrap(spark.createDataFrame(cells, "c string, s int, q int, e double"), ["c"], "s", "q", "e", 5, 1).collect()


def test_draws_of_one_contrast_are_dealt_to_tasks(spark):
    rows = spark.range(400).select(F.lit("a").alias("c"), (F.col("id") % 4).alias("s"), F.floor(F.col("id") / 4).alias("q"))
    _, taken = stats._resampled(rows, ["c"], "q", "p", 50, 3)
    plan = taken._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = [next(k for k, line in enumerate(plan) if name in line) for name in ("Generate", "RepartitionByExpression", "Window")]
    assert at == sorted(at)


def test_crossed_draws_against_plain_resampling(spark):
    pick = random.Random(9)
    rows = [(c, s, q, pick.gauss(0.3, 1)) for c, seeds, problems in (("x", 3, 7), ("y", 2, 4)) for s in range(seeds) for q in range(problems)]
    df = spark.createDataFrame(rows, "c string, s int, q int, e double")
    got = {(r["c"], r["draw"]): r["mean"] for r in stats.crossed_draws(df, ["c"], "s", "q", "e", 40, 5).collect()}
    taken = lambda side, b, n: [int(hashlib.sha256(f"5:{side}:{b}:{i}".encode()).hexdigest()[:15], 16) % n for i in range(n)]
    for c, seeds, problems in (("x", 3, 7), ("y", 2, 4)):
        m = np.array([[next(r[3] for r in rows if r[:3] == (c, s, q)) for q in range(problems)] for s in range(seeds)])
        means = [m[np.ix_(taken("s", b, seeds), taken("p", b, problems))].mean() for b in range(40)]
        assert np.allclose([got[c, b] for b in range(40)], means)
        for flag in (False, True):
            r = stats.crossed_bootstrap(df.where(F.col("c") == c), ["c"], "s", "q", "e", 40, 5, interpolated=flag).first()
            ordered = sorted(means)
            ends = np.quantile(means, [0.025, 0.975]) if flag else (ordered[0], ordered[39])
            p = min(1.0, 2 * min(np.mean(np.array(means) <= 0), np.mean(np.array(means) >= 0)))
            assert np.allclose([r["estimate"], r["low"], r["high"], r["p"]], [m.mean(), *ends, p]) and (r["problems"], r["seeds"]) == (problems, seeds)


def test_seeds_must_have_the_same_problems(spark):
    for rows in ([("x", 0, 0, 1.0), ("x", 0, 1, 1.0), ("x", 1, 0, 1.0)], [("x", 0, 0, 1.0), ("x", 0, 0, 2.0), ("x", 1, 0, 1.0), ("x", 1, 1, 1.0)]):
        df = spark.createDataFrame(rows, "c string, s int, q int, e double")
        with pytest.raises(Exception, match="seeds differ in their problems"):
            stats.crossed_bootstrap(df, ["c"], "s", "q", "e", 5, 1).collect()
