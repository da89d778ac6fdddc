import random

import numpy as np

from tracemill.operators import stats

SCHEMA = "f string, g string, y double, x double, z double, beta double"


def plain(rows, predictors):
    """Demeaned least squares with its errors, in numpy."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    used = {g: v for g, v in groups.items() if len(v) > 1}
    at = {"x": 3, "z": 4}
    demean = lambda v, i: [r[i] - sum(q[i] for q in v) / len(v) for r in v]
    y = np.array([e for v in used.values() for e in demean(v, 2)])
    x = np.array([[e for v in used.values() for e in demean(v, at[p])] for p in predictors]).T
    label = [g for g, v in used.items() for _ in v]
    beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
    left, bread = y - x @ beta, np.linalg.pinv(x.T @ x)
    meat = sum(np.outer(s, s) for g in used for s in [x[[k == g for k in label]].T @ left[[k == g for k in label]]])
    c, n = len(used), len(y)
    clustered = c / (c - 1) * (n - 1) / max(1, n - rank) * bread @ meat @ bread
    return beta, np.sqrt(np.diag(clustered)), np.sqrt(np.diag(bread) * (left @ left) / (n - rank)), n, len(groups), c, rank


def test_families_against_numpy(spark):
    pick = random.Random(6)
    rows = []
    for f in ("a", "b", None):
        for g in range(12):
            for _ in range(pick.randint(1, 9)):
                x, z = pick.gauss(0, 1), pick.gauss(5, 2)
                rows.append((f, f"g{g}", 3 * x - 0.5 * z + g + pick.gauss(0, 1) + 1e4, x, z, 0.0))
    rows += [(f, "hot", pick.gauss(0, 1), pick.gauss(0, 1), pick.gauss(0, 1), 0.0) for f in ("a",) for _ in range(400)]
    df = spark.createDataFrame([*rows, ("a", "g1", None, 1.0, 1.0, 0.0), ("b", "g2", 1.0, None, 1.0, 0.0)], SCHEMA).repartition(5)
    got = {(r["f"], r["predictor"]): r for r in stats.fixed_effect_table(df, ["f"], "g", "y", ["x", "z"]).collect()}
    assert len(got) == 6
    for f in ("a", "b", None):
        beta, clustered, naive, n, questions, clusters, rank = plain([r for r in rows if r[0] == f], ["x", "z"])
        for i, p in enumerate(("x", "z")):
            r = got[f, p]
            assert np.allclose([r["beta"], r["se_clustered"], r["se_naive"]], [beta[i], clustered[i], naive[i]], rtol=1e-6)
            assert (r["observations"], r["questions"], r["clusters"], r["rank"]) == (n, questions, clusters, rank)


def test_collinear_predictors_have_least_norm(spark):
    rows = [("a", g, 2.5 * -x + o, x, -x, 0.0) for g, o in (("p", 10.0), ("q", -7.0), ("r", 3.0)) for x in (0.0, 1.0, 4.0)]
    got = {r["predictor"]: r for r in stats.fixed_effect_table(spark.createDataFrame(rows, SCHEMA), ["f"], "g", "y", ["x", "z"]).collect()}
    assert abs(got["x"]["beta"] + 1.25) < 1e-9 and abs(got["x"]["beta"] - got["z"]["beta"] + 2.5) < 1e-9 and got["x"]["rank"] == 1


def test_too_few(spark):
    rows = [("one", "p", 1.0, 1.0, 2.0, 0.0), ("one", "p", 2.0, 3.0, 2.5, 0.0), ("none", "p", 1.0, 1.0, 1.0, 0.0)]
    got = {(r["f"], r["predictor"]): r for r in stats.fixed_effect_table(spark.createDataFrame(rows, SCHEMA), ["f"], "g", "y", ["x"]).collect()}
    assert got["one", "x"]["se_clustered"] is None and abs(got["one", "x"]["beta"] - 0.5) < 1e-9 and got["one", "x"]["clusters"] == 1
    assert got["none", "x"]["observations"] == 0 and got["none", "x"]["se_naive"] is None and got["none", "x"]["questions"] == 1
    assert stats.fixed_effect_table(spark.createDataFrame(rows, SCHEMA).limit(0), ["f"], "g", "y", ["x"]).count() == 0
