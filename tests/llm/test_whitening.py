import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tracemill.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, component int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "x", 9) for i, v in rows], SCHEMA).repartition(parts)


def plain(rows, most=32):
    """Exact sums and covariance by fractions; the eigenvectors of that."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    y = [[Fraction(n * r[k] - sums[k], n) for k in range(d)] for r in x]
    v = np.array([[float(sum(r[a] * r[b] for r in y) / n) for b in range(d)] for a in range(d)])
    e, columns = np.linalg.eigh(v)
    e, columns = e[::-1], columns[:, ::-1]
    white = np.array([[float(c) for c in r] for r in y]) @ columns / np.sqrt(e)
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    return [i for i, _ in kept], n, deviation, white[:, :most], (e / e.sum())[:most], v


def vectors(seed, n, d, spread=True):
    pick = random.Random(seed)
    return [(k, [pick.gauss(1, 1 + (j if spread else 0)) for j in range(d)]) for k in range(n)]


def test_against_fractions(spark):
    rows = vectors(1, 150, 6)
    rows += [(200, None), (201, []), (202, [1.0] * 5 + [None]), (203, [1.0] * 5 + [math.nan]), (204, [math.inf] * 6), (205, [1.0, 2.0])]
    rows += [(None, [2.0] * 6), (7, [3.0] * 6), rows[0]]
    got = whitening.whiten(frame(spark, rows)).collect()
    ids, n, deviation, white, explained, _ = plain([r for r in rows if r[0] != 205])
    assert len(got) == n * 6 and {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, 7))
    assert max(r["identity_error"] for r in got) < 1e-10
    for c in range(6):
        mine = sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["deviation"], r["whitened"]) for r in got if r["component"] == c + 1))
        for sign in (1, -1):
            theirs = sorted((i is None, i or 0, v, sign * w) for i, v, w in zip(ids, deviation, white[:, c], strict=True))
            if all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-9 for a, b in zip(mine, theirs, strict=True)):
                break
        else:
            pytest.fail(f"component {c + 1}")
        assert all(abs(r["explained"] / explained[c] - 1) < 1e-12 for r in got if r["component"] == c + 1)


def test_covariance_far_from_zero_is_exact(spark):
    """Values of a great common part: products of uncentred doubles would lose all digits."""
    pick = random.Random(2)
    rows = [(k, [15_000.0 + pick.random() for _ in range(3)]) for k in range(3000)]
    kept = frame(spark, rows, 5).selectExpr("vec_id as i", "cast(embedding as array<double>) as v")
    fitted = whitening.fit(kept)
    *_, v = plain(rows)
    again = fitted.components.T @ np.diag(fitted.values) @ fitted.components
    assert np.abs(again - v).max() < 1e-12 * np.abs(v).max()


def test_double_double_sums():
    pick = random.Random(3)
    y = np.array([[pick.uniform(-1, 1) * 10 ** pick.randint(-8, 8) for _ in range(4)] for _ in range(2500)])
    outer = whitening.Outer(4)
    for at in range(0, 2500, 700):
        outer.add(y[at : at + 700], np.zeros_like(y[at : at + 700]))
    for i in range(4):
        for j in range(i, 4):
            exact = sum(Fraction(a) * Fraction(b) for a, b in y[:, [i, j]].tolist())
            got = Fraction(float(outer.rows[i][0][j - i])) + Fraction(float(outer.rows[i][1][j - i]))
            size = sum(abs(Fraction(a) * Fraction(b)) for a, b in y[:, [i, j]].tolist())
            assert abs(got - exact) < size * Fraction(1, 2**95)


def test_without_variance(spark):
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(spark, [(k, [1.0, 2.0]) for k in range(9)])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(frame(spark, []).limit(0)).count() == 0
    flat = [(k, [float(k), 2.0 * k, 5.0]) for k in range(9)]  # one direction only
    got = whitening.whiten(frame(spark, flat)).collect()
    assert {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12


def test_lengths_and_great_values(spark):
    rows = vectors(5, 20, 3) + [(90 + k, [1.0, 2.0]) for k in range(5)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r["vec_id"] for r in got} == set(range(20))
    huge = [(k, [1e30 * (k % 3), float(k)]) for k in range(50)]
    got = whitening.whiten(frame(spark, huge)).collect()
    assert len(got) == 50 and all(math.isfinite(r["whitened"]) for r in got)


def test_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = whitening.whiten(table).collect()
    n = got[0]["n"]
    assert len(got) == 32 * n and got[0]["identity_error"] < 1e-9
    white = np.array([[r["whitened"] for r in got if r["component"] == c + 1] for c in range(32)])
    assert np.abs(white @ white.T / n - np.eye(32)).max() < 1e-9
