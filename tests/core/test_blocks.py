import random

import numpy as np

from tracemill.operators import blocks, pairing


def vectors(seed, n, kind=int):
    pick = random.Random(seed)
    rows = [(kind(k), [float(pick.randint(-3, 3)) for _ in range(5)]) for k in range(n)]
    return rows + [(kind(n), rows[0][1]), (kind(n + 1), rows[0][1]), (kind(n + 2), [0.0] * 5)]


def test_nearest_against_all_distances(spark):
    q, r = vectors(1, 40), vectors(2, 150)
    one, two = (spark.createDataFrame([*t, (900, None)], "id long, v array<float>").repartition(3) for t in (q, r))
    for block in (7, 1000):
        got = blocks.nearest_in_blocks(blocks.packed(one, "id", "v", block), blocks.packed(two, "id", "v", block), 4).collect()
        want = set()
        for i, x in q:
            near = sorted((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in r)[:4]
            want |= {(i, j, d, k) for k, (d, j) in enumerate(near, 1)}
        assert {tuple(g) for g in got} == want
    assert pairing.nearest(one, two.limit(0), "id", "v", 3).count() == 0


def test_mutual_matches_against_all_pairs(spark):
    a, b = vectors(3, 60, str), vectors(4, 70, str)
    one, two = (spark.createDataFrame(t, "id string, v array<double>") for t in (a, b))
    cos = blocks.cosines(np.array([v for _, v in a]), np.array([v for _, v in b]))
    best_b = {i: min((-round(cos[m, n], 12), j) for n, (j, _) in enumerate(b))[1] for m, (i, _) in enumerate(a)}
    best_a = {j: min((-round(cos[m, n], 12), i) for m, (i, _) in enumerate(a))[1] for n, (j, _) in enumerate(b)}
    want = {(i, j) for i, j in best_b.items() if best_a[j] == i and cos[[x for x, _ in a].index(i), [x for x, _ in b].index(j)] >= 0.5}
    got = blocks.mutual_in_blocks(blocks.packed(one, "id", "v", 1000), blocks.packed(two, "id", "v", 1000), 0.5).collect()
    assert {(r["left_id"], r["right_id"]) for r in got} == want


def test_support_differences(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1), ("c", 3)], "arm string, k int")
    assert {tuple(r) for r in pairing.support_differences(rows, "arm", ["k"]).collect()} == {(1, "c"), (2, "b"), (2, "c"), (3, "a"), (3, "b")}
