import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracemill.llm import simhash
from tracemill.operators.components import components


def plain_fingerprint(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [words[i : i + size] for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps, distance):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_groups_of_texts(spark):
    pick = random.Random(3)
    texts = [" ".join(pick.choice("abcdefgh") for _ in range(pick.randint(1, 5))) for _ in range(120)]
    long = [str(i) for i in range(3000)]
    texts += [None, "", " \t", "A b", "a\x0bB", " ".join(long), " ".join([*long[:-1], "x"]), "é È"]
    rows = [(i + 10, t, "clash") for i, t in enumerate(texts)]
    got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    fps = {i: plain_fingerprint(t, 3) for i, t, _ in rows}
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == plain_groups(fps, 2)


def test_nulls_repeats_and_nothing(spark):
    rows = [(None, "a b c"), (7, "a b c"), (7, "a b c"), (None, "zzz q r s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.simhash_groups(docs).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (None, None)], key=str)
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("distance", [0, 1, 2])
@pytest.mark.parametrize("hot", [64, 3])
def test_links_against_all_pairs(spark, distance, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    pick = random.Random(distance)
    base = [pick.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    fps = {b for b in base}
    for b in base:
        for _ in range(30):
            x = b
            for _ in range(pick.randint(1, 4)):
                x ^= 1 << pick.randint(0, 63)
            fps.add(x)
    nodes = dict(enumerate(sorted(fps, key=lambda _: pick.random())))
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in nodes.items()]
    edges = simhash.links(spark.createDataFrame(signed, "fp long, rep long"), distance)
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert {i: found.get(i, i) for i in nodes} == plain_groups(nodes, distance)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 3), (7, 6)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}


def plain_near(texts, size=5, similarity=0.8):
    sets = {i: frozenset(simhash.shingle_set(t, size).tolist()) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and (sets[i] == sets[j] or (sets[i] | sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity)):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("crowd", [24, 2])
def test_near_groups(spark, crowd, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    pick, texts = random.Random(8), {}
    shared = [f"p{i}" for i in range(40)]
    for n in (3, 12, 60, 200, 1500):
        for _ in range(6):
            words = [str(pick.randint(0, 10**6)) for _ in range(n)]
            for change in (0, 0, 1, n // 60, n // 45, n // 30, n // 12):
                copy = list(words)
                for k in pick.sample(range(n), min(n, change)):
                    copy[k] = "changed"
                texts[len(texts)] = " ".join(copy if pick.random() < 0.8 else shared + copy)
    texts |= {5000: None, 5001: "", 5002: " \n"}
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], "doc_id long, text string, keys string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(df).collect()}
    assert got == plain_near(texts)
    assert simhash.near_groups(df.limit(0)).count() == 0


def hub(base, own, tail):
    """A text and copies of it that differ from it enough, and from each other too much."""
    return [" ".join([*base, *(f"own{k}x{j}" for j in range(own))]) if tail else " ".join(w if i % 28 else f"own{k}x{i}" for i, w in enumerate(base)) for k in range(200)]


@pytest.mark.parametrize("first", [True, False])
def test_near_groups_of_hubs(spark, first):
    short, long = [f"s{i}" for i in range(8)], [f"l{i}" for i in range(300)]
    texts = [*hub(short, 1, True), *hub(long, 60, True), *hub([f"m{i}" for i in range(300)], 0, False)]
    middle = [" ".join(short), " ".join(long), " ".join(f"m{i}" for i in range(300))]
    one_word = [" ".join(["a", "b", "c", "d", "e", "f", "g", "h", "i", f"z{k}"]) for k in range(40)]
    rows = dict(enumerate((middle + texts if first else texts + middle) + one_word))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    want = plain_near(rows)
    assert len(set(want.values())) < 300
    assert got == want


def test_near_groups_begin_with_simhash(spark, monkeypatch):
    """Without the exact way for the rest, near copies within 2 bits of fingerprint are found, and no others."""
    none = lambda of, *_: of.select(F.col("i").alias("a"), F.col("i").alias("b")).limit(0)
    monkeypatch.setattr(simhash, "_stars", none)
    monkeypatch.setattr(simhash, "_across", none)
    pick, texts = random.Random(4), {}
    for n in (30, 800, 4000):
        for _ in range(4):
            words = [str(pick.randint(0, 10**6)) for _ in range(n)]
            for change in (0, 0, 1, 1, n // 60, n // 45):
                copy = list(words)
                for k in pick.sample(range(n), change):
                    copy[k] = f"y{pick.randint(0, 10**6)}"
                texts[len(texts)] = " ".join(copy)
    sets = {i: simhash.shingle_set(t, 5) for i, t in texts.items()}
    want = plain_groups({i: simhash.majority([s]) for i, s in sets.items()}, 2)
    assert all(len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) for i in want for j in want if want[i] == want[j])
    exact = {i: min(j for j in texts if texts[j] == texts[i]) for i in texts}
    assert len(set(want.values())) < len(set(exact.values()))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(df).collect()}
    assert got == want
    assert {r["doc_id"] for r in simhash.near_unique(df).collect()} == set(want.values())


def test_large_groups_of_near_copies(spark):
    """Hundreds of variants of one text, most of which are similar to some others only: every link of brute force is found."""
    pick, rows = random.Random(2), {}
    for base, count in (("a", 200), ("b", 2000)):
        words = [f"{base}{k}" for k in range(100)]
        for _ in range(count):
            copy = list(words)
            for k in pick.sample(range(100), pick.choice((0, 1, 1, 2, 3, 5, 8))):
                copy[k] = f"x{pick.randint(0, 10**9)}"
            rows[len(rows)] = " ".join(copy)
    sets = [simhash.shingle_set(t, 5) for t in rows.values()]
    number = {h: k for k, h in enumerate(np.unique(np.concatenate(sets)).tolist())}
    bits = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        bits[i, [number[h] for h in s.tolist()]] = 1
    both, n = bits @ bits.T, bits.sum(axis=1)
    near = both >= 0.8 * (n[:, None] + n[None, :] - both) - 1e-6
    least = np.arange(len(sets))
    while (new := np.array([least[row].min() for row in near])).tolist() != least.tolist():
        least = new
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(df).collect()}
    assert got == dict(enumerate(least.tolist())) and 100 < len(set(got.values())) < 2000


ODD = [(None, "a b c d e f g"), (3, "h i j k l m n"), (None, "o p q r s t u"), (10, "v w x y z a b"), (3, "o p q r s t u"), (20, "a b c d e f g"), (20, "c c c c c d e")]


def test_null_and_repeated_ids_link_nothing(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    want = sorted([(None, 20), (3, 3), (None, 3), (10, 10), (3, 3), (20, 20), (20, 20)], key=str)
    for groups in (simhash.simhash_groups(docs), simhash.near_groups(docs)):
        assert sorted(((r["doc_id"], r["component_id"]) for r in groups.collect()), key=str) == want


def test_one_row_of_each_group(spark):
    rows = [(i, t, f"l{k}", None, k, "clash") for k, (i, t) in enumerate([*ODD, (None, None), (7, ""), (8, "é\n\"q\" h i j k"), (8, "é\n\"q\" h i j k")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, c0 string")
    out = simhash.near_unique(docs)
    got = [tuple(r) for r in out.collect()]
    assert out.columns == docs.columns and len(got) == len(set(got)) and set(got) <= set(rows)
    assert sorted(r[1] or "" for r in got) == sorted(["h i j k l m n", "o p q r s t u", "v w x y z a b", "a b c d e f g", "c c c c c d e", "", rows[-1][1]])
    assert {r[0] for r in got if (r[1] or "").startswith(("o", "a b"))} == {3, 20}
    assert {r[:2] for r in got if not r[1]} == {(7, "")}
    assert simhash.near_unique(docs.where("doc_id is null and text is null")).collect()[0]["text"] is None
    assert simhash.near_unique(docs.limit(0)).count() == 0
