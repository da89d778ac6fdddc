import random

from tracemill.llm import decontaminate as d

DOCS, ITEMS = "doc_id long, text string, items string", "item_id long, text string, runs string"


def case(seed):
    pick = random.Random(seed)
    words = ["a", "b", "c", "dé", "7", "Zz"]
    say = lambda n: " ".join(pick.choice(words) for _ in range(n))
    items = [(i, say(pick.choice([1, 3, 9, 10, 12, 30]))) for i in range(12)] + [(50, None), (51, "..."), (None, say(11)), (3, say(12))]
    docs = [(i, say(pick.randint(0, 60)) + ", " + (pick.choice(items)[1] or "")) for i in range(40)]
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, "a " * 50_000), (5, "repeated " + items[3][1]), (5, "repeated " + items[3][1])]
    return docs, items


def check(spark, docs, items, size, **more):
    a = spark.createDataFrame([(*r, "clash") for r in docs], DOCS)
    b = spark.createDataFrame([(*r, "clash") for r in items], ITEMS)
    got = sorted(map(tuple, d.decontaminate(a, b, size, **more).collect()), key=str)
    named = [("" if i is None else str(i), t) for i, t in items]
    want = sorted(((i, *d.plain(t, named, size)) for i, t in docs), key=str)
    assert got == want


def test_against_brute_force(spark):
    check(spark, *case(1), 10)
    check(spark, *case(2), 3)


def test_blocks_of_items(spark):
    check(spark, *case(3), 5, block_bytes=60)


def test_full_filter_changes_nothing(spark):
    check(spark, *case(3), 7, block_bytes=8, filter_bytes=8)


def test_words_and_shingles_of_several_texts():
    texts = ["", "a b", "Ab--c d", "  ", "a b a b", "é" * 3 + " a b", None]
    found = d.Words([d.spaced(t) for t in texts])
    assert found.n.tolist() == [len(d.words_of(t)) for t in texts]
    at, h = found.shingles(2)
    same = {}
    for k, x in zip(at.tolist(), h.tolist(), strict=True):
        same.setdefault(found.said(k, k + 2), set()).add(x)
    assert {k: len(v) for k, v in same.items()} == {"a b": 1, "ab c": 1, "c d": 1, "b a": 1, "ééé a": 1}
    assert len(set.union(*same.values())) == 5
    assert [len(x) for _, x in d._slices([b"a" * (d.SLICE_BYTES // 2)] * 5)] == [2, 2, 1]


def test_nothing(spark):
    docs, items = case(4)
    check(spark, docs[:5], [], 10)
    check(spark, [], items, 10)


def test_clean_rows_keep_all_columns_and_judge_texts(spark):
    said = "one two three four five six seven eight nine ten"
    rows = [(1, f"so {said} then", "a", "b", "c"), (1, "nothing of it", "a", "b", "c"), (None, None, "d", "e", "f"), (None, said, "g", "h", "i"), (2, "", "j", "k", "l"), (2, "", "j", "k", "l")]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "__key", "own", "a.b"])
    items = spark.createDataFrame([(7, said)], "item_id long, text string")
    got = d.clean_rows(docs, items, size=10)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted((r for r in rows if said not in (r[1] or "")), key=str)
    assert d.clean_rows(docs.limit(0), items, size=10).count() == 0 and d.clean_rows(docs, items.limit(0), size=10).count() == 6
