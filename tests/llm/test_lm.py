import math
import random
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tracemill.llm import lm

SCHEMA = "doc_id long, text string, score string"


def plain(rows, d=lm.DISCOUNT):
    docs = []
    for i, t in rows:
        words = (t or "").encode().lower().split() + [b"\n"]
        docs.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, words))
    one, two, three = Counter(), defaultdict(Counter), defaultdict(Counter)
    for _, held, w in docs:
        if not held:
            one.update(w)
            for k in range(1, len(w)):
                two[w[k - 1]][w[k]] += 1
            for k in range(2, len(w)):
                three[w[k - 2], w[k - 1]][w[k]] += 1
    n, v = sum(one.values()), len(one)

    def mix(table, context, word, lower):
        if not table.get(context):
            return lower
        total = sum(table[context].values())
        return max(table[context][word] - d, 0) / total + d * len(table[context]) / total * lower

    out = []
    for i, held, w in docs:
        base = score = 0.0
        for k, x in enumerate(w):
            p = (one[x] + 1) / (n + v + 1)
            base += math.log10(p)
            if k:
                p = mix(two, w[k - 1], x, p)
            if k > 1:
                p = mix(three, (w[k - 2], w[k - 1]), x, p)
            score += math.log10(p)
        out.append((i, held, len(w), sum(one[x] > 0 for x in w), n, base, score))
    return sorted(out, key=str)


def test_against_plain_counts(spark):
    pick = random.Random(4)
    rows = [(i, " ".join(pick.choice(["a", "B", "b", "c", "dé", "e\t", "f"]) for _ in range(pick.randint(0, 60)))) for i in range(80)]
    rows += [(None, "a b a"), (100, None), (101, ""), (3, rows[3][1]), (3, rows[3][1]), (102, "new words only"), (103, "the the " * 20_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(2)
    for size in (1 << 20, 300):
        got = sorted(map(tuple, lm.score_documents(df, chunk_bytes=size).collect()), key=str)
        want = plain(rows)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        for g, w in zip(got, want, strict=True):
            assert abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5])) and abs(g[6] - w[6]) <= 0.012 * w[2] + 1e-9
    assert lm.score_documents(df.limit(0)).count() == 0
    assert {r["train_tokens"] for r in lm.score_documents(df.where("doc_id = 19"), held_out=df["doc_id"] > 0).collect()} == {0}


def test_elias_fano_against_a_list():
    pick = np.random.default_rng(1)
    for top in (1, 50, 10_000, 1 << 40):
        values = np.unique(pick.integers(0, top, 700))
        ef = lm.EliasFano(values, lambda a: a)
        assert (ef[np.arange(len(values))] == values).all()
        asked = np.concatenate((values, pick.integers(0, top * 2, 500)))
        where = {x: i for i, x in enumerate(values.tolist())}
        assert ef.find(asked).tolist() == [where.get(x, -1) for x in asked.tolist()]
    same = np.array([0, 0, 3, 3, 3, 9])
    assert (lm.EliasFano(same, lambda a: a)[np.arange(6)] == same).all()


def test_scores_do_not_depend_on_the_number_of_shards(spark):
    pick = random.Random(9)
    rows = [(i, " ".join(pick.choice(["a", "B", "c", "dé", "f"]) + str(pick.randint(0, 30)) for _ in range(pick.randint(0, 90))), "x") for i in range(60)]
    df, found = spark.createDataFrame(rows, SCHEMA), []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for shards in ("3", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", shards)
            found.append({r["doc_id"]: r["score"] for r in lm.score_documents(df, chunk_bytes=2000).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0].keys() == found[1].keys() and all(abs(found[0][i] - s) < 1e-9 for i, s in found[1].items())


def test_codes_and_steps():
    low = lm.least_log(0.75, 10**6)
    values = 10.0 ** np.linspace(low, 0, 1000)
    codes = lm.Codes(values, low, lambda a: a)
    read = lm.Codes.value(codes.at(np.arange(1000)), low, 0.0)
    assert np.abs(np.log10(read / values)).max() <= -low / 254 / 2 + 1e-9 and lm.Codes.value(codes.at(np.array([-1])), low, 0.0)[0] == 0
    counts = np.array([0, 3, 0, 2, 1, 0])
    values = np.array([4, 9, 11, 0, 7, 5])
    assert lm.unstepped(lm.steps(values, counts), counts).tolist() == values.tolist()
    assert lm.steps(values[:0], counts[:1]).tolist() == []


def test_ranges_of_words():
    part = [lm.Part.__new__(lm.Part) for _ in range(2)]
    for p, own, n in zip(part, ([1, 5, 9], [5, 7]), ([4, 4, 4], [9, 1]), strict=True):
        p.own, p.pair = np.array(own, np.uint64), np.cumsum([0, *n])
        p.context = p.triple = np.zeros(len(n) + 1, int)
    cuts = lm.ranges(part, 5)
    assert all(a <= b for x, y in zip(cuts, cuts[1:], strict=False) for a, b in zip(x, y, strict=True)) and len(cuts) > 2
    assert cuts[0].tolist() == [0, 0] and cuts[-1].tolist() == [3, 2]
    assert [c.tolist() for c in lm.ranges(part, 1 << 20)] == [[0, 0], [3, 2]]


def test_resolving_by_ranges_is_the_same(monkeypatch):
    monkeypatch.setattr(lm.TaskContext, "get", staticmethod(lambda: SimpleNamespace(partitionId=lambda: 0)))
    pick = np.random.default_rng(3)

    def blob(chunk):
        words = [b" ".join(b"w%d" % k for k in pick.integers(0, 30, 50)) for _ in range(6)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([False] * 5 + [True]), pa.array([w.decode() for w in words])], ["i", "h", "t"])
        made = next(iter(lm._tokenise(1 << 30)([batch])))
        out = next(iter(lm._send(1)([pa.RecordBatch.from_arrays([pa.array([chunk]), made.column("ids"), made.column("data")], ["chunk", "ids", "data"])])))
        return out.column("blob")[0].as_py()
    blobs = [blob(k) for k in range(3)]

    def answers(most):
        parts = [lm.Part(b) for b in blobs]
        names = np.unique(np.concatenate([p.names for p in parts]))
        for p in parts:
            p.named(names)
        ends, found = lm.ranges(parts, most), [[] for _ in parts]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            for mine, got in zip(found, lm._resolve(parts, a, b, len(names), 0.75, -6.0), strict=True):
                mine.append(got)
        return len(ends), [[np.concatenate(x).tolist() for x in zip(*mine, strict=True)] for mine in found]

    (one, whole), (many, split) = answers(1 << 30), answers(40)
    assert one == 2 and many > 5 and whole == split
