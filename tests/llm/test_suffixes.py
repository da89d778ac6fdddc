import random

import numpy as np
import pytest

from tracemill.llm import suffixes

SCHEMA = "doc_id long, text string, chunk string"


def corpus(seed, alphabet="ab é\n", length=40):
    pick = random.Random(seed)
    say = lambda n: "".join(pick.choice(alphabet) for _ in range(n))
    passages = [say(pick.randint(30, 200)) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [pick.choice(passages) if pick.random() < 0.5 else say(pick.randint(0, 60)) for _ in range(pick.randint(0, 6))]
        docs.append((i * 7 % 61, "".join(parts)))
    docs += [(200, docs[3][1]), (201, docs[3][1]), (202, None), (203, ""), (204, "a" * 500), (205, "a" * 300), (206, "x\0y" * 100), (207, "\0" * 90 + "x\0y" * 40)]
    docs += [(208, passages[0] + passages[0]), (208, passages[0] + passages[0]), (None, passages[1]), (None, passages[1]), (-5, passages[2]), (209, "k" * 49)]
    return docs


@pytest.mark.parametrize("seed,chunk_bytes", [(1, 1 << 20), (2, 500), (3, 1)])
def test_against_all_windows(spark, seed, chunk_bytes, monkeypatch):
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, "clash") for d in docs], SCHEMA).repartition(3)
    got = sorted(map(tuple, suffixes.remove_repeats(df, 50, chunk_bytes=chunk_bytes).collect()), key=str)
    assert got == sorted(suffixes.plain(docs), key=str)


def test_kept_text_has_whole_characters(spark):
    docs = [(1, "é" * 60), (2, "xé" + "é" * 60 + "z", ), (3, "plain")]
    df = spark.createDataFrame([(*d, "c") for d in docs], SCHEMA)
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(df, 51, texts=True, carry=["chunk"]).collect()}
    assert got[1]["kept"] == docs[0][1] and got[2]["kept"] == "xz" and got[3]["carry"] == '{"chunk":"c"}'
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_levels_against_a_dictionary():
    pick = np.random.default_rng(0)
    levels, least = suffixes.SuffixLevels(2), {}
    docs = np.sort(pick.integers(0, 40, 3000))
    values = np.array([bytes(pick.integers(97, 110, 2).tolist()) for _ in docs])
    for v, d in zip(values.tolist(), docs.tolist(), strict=True):
        least[v] = min(least.get(v, 99), d)
    got = np.concatenate([levels.add(values[i : i + 37], docs[i : i + 37]) for i in range(0, 3000, 37)])
    assert got.tolist() == [least[v] < d for v, d in zip(values.tolist(), docs.tolist(), strict=True)]
    sizes = [len(a) for a, _ in levels.levels]
    assert sizes == sorted(sizes, reverse=True)
