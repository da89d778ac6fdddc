import os

import numpy as np
import pytest


import corpus_pipeline
from tracemill.llm import bpe, decontaminate, simhash, suffixes
from tracemill.llm.queries import vocabulary

DATA = os.environ.get("TRACEMILL_DATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows[k] = {r["doc_id"]: r for r in docs.collect()}
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    clean = [i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(i in rows[0] for i in clean) >= 0.97 * len(clean)

    groups = near({i: r["text"] for i, r in rows[0].items()})
    assert set(rows[1]) == {i for i, g in groups.items() if i == g}
    cut = {r[0]: r for r in suffixes.plain([(i, r["text"]) for i, r in rows[1].items()])}
    for i, r in rows[2].items():
        assert cut[i][2] > 0 or r["text"] == rows[1][i]["text"]
        assert len(r["text"].encode()) >= cut[i][1] - cut[i][2] and r["n_chars"] == len(r["text"])
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert set(rows[3]) == {i for i, r in rows[2].items() if not decontaminate.plain(r["text"], items)[4]}
    codec = bpe.Codec(vocabulary())
    assert set(rows[4]) == set(rows[3]) and all(codec.decode(np.array(r["ids"], int)) == rows[3][i]["text"] for i, r in rows[4].items())


def near(texts):
    sets = {i: frozenset(simhash.shingle_set(t, 5).tolist()) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_registered(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
