import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracemill.llm import quality

SCHEMA = "doc_id long, text string, source string, lang string, keep string"


def corpus(n=1500):
    pick = random.Random(9)
    say = lambda k: [pick.choice(["river", "stone", "cloud", "tree", "light", "wind"]) + pick.choice(["", "s", "y"]) for _ in range(k)]
    docs, labels = [], []
    for i in range(n):
        words, kind = say(pick.randint(5, 60)), i % 5
        if kind == 1:
            words.insert(pick.randint(0, len(words)), pick.choice(["grumbo", "grumboes", "zazzle"]))
        if kind == 2:
            words = [w.upper() + "!!" for w in words]
        if kind == 3 and i % 4:
            words += ["same"] * 6
        low = kind == 2 or (kind == 3 and i % 4 > 0)
        docs.append((i, " ".join(words), f"s{i % 3}", "en", "clash"))
        if i % 3 > 0:
            labels.append((i, 0 if low else 1, int(kind == 1)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    df, lf = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(df, quality.train(df, lf)).collect()}
    known = {i for i, *_ in labels}
    wrong = [i for i in got if i not in known and got[i]["keep"] != (i % 5 not in (1, 2) and not (i % 5 == 3 and i % 4))]
    assert len(wrong) <= 5 and len(got) == len(docs)


def test_shrinkage(spark):
    rows = [("big", "a", 0.9)] * 300 + [("other", "a", 0.1)] * 300 + [("tiny", "a", 0.9)]
    sites, mean, k = quality.site_rates(spark.createDataFrame(rows, "host string, path string, p double"))
    assert mean == pytest.approx((0.9 * 301 + 0.1 * 300) / 601) and 1 <= k < 20 and sites.count() == 3


def test_odd_rows(spark):
    docs, labels = corpus(60)
    docs += [(None, None, None, None, None), (1, "", None, "x", None), (1, "", None, "x", None), (900, "grumbo " * 100_000, "s0", "en", None)]
    labels += [(None, 0, 1), (10_000, 0, 1), (5, None, None)]
    df, lf = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.judge(df, quality.train(df, lf))
    rows = out.collect()
    assert len(rows) == len(docs) and all(0 <= r["posterior"] <= 1 and math.isfinite(r["low"]) for r in rows)
    none = quality.train(df, lf.limit(0))
    assert all(r["keep"] for r in quality.judge(df, none).collect())
    assert quality.judge(df.limit(0), none).count() == 0


def test_repeats():
    assert quality.repeats(["a"] * 4) and not quality.repeats(["a", "a", "a", "b", "a"]) and not quality.repeats([])


def test_judgement_from_known_evidence(spark, monkeypatch):
    """Site rates and posteriors, recomputed in plain Python from given log odds."""
    pick = random.Random(4)
    rows = [(i, str(round(pick.uniform(-6, 4), 3)), pick.choice(["a", "a", "b", None, f"h{i}"]), pick.choice(["x", "y", None])) for i in range(200)]
    monkeypatch.setattr(quality, "evidence", lambda model, text: F.struct(text.cast("double").alias("low"), F.lit(-3.0).alias("toxic")))
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), None).collect()}
    sig, logit = lambda z: 1 / (1 + math.exp(-z)), lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    p = {i: 1 - (1 - sig(float(t))) * (1 - sig(-3.0)) for i, t, *_ in rows}
    host, path = defaultdict(list), defaultdict(list)
    for i, _, h, x in rows:
        host[h or ""].append(p[i])
        path[h or "", x or ""].append(p[i])
    mean = sum(p.values()) / len(p)
    q = sum(sum(v) ** 2 / len(v) for v in host.values()) / len(p) - mean**2
    spread = max(q - mean * (1 - mean) * sum(1 / len(v) for v in host.values()) / len(host), 1e-6)
    k = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e4)
    for i, _, h, x in rows:
        up = (sum(host[h or ""]) - p[i] + k * mean) / (len(host[h or ""]) - 1 + k)
        rate = (sum(path[h or "", x or ""]) - p[i] + k * up) / (len(path[h or "", x or ""]) - 1 + k)
        posterior = sig(logit(p[i]) + quality.SITE_WEIGHT * (logit(rate) - logit(mean)))
        assert got[i]["site_rate"] == pytest.approx(rate, rel=1e-6) and got[i]["posterior"] == pytest.approx(posterior, rel=1e-6)
        assert got[i]["keep"] == (got[i]["posterior"] < 0.5)


def test_labels_without_a_document_do_not_use_up_the_sample(spark):
    docs, labels = corpus(300)
    df = spark.createDataFrame([*docs, *docs[:50]], SCHEMA)
    lf = spark.createDataFrame(labels + [(10_000 + i, 0, 1) for i in range(3000)], "doc_id long, quality int, toxic int")
    assert quality.train(df, lf, sample=400).weights == quality.train(df, lf.where("doc_id < 10000"), sample=400).weights != {}


def test_columns_named_like_what_is_used_inside(spark, monkeypatch):
    monkeypatch.setattr(quality, "evidence", lambda model, text: F.struct(text.cast("double").alias("low"), F.lit(-3.0).alias("toxic")))
    names = ["p", "__host", "__e", "e", "row", "host", "path", "host_sum", "path_n", "a.b"]
    rows = spark.createDataFrame([("1.5", "s", "l", *names), (None, None, None, *names)], ["text", "source", "lang", *names])
    plain = {r["text"]: r for r in quality.judge(rows.select("text", "source", "lang"), None).collect()}
    for r in quality.judge(rows, None).collect():
        assert [r[n] for n in names] == names and (r["posterior"], r["site_rate"]) == (plain[r["text"]]["posterior"], plain[r["text"]]["site_rate"])
