"""Quality classifier: document evidence and site posteriors by hierarchical empirical Bayes.

Two logistic heads (low quality, toxic) over the presence of words, word beginnings, marks
around words, shouting and repetition give each document its evidence.  Sites are hosts and,
below them, paths.  Their rates of bad documents are grouped sums of the evidence; a host's
rate is shrunk to the global rate and a path's rate to its host's, by as many pseudo-documents
as the spread between hosts calls for, so sparse sites follow their parents.  A document is
judged by its evidence shifted by its site's log odds, its own share left out.

Fitted on a bounded sample: the SAMPLE labelled rows with the smallest hash.  Everything else
covers all documents.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracemill.llm.chunks import trim
from tracemill.llm.store import stored

#: Labelled rows that the heads are fitted on.
SAMPLE = 6000
#: A feature needs so many sampled documents, and to be so many standard errors from chance.
LEAST_DOCS, LEAST_Z = 5, 6.0
BEGINNINGS = (4, 5, 6)
#: Equal words in a row that count as repetition.
REPEATS = 4
#: Words whose features a task remembers, and their characters; beyond either it starts anew.
CACHE, CACHE_CHARS = 300_000, 8 << 20
#: Weight of the site's log odds against the document's evidence.
SITE_WEIGHT = 0.5
HEADS = ("low", "toxic")


def word_features(word: str) -> list[str]:
    if word.isalnum():
        core, marks = word.lower(), ""
    elif word[:-1].isalnum() and not word[-1].isalnum():
        core, marks = word[:-1].lower(), word[-1]
    else:
        core = "".join(c for c in word if c.isalnum()).lower()
        marks = "".join(c for c in word if not c.isalnum())
    out = [f"w:{core}", *(f"{n}:{core[:n]}" for n in BEGINNINGS)] if core else []
    if marks:
        out.append(f"m:{marks[:8]}")
    if len(core) > 2 and word.upper() == word and word.lower() != word:
        out.append("shout")
    return out


def repeats(words: list[str]) -> bool:
    """Whether one word stands REPEATS times in a row."""
    return b"\1" * (REPEATS - 1) in bytes(map(eq, words, words[1:]))


def features(text: str | None) -> set[str]:
    words = (text or "").split()
    out = {f for w in set(words) for f in word_features(w)}
    if repeats(words):
        out.add("repeat")
    return out


@dataclass
class Model:
    """Weights of both heads by feature."""

    weights: dict[str, tuple[float, float]]
    bias: tuple[float, float]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def scorer(self):
        """A function from texts to two log odds each, with its own bounded cache of words."""
        known: set[str] = set()
        active: dict[str, tuple[str, ...]] = {}
        table, marks_repeats, held = self.weights, "repeat" in self.weights, 0

        def score(text: str | None) -> tuple[float, float]:
            nonlocal held
            words = (text or "").split()
            own = set(words)
            for w in own - known:
                held += len(w)
                if f := tuple(f for f in word_features(w) if f in table):
                    active[w] = f
            known.update(own)
            found = {f for w in own & active.keys() for f in active[w]}
            if marks_repeats and repeats(words):
                found.add("repeat")
            if len(known) > CACHE or held > CACHE_CHARS:
                known.clear()
                active.clear()
                held = 0
            pairs = [table[f] for f in sorted(found)]
            return self.bias[0] + sum(p[0] for p in pairs), self.bias[1] + sum(p[1] for p in pairs)

        return score


def _fit(index: np.ndarray, owner: np.ndarray, y: np.ndarray, n: int, rounds: int = 400, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse presence by adaptive gradient steps."""
    w, b = np.zeros(n), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    g2, gb2 = np.full(n, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.clip(np.bincount(owner, weights=w[index], minlength=len(y)) + b, -30, 30)
        off = 1 / (1 + np.exp(-z)) - y
        g = np.bincount(index, weights=off[owner], minlength=n) + ridge * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
        gb = off.sum()
        gb2 += gb * gb
        b -= 0.5 * gb / math.sqrt(gb2)
    return w, b


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fits both heads on the ``sample`` labelled rows of smallest hash.

    Labels have doc_id, quality (0 is low) and toxic (1 is toxic); a null label counts as good, a
    null doc_id is left out, as are labels without a document, and neither uses up the sample; of
    several texts with one id one is taken.  Without labels of a kind
    its head is a small constant, so nothing is rejected for it.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("t"))
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("i"), (F.coalesce("quality", F.lit(1)) == 0).alias("low"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"))
        .join(texts.select("i"), "i", "left_semi").orderBy(F.xxhash64("i"), "i", "low", "toxic").limit(sample)
    )
    # bounded by ``sample``: of several texts with one id the least counts
    wanted = texts.join(F.broadcast(picked.select("i").distinct()), "i").groupBy("i").agg(F.min("t").alias("t"))
    rows = stored(wanted.join(picked, "i").select("t", "low", "toxic"))

    def count(batches):
        for batch in batches:
            names, low, toxic = [], [], []
            for t, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = features(t)
                names += own
                low += [int(a)] * len(own)
                toxic += [int(b)] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(low, pa.int32()), pa.array(toxic, pa.int32())], ["f", "low", "toxic"])

    total = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("low").cast("long")), F.lit(0)), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    counts = rows.mapInArrow(count, "f string, low int, toxic int").groupBy("f").agg(
        F.count("*").alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic")
    )
    z = [_z(F.col(h), F.col("n"), float(total[1 + k]), float(total[0])) for k, h in enumerate(HEADS)]
    chosen = sorted(r["f"] for r in counts.where((F.col("n") >= LEAST_DOCS) & (F.greatest(*(F.abs(x) for x in z)) > LEAST_Z)).select("f").collect())
    number = {f: k for k, f in enumerate(chosen)}

    def place(batches):
        for batch in batches:
            at = [sorted(number[f] for f in features(t) if f in number) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(at, pa.list_(pa.int32()))], ["low", "toxic", "at"])

    fitted = rows.mapInArrow(place, "low boolean, toxic boolean, at array<int>").collect()
    owner = np.repeat(np.arange(len(fitted)), [len(r["at"]) for r in fitted])
    index = np.array([k for r in fitted for k in r["at"]], np.int64)
    heads = []
    for h in HEADS:
        y = np.array([r[h] for r in fitted], float)
        heads.append(_fit(index, owner, y, len(chosen)) if y.any() else (np.zeros(len(chosen)), -math.log(2 * len(y) + 200)))
    (a, x), (b, y) = heads
    return Model({f: (float(a[k]), float(b[k])) for f, k in number.items()}, (float(x), float(y)))


def _z(positive: Column, n: Column, bad: float, every: float) -> Column:
    """The root of the likelihood ratio statistic of a feature and a label: about its distance from chance in standard errors."""

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / F.greatest(expected, F.lit(1e-9)))).otherwise(0.0)

    share, good = F.lit(bad / max(every, 1.0)), F.lit(1 - bad / max(every, 1.0))
    cells = [(positive, n * share), (n - positive, n * good), (bad - positive, (every - n) * share), (every - bad - n + positive, (every - n) * good)]
    return F.sqrt(F.greatest(F.lit(0.0), 2 * sum((term(s.cast("double"), e) for s, e in cells), F.lit(0.0))))


def evidence(model: Model, text: Column) -> Column:
    """struct(low, toxic): log odds of each head."""

    @F.pandas_udf("low double, toxic double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = model.scorer()
        for parts in batches:
            yield pd.DataFrame([score(t) for t in parts], columns=list(HEADS))
        del score
        trim()

    return run(text)


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def _odds(bad: Column) -> Column:
    """Probability that either head holds."""
    return 1 - (1 - 1 / (1 + F.exp(-bad.low))) * (1 - 1 / (1 + F.exp(-bad.toxic)))


def site_rates(scored: DataFrame) -> tuple[DataFrame, float, float]:
    """(host, path, host_n, host_sum, path_n, path_sum) of rows (host, path, p), the global rate and the pseudo-documents."""
    paths = stored(scored.groupBy("host", "path").agg(F.count("*").alias("path_n"), F.sum("p").alias("path_sum")))
    hosts = paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_sum").alias("host_sum"))
    rate = F.col("host_sum") / F.col("host_n")
    r = hosts.agg(
        F.sum("host_n").alias("n"), F.sum("host_sum").alias("s"), F.count("*").alias("k"), F.sum(rate * rate * F.col("host_n")).alias("q"), F.avg(1 / F.col("host_n")).alias("inv")
    ).first()
    if not r["n"]:
        return paths.join(hosts, "host"), 0.5, 1.0
    mean = min(max(r["s"] / r["n"], 1e-6), 1 - 1e-6)
    spread = max(r["q"] / r["n"] - mean * mean - mean * (1 - mean) * r["inv"], 1e-6)  # moments: spread between hosts beyond chance
    return paths.join(hosts, "host"), mean, min(max(mean * (1 - mean) / spread - 1, 1.0), 1e4)


def judge(
    docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", site_weight: float = SITE_WEIGHT,
    columns: list[str] | None = None,
) -> DataFrame:
    """``columns`` (or all) of ``docs`` with low, toxic (log odds), site_rate, posterior (probability of bad) and keep.

    Defined cases: a null text has no features; a null host or path is the site of the empty name;
    repeated rows stay and count repeatedly; columns of ``docs`` named like a result are replaced;
    no rows give no rows.

    Scale: texts are scored once, and ``columns`` with their evidence written; site sums are
    combined before their shuffle, and the written rows are judged.  Only if the table of sites is
    too large for Spark to broadcast is there a join by (host, path), of which AQE splits a hot one.
    """
    added = ("low", "toxic", "site_rate", "posterior", "keep")
    kept = [c for c in (docs.columns if columns is None else columns) if c not in added]
    site = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.lit(None).cast("boolean")  # apart from all names used here
    scored = stored(docs.select(own.alias("row"), site(host).alias("host"), site(path).alias("path"), evidence(model, F.col(text).cast("string")).alias("e")))
    scored = scored.withColumn("p", _odds(F.col("e")))
    sites, mean, k = site_rates(scored.select("host", "path", "p"))
    host_rate = (F.col("host_sum") - F.col("p") + k * mean) / (F.col("host_n") - 1 + k)
    rate = (F.col("path_sum") - F.col("p") + k * host_rate) / (F.col("path_n") - 1 + k)
    posterior = 1 / (1 + F.exp(-(_logit(F.col("p")) + site_weight * (_logit(F.col("site_rate")) - _logit(F.lit(mean))))))
    return (
        scored.join(sites, ["host", "path"])
        .withColumn("site_rate", rate)
        .withColumn("posterior", posterior)
        .select(*(F.col("row").getField(c).alias(c) for c in kept), F.col("e.low").alias("low"), F.col("e.toxic").alias("toxic"), "site_rate", "posterior", (F.col("posterior") < 0.5).alias("keep"))
    )
