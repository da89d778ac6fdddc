"""The corpus pipeline: five stages, each over all documents that its predecessor kept.

Every stage takes any rows with the columns of ``documents``: columns besides are dropped, no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracemill.llm import bpe, decontaminate, quality, simhash, suffixes
from tracemill.llm.queries import table, vocabulary
from tracemill.llm.store import scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL for the whole pipeline: none, as no stage but the fourth can be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects as low in quality or toxic.

    Every row is judged by its own text and site: a null or empty text has no features and is judged by its
    site alone, null and repeated ids make no difference, repeated rows share one fate.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model, columns=COLUMNS).where("keep").select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies one row, that of the smallest doc_id (see ``near_unique`` for nulls and repeats)."""
    return simhash.near_unique(docs.select(*COLUMNS), size=5, similarity=0.8)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings of 50 and more that an earlier document has; documents of which nothing is left go.

    A null text comes out empty; null ids come last, and rows of equal ids do not cut each other; ``n_chars`` is
    counted anew.
    """
    cut = suffixes.remove_repeats(docs, length=50, texts=True, carry=["lang", "source"])
    rest = F.from_json("carry", "lang string, source string")
    kept = cut.where("n_removed = 0 or kept != ''").withColumn("rest", rest)
    return kept.select("doc_id", F.col("kept").alias("text"), "rest.lang", "rest.source", F.length("kept").cast("long").alias("n_chars"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose own text holds a window of ten words of a benchmark item; a null text stays."""
    return decontaminate.clean_rows(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), size=10)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left: one row each with its ids and the digests of the round trip; a null text has no ids."""
    return bpe.encode_documents(docs, vocabulary(), ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("suffix-array dedup", repeats_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("BPE encoding", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = scratch(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
