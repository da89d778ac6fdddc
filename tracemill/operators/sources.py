"""Adapters from raw rows to records, and reject-with-reason filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracemill.functions.text import stripped
from tracemill.operators.grading import boxed

# What the lexical screen looks for.
PROOF = r"(?i)\b(?:prove|proof|show\s+that|demonstrate\s+that)\b"
VISUAL = r"(?i)\b(?:diagram|figure|image|illustration)\b|\[asy\]|<img|!\["
CJK = r"[㐀-鿿]"


def read_rows(spark: SparkSession, path: str, schema: str, form: str = "json") -> DataFrame:
    """JSON lines (a malformed one fails), Parquet or CSV under a schema, with the file that a row is from."""
    if form not in ("json", "parquet", "csv"):
        raise ValueError(f"no reader for {form}")
    reader = spark.read.schema(schema)
    if form != "parquet":
        reader = reader.option("mode", "FAILFAST").option("header", True)
    return reader.format(form).load(path).withColumn("source_file", F.col("_metadata.file_path"))


def write_rows(df: DataFrame, path: str, form: str = "json") -> None:
    """Writes to a path that must not exist."""
    df.write.mode("errorifexists").option("header", form == "csv").format(form).save(path)


def conversation_pairs(rows: DataFrame) -> DataFrame:
    """(conv_id, question, answer) of conversations of exactly a user and then an assistant turn."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    t = rows.groupBy("conv_id").agg(F.count("*").alias("n"), turns.alias("t")).where("n = 2")
    ok = (F.col("t")[0].role == "user") & (F.col("t")[1].role == "assistant")
    return t.where(ok).select("conv_id", F.col("t")[0].text.alias("question"), F.col("t")[1].text.alias("answer"))


def screen_flags(question: Column, reference: Column | None = None) -> Column:
    """Review flags of a question text, and of its reference if that is given; none does not mean that it is fit."""
    void = lambda text: stripped(F.coalesce(text, F.lit(""))) == ""
    rules = [("missing_question", void(question)), *([] if reference is None else [("missing_reference", void(reference))]), ("proof_wording_review", question.rlike(PROOF)), ("visual_dependency_review", question.rlike(VISUAL)), ("cjk_text_review", question.rlike(CJK))]
    if reference is not None:
        rules.append(("missing_or_empty_reference_box", F.coalesce(boxed(reference), F.lit("")) == ""))
    return F.array_compact(F.array(*(F.when(ok, F.lit(name)) for name, ok in rules)))


def failed_filters(df: DataFrame, fails: dict[str, Column]) -> DataFrame:
    """Every row with the names of the filters that it fails, in order."""
    return df.withColumn("failed_filters", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in fails.items()))))


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """One table with a source label; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("source_label", F.lit(n)) for n, df in parts.items()))


def problem_records(df: DataFrame, question: str, answer: str, ident: str | None = None, ordinal: str | None = None) -> DataFrame:
    """problem_id, question, answer and the rest as a JSON text; ids by ordinal where there are none."""
    own = F.col(ident).cast("string") if ident else F.format_string("hf-%06d", F.col(ordinal))
    rest = [c for c in df.columns if c not in (question, answer, ident)]
    return df.select(own.alias("problem_id"), F.col(question).alias("question"), F.col(answer).alias("answer"), F.to_json(F.struct(*rest)).alias("metadata"))
