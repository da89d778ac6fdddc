"""Rows of differently laid out sources as one kind of record, by a declared table of paths for each layout.

A source's rows are JSON texts, read as VARIANT: a layout says where its fields lie, in which form, and what a row
must say to be in scope.  No row is lost: one that gives no record keeps its reason.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tracemill.functions.text import stripped
from tracemill.operators.grading import boxed, final_answer

#: How a field's text becomes an answer.
READINGS: dict[str, Callable[[Column], Column]] = {"as_is": lambda c: c, "final_answer": final_answer, "box": boxed}
RECORD = ("problem_id", "source_index", "dataset", "question", "answer", "reference_solution", "source_unique_id", "details")


@dataclass(frozen=True)
class Layout:
    """Paths such as ``$.a.b`` of the record's fields in a source's rows.

    ``question`` may have several paths, joined by line feeds, and one of an array, whose elements are joined too.
    ``answer`` has (path, reading) in order of preference; ``scope`` the values that paths must have; ``absent`` paths
    that must be null or empty; ``details`` further fields by name, kept as texts.
    """

    question: tuple[str, ...]
    answer: tuple[tuple[str, str], ...]
    reference: str | None = None
    unique_id: str | None = None
    scope: dict[str, str] = field(default_factory=dict)
    absent: tuple[str, ...] = ()
    details: dict[str, str] = field(default_factory=dict)


def _text(row: Column, path: str) -> Column:
    """What lies at a path as a text: a list's elements one a line; null if nothing does."""
    return F.coalesce(F.array_join(F.try_variant_get(row, path, "array<string>"), "\n"), F.try_variant_get(row, path, "string"))


def adapted(rows: DataFrame, dataset: str, layout: Layout, raw: str = "row", index: str = "source_index") -> DataFrame:
    """Records of one source, and ``rejected``: why a row is none (null: it is one).

    Reasons, the first that holds: malformed (no JSON object, or null), outside_scope, unexpected_content (of a path
    that must be empty), missing_question, missing_answer (null, empty or white space).  A rejected row keeps its index.
    """
    v = F.try_parse_json(F.col(raw))
    read = rows.select(F.col(index).cast("long").alias("source_index"), v.alias("v"))
    blank = lambda c: stripped(F.coalesce(c, F.lit(""))) == ""
    at = lambda path: _text(F.col("v"), path)
    outside = [~at(p).eqNullSafe(F.lit(want)) for p, want in layout.scope.items()]
    filled = [~blank(at(p)) for p in layout.absent]
    answers = [READINGS[how](at(p)) for p, how in layout.answer]
    details = [x for name, p in layout.details.items() for x in (F.lit(name), at(p))]
    any_of = lambda some: F.array_contains(F.array(*some), True) if some else F.lit(False)
    record = read.select(
        "source_index",
        F.format_string(f"{dataset}-%05d", "source_index").alias("problem_id"),
        F.lit(dataset).alias("dataset"),
        F.concat_ws("\n", *(at(p) for p in layout.question)).alias("question"),
        F.coalesce(*(F.when(~blank(a), a) for a in answers)).alias("answer"),
        (at(layout.reference) if layout.reference else F.lit(None).cast("string")).alias("reference_solution"),
        (at(layout.unique_id) if layout.unique_id else F.lit(None).cast("string")).alias("source_unique_id"),
        (F.create_map(*details) if details else F.create_map().cast("map<string,string>")).alias("details"),
        F.when(F.coalesce(F.schema_of_variant("v"), F.lit("VOID")).startswith("OBJECT"), F.when(any_of(outside), "outside_scope").when(any_of(filled), "unexpected_content")).otherwise("malformed").alias("why"),
    )
    reason = F.when(F.col("why").isNotNull(), F.col("why")).when(blank(F.col("question")), "missing_question").when(blank(F.col("answer")), "missing_answer")
    return record.select(*RECORD, reason.alias("rejected"))


def union_of_layouts(sources: dict[str, tuple[DataFrame, Layout]], raw: str = "row", index: str = "source_index") -> DataFrame:
    """The records and rejections of all sources as one table."""
    first, *rest = [adapted(rows, name, layout, raw, index) for name, (rows, layout) in sources.items()]
    for more in rest:
        first = first.unionByName(more)
    return first
