"""Lines that many documents share, kept only where they stand last, and each document's kept lines as runs.

The hashes of the lines are range-partitioned by (hash, document, position), so a hash of any weight is spread over
as many ranges as it fills; the ranges are written in that order.  A hash that lies within one range is decided by
streaming its rows, the last document first.  Only the first and the last hash of a range can reach into another one:
those, at most two a range, are decided by an aggregate that is combined before its shuffle.  What comes back for a
document is no text but a bitmap of its lines, compressed as the runs of its dropped lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracemill.llm.store import stored

#: What is stripped from both ends of a line for its key, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, row, text): rows equal in id and text have one name, as they have the same lines and the same fate."""
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return chosen.select("doc", F.xxhash64("text", "doc").alias("row"), "text")


def _lines(named: DataFrame, least: int) -> DataFrame:
    """(doc, row, pos, h, g): every line whose key has ``least`` code points or more, the key as two hashes."""
    plain = F.octet_length("text") == F.char_length("text")
    low = F.when(plain, F.lower("text")).otherwise(F.translate("text", UPPER, LOWER))
    cut = named.select("doc", "row", F.posexplode(F.split(low, "\n")).alias("pos", "line"))
    keyed = cut.select("doc", "row", "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).where(F.char_length("key") >= least)
    return keyed.select("doc", "row", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))


def shared_lines(lines: DataFrame, documents: int) -> DataFrame:
    """(doc, row, pos) of the lines to drop: those of hashes in ``documents`` documents or more, but for the last of these."""
    order = ["h", "g", F.col("doc").desc_nulls_last(), "pos"]
    ranges = stored(lines.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()))
    ends = ranges.groupBy("range").agg(F.min(F.struct("h", "g")).alias("a"), F.max(F.struct("h", "g")).alias("b"))
    ends = ends.select(F.explode(F.array("a", "b")).alias("end")).select("end.h", "end.g").distinct()  # at most two a range
    across = ranges.join(F.broadcast(ends), ["h", "g"], "left_semi")
    count = F.count_distinct("doc") + F.max(F.col("doc").isNull().cast("int"))
    judged = across.groupBy("h", "g").agg(count.alias("n"), F.max("doc").alias("last")).where(F.col("n") >= documents)
    outer = across.join(F.broadcast(judged), ["h", "g"]).where(~F.col("doc").eqNullSafe(F.col("last")))
    within = Window.partitionBy("h", "g")
    stream = within.orderBy(F.col("doc").desc_nulls_last())
    inner = ranges.join(F.broadcast(ends), ["h", "g"], "left_anti").withColumn("nth", F.dense_rank().over(stream))
    inner = inner.withColumn("n", F.max("nth").over(within)).where((F.col("n") >= documents) & (F.col("nth") > 1))
    return inner.select("doc", "row", "pos").unionByName(outer.select("doc", "row", "pos"))


def _bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc, row, n_dropped, dropped): each row's dropped lines as runs of (at, n), in order."""
    found = dropped.groupBy("doc", "row").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    first = F.filter("p", lambda x, i: ~F.get("p", i - 1).eqNullSafe(x - 1))
    last = F.filter("p", lambda x, i: ~F.get("p", i + 1).eqNullSafe(x + 1))
    runs = F.transform(F.arrays_zip(first.alias("a"), last.alias("b")), lambda r: F.struct(r["a"].alias("at"), (r["b"] - r["a"] + 1).alias("n")))
    return found.select("doc", "row", F.size("p").cast("long").alias("n_dropped"), runs.alias("dropped"))


def kept_lines(lines: Column, dropped: Column) -> Column:
    """The lines that a bitmap of dropped runs keeps; null or no runs keep all."""
    end = lambda i: F.coalesce(F.get(dropped, i)["at"] + F.get(dropped, i)["n"], F.lit(0))
    before = F.transform(dropped, lambda r, i: F.slice(lines, end(i - 1) + 1, r["at"] - end(i - 1)))
    after = F.slice(lines, end(F.size(dropped) - 1) + 1, F.size(lines))
    return F.when(F.coalesce(F.size(dropped), F.lit(0)) > 0, F.concat(F.flatten(before), after)).otherwise(lines)


def drop_shared_lines(docs: DataFrame, least: int = 20, documents: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped, kept): every row with its bitmap of dropped runs and the text that it leaves.

    A line's key is the line stripped of blanks at both ends, A-Z lower-cased; a key of ``least`` code points or more
    that ``documents`` documents or more hold stays only in the document of the greatest id, there in all its lines.
    Defined cases: a null or an empty text is one empty line; rows of equal ids are one document, null ids too, and that
    comes before all others; repeated rows stay and share one fate; a text that ends with a line feed ends with an
    empty line; other columns are ignored; no rows give no rows.
    """
    named = _named(docs, doc_id, text)
    bitmaps = _bitmaps(shared_lines(_lines(named, least), documents)).withColumnsRenamed({"doc": "d", "row": "r"})
    same = F.col("row").eqNullSafe(F.col("r")) & F.col("doc").eqNullSafe(F.col("d"))
    cut = named.join(bitmaps, same, "left").select("doc", "n_dropped", "dropped", F.split("text", "\n").alias("lines"))
    return cut.select(
        F.col("doc").alias("doc_id"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"),
        F.coalesce("dropped", F.array().cast("array<struct<at:int,n:int>>")).alias("dropped"),
        F.array_join(kept_lines(F.col("lines"), F.col("dropped")), "\n").alias("kept"),
    )
