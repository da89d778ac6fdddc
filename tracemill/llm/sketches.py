"""Document fingerprints as invertible Bloom lookup sketches (DataFrame operations only).

A document's set of paragraphs (lines that are not empty) is hashed to 64-bit digests.  A
sketch has three rows of WIDTH cells; a digest enters one cell of each row, and a cell holds
the number of its digests, their exclusive or, and that of their check sums.  Subtracting
two sketches cell by cell leaves the digests that only one document has, and peeling cells
with a single digest recovers them.  If that fails, the digests are split by two more of
their bits into four sketches, so the retry is four times larger; only what failed goes on.
Each retry handles every digest once, so the work grows with the text, not its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracemill.llm.store import shuffle_partitions, stored

ROWS, WIDTH = 3, 8
CELLS = ROWS * WIDTH
#: Peeling steps of one sketch: more digests than so many do not fit its cells.
STEPS = 18
#: Bits of a digest from which the splits of retries are taken, two a level, above those of the cells.
SPLIT_FROM, LEVELS = 12, 26
CHECK = 0xFFFFFFFF


def paragraphs(text: Column) -> Column:
    """Distinct digests of the lines of a text that are not empty."""
    return F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda p: F.length(p) > 0), lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(1)).bitwiseAND(F.lit(CHECK))


def _place(digest: Column, row: int) -> Column:
    """The cell of a digest in one row."""
    return F.shiftrightunsigned(digest, 3 * row).bitwiseAND(F.lit(WIDTH - 1)) + row * WIDTH


def _in_cell(digest: Column, cell: Column) -> Column:
    """Whether a digest enters this cell."""
    row = F.floor(cell / WIDTH).cast("int")
    bits = F.when(row == 0, digest).when(row == 1, F.shiftrightunsigned(digest, 3)).otherwise(F.shiftrightunsigned(digest, 6))
    return bits.bitwiseAND(F.lit(WIDTH - 1)) == cell - row * WIDTH


def _cell(n: Column, key: Column, check: Column) -> Column:
    return F.struct(n.cast("long").alias("n"), key.alias("k"), check.alias("c"))


def _zero() -> Column:
    return _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))


def sketch(digests: Column) -> Column:
    """The cells of an array of digests."""

    def cell(i):
        put = lambda acc, d: _cell(acc.n + 1, acc.k.bitwiseXOR(d), acc.c.bitwiseXOR(_check(d)))
        return F.aggregate(F.filter(digests, lambda d: _in_cell(d, i)), _zero(), put)

    return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), cell)


def subtract(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: _cell(a.n - b.n, a.k.bitwiseXOR(b.k), a.c.bitwiseXOR(b.c)))


def peel(cells: Column) -> Column:
    """struct(cells, plus, minus): what is left, and the digests recovered from either side."""
    none = F.array().cast("array<long>")
    pure = lambda c: (F.abs(c.n) == 1) & (_check(c.k) == c.c)

    def step(acc, _):
        found = F.filter(acc.cells, pure)
        one = F.coalesce(F.get(found, F.lit(0)), _zero())

        def less(c, i):
            gone = _cell(c.n - one.n, c.k.bitwiseXOR(one.k), c.c.bitwiseXOR(one.c))
            return F.when(_in_cell(one.k, i), gone).otherwise(c)

        new = F.array(one.k)
        then = F.struct(
            F.transform(acc.cells, less).alias("cells"),
            F.when(one.n > 0, F.concat(acc.plus, new)).otherwise(acc.plus).alias("plus"),
            F.when(one.n < 0, F.concat(acc.minus, new)).otherwise(acc.minus).alias("minus"),
        )
        return F.when(F.size(found) > 0, then).otherwise(acc)

    start = F.struct(cells.alias("cells"), none.alias("plus"), none.alias("minus"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)


def differences(pairs: DataFrame, *key: str) -> DataFrame:
    """(key, plus, minus): the digests only in ``left`` and only in ``right``, over all retries.

    ``pairs`` has the key columns and the arrays left and right of distinct digests.  Each level
    is written to the shared folder; the driver learns only whether sketches are left.
    """
    now, done = pairs.select(*key, "left", "right"), []
    for level in range(LEVELS + 1):
        peeled = peel(subtract(sketch(F.col("left")), sketch(F.col("right"))))
        ok = ~F.exists("p.cells", lambda c: (c.n != 0) | (c.k != 0) | (c.c != 0))
        tried = stored(
            now.withColumn("p", peeled)
            .withColumn("ok", ok)
            .select(
                *key,
                "ok",
                *(F.when(F.col("ok"), F.col(f"p.{c}")).alias(c) for c in ("plus", "minus")),
                *(F.when(~F.col("ok"), F.col(c)).alias(c) for c in ("left", "right")),
            )
        )
        done.append(tried.where("ok").select(*key, "plus", "minus"))
        failed = tried.where("not ok")
        if failed.isEmpty():
            break
        if level == LEVELS:  # digests that agree in all these bits: compared directly
            done.append(failed.select(*key, F.array_except("left", "right").alias("plus"), F.array_except("right", "left").alias("minus")))
            break
        part = lambda c, level=level: F.filter(
            c, lambda d: F.shiftrightunsigned(d, SPLIT_FROM + 2 * level).bitwiseAND(F.lit(3)) == F.col("part")
        )
        split = failed.withColumn("part", F.explode(F.array(*(F.lit(i).cast("long") for i in range(4)))))
        now = split.select(*key, part("left").alias("left"), part("right").alias("right"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def fingerprint(cells: Column) -> Column:
    """The cells as hexadecimal: four digits of the number, sixteen of the key, eight of the check, each."""
    part = lambda c, n: F.lower(F.lpad(F.right(F.hex(c), F.lit(n)), n, "0"))
    return F.array_join(F.transform(cells, lambda c: F.concat(part(c.n, 4), part(c.k, 16), part(c.c, 8))), "")


def likeness(left: Column, right: Column, apart: Column) -> Column:
    """The shared part of two sets of the given sizes that differ in ``apart`` members (Dice); two empty ones are alike."""
    both = left + right
    return F.when(both == 0, F.lit(1.0)).otherwise(1.0 - apart / both)


def with_next(docs: DataFrame, doc_id: str, text: str, buckets: int | None = None) -> DataFrame:
    """(bucket, place, doc_id, text, next): each row with the text of the next one by descending doc_id, the last with the first.

    Rows are dealt to buckets by quantiles of doc_id (at most ``buckets`` numbers come to the
    driver), each bucket is one window, and the first row of the following bucket is added to
    each bucket, so there is no window over all rows and one shuffle of the texts.
    Equal ids are ordered by a hash of the text; null ids come last.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("d", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = buckets or 2 * shuffle_partitions(spark)
    cuts = rows.agg(F.percentile_approx("d", [i / n for i in range(1, n)] if n > 1 else [0.5], 10_000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    bounds, steps = F.lit([-(1 << 63), *cuts]), [1 << k for k in reversed(range((len(cuts) + 1).bit_length()))]
    go = lambda lo, s: F.when(
        (lo + s <= len(cuts)) & (F.coalesce(F.get(bounds, lo + s), F.lit(1 << 62)) <= F.col("d")), lo + s
    ).otherwise(lo)
    rows = rows.withColumn("bucket", F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), go))
    heads = {r["bucket"]: r["d"] for r in rows.groupBy("bucket").agg(F.max("d").alias("d")).collect()}
    order = sorted(heads, reverse=True)
    follows = [(b, heads[order[(i + 1) % len(order)]]) for i, b in enumerate(order)]
    edge = spark.createDataFrame(follows, "to int, d long")
    head = F.min_by("text", F.struct(F.xxhash64("text"), F.col("text")))
    texts = rows.join(F.broadcast(edge.select("d").distinct()), "d", "left_semi").groupBy("d").agg(head.alias("text"))  # one id a bucket
    edges = edge.join(texts, "d").select(
        F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("d"), F.col("to").alias("bucket"), F.lit(True).alias("edge")
    )
    every = rows.withColumn("edge", F.lit(False)).unionByName(edges)
    w = Window.partitionBy("bucket").orderBy("edge", F.desc("d"), F.xxhash64("text"), "text")
    seen = every.withColumns({"next": F.lead("text").over(w), "place": F.row_number().over(w)})
    return seen.where("not edge").select("bucket", "place", "doc_id", "text", "next")


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness; see the README for the edit.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).
    Likeness is the Dice share of common paragraphs, from the digests that peeling recovers.

    Defined cases: a null text is empty; two texts without paragraphs are alike (1), one with and
    one without are not (0); a single row is its own next; equal ids are ordered by the text's
    hash, null ids come last; repeated rows stay; other columns are ignored; no rows give no rows.
    """
    seen = with_next(docs, doc_id, text)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half))
    sets = stored(
        seen.withColumns({"n_chars": F.length("text").cast("long"), "edited": edited}).select(
            "bucket", "place", "doc_id", "n_chars",
            F.sha2("edited", 256).alias("edited_sha256"),
            paragraphs(F.col("text")).alias("own"), paragraphs(F.col("edited")).alias("new"), paragraphs(F.col("next")).alias("other"),
        )
    )
    pair = lambda name, right: F.struct(F.lit(name).alias("pair"), F.col(right).alias("right"))
    pairs = sets.select("bucket", "place", F.col("own").alias("left"), F.explode(F.array(pair(0, "new"), pair(1, "other"))).alias("x"))
    apart = differences(pairs.select("bucket", "place", "x.pair", "left", "x.right"), "bucket", "place", "pair")
    size = F.size("plus") + F.size("minus")
    sums = apart.groupBy("bucket", "place").agg(
        F.sum(F.when(F.col("pair") == 0, size).otherwise(0)).alias("to_edited"), F.sum(F.when(F.col("pair") == 1, size).otherwise(0)).alias("to_next")
    )
    return sets.join(sums, ["bucket", "place"]).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(sketch(F.col("own"))).alias("fingerprint"),
        fingerprint(sketch(F.col("new"))).alias("edited_fingerprint"),
        likeness(F.size("own"), F.size("new"), F.col("to_edited")).alias("near_edited"),
        likeness(F.size("own"), F.size("other"), F.col("to_next")).alias("near_next"),
    )
