"""Benchmark decontamination: a prefix-filtered set join with exact verification.

Items are cut into windows of ``size`` words, windows into shingles of five words.  A window
must be contained whole, so any one of its shingles is a necessary prefix: the rarest is taken,
counted over the places of all documents.  The prefix table is joined with the documents'
shingles by Spark; the offset of the prefix in its window and the lengths bound where the
window can lie; what is left is verified word by word.  Items of fewer words than ``size`` are
one window of their own length, those of fewer than five words one shingle of their own.

Windows, prefixes and places are tables; nothing of the items is gathered on the driver but a
Bloom filter of their shingles, of ``FILTER_BYTES`` at most.  It only spares rows: a full one
lets more shingles through to the join and changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tracemill.llm.store import stored

#: Words of a shingle.
SHINGLE = 5
#: The Bloom filter: bits for each shingle, bytes of a block, and of the whole at most.
FILTER_BITS, BLOCK_BYTES, FILTER_BYTES = 16, 1 << 16, 32 << 20
#: Bytes of text taken at a time, and windows in one batch.
SLICE_BYTES, BATCH = 2 << 20, 1 << 13
#: Odd multipliers of the polynomial hashes of bytes and of words.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: A-Z lower-cased; what is neither digit, letter nor beyond ASCII becomes a space.
WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def spaced(text: str | None) -> bytes:
    """The text in lower case with spaces for all that belongs to no word."""
    return (text or "").encode("utf-8", "replace").translate(WORDS)


def words_of(text: str | None) -> list[bytes]:
    return spaced(text).split()


def windows_of(words: list, size: int) -> list[tuple]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of an odd base modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """Where the words of several spaced texts lie, their owners and their hashes."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts) + b" "
        lens = np.array([len(t) + 1 for t in texts], np.int64)
        raw = np.frombuffer(self.data, np.uint8)
        edge = np.flatnonzero(np.diff((raw != 0x20).view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edge[::2], edge[1::2]
        self.owner = np.searchsorted(np.cumsum(lens), self.start, side="right")
        self.n = np.bincount(self.owner, minlength=len(texts)).astype(np.int64)
        self.first = np.cumsum(self.n) - self.n
        room = 1 << max(12, len(raw).bit_length())
        back = pow(BYTE_BASE, -1, 1 << 64)
        summed = np.concatenate(([np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(BYTE_BASE, room)[: len(raw)])))
        self.hash = _mixed((summed[self.end] - summed[self.start]) * _powers(back, room)[self.start])

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of ``size`` words inside one text."""
        m = len(self.start) - size + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.owner[:m] == self.owner[size - 1 :])
        h = np.full(len(at), size, np.uint64)
        for j in range(size):
            h = h * np.uint64(WORD_BASE) + self.hash[at + j]
        return at, _mixed(h)

    def said(self, a: int, b: int) -> str:
        """Words a to b - 1, one space between them."""
        return b" ".join(self.data[self.start[a] : self.end[b - 1]].split()).decode()


def _slices(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, texts) in runs of about SLICE_BYTES bytes."""
    begin, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t) + 1
        if held >= SLICE_BYTES:
            yield begin, texts[begin : k + 1]
            begin, held = k + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


WINDOWS = "item string, said string, m int, tokens array<long>"


def _windows(benchmark: DataFrame, size: int, item_id: str, text: str) -> DataFrame:
    """One row for each window of each item, with its shingles in their order."""
    width = min(SHINGLE, size)

    def run(batches):
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = Words([spaced(text)])
                n = len(words.start)
                if not n:
                    continue
                m, w = min(n, size), min(n, width)
                hashes = words.shingles(w)[1].view(np.int64)
                for a in range(0, n - m + 1, BATCH):
                    starts = np.arange(a, min(a + BATCH, n - m + 1))
                    said = [words.said(s, s + m) for s in starts.tolist()]
                    per = m - w + 1
                    tokens = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * per, pa.int32()), pa.array(hashes[(starts[:, None] + np.arange(per)).ravel()]))
                    columns = [pa.array([name] * len(starts), pa.string()), pa.array(said, pa.string()), pa.array(np.full(len(starts), m, np.int32)), tokens]
                    yield pa.RecordBatch.from_arrays(columns, ["item", "said", "m", "tokens"])

    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text"))
    return stored(rows.where("text is not null").mapInArrow(run, WINDOWS))


def _places(h: np.ndarray, blocks: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block of a hash in the filter, and its two bits in the ``width`` bytes there."""
    bits = np.uint64(8 * width)
    return tuple(x.astype(np.int64) for x in ((h >> np.uint64(48)) % np.uint64(blocks), h % bits, (h >> np.uint64(24)) % bits))


def _filter(tokens: DataFrame, width: int, limit: int) -> np.ndarray:
    """The blocks of the Bloom filter of all shingles, made one block a group."""
    n = tokens.count()
    blocks = max(1, min(limit // width, -(-n * FILTER_BITS // (8 * width))))

    def numbered(batches):
        for batch in batches:
            block = _places(batch.column(0).to_numpy().view(np.uint64), blocks, width)[0]
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), batch.column(0)], ["block", "token"])

    def fill(table: pa.Table) -> pa.Table:
        bits = np.zeros(8 * width, bool)
        _, one, two = _places(table.column("token").to_numpy().view(np.uint64), blocks, width)
        bits[one] = bits[two] = True
        return pa.table({"block": table.column("block")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    made = tokens.mapInArrow(numbered, "block int, token long").groupBy("block").applyInArrow(fill, "block int, bits binary")
    out = np.zeros((blocks, width), np.uint8)
    for r in made.collect():  # ``limit`` bytes at most
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out


def _passing(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    block, one, two = _places(h, *bits.shape)
    inside = lambda at: (bits[block, at >> 3] >> (at & 7).astype(np.uint8)) & 1
    return (inside(one) & inside(two)).astype(bool)


PLACE = "struct<pos:int,token:long,lead:int,said:string>"
SEEN = f"doc_id long, key string, n_words long, places array<{PLACE}>"


def _seen(docs: DataFrame, bits, size: int, lengths: list[int]) -> DataFrame:
    """Per document: its number of words and the shingles that windows may have, with the words about them."""
    width = min(SHINGLE, size)
    short = [m for m in lengths if m < width]
    least = min((m for m in lengths if m >= width), default=None)

    def places(words: Words, grid: np.ndarray):
        """(word, hash, words before, words in all) of every place a window may take."""
        for w in [*short, *([width] if least else [])]:
            at, h = words.shingles(w)
            ok = _passing(h, grid)
            at, h = at[ok], h[ok]
            if w == width and least and least > width and len(at):  # a window needs so many shingles in a row
                cut = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | np.diff(words.owner[at]).astype(bool), [True])))
                long = np.diff(cut) >= least - width + 1
                keep = np.repeat(long, np.diff(cut))
                at, h = at[keep], h[keep]
            own = words.owner[at]
            pos = at - words.first[own]
            lead = np.minimum(pos, size - width) if w == width else np.zeros(len(at), np.int64)
            reach = np.minimum(words.n[own] - pos, size) if w == width else np.full(len(at), w)
            yield from zip(own.tolist(), at.tolist(), pos.tolist(), h.view(np.int64).tolist(), lead.tolist(), reach.tolist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]):
        grid = bits.value
        for batch in batches:
            for begin, texts in _slices([spaced(t) for t in batch.column(2).to_pylist()]):
                words = Words(texts)
                found: list[list] = [[] for _ in texts]
                for own, at, pos, h, lead, reach in places(words, grid):
                    found[own].append({"pos": pos, "token": h, "lead": lead, "said": words.said(at - lead, at + reach)})
                kind = pa.list_(pa.struct([("pos", pa.int32()), ("token", pa.int64()), ("lead", pa.int32()), ("said", pa.string())]))
                part = batch.slice(begin, len(texts))
                columns = [part.column(0), part.column(1), pa.array(words.n), pa.array(found, kind)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n_words", "places"])

    return stored(docs.mapInArrow(run, SEEN))


def _prefixes(windows: DataFrame, places: DataFrame) -> DataFrame:
    """(token, shift, m, said): each distinct window by its rarest shingle; one with a shingle that no document has is out."""
    counts = places.groupBy("token").agg(F.count("*").alias("n"))
    parts = windows.select("said", "m", F.size("tokens").alias("all"), F.posexplode("tokens").alias("shift", "token")).distinct()
    ranked = parts.join(counts, "token").groupBy("said", "m", "all").agg(
        F.count("*").alias("had"), F.min(F.struct("n", "token", "shift")).alias("least")
    )
    return ranked.where("had = all").select("least.token", "least.shift", "m", F.col("said").alias("window"))


def _runs(found: DataFrame) -> DataFrame:
    """(key, runs): the maximal runs of hit words; a group is one text."""
    by = Window.partitionBy("key").orderBy("a", "b")
    before = F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1))
    cut = found.select("key", "a", "b").distinct().withColumn("new", (F.coalesce(before, F.lit(-1)) < F.col("a")).cast("int"))
    islands = cut.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("key", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return islands.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"))


def find_items(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, filter_bytes: int = FILTER_BYTES, keyed: bool = False,
) -> DataFrame:
    """(doc_id, n_words, runs, items) for every document: hit word runs [a, b) and the items found, sorted as strings.

    With ``keyed`` comes ``key``, the digest of the text (null for a null text).

    Defined cases: null texts have no words and match nothing; an item of fewer than ``size``
    words is one window, of none no window; equal item_ids are one item and a null one is the
    empty string; repeated documents stay; other columns are ignored; no rows give no rows.
    """
    windows = _windows(benchmark, size, item_id, item_text)
    lengths = sorted(r["m"] for r in windows.select("m").distinct().collect())  # ``size`` values at most
    bits = _filter(windows.select(F.explode("tokens").alias("token")).distinct(), block_bytes, filter_bytes)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.sha2(F.col(text).cast("string"), 256).alias("key"), F.col(text).cast("string").alias("text"))
    seen = _seen(base, docs.sparkSession.sparkContext.broadcast(bits), size, lengths)
    places = seen.where("size(places) > 0").select("key", F.inline("places"))
    at = F.col("pos") - F.col("shift")
    lies = F.slice(F.split("said", " "), F.col("lead") - F.col("shift") + 1, F.col("m"))
    near = places.join(_prefixes(windows, places), "token").where("lead >= shift")
    found = stored(near.where(F.array_join(lies, " ") == F.col("window")).select("key", at.alias("a"), (at + F.col("m")).alias("b"), "window").distinct())
    owners = windows.select(F.col("said").alias("window"), "item").distinct()
    items = found.select("key", "window").distinct().join(owners, "window").select("key", "item").distinct()
    items = items.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    none = {"runs": F.array().cast("array<struct<a:int,b:int>>"), "items": F.array().cast("array<string>")}
    head = ["doc_id", "key", "n_words"]
    clean = seen.where("size(places) = 0").select(*head, *(v.alias(k) for k, v in none.items()))
    rest = seen.where("size(places) > 0").select(*head).join(_runs(found).join(items, "key"), "key", "left")
    both = clean.unionByName(rest.select(*head, *(F.coalesce(k, v).alias(k) for k, v in none.items())))
    return both if keyed else both.drop("key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, **names) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated); see ``find_items``."""
    found = find_items(docs, benchmark, size, **names)
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r.b - r.a)
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame, size: int = 10, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of an item; all columns as they are.

    A row is judged by its own text, so null and repeated ids make no difference; a null text stays.
    """
    found = find_items(docs, benchmark, size, doc_id, text, keyed=True, **names)
    bad = found.where("size(runs) > 0").select(F.col("key").alias("judged")).distinct()
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.sha2(F.col(f"`{text}`").cast("string"), 256).alias("own"))
    return own.join(bad, F.col("own") == F.col("judged"), "left_anti").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def plain(text: str | None, items: list[tuple[str, str | None]], size: int = 10) -> tuple[int, int, int, str, bool]:
    """The result for one document by comparing it with every window; for tests."""
    words, hit, names = words_of(text), set(), set()
    for name, t in items:
        for w in windows_of(words_of(t), size):
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    names.add(name)
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)
