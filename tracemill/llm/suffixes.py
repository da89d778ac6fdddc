"""Removal of long byte strings that an earlier document has, by a logarithmic suffix index.

Only matches of ``length`` bytes matter, so suffixes are compared over their first
``length`` bytes, and suffixes that cannot match are left out first:

1. A window is a start whose ``length`` bytes lie in one document.  Each window has the least
   hash of its ANCHOR-byte strings; equal windows have equal least hashes.  Each chunk sends
   the set of its least hashes, by shard of the hash; those that two documents have come back.
2. Each chunk takes its windows with such hashes, settles those that a smaller document of the
   same chunk has, and sends the bytes of the rest to the shard of their hash.
3. A shard adds its suffixes to a ``SuffixLevels`` family in the order of doc_id, batch by
   batch: a batch gets a sorted suffix array, is merge-scanned against the levels for matches
   with smaller documents, and becomes a level; levels of equal size merge geometrically.
   The matched starts go back to their chunks, which cut the covered bytes.

Hashes only choose what is compared: every match is one of bytes.  A passage that a third
of all documents have reaches its shard at most once from each chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracemill.llm.chunks import LAST, Chunk, by_shard, gaps, packed, ragged, spread, squeeze, trim
from tracemill.llm.store import shuffle_partitions

ANCHOR = 24
CHUNK_BYTES = 4 << 20
BATCH = 1 << 16
#: Windows hashed or compared at a time.
BLOCK = 1 << 19
MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class SuffixLevels:
    """Sorted suffix arrays of geometrically growing size, each suffix with its smallest document.

    Suffixes are byte strings of one fixed width.  Batches must come in the order of their
    documents; a batch may end inside a document.
    """

    def __init__(self, width: int):
        self.width = width
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, suffixes: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Whether each suffix is also that of a smaller document, of this batch or of an earlier one."""
        order = np.lexsort((docs, suffixes)) if len(suffixes) < 2 else np.argsort(suffixes, kind="stable")
        array, owner = suffixes[order], docs[order]
        if not len(array):
            return np.zeros(0, bool)
        head = np.concatenate(([True], array[1:] != array[:-1]))
        least = np.minimum.reduceat(owner, np.flatnonzero(head))
        unique = array[head]
        group = np.cumsum(head) - 1
        for level, first in self.levels:  # merge scan: both sides are sorted
            at = np.minimum(np.searchsorted(level, unique), len(level) - 1)
            least = np.where(level[at] == unique, np.minimum(least, first[at]), least)
        found = np.empty(len(array), bool)
        found[order] = least[group] < owner
        self.levels.append((unique, least))
        while len(self.levels) > 1 and len(self.levels[-1][0]).bit_length() >= len(self.levels[-2][0]).bit_length():
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            both, own = np.concatenate((b, a)), np.concatenate((y, x))
            order = np.argsort(both, kind="stable")
            both, own = both[order], own[order]
            head = np.concatenate(([True], both[1:] != both[:-1]))
            self.levels.append((both[head], np.minimum.reduceat(own, np.flatnonzero(head))))
        return found


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The least or largest of every ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        values = pick(values[:-done], values[done:])
        done *= 2
    return pick(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


def words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at every position, as an overlapping view."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))


def least_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """The least 48-bit hash of the ANCHOR-byte strings of every window of ``length`` bytes."""
    n = len(data) - length + 1
    out = np.zeros(max(0, n), np.uint64)
    for i in range(0, max(0, n), BLOCK):
        m = min(BLOCK, n - i)
        w = words(data[i : i + m + length - 1])
        h = w[: -(ANCHOR - 8)] * MIX[0]
        for k in range(8, ANCHOR, 8):
            h ^= h >> np.uint64(29)
            h += w[k : k + len(h)] * MIX[k // 8]
        h ^= h >> np.uint64(32)
        h *= MIX[3]
        h >>= np.uint64(16)
        out[i : i + m] = sliding(h, length - ANCHOR + 1, np.minimum)
    return out


def runs(chunk: Chunk, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one document with one least hash: (start, number, hash, document's place)."""
    starts, room = chunk.starts, np.maximum(chunk.lens - length + 1, 0)
    least = least_hashes(chunk.data, length)
    change = np.zeros(len(chunk.data) + 2, np.int32)
    np.add.at(change, starts[room > 0], 1)
    np.add.at(change, (starts + room)[room > 0], -1)
    inside = np.cumsum(change[: len(least)]) > 0
    head = inside.copy()
    head[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
    end = inside.copy()
    end[:-1] &= ~inside[1:] | (least[1:] != least[:-1])
    first, last = np.flatnonzero(head), np.flatnonzero(end)
    whole = np.flatnonzero(chunk.lens > 0)
    place = whole[np.searchsorted(starts[whole], first, side="right") - 1]
    return first, last - first + 1, least[first], place


def _rows(shards, chunk: int, blobs) -> pa.Table:
    return pa.table({"shard": pa.array(shards, pa.int64()), "chunk": pa.array([chunk] * len(shards), pa.int64()), "blob": pa.array(blobs, pa.binary())})


MOVED = "shard long, chunk long, blob binary"


def _offer(length: int, shards: int):
    """Step 1, of a chunk: its least hashes, and which of them two of its documents have."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                _, _, least, place = runs(Chunk.of(batch, k), length)
                order = np.lexsort((place, least))
                least, place = least[order], place[order]
                head = np.concatenate(([True], least[1:] != least[:-1])) if len(least) else np.zeros(0, bool)
                several = np.zeros(int(head.sum()), bool)
                group = np.cumsum(head) - 1
                several[group[1:][~head[1:] & (place[1:] != place[:-1])]] = True
                least = least[head]
                out = [(s, squeeze(gaps(least[g]), several[g])) for s, g in by_shard((least % np.uint64(shards)).astype(np.int64))]
                if out:
                    yield from _rows([s for s, _ in out], batch.column("chunk")[k].as_py(), [b for _, b in out]).to_batches()
                del least, place, order, head, several, group, out
                trim()

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Step 1, of a shard: the least hashes that several documents have, for each chunk with them."""
    chunks = table.column("chunk").to_pylist()
    parts = [spread(b.as_py()) for b in table.column("blob")]
    hashes = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
    flat = np.concatenate(hashes)
    unique, count = np.unique(np.concatenate((flat, *(h[p[1]] for h, p in zip(hashes, parts, strict=True)))), return_counts=True)
    shared = unique[count > 1]
    kept = [h[np.isin(h, shared, assume_unique=True)] for h in hashes]
    some = [(c, squeeze(gaps(h))) for c, h in zip(chunks, kept, strict=True) if len(h)]
    return pa.table({"chunk": pa.array([c for c, _ in some], pa.int64()), "blob": pa.array([b for _, b in some], pa.binary())})


def segments(at: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions as (first index, number) of runs of neighbours with equal values."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.diff(at) != 1
    for s in same:
        cut |= s[1:] != s[:-1]
    first = np.flatnonzero(np.concatenate(([True], cut)))
    return first, np.diff(np.append(first, len(at)))


def _settled(data: np.ndarray, at: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """Windows whose bytes a smaller document of the chunk has (a few may be left to the shards)."""
    w = words(data)
    h = np.zeros(len(at), np.uint64)
    steps = [*range(0, length - 8, 8), length - 8]
    for i in range(0, len(at), BLOCK):
        p = at[i : i + BLOCK]
        g = np.zeros(len(p), np.uint64)
        for k in steps:
            g = (g ^ (g >> np.uint64(29))) * MIX[3] + w[p + k] * MIX[0]
        h[i : i + BLOCK] = g
    order = np.lexsort((owner, h))
    sorted_h = h[order]
    head = np.concatenate(([True], sorted_h[1:] != sorted_h[:-1]))
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))]
    maybe = owner[first] < owner[order]
    mine, theirs = order[maybe], first[maybe]
    out = np.zeros(len(at), bool)
    for i in range(0, len(mine), BLOCK):
        a, b = at[mine[i : i + BLOCK]], at[theirs[i : i + BLOCK]]
        equal = np.ones(len(a), bool)
        for k in steps:
            equal &= w[a + k] == w[b + k]
        out[mine[i : i + BLOCK]] = equal
    return out


def _ask(length: int, shards: int):
    """Step 2, of a chunk: settle what it can, send the bytes of the other windows in question."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        if not left.num_rows or not right.num_rows:
            return _rows([], 0, [])
        chunk, number = Chunk.of(left), left.column("chunk")[0].as_py()
        shared = np.sort(np.concatenate([np.cumsum(spread(b.as_py())[0], dtype=np.uint64) for b in right.column("blob")]))
        first, n, least, place = runs(chunk, length)
        asked = np.isin(least, shared)
        first, n, least, owner = first[asked], n[asked], least[asked], chunk.ids[place[asked]]
        at = ragged(first, n)
        least, owner = np.repeat(least, n), np.repeat(owner, n)
        done = _settled(chunk.data, at, owner, length)
        a, m = segments(at[done])
        out = [(-1 - number % (4 * shards), squeeze(at[done][a], m))] if len(a) else []
        at, least, owner = at[~done], least[~done], owner[~done]
        a, m = segments(at, least)
        start, owner, shard = at[a], owner[a], (least[a] % np.uint64(shards)).astype(np.int64)
        for s, g in by_shard(shard):
            text = chunk.data[ragged(start[g], m[g] + length - 1)]
            out.append((s, squeeze(start[g], m[g], owner[g], text)))
        return _rows([s for s, _ in out], number, [b for _, b in out])

    return run


def _answer(length: int):
    """Step 3, of a shard: the windows that a smaller document has, by the levelled index."""

    def run(table: pa.Table) -> pa.Table:
        trim()
        chunks = table.column("chunk").to_pylist()
        if table.column("shard")[0].as_py() < 0:
            return table.select(["chunk", "blob"])
        start, many, owner, text, source = [], [], [], [], []
        for k, blob in enumerate(table.column("blob")):
            a, m, o, t = spread(blob.as_py())
            for x, y in ((start, a), (many, m), (owner, o), (text, t), (source, np.full(len(a), k))):
                x.append(y)
        start, many, owner, text, source = map(np.concatenate, (start, many, owner, text, source))
        size = many + length - 1
        base = np.cumsum(size) - size
        view = np.ndarray((len(text) - length + 1,), f"S{length}", text, strides=(1,))
        order = np.argsort(owner, kind="stable")
        levels = SuffixLevels(length)
        where, which = ragged(base[order], many[order]), np.repeat(order, many[order])
        found = np.zeros(len(where), bool)
        for i in range(0, len(where), BATCH):
            found[i : i + BATCH] = levels.add(view[where[i : i + BATCH]], owner[which[i : i + BATCH]])
        where, which = where[found], which[found]
        at, of = start[which] + where - base[which], source[which]
        order = np.lexsort((at, of))
        at, of = at[order], of[order]
        a, m = segments(at, of)
        blobs = [(chunks[k], squeeze(at[a[g]], m[g])) for k, g in by_shard(of[a])] if len(a) else []
        return pa.table({"chunk": pa.array([c for c, _ in blobs], pa.int64()), "blob": pa.array([b for _, b in blobs], pa.binary())})

    return run


def _cut(length: int, texts: bool):
    """Step 3, of a chunk: cover the matched windows and remove them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        chunk = Chunk.of(left)
        data, starts = chunk.data, chunk.starts
        change = np.zeros(len(data) + 1, np.int32)
        for blob in right.column("blob"):
            at, n = spread(blob.as_py())
            np.add.at(change, at, 1)
            np.add.at(change, at + n + length - 1, -1)
        gone = np.cumsum(change[:-1]) > 0
        counts, spans, digests, kept_texts = [], [], [], []
        for a, n in zip(starts.tolist(), chunk.lens.tolist(), strict=True):
            out, body = gone[a : a + n], data[a : a + n]
            counts.append(int(out.sum()))
            spans.append(int(out[:1].sum()) + int((out[1:] & ~out[:-1]).sum()))
            digests.append(hashlib.sha256(body[~out].tobytes()).hexdigest())
            if texts:
                kept_texts.append(body[~whole_characters(body, out)].tobytes().decode("utf-8", "replace") if counts[-1] else body.tobytes().decode())
        ids = pa.array([None if i == LAST else i for i in chunk.ids.tolist()], pa.int64())
        made = {"doc_id": ids, "n_bytes": pa.array(chunk.lens), "n_removed": pa.array(counts, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests)}
        if texts:
            made |= {"kept": pa.array(kept_texts, pa.string()), "carry": pa.array(chunk.carry, pa.string())}
        return pa.table(made)

    return run


def whole_characters(body: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The part of ``out`` that removes whole UTF-8 characters only."""
    begins = np.flatnonzero((body & 0xC0) != 0x80)
    if not len(begins):
        return out
    all_gone = np.minimum.reduceat(out, begins)
    return np.repeat(all_gone, np.diff(np.append(begins, len(body))))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(
    docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text", texts: bool = False, carry: list[str] | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row.

    Removed is each byte covered by a ``length``-byte string that also starts in a document with
    a smaller doc_id, judged on the input.  With ``texts`` come ``kept``, the remaining text (a
    character of which only some bytes are covered stays whole), and ``carry``, the columns of
    that name as JSON.

    Defined cases: a null text is empty; a text shorter than ``length`` stays; rows with equal ids
    do not remove each other's bytes; null ids come last, after all others, and do not remove each
    other's bytes; other columns are ignored; no rows give no rows.
    """
    if length < ANCHOR + 8:
        raise ValueError(f"length is {ANCHOR + 8} at least")
    shards = 2 * shuffle_partitions(docs.sparkSession)
    chunks = packed(docs, chunk_bytes, doc_id, text, carry)
    offered = chunks.select("chunk", "ids", "lens", "carry", "data").mapInArrow(_offer(length, shards), MOVED)
    shared = offered.groupBy("shard").applyInArrow(_shared, "chunk long, blob binary")
    asked = chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_ask(length, shards), MOVED)
    found = asked.groupBy("shard").applyInArrow(_answer(length), "chunk long, blob binary")
    schema = RESULT + (", kept string, carry string" if texts else "")
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_cut(length, texts), schema)


def plain(docs: list[tuple[int | None, str | None]], length: int = 50) -> list[tuple]:
    """The result by a dictionary of all windows; for tests."""
    raw = [(LAST if i is None else i, (t or "").encode()) for i, t in docs]
    least: dict[bytes, int] = {}
    for i, b in raw:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            least[w] = min(least.get(w, LAST), i)
    out = []
    for (i, b), (own, _) in zip(raw, docs, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((own, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
