"""Documents packed into chunks, and compact numpy arrays between tasks.

A chunk is one row with some megabytes of whole documents.  The chunk table is written once,
bucketed by chunk, so each later step over the texts reads its chunks without a shuffle and
only small packed arrays move between tasks.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tracemill.llm.store import bucketed, shuffle_partitions

#: Stands for a null doc_id: it comes last.
LAST = (1 << 63) - 1


def trim() -> None:
    """Gives freed memory back to the system, where the C library can: workers are used again and again."""
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)
    pa.default_memory_pool().release_unused()


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; each is laid out byte plane by byte plane."""
    head = [len(arrays)]
    parts = []
    for a in arrays:
        code = a.dtype.str.encode().ljust(4)
        raw = np.ascontiguousarray(a)
        planes = raw.view(np.uint8).reshape(len(raw), raw.dtype.itemsize).T if len(raw) else np.zeros(0, np.uint8)
        head += [int.from_bytes(code, "little"), len(raw)]
        parts.append(np.ascontiguousarray(planes).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, np.int64).tobytes() + b"".join(parts))


def spread(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 1 + 2 * n)[1:].tolist()
    at, out = 8 * (1 + 2 * n), []
    for code, size in zip(head[::2], head[1::2], strict=True):
        kind = np.dtype(code.to_bytes(4, "little").decode().strip())
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size * kind.itemsize
    return out


def gaps(values: np.ndarray) -> np.ndarray:
    """Differences of sorted unsigned values, for ``squeeze``."""
    return np.diff(values, prepend=values.dtype.type(0))


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of runs of the given starts and lengths, one after another."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(total)


def small(values: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest unsigned type."""
    top = int(values.max(initial=0))
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def by_shard(shard: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(shard, indices) for each shard that occurs."""
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    return [(int(shard[g[0]]), g) for g in np.split(order, cuts) if len(g)]


@dataclass
class Chunk:
    """Documents in the order of their ids: ids, byte lengths, bytes, and what is carried along."""

    ids: np.ndarray
    lens: np.ndarray
    data: np.ndarray
    carry: list[str | None]

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.lens) - self.lens

    @classmethod
    def of(cls, table: pa.Table | pa.RecordBatch, row: int = 0) -> Chunk:
        get = lambda name: table.column(name)[row].as_py()
        raw = zstandard.ZstdDecompressor().decompress(get("data"), max_output_size=1)
        return cls(np.array(get("ids"), np.int64), np.array(get("lens"), np.int64), np.frombuffer(raw, np.uint8), get("carry"))


CHUNKS = "chunk long, ids array<long>, lens array<long>, carry array<string>, data binary"


def packed(docs: DataFrame, chunk_bytes: int, doc_id: str, text: str, carry: list[str | Column] | None = None) -> DataFrame:
    """The written chunk table of ``docs``; ``carry`` are columns kept as JSON beside each document."""

    def run(batches):
        part, number, rows, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal number, rows, size
            rows.sort(key=lambda r: r[0])
            raw = zstandard.ZstdCompressor(level=1).compress(b"".join(r[1] for r in rows))
            values = [[(part << 32) + number], [[r[0] for r in rows]], [[len(r[1]) for r in rows]], [[r[2] for r in rows]], [raw]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary()]
            batch = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["chunk", "ids", "lens", "carry", "data"])
            number, rows, size = number + 1, [], 0
            return batch

        for batch in batches:
            for i, t, c in zip(*(batch.column(k) for k in range(3)), strict=True):
                raw = (t.as_py() or "").encode("utf-8", "replace")
                rows.append((LAST if (n := i.as_py()) is None else n, raw, c.as_py()))
                size += len(raw) + 16
                if size >= chunk_bytes:
                    yield flush()
        if rows:
            yield flush()

    rest = F.to_json(F.struct(*carry)) if carry else F.lit(None).cast("string")
    chosen = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("t"), rest.alias("c"))
    return bucketed(chosen.mapInArrow(run, CHUNKS), "chunk", 2 * shuffle_partitions(docs.sparkSession))
