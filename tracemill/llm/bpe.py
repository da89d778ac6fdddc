"""Byte-level BPE encoding and decoding by batched merge rounds in numpy.

Texts are split into the pattern's pieces, new pieces of a batch are encoded together: the
symbols of all words lie in one flat array, each round finds every word's lowest-rank pair
by binary search over the sorted pair keys and merges all its occurrences.  A round merges
one rank of a word, so words of over ``LONG`` bytes take their pairs from a heap instead, which
is near linear in their length.  Encoded pieces are kept in a bounded cache of the task.  The vocabulary file is a parameter; executors
open it by the same path.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tracemill.llm.chunks import trim

#: Pieces kept by a task, and bytes of pieces and their ids; beyond either the cache starts anew.
CACHE, CACHE_BYTES = 200_000, 64 << 20
#: Bytes of a word from which its pairs wait in a heap.
LONG = 256
#: Text characters encoded at a time.
BATCH_CHARS = 4 << 20
#: The pattern of the vocabulary's pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""".replace(r"\s", r"\p{White_Space}").replace(
    r"\S", r"\P{White_Space}"
)
PIECES = regex.compile(PATTERN)
#: A space in front of anything but white space begins a piece in any context.
CUT = regex.compile(r" (?=\P{White_Space})")
ODD = regex.compile(r" (?=\p{White_Space}|$)")


def byte_characters() -> dict[int, str]:
    """The visible character that stands for each byte: itself if printable, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(total)


class Codec:
    """Encodes and decodes texts with one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        by_char = {c: b for b, c in byte_characters().items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        table = [b""] * size
        for token, i in vocab.items():
            table[i] = bytes(by_char[c] for c in token)
        for token, i in self.special.items():
            table[i] = token.encode()
        self.token_len = np.array([len(t) for t in table], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.of_byte = np.array([vocab[c] for _, c in sorted(byte_characters().items())], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left * size + right
        order = np.argsort(key, kind="stable")
        self.size, self.keys, self.rank, self.made = size, key[order], order, made[order]
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.reset()

    def reset(self) -> None:
        self.codes: dict[str, int] = {}
        self.words: dict[str, np.ndarray] = {}
        self.flat = [np.zeros(0, np.int32)]
        self.lens: list[int] = []
        self.held = 0

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of every word."""
        usual = iter(self.merge_rounds([w for w in words if len(w) <= LONG]))
        return [next(usual) if len(w) <= LONG else self.merge_long(w) for w in words]

    @cached_property
    def merge_of(self) -> dict[int, tuple[int, int]]:
        """(rank, symbol made) of every pair."""
        return dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.made.tolist(), strict=True), strict=True))

    def merge_long(self, word: bytes) -> np.ndarray:
        """One word, its pairs by rank and place from a heap; symbols are linked to their neighbours."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        end, get, size = len(ids), self.merge_of.get, self.size
        before, after = list(range(-1, end - 1)), list(range(1, end + 1))
        heap = [(m[0], k, m[1], ids[k], ids[k + 1]) for k in range(end - 1) if (m := get(ids[k] * size + ids[k + 1]))]
        heapq.heapify(heap)
        while heap:
            _, k, made, one, two = heapq.heappop(heap)
            gone = after[k]
            if ids[k] != one or gone >= end or ids[gone] != two:  # a neighbour has merged since
                continue
            ids[k], ids[gone], after[k] = made, -1, after[gone]
            if after[k] < end:
                before[after[k]] = k
                if m := get(made * size + ids[after[k]]):
                    heapq.heappush(heap, (m[0], k, m[1], made, ids[after[k]]))
            if (left := before[k]) >= 0 and (m := get(ids[left] * size + made)):
                heapq.heappush(heap, (m[0], left, m[1], ids[left], made))
        return np.array([x for x in ids if x >= 0], np.int32)

    def merge_rounds(self, words: list[bytes]) -> list[np.ndarray]:
        """Merge rounds over all words at once."""
        if not words:
            return []
        lens = np.array([len(w) for w in words], np.int64)
        ids = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lens)
        out_ids, out_word = [], []
        none = len(self.rank)
        while len(ids):
            key = ids[:-1] * self.size + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            ok = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.where(ok, self.rank[at], none)
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            low = np.minimum.reduceat(np.append(rank, none), starts)
            sizes = np.diff(np.append(starts, len(ids)))
            open_words = low < none
            if not open_words.all():  # these words are done
                done = np.repeat(~open_words, sizes)
                out_ids.append(ids[done])
                out_word.append(word[done])
                keep = ~done
                rank, at = np.append(rank, none)[keep], np.append(at, 0)[keep]
                ids, word = ids[keep], word[keep]
                low, sizes = low[open_words], sizes[open_words]
                if not len(ids):
                    break
            else:
                rank, at = np.append(rank, none), np.append(at, 0)
            hit = rank == np.repeat(low, sizes)
            if (hit[1:] & hit[:-1]).any():  # a run of one pair: every second, from the left
                n = np.arange(len(hit))
                first = np.maximum.accumulate(np.where(hit & ~np.concatenate(([False], hit[:-1])), n, -1))
                hit &= (n - first) % 2 == 0
            where = np.flatnonzero(hit)
            ids[where] = self.made[at[where]]
            keep = np.ones(len(ids), bool)
            keep[where + 1] = False
            ids, word = ids[keep], word[keep]
        all_ids, all_word = np.concatenate(out_ids), np.concatenate(out_word)
        order = np.argsort(all_word, kind="stable")
        return np.split(all_ids[order].astype(np.int32), np.cumsum(np.bincount(all_word, minlength=len(words)))[:-1])

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that the cache does not have."""
        parts = [PIECES.findall(p) for p in pieces]
        new = list(dict.fromkeys(w for part in parts for w in part if w not in self.words))
        if new:
            made = self.encode_words([w.encode() for w in new])
            self.words.update(zip(new, made, strict=True))
            self.held += sum(len(w) + ids.nbytes for w, ids in zip(new, made, strict=True))
        for piece, part in zip(pieces, parts, strict=True):
            ids = [self.words[w] for w in part]
            ids = ids[0] if len(ids) == 1 else np.concatenate(ids)
            self.codes[piece] = len(self.lens)
            self.lens.append(len(ids))
            self.flat.append(ids)
            self.held += len(piece) + ids.nbytes

    def pieces(self, text: str) -> list[str]:
        """Pieces that are encoded by themselves; a special string is one that begins with NUL NUL."""
        if self.split and (parts := self.split.split(text))[1:]:
            return [x for k, p in enumerate(parts) for x in ([f"\0\0{p}"] if k % 2 else self.pieces_of(p))]
        return self.pieces_of(text)

    @staticmethod
    def pieces_of(text: str) -> list[str]:
        if not text:
            return []
        first, *rest = CUT.split(text) if ODD.search(text) else text.split(" ")
        return [*([first] if first else []), *[f" {p}" for p in rest]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        if len(self.codes) > CACHE or len(self.words) > CACHE or self.held > CACHE_BYTES:
            self.reset()
        cut = [self.pieces(t) for t in texts]
        new = list(dict.fromkeys(p for part in cut for p in part if p not in self.codes))
        for p in [p for p in new if p.startswith("\0\0") and p[2:] in self.special]:
            self.codes[p] = len(self.lens)
            self.lens.append(1)
            self.flat.append(np.array([self.special[p[2:]]], np.int32))
        self.learn([p for p in new if p not in self.codes])
        self.flat = [np.concatenate(self.flat)]
        lens = np.array(self.lens, np.int64)
        get = self.codes.__getitem__
        code = np.fromiter((get(p) for part in cut for p in part), np.int64, sum(map(len, cut)))
        n = lens[code]
        ids = self.flat[0][ragged((np.cumsum(lens) - lens)[code], n)]
        owner = np.repeat(np.arange(len(texts)), [len(part) for part in cut])
        return ids, np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64)

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        return self.token_bytes[ragged(self.token_at[ids], self.token_len[ids])]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def slices(texts: list[str]):
    """Texts in runs of about BATCH_CHARS characters."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= BATCH_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every whole text.

    Special strings inside a text become their ids, as the library does by default.  Defined
    cases: a null text is empty; an empty text has no ids; repeated rows stay; other columns are
    ignored; no rows give no rows.  Each row by itself, no shuffle.
    """

    def run(batches):
        c = codec(path)
        for batch in batches:
            start = 0
            for texts in slices([t or "" for t in batch.column(1).to_pylist()]):
                flat, n = c.encode(texts)
                size = c.token_len[flat]
                raw = c.decode_bytes(flat)
                ends = np.cumsum(n)
                at = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], ends))]
                le = flat.astype("<u4")
                rows = []
                for k in range(len(texts)):
                    a, b = int(ends[k] - n[k]), int(ends[k])
                    said = raw[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace").encode()
                    rows.append((hashlib.sha256(le[a:b].tobytes()).hexdigest(), hashlib.sha256(said).hexdigest()))
                columns = [batch.column(0).slice(start, len(texts)), pa.array(n), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                start += len(texts)
                del flat, size, raw, le, columns
                trim()
        c.reset()
        trim()

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, RESULT + (", ids array<int>" if ids else ""))


def decode_ids(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with the column decoded: the text of the ids, special strings kept (null ids: null)."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            said = [None if x is None else c.decode(np.array(x, np.int64)) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(said, pa.string())], [*batch.schema.names[1:], "decoded"])

    rest = rows.drop("decoded")
    schema = rest.schema.add("decoded", "string")
    return rest.select(F.col(ids).alias("__ids"), "*").mapInArrow(run, schema)
