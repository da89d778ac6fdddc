"""Alignment of the tokens of two vocabularies over the same bytes.

A text is written as one label for each byte: no token ends there, one of A, one of B, or one of
both.  A regular expression scans the labels for spans up to each both-label; the labels that a span
holds say how many tokens of A and of B form the group.  The last tokens of a group end together: they
are linked, and links are counted by the pair of their ids over the whole corpus.

Both tokenizers cut at a space after anything but white space, so a text is the sequence of its *units*
between such spaces, and a unit's tokens and groups are the same wherever it stands.  Units are aligned
once and kept in a bounded cache of the task.  Chunks of some megabytes of text are written once with
the units of their documents; only their distinct pairs are shuffled, counted, and sent back.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tracemill.llm.bpe import PIECES, Codec
from tracemill.llm.chunks import ragged, spread, squeeze, trim
from tracemill.llm.store import stored

#: Characters of text in a chunk; a longer text is a chunk of its own.  Units aligned at a time.
CHUNK_CHARS, STEP = 4 << 20, 50_000
#: Units kept by a task, and characters of units and their groups; beyond either the cache starts anew.
CACHE, CACHE_CHARS = 300_000, 64 << 20
#: A space after anything but white space.
CUT = re.compile(r"(?<=\S) ")
#: A space at the start or after white space: such texts need the expression above, others split at spaces.
ODD = re.compile(r"(?:^|\s) ")
#: Labels: no token ends at this byte, one of A, one of B, one of both.
LABELS = np.frombuffer(b".AB*", np.uint8)
SPAN = re.compile(rb"[.AB]*\*")


class PieceModel:
    """A sentencepiece model: ids of texts and the bytes of every id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        table = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.token_len = np.array([len(t) for t in table], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(table), np.uint8)
        #: No piece holds a space after something else, so no merge crosses one.
        self.cuts = not any(re.search("[^▁]▁", n) for n in names)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = self.model.encode(texts, num_threads=1)
        n = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(chain.from_iterable(made), np.int64, int(n.sum())), n

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        return self.token_bytes[ragged(self.token_at[ids], self.token_len[ids])]


codec = lru_cache(maxsize=1)(Codec)


def byte_ids(a: Codec, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another and their number for each text; strings of special tokens are plain text."""
    parts = [PIECES.findall(t) for t in texts]
    place: dict[str, int] = {}
    code = np.fromiter((place.setdefault(w, len(place)) for part in parts for w in part), np.int64, sum(map(len, parts)))
    made = a.encode_words([w.encode() for w in place])
    lens = np.fromiter(map(len, made), np.int64, len(made))
    n = np.bincount(np.repeat(np.arange(len(texts)), list(map(len, parts))), weights=lens[code], minlength=len(texts))
    return np.concatenate([np.zeros(0, np.int32), *made])[ragged((np.cumsum(lens) - lens)[code], lens[code])], n.astype(np.int64)


def groups_of(labels: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B in each span up to a both-label."""
    spans = SPAN.findall(labels)
    kinds = set(spans)
    count = lambda mark: np.fromiter(map({s: s.count(mark) + 1 for s in kinds}.__getitem__, spans), np.int64, len(spans))
    return count(b"A"), count(b"B")


class Book(dict):
    """Units by number, with what their alignment gives; a unit is kept without the space in front of it."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = codec(a_path), PieceModel(b_path)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.said: list[str] = []
        self.facts = np.zeros((0, 4), np.int64)  # tokens of A, tokens of B, groups, bad
        self.links = [np.zeros(0, np.int64)]
        self.held = 0

    def __missing__(self, unit: str) -> int:
        self[unit] = code = len(self)
        self.new.append(unit)
        return code

    def codes(self, text: str) -> list[int]:
        """The units of a text; a space at its end stays with the last one."""
        if not self.b.cuts:
            return [self[text]]
        units = CUT.split(text) if ODD.search(text) else text.split(" ")
        if len(units) > 1 and not units[-1]:
            units[-2:] = [units[-2] + " "]
        return list(map(self.__getitem__, units))

    def learn(self) -> None:
        """Align the units met since the last call."""
        units, self.new = self.new, []
        for at in range(0, len(units), STEP):
            self._learn(units[at : at + STEP])

    def _learn(self, units: list[str]) -> None:
        raw = [f" {u}".encode() for u in units]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        a_ids, a_n = byte_ids(self.a, [f" {u}" for u in units])
        b_ids, b_n = self.b.encode(units)
        ok = self._same(self.a, a_ids, a_n, flat, size) & self._same(self.b, b_ids, b_n, flat, size)
        a_ids, b_ids = a_ids[np.repeat(ok, a_n)].astype(np.int64), b_ids[np.repeat(ok, b_n)]
        facts = np.zeros((len(units), 4), np.int64)
        facts[:, 3] = ~ok
        facts[ok, 0], facts[ok, 1] = a_n[ok], b_n[ok]
        ends = np.cumsum(size[ok])
        label = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        label[np.cumsum(self.a.token_len[a_ids]) - 1] += 1
        label[np.cumsum(self.b.token_len[b_ids]) - 1] += 2
        both = np.flatnonzero(label == 3)
        in_a, in_b = groups_of(LABELS[label].tobytes())
        facts[ok, 2] = np.diff(np.searchsorted(both, ends - 1, side="right"), prepend=0)
        to_a, to_b = np.cumsum(in_a), np.cumsum(in_b)
        self.links.append((a_ids[to_a - 1] << 32) | b_ids[to_b - 1])
        a_text, b_text = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
        parts, i, j = [], 0, 0
        for m, n in zip(to_a.tolist(), to_b.tolist(), strict=True):
            parts.append(f"{','.join(a_text[i:m])}|{','.join(b_text[j:n])}")
            i, j = m, n
        at = 0
        for n in facts[:, 2].tolist():
            self.said.append(";".join(parts[at : at + n]))
            at += n
        self.facts = np.concatenate([self.facts, facts])
        self.held += sum(map(len, units)) + sum(map(len, self.said[-len(units) :]))

    @staticmethod
    def _same(side: Codec | PieceModel, ids: np.ndarray, n: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the tokens of each unit give the unit's bytes."""
        owner = np.repeat(np.arange(len(n)), n)
        made = np.bincount(owner, weights=side.token_len[ids], minlength=len(n)).astype(np.int64)
        ok = made == size
        got = side.decode_bytes(ids)[np.repeat(ok, made)]
        wrong = got != flat[np.repeat(ok, size)]
        if wrong.any():
            ok[np.unique(np.repeat(np.flatnonzero(ok), size[ok])[wrong])] = False
        return ok


CHUNKS = (
    "chunk long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, "
    "pairs array<long>, n array<long>, blob binary"
)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _chunk(book: Book, number: int, ids: list, texts: list[str]) -> pa.RecordBatch:
    """One chunk: the facts of its documents, their units, and its distinct pairs with the number of links of each."""
    if len(book) > CACHE or book.held > CACHE_CHARS:
        book.reset()
    of = [np.array(book.codes(t) if t else [], np.int64) for t in texts]
    book.learn()
    book.links = [np.concatenate(book.links)]
    n = np.fromiter(map(len, of), np.int64, len(of))
    code = np.concatenate(of) if of else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(of)), n)
    total = lambda of_unit: np.bincount(owner, weights=of_unit[code], minlength=len(of)).astype(np.int64)
    good = total(book.facts[:, 3]) == 0
    code, n = code[good[owner]], np.where(good, n, 0)
    owner = np.repeat(np.arange(len(of)), n)
    sums = [total(book.facts[:, k]) for k in range(3)]
    said = [
        hashlib.sha256(";".join(map(book.said.__getitem__, part.tolist())).encode()).hexdigest() if good[k] and len(part) else ""
        for k, part in enumerate(of)
    ]
    used, local, times = np.unique(code, return_inverse=True, return_counts=True)
    groups = book.facts[:, 2]
    links = book.links[0][ragged((np.cumsum(groups) - groups)[used], groups[used])]
    pairs, pair = np.unique(links, return_inverse=True)
    count = np.bincount(pair, weights=np.repeat(times, groups[used]), minlength=len(pairs)).astype(np.int64)
    blob = squeeze(n, local.astype(np.uint32), groups[used].astype(np.uint32), pair.astype(np.uint32))
    values = [number, ids, *(s.tolist() for s in sums), said, pairs.tolist(), count.tolist(), blob]
    kinds = [pa.int64(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string()), *[pa.list_(pa.int64())] * 2, pa.binary()]
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)


def align_documents(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row for each document: tokens of A (byte-level, of space+text) and B (pieces, of text), groups, links, their counts.

    ``n_best`` counts the links whose pair is the commonest of its B id in all documents, ties included;
    ``count_sum`` adds the counts of the pairs over the links.  Defined cases: a null or an empty text, and
    one that either model does not give back byte by byte, has zeros and an empty ``groups_sha256``; null and
    repeated ids and repeated rows stay rows of their own and count as often as they stand there; other columns
    are ignored; no rows give no rows.  A unit that is not cut, however long, is aligned as a whole.  Only the
    distinct pairs of a chunk are shuffled, one row each, so no pair is a hot key; what a task holds is a chunk.
    """

    def write(batches):
        part, number, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
        book = Book(a_path, b_path)
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(i.as_py())
                texts.append(t.as_py() or "")
                size += len(texts[-1]) + 16
                if size >= chunk_chars:
                    yield _chunk(book, (part << 32) + number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
                    trim()
        if ids:
            yield _chunk(book, (part << 32) + number, ids, texts)
        book.reset()
        trim()

    def finish(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda name: batch.column(name)[k]  # noqa: B023, E731
                n, code, groups, pair = spread(get("blob").as_py())
                value = np.zeros((len(get("n")), 2), np.int64)
                if get("reply").is_valid:
                    reply = get("reply").values
                    place = reply.field("place").to_numpy()
                    value[place, 0] = reply.field("best").to_numpy(zero_copy_only=False)
                    value[place, 1] = reply.field("total").to_numpy()
                sums = []
                for kind in range(2):
                    edge = np.concatenate(([0], np.cumsum(value[pair, kind])))
                    ends = np.cumsum(groups, dtype=np.int64)
                    unit = edge[ends] - edge[ends - groups.astype(np.int64)]
                    edge = np.concatenate(([0], np.cumsum(unit[code])))
                    ends = np.cumsum(n)
                    sums.append(pa.array(edge[ends] - edge[ends - n]))
                flat = {name: get(name).values for name in ("ids", "n_a", "n_b", "n_groups", "groups_sha256")}
                names = [c.split()[0] for c in RESULT.split(", ")]
                columns = [flat["ids"], flat["n_a"], flat["n_b"], flat["n_groups"], flat["n_groups"], *sums, flat["groups_sha256"]]
                yield pa.RecordBatch.from_arrays(columns, names)

    chosen = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("t"))
    chunks = stored(chosen.mapInArrow(write, CHUNKS))
    said = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "n")).alias("place", "x")).select("chunk", "place", "x.pairs", "x.n")
    totals = said.groupBy("pairs").agg(F.sum("n").alias("total"))
    most = F.max("total").over(Window.partitionBy(F.col("pairs").bitwiseAND(0xFFFFFFFF)))
    totals = totals.withColumn("best", F.col("total") == most)
    reply = said.drop("n").join(totals, "pairs").groupBy("chunk").agg(F.collect_list(F.struct("place", "total", "best")).alias("reply"))
    back = chunks.drop("pairs").join(reply, "chunk", "left")
    return back.mapInArrow(finish, RESULT)
