"""Language-model scores from a sharded Elias-Fano trie of n-grams up to three words.

Texts are tokenised once into chunks (one row each, written and bucketed by chunk).  Each chunk
sends its distinct n-grams with their training counts to the shard of the word before the last:
``u`` for the pair (u, w) and for the triple (v, u, w).  A shard adds the counts, builds its part
of the trie in a memory-mapped temporary file, looks up every n-gram that a chunk has sent, and
answers with one-byte codes.  The chunk puts its texts' scores together from the answers.
What moves is distinct n-grams of a chunk, never tokens or texts, so a common word or pair
reaches its shard once a chunk, and no model is held whole anywhere.

Model, with absolute discount d: P(w) = (c+1)/(N+V+1), P(w|u) = max(c(uw)-d,0)/c(u.) +
d*T(u)/c(u.) * P(w), and the same for P(w|vu) over P(w|u), T being the number of successors.
Discounted shares and weights are stored as 8-bit codes of their logarithm, between 0 and that of
the least share that N tokens allow; N and V are added up first, from the words alone.

Trie levels of a shard: successors of u (sorted values u*D+w), contexts (u, v), and the
successors of a context, each written as its place among the successors of u and put in order
by monotone pointers.  All are Elias-Fano sequences; a lookup is one successor search.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tracemill.llm.chunks import LAST, by_shard, gaps, small, spread, squeeze, trim
from tracemill.llm.store import bucketed, shuffle_partitions

CHUNK_BYTES = 10 << 20
DISCOUNT = 0.75
#: The end of a text; no word has white space.
END = xxhash.xxh64_intdigest(b"\n")
#: Values whose low parts are packed at a time.
PACK = 1 << 14
#: Values looked up at a time.
FOUND = 1 << 16
#: Entries of a shard that are added up and made a trie at a time.
RANGE = 1 << 20
#: Bits that name a word between tasks: the first 48, in whose order the codes of a chunk are.
NAME_SHIFT = np.uint64(16)
POPCOUNT = np.array([b.bit_count() for b in range(256)], np.uint8)
#: The place of the k-th set bit of a byte.
NTH_BIT = np.array([[([i for i in range(8) if b >> i & 1] + [8] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)


class Bits:
    """A bit sequence with vectorised selection of ones or zeros."""

    def __init__(self, packed: np.ndarray, ones: bool):
        self.packed, self.flip = packed, 0 if ones else 255
        count = POPCOUNT[packed ^ self.flip] if self.flip else POPCOUNT[packed]
        self.before = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))

    def select(self, k: np.ndarray) -> np.ndarray:
        byte = np.searchsorted(self.before, k, side="right") - 1
        return byte * 8 + NTH_BIT[self.packed[byte] ^ self.flip, k - self.before[byte]]


class EliasFano:
    """A sorted sequence of integers; high parts in unary, low parts packed."""

    def __init__(self, values: np.ndarray, store):
        self.n, top = len(values), int(values[-1]) if len(values) else 0
        self.low_bits = min(48, max(0, (top // max(1, self.n)).bit_length() - 1)) if self.n else 0
        high = (values >> self.low_bits).astype(np.int64)
        self.highs = (int(high[-1]) if self.n else 0) + 1
        unary = np.zeros(self.n + self.highs + 8, np.uint8)
        unary[high + np.arange(self.n)] = 1
        unary[self.n + self.highs :] = 0
        self.unary = store(np.packbits(unary, bitorder="little"))
        packed = []
        for i in range(0, self.n, PACK):  # whole bytes, as PACK is a multiple of 8
            low = values[i : i + PACK].astype(np.uint64)
            bits = ((low[:, None] >> np.arange(self.low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            packed.append(np.packbits(bits.ravel(), bitorder="little"))
        self.low = store(np.concatenate((*packed, np.zeros(16, np.uint8))))
        self.words = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))
        self.ones, self.zeros = Bits(self.unary, True), Bits(self.unary, False)

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low_bits
        word = self.words[at >> 3] >> (at & 7).astype(np.uint64)
        return (word & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return ((self.ones.select(i) - i) << self.low_bits) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each value, or -1: successor search among those with its high part."""
        out = np.full(len(x), -1, np.int64)
        for i in range(0, len(x) if self.n else 0, FOUND):
            out[i : i + FOUND] = self._find(x[i : i + FOUND])
        return out

    def _find(self, x: np.ndarray) -> np.ndarray:
        high, low = x >> self.low_bits, x & ((1 << self.low_bits) - 1)
        inside = (x >= 0) & (high < self.highs)
        h = np.where(inside, high, 0)
        lo = np.where(h > 0, self.zeros.select(np.maximum(h - 1, 0)) - (h - 1), 0)
        end = self.zeros.select(h) - h
        hi = end.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            less = open_ & (self._low(np.minimum(mid, self.n - 1)) < low)
            lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        hit = inside & (lo < end) & (self._low(np.minimum(lo, self.n - 1)) == low)
        return np.where(hit, lo, -1)


class Codes:
    """Numbers of up to 1 as one byte each, evenly spaced in their logarithm from ``low`` to 0; code 0 stands for none.

    ``low`` is the same for all shards, so what is scored does not depend on their number.
    """

    def __init__(self, values: np.ndarray, low: float, store):
        log = np.clip(np.log10(np.maximum(values, 1e-300)), low, 0.0)
        self.codes = store((1 + np.rint((log - low) * (254 / -low))).astype(np.uint8)) if len(values) else np.zeros(0, np.uint8)

    def at(self, place: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(len(place), np.uint8)
        return np.where(place >= 0, self.codes[np.maximum(place, 0)], 0).astype(np.uint8)

    @staticmethod
    def value(codes: np.ndarray, low: float, none: float) -> np.ndarray:
        return np.where(codes > 0, 10.0 ** (low - low / 254 * (codes.astype(np.int64) - 1)), none)


def least_log(discount: float, total: int) -> float:
    """The logarithm of the least share or weight that ``total`` training tokens can give."""
    return min(-1.0, float(np.log10(max(min(discount, 1 - discount), 1e-9) / max(total, 1))))


def mapped(file):
    """A function that moves an array into the file and gives its memory-mapped view."""

    def store(a: np.ndarray) -> np.ndarray:
        if not a.nbytes:
            return a
        at = file.seek(0, 2)
        file.write(a.tobytes())
        file.flush()
        return np.memmap(file, a.dtype, "r", at, a.shape)

    return store


class Trie:
    """One shard: pairs (u, w) and triples (v, u, w) with training counts, sorted and distinct."""

    def __init__(self, size: int, pairs: np.ndarray, pair_n: np.ndarray, contexts: np.ndarray, triples, triple_n: np.ndarray, discount: float, low: float, store):
        """pairs and contexts are u * size + word; triples are (index into contexts, w)."""
        self.size = size
        u = pairs // size
        n = int(u.max()) + 1 if len(u) else 0
        self.successors = EliasFano(pairs, store)
        self.degree = np.bincount(u, minlength=n)
        self.first = np.cumsum(self.degree) - self.degree
        total = np.bincount(u, weights=pair_n, minlength=n)
        self.share2 = Codes(np.maximum(pair_n - discount, 1e-9) / total[u], low, store)
        self.weight2 = Codes(discount * self.degree[self.degree > 0] / total[self.degree > 0], low, store)
        self.dense = np.where(self.degree > 0, np.cumsum(self.degree > 0) - 1, -1)
        ctx, w = triples
        used, ctx = np.unique(ctx, return_inverse=True)
        self.contexts = EliasFano(contexts[used], store)
        room = self.degree[contexts[used] // size] if len(used) else np.zeros(0, np.int64)
        self.pointers = EliasFano(np.concatenate(([0], np.cumsum(room))).astype(np.int64), store)
        owner = contexts[used][ctx] // size if len(ctx) else np.zeros(0, np.int64)
        place = self.successors.find(owner * size + w) - self.first[owner] if len(ctx) else np.zeros(0, np.int64)
        value = self.pointers[ctx] + place if len(ctx) else np.zeros(0, np.int64)
        order = np.argsort(value, kind="stable")
        self.triples = EliasFano(value[order], store)
        total = np.bincount(ctx, weights=triple_n, minlength=len(used))
        kinds = np.bincount(ctx, minlength=len(used))
        self.share3 = Codes((np.maximum(triple_n - discount, 1e-9) / total[ctx])[order] if len(ctx) else np.zeros(0), low, store)
        self.weight3 = Codes(discount * kinds / total if len(used) else np.zeros(0), low, store)

    def pair(self, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the pairs, and the place of each among the successors of u (-1: none)."""
        at = self.successors.find(u * self.size + w)
        inside = np.minimum(u, max(0, len(self.first) - 1))
        place = np.where(at >= 0, at - self.first[inside], -1) if len(self.first) else np.full(len(u), -1)
        return self.share2.at(at), place

    def weight_of(self, u: np.ndarray) -> np.ndarray:
        known = u < len(self.dense)
        return self.weight2.at(np.where(known, self.dense[np.where(known, u, 0)], -1)) if len(self.dense) else np.zeros(len(u), np.uint8)

    def context(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.contexts.find(keys)
        return self.weight3.at(at), at

    def triple(self, context: np.ndarray, place: np.ndarray) -> np.ndarray:
        ok = (context >= 0) & (place >= 0)
        value = self.pointers[np.where(ok, context, 0)] + np.where(ok, place, 0)
        return self.share3.at(np.where(ok, self.triples.find(value), -1))


CHUNKS = "chunk long, ids array<long>, data binary"


def _tokenise(chunk_bytes: int):
    """Rows (doc_id, held out, text) as chunks of word codes; code k is the k-th smallest hash."""

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, held, lens, codes, vocab, size = [], [], [], [], {}, 0

        def flush():
            nonlocal number, ids, held, lens, codes, vocab, size
            end = vocab.setdefault(b"\n", len(vocab))
            hashes = np.fromiter((END if w == b"\n" else xxhash.xxh64_intdigest(w) for w in vocab), np.uint64, len(vocab))
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            flat = rank[np.concatenate(codes)] if codes else np.zeros(0, np.int32)
            data = squeeze(gaps(hashes[order]), np.array(lens, np.int32), np.array(held, np.uint8), flat, rank[end : end + 1])
            row = [pa.array([(part << 32) + number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([data], pa.binary())]
            number, ids, held, lens, codes, vocab, size = number + 1, [], [], [], [], {}, 0
            trim()
            return pa.RecordBatch.from_arrays(row, ["chunk", "ids", "data"])

        for batch in batches:
            for i, h, t in zip(*batch.columns, strict=True):
                raw = (t.as_py() or "").encode("utf-8", "replace")
                words = raw.lower().split()
                put = vocab.setdefault
                codes.append(np.fromiter((put(w, len(vocab)) for w in words), np.int32, len(words)))
                ids.append(LAST if (n := i.as_py()) is None else n)
                held.append(bool(h.as_py()))
                lens.append(len(words))
                size += len(raw) + 16
                if size >= chunk_bytes:
                    yield flush()
        if ids:
            yield flush()

    return run


def place_type(n: int) -> type:
    """The type of places among ``n`` values: 32 bits if they have room."""
    return np.int32 if n < 1 << 31 else np.int64


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the place of each key among them."""
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, inverse.astype(place_type(len(unique)))


def steps(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Values that grow within runs of ``counts`` as their differences, the first of each run as it is."""
    out = np.diff(values, prepend=values[:1])
    head = (np.cumsum(counts) - counts)[counts > 0]
    out[head] = values[head]
    return out


def unstepped(out: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of ``steps``."""
    total, runs = np.cumsum(out, dtype=np.int64), counts[counts > 0].astype(np.int64)
    head = np.cumsum(runs) - runs
    return total - np.repeat(total[head] - out[head].astype(np.int64), runs)


class Grams:
    """The distinct n-grams of a chunk, in an order that any task finds again."""

    def __init__(self, data: bytes, shards: int):
        spaced, lens, held, flat, end = spread(data)
        self.hashes, self.held = np.cumsum(spaced, dtype=np.uint64), held.astype(bool)
        lens = lens.astype(np.int64)
        self.sizes = lens + 1
        ends = np.cumsum(self.sizes) - 1
        tokens = np.full(int(self.sizes.sum()), end[0], np.int64)
        place = np.ones(len(tokens), bool)
        place[ends] = False
        tokens[place] = flat
        self.tokens, self.starts = tokens.astype(np.int32), ends - lens
        train = np.repeat(~self.held, self.sizes)
        v = len(self.hashes)
        self.shard = (self.hashes % np.uint64(shards)).astype(np.int64)
        order = np.argsort(self.shard, kind="stable")  # words by shard, by hash in a shard
        rank = np.empty(v, np.int64)
        rank[order] = np.arange(v)
        self.word, self.rank = order, rank
        self.word_n = np.bincount(tokens[train], minlength=v)[order]
        after = np.ones(len(tokens), bool)
        after[self.starts] = False
        self.second = np.flatnonzero(after)
        u, w = rank[tokens[self.second - 1]], tokens[self.second]
        pairs, self.of_pair = distinct(u * v + w)
        self.pair_u, self.pair_w = (pairs // v).astype(np.int32), (pairs % v).astype(np.int32)
        self.pair_n = np.bincount(self.of_pair, weights=train[self.second], minlength=len(pairs)).astype(np.int64)
        third = after.copy()
        third[1:] &= after[:-1]
        self.third = np.flatnonzero(third).astype(np.int32)
        self.second = self.second.astype(np.int32)
        del pairs, u, w, after
        pair_at = np.zeros(len(tokens), np.int32)
        pair_at[self.second] = self.of_pair
        first_pair = np.searchsorted(self.pair_u, np.arange(v))
        u = rank[tokens[self.third - 1]]
        contexts, of_context = distinct(u * v + tokens[self.third - 2])
        self.context_u, self.context_v = (contexts // v).astype(np.int32), (contexts % v).astype(np.int32)
        relative = pair_at[self.third] - first_pair[u]
        del pair_at, contexts, u, tokens
        wide = int(relative.max(initial=0)) + 1
        triples, self.of_triple = distinct(of_context.astype(np.int64) * wide + relative)
        self.triple_context, self.triple_place = (triples // wide).astype(np.int32), (triples % wide).astype(np.int32)
        self.triple_n = np.bincount(self.of_triple, weights=train[self.third], minlength=len(triples)).astype(np.int64)

    def parts(self, shards: int):
        """(shard, slices of words, pairs, contexts, triples), each a range as all are ordered by shard."""
        edges = np.searchsorted(self.shard[self.word], np.arange(shards + 1))
        pair = np.searchsorted(self.pair_u, edges)
        context = np.searchsorted(self.context_u, edges)
        triple = np.searchsorted(self.triple_context, context)
        for s in range(shards):
            if edges[s + 1] > edges[s]:
                yield s, *(slice(int(e[s]), int(e[s + 1])) for e in (edges, pair, context, triple))


def _send(shards: int):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                g, out = Grams(batch.column("data")[k].as_py(), shards), []
                for s, w, p, c, t in g.parts(shards):
                    own = g.hashes[g.word[w]]
                    used = np.unique(np.concatenate((g.pair_w[p], g.context_v[c])))
                    names = g.hashes[used] >> NAME_SHIFT
                    place = lambda codes: np.searchsorted(used, codes)  # noqa: B023, E731
                    n = w.stop - w.start
                    followers, fronts = np.bincount(g.pair_u[p] - w.start, minlength=n), np.bincount(g.context_u[c] - w.start, minlength=n)
                    out.append((s, squeeze(
                        gaps(own), small(g.word_n[w]), gaps(names),
                        small(followers), small(steps(place(g.pair_w[p]), followers)), small(g.pair_n[p]),
                        small(fronts), small(steps(place(g.context_v[c]), fronts)),
                        small(np.bincount(g.triple_context[t] - c.start, minlength=c.stop - c.start)), small(g.triple_place[t]), small(g.triple_n[t]),
                    )))
                number = batch.column("chunk")[k].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _ in out], pa.int64()), pa.array([number] * len(out), pa.int64()), pa.array([b for _, b in out], pa.binary())],
                    ["shard", "chunk", "blob"],
                )
                del g, out
                trim()

    return run


def _sum_by(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    unique, inverse = distinct(keys)
    return unique, inverse, np.bincount(inverse, weights=n, minlength=len(unique)).astype(np.int64)


def _words(shards: int):
    """A chunk: its training words and their counts, to the shards of their hashes."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                spaced, lens, held, flat, end = spread(batch.column("data")[k].as_py())
                hashes, train = np.cumsum(spaced, dtype=np.uint64), ~held.astype(bool)
                count = np.bincount(flat[np.repeat(train, lens)], minlength=len(hashes))
                count[end[0]] += int(train.sum())
                seen = count > 0
                hashes, count = hashes[seen], count[seen]
                parts = [(s, squeeze(gaps(hashes[g]), small(count[g]))) for s, g in by_shard((hashes % np.uint64(shards)).astype(np.int64))] if len(hashes) else []
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int64()), pa.array([b for _, b in parts], pa.binary())], ["shard", "blob"])

    return run


def _counted(table: pa.Table) -> pa.Table:
    """A shard: how many training tokens and how many distinct ones it has."""
    parts = [spread(b.as_py()) for b in table.column("blob")]
    words = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]))
    n = sum(int(p[1].sum(dtype=np.int64)) for p in parts)
    return pa.table({"n": pa.array([n], pa.int64()), "v": pa.array([len(words)], pa.int64())})


ANSWER = "shard long, chunk long, blob binary"


class Part:
    """What one chunk has sent to a shard, by ranges of its words, which are in the order of their hashes."""

    def __init__(self, blob: bytes):
        spaced, self.n, names, self.followers, self.follower, self.pair_n, self.fronts, self.front, self.thirds, self.place, self.triple_n = spread(blob)
        self.own, self.names = np.cumsum(spaced, dtype=np.uint64), np.cumsum(names, dtype=np.uint64)
        start = lambda counts: np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        self.pair, self.context = start(self.followers), start(self.fronts)
        self.triple = start(self.thirds)[self.context]

    @property
    def sizes(self) -> np.ndarray:
        """Pairs, contexts and triples of each word."""
        return np.diff(self.pair) + np.diff(self.context) + np.diff(self.triple)

    def named(self, dictionary: np.ndarray) -> None:
        self.names = np.searchsorted(dictionary, self.names).astype(np.int32)


def ranges(parts: list[Part], most: int) -> list[np.ndarray]:
    """For each range of word hashes the places where it begins in each part, and where the last one ends.

    A range has ``most`` entries or few more, but for a word that has more alone.
    """
    own, sizes = np.concatenate([p.own for p in parts]), np.concatenate([p.sizes for p in parts])
    order = np.argsort(own, kind="stable")
    own, before = own[order], np.cumsum(sizes[order]) - sizes[order]
    level = before // most
    heads = own[np.flatnonzero(np.diff(level)) + 1]  # the first hash of each range but the first
    ends = [np.zeros(len(parts), np.int64)]
    ends += [np.array([np.searchsorted(p.own, h) for p in parts]) for h in np.unique(heads)]
    return [*ends, np.array([len(p.own) for p in parts])]


def _resolve(parts: list[Part], begin: np.ndarray, end: np.ndarray, size: int, discount: float, low: float) -> list[tuple]:
    """A range of words: adds the counts, builds its trie, looks up what each part has; (counts, codes of w2, s2, w3, s3) of each."""
    words = [slice(int(a), int(b)) for a, b in zip(begin, end, strict=True)]
    pair, context, triple = ([slice(int(getattr(p, k)[w.start]), int(getattr(p, k)[w.stop])) for p, w in zip(parts, words, strict=True)] for k in ("pair", "context", "triple"))
    starts = lambda cuts: np.cumsum([0, *(c.stop - c.start for c in cuts)])
    w_at, p_at, c_at, t_at = map(starts, (words, pair, context, triple))
    join = lambda name, cuts: np.concatenate([getattr(p, name)[c] for p, c in zip(parts, cuts, strict=True)])
    known, of_own, word_n = _sum_by(join("own", words), join("n", words))
    pu, pw, cu, cv, tc, tp = [], [], [], [], [], []
    for k, (x, w, p, c, t) in enumerate(zip(parts, words, pair, context, triple, strict=True)):
        mine, followers, fronts = of_own[w_at[k] : w_at[k + 1]], x.followers[w], x.fronts[w]
        pu.append(np.repeat(mine, followers))
        pw.append(x.names[unstepped(x.follower[p], followers)])
        cu.append(np.repeat(mine, fronts))
        cv.append(x.names[unstepped(x.front[c], fronts)])
        local = np.repeat(np.arange(c.stop - c.start, dtype=np.int32), x.thirds[c])
        tc.append(local.astype(place_type(c_at[-1])) + place_type(c_at[-1])(c_at[k]))
        first = (np.cumsum(followers, dtype=np.int64) - followers + p_at[k]).astype(place_type(p_at[-1]))
        tp.append(first[np.repeat(np.arange(len(mine), dtype=np.int32), fronts)[local]] + x.place[t].astype(first.dtype))
    key = lambda a, b: a.astype(np.int64) * size + b
    pw, tc, tp = np.concatenate(pw), np.concatenate(tc), np.concatenate(tp)
    pairs, of_pair, pair_n = _sum_by(key(np.concatenate(pu), pw), join("pair_n", pair))
    contexts, of_context = distinct(key(np.concatenate(cu), np.concatenate(cv)))
    third = key(of_context[tc], pw[tp])
    del pu, cu, cv, pw, tc, tp
    triples, of_triple, triple_n = _sum_by(third, join("triple_n", triple))
    del third
    seen, seen3 = pair_n > 0, triple_n > 0
    with tempfile.TemporaryFile() as file:
        trie = Trie(size, pairs[seen], pair_n[seen], contexts, (triples[seen3] // size, triples[seen3] % size), triple_n[seen3], discount, low, mapped(file))
        share2, place = trie.pair(pairs // size, pairs % size)
        weight2 = trie.weight_of(np.arange(len(known)))
        weight3, context_at = trie.context(contexts)
        ctx, w = triples // size, triples % size
        at = np.searchsorted(pairs, contexts[ctx] // size * size + w)
        share3 = trie.triple(context_at[ctx], place[at])
        del trie, ctx, w, at, place, context_at
    out = []
    for k in range(len(parts)):
        mine = of_own[w_at[k] : w_at[k + 1]]
        out.append((
            word_n[mine], weight2[mine], share2[of_pair[p_at[k] : p_at[k + 1]]], weight3[of_context[c_at[k] : c_at[k + 1]]],
            share3[of_triple[t_at[k] : t_at[k + 1]]],
        ))
    return out


def _answer(discount: float, low: float):
    """A shard: answers what each chunk has sent, range by range of its words."""

    def run(table: pa.Table) -> pa.Table:
        shard, chunks = table.column("shard")[0].as_py(), table.column("chunk").to_pylist()
        parts = [Part(b.as_py()) for b in table.column("blob")]
        dictionary = np.unique(np.concatenate([p.names for p in parts]))
        for p in parts:
            p.named(dictionary)
        size, ends, found = max(1, len(dictionary)), ranges(parts, RANGE), [[] for _ in parts]
        for begin, end in zip(ends[:-1], ends[1:], strict=True):
            for mine, got in zip(found, _resolve(parts, begin, end, size, discount, low), strict=True):
                mine.append(got)
            trim()
        blobs = []
        for k, mine in enumerate(found):
            n, *codes = (np.concatenate(x) for x in zip(*mine, strict=True))
            blobs.append(squeeze(small(n), *codes))
            found[k] = None
        return pa.table({
            "shard": pa.array([shard] * len(chunks), pa.int64()), "chunk": pa.array(chunks, pa.int64()), "blob": pa.array(blobs, pa.binary()),
        })

    return run


RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def _score(shards: int, total: int, distinct: int, low: float):
    """A chunk: puts the scores of its texts together."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        g = Grams(left.column("data")[0].as_py(), shards)
        ids = left.column("ids")[0].as_py()
        blobs = {s: b for s, b in zip(right.column("shard").to_pylist(), right.column("blob"), strict=True)}
        v = len(g.hashes)
        count, l2 = np.zeros(v, np.int64), np.zeros(v)
        a2, l3, a3 = np.zeros(len(g.pair_u)), np.zeros(len(g.context_u)), np.zeros(len(g.triple_context))
        for s, w, p, c, t in g.parts(shards):
            n, weight2, share2, weight3, share3 = spread(blobs[s].as_py())
            count[w] = n
            a2[p], l2[w] = Codes.value(share2, low, 0.0), Codes.value(weight2, low, 1.0)
            a3[t], l3[c] = Codes.value(share3, low, 0.0), Codes.value(weight3, low, 1.0)
        c = count[g.rank[g.tokens]]
        base = (c + 1) / (total + distinct + 1)
        p = base.copy()
        p[g.second] = a2[g.of_pair] + l2[g.rank[g.tokens[g.second - 1]]] * base[g.second]
        p[g.third] = a3[g.of_triple] + l3[g.triple_context[g.of_triple]] * p[g.third]
        add = lambda x: np.add.reduceat(x, g.starts) if len(g.starts) else x
        return pa.table({
            "doc_id": pa.array([None if i == LAST else i for i in ids], pa.int64()),
            "held_out": pa.array(g.held),
            "n_tokens": pa.array(g.sizes),
            "n_known": pa.array(add((c > 0).astype(np.int64))),
            "train_tokens": pa.array(np.full(len(ids), total)),
            "base_score": pa.array(add(np.log10(base))),
            "score": pa.array(add(np.log10(p))),
        })

    return run


def in_fold(doc_id: str, folds: int = 7, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls into the fold (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == fold


def score_documents(
    docs: DataFrame, held_out: Column | None = None, doc_id: str = "doc_id", text: str = "text", discount: float = DISCOUNT, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    The model learns from the rows that ``held_out`` leaves (by default fold 2 of 7 is held out).
    Defined cases: a null text is empty and has one token, its end; a null ``held_out`` counts as
    false; repeated rows count and are scored repeatedly; without training tokens N and V are 0;
    other columns are ignored; no rows give no rows.
    """
    shards = shuffle_partitions(docs.sparkSession)
    held = in_fold(doc_id) if held_out is None else held_out
    chosen = docs.select(F.col(doc_id).cast("long").alias("i"), F.coalesce(held, F.lit(False)).alias("h"), F.col(text).cast("string").alias("t"))
    chunks = bucketed(chosen.mapInArrow(_tokenise(chunk_bytes), CHUNKS), "chunk", 2 * shards)
    sent = chunks.mapInArrow(_send(shards), "shard long, chunk long, blob binary")
    words = chunks.mapInArrow(_words(shards), "shard long, blob binary").groupBy("shard").applyInArrow(_counted, "n long, v long")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    low = least_log(discount, total)
    answers = sent.groupBy("shard").applyInArrow(_answer(discount, low), ANSWER)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(shards, total, kinds, low), RESULT)
