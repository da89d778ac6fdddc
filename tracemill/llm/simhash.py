"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tracemill.operators.components import components
from tracemill.llm.chunks import LAST, Chunk, by_shard, gaps, packed, small, spread, squeeze, trim
from tracemill.llm.store import discard, shuffle_partitions, stored

SEED = 42
#: Shingles hashed at a time, so that a text of any length needs bounded memory.
STEP = 1 << 18
#: Members from which a block is linked by shared neighbours instead of pairs.
HOT = 64


def shingle_hashes(text: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``size`` words (A-Z lower-cased, ASCII white space), in parts; a shorter text is one run."""
    words = text.lower().split()
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    first, last = starts[:n], ends[min(size, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, STEP):
        pairs = zip(first[i : i + STEP].tolist(), last[i : i + STEP].tolist(), strict=True)
        yield np.fromiter((digest(line[a:b], SEED) for a, b in pairs), np.uint64, min(STEP, n - i))


def majority(parts: Iterator[np.ndarray]) -> int:
    """A bit is 1 if it is set in over half the hashes; no hash: 0."""
    ones, total = np.zeros(64, np.int64), 0
    for h in parts:
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(h)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big") if total else 0


def fingerprints(docs: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of every row's whole text, as a signed long."""

    def run(batches):
        for batch in batches:
            fps = [majority(shingle_hashes((t or "").encode("utf-8", "replace"), size)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


def links(nodes: DataFrame, distance: int = 2, blocks: int = 4) -> DataFrame:
    """(a, b): edges between ``nodes`` (fp, rep; fp distinct) that join all fingerprints within ``distance`` bits.

    Of ``blocks`` blocks, two fingerprints within ``distance`` agree on ``blocks - distance`` at
    least (pigeonhole), so all combinations of so many blocks are join keys, and the pairs of a
    key are verified by their Hamming distance.  With the defaults a key has 32 bits.

    A key with over HOT members makes no pairs.  Its members emit themselves and their 64
    one-bit neighbours instead: two fingerprints are within 2 bits if and only if they share
    such a value, and each value links its members to the least of them.  That is exact, and
    linear in the members.
    """
    if not 0 <= distance <= 2 or not distance < blocks <= 16:
        raise ValueError("distance is 0, 1 or 2, and blocks are more than that")
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for kept in combinations(range(blocks), blocks - distance):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in kept)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(len(keys)).alias("k"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bits")))
    keyed = nodes.select("fp", "rep", F.explode(F.array(*keys)).alias("key")).select("fp", "rep", "key.k", "key.bits")
    sizes = keyed.groupBy("k", "bits").agg(F.count("*").alias("n")).where("n > 1")
    few = keyed.join(sizes.where(F.col("n") <= HOT), ["k", "bits"])
    pairs = (
        few.alias("x").join(few.alias("y"), ["k", "bits"])
        .where("x.fp < y.fp")
        .where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance)
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    )
    many = keyed.join(sizes.where(F.col("n") > HOT), ["k", "bits"], "left_semi").select("fp", "rep").distinct()
    flips = [1 << i for i in range(63)] + [-(1 << 63)] if distance else []
    reach = flips if distance == 2 else []
    around = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(f)) for f in reach))
    spread = many.select("rep", F.explode(around).alias("at"))
    hub = spread.groupBy("at").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = spread.join(hub, "at").where("rep != least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    if distance == 1:  # a value and its one-bit neighbour: one of the two emits itself only
        near = many.select(F.col("rep").alias("b"), F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(f)) for f in flips))).alias("fp"))
        stars = near.join(many, "fp").select(F.col("rep").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def simhash_groups(docs: DataFrame, size: int = 3, distance: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    Fingerprints of shingles of ``size`` words link at ``distance`` differing bits or fewer;
    component_id is the smallest doc_id that a document reaches over links, itself included.

    Defined cases: a null or empty text, or one of white space only, has the fingerprint zero and
    is linked like any other; equal fingerprints are one component; repeated rows stay; a null
    doc_id comes last, so a component has a null id only if all its ids are null; other columns
    are ignored; no rows give no rows.

    Scale: texts are read once and (doc_id, fp) written; equal fingerprints are combined before
    any link is sought, so exact copies, however many, are one node.
    """
    fps = stored(fingerprints(docs, size, doc_id, text))
    nodes = stored(fps.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("least")))
    found = components(links(nodes.select("fp", F.col("fp").alias("rep")), distance))
    of = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    named = of.select("fp", "c").join(of.groupBy("c").agg(F.min("least").alias("least")), "c")
    return fps.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("least") != LAST, F.col("least")).alias("component_id"),
    )


# Near-duplicates by similarity of shingle sets.
#
# First come the 64-bit SimHash fingerprints of the sets: those within 2 bits are candidates,
# by ``links``, and an exact check of the whole sets follows.  What it confirms is one group.
#
# One 64-bit fingerprint cannot tell 0.8 apart: texts of that similarity differ in about ten
# of its bits.  The groups that SimHash leaves apart are therefore met in an exact way: two
# sets of m and n shingles are similar enough if they differ in D = (1 - similarity) /
# (1 + similarity) * (m + n) shingles at most.  The blocks are single shingles in the order
# of rarity: of the first D + 1 shingles of the two, one at least is common (pigeonhole), rare
# shingles have few members, and a shingle that one text has joins none.

#: Bytes of text in a chunk, and bytes of text whose shingles one shard counts.
CHUNK_BYTES = 4 << 20
SHARD_BYTES = 32 << 20
#: Sizes of sets are compared by classes of this ratio: similar sets lie in one or in neighbouring classes.
RATIO = 1.25
#: Members from which a block is linked by stars before its pairs are made.
CROWD = 24
#: Rounds of stars at most; what they do not link is left to the pairs.
TURNS = 4
#: Sets of one block that are joined with all others by one task.
SALT = 256


def shingle_set(text: str | None, size: int) -> np.ndarray:
    parts = list(shingle_hashes((text or "").encode("utf-8", "replace"), size))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


class Sets:
    """The shingle sets of a chunk's distinct texts, in an order that any task finds again."""

    def __init__(self, chunk: Chunk, size: int):
        number: dict[bytes, int] = {}
        self.of = np.zeros(len(chunk.lens), np.int64)
        for row, (a, n) in enumerate(zip(chunk.starts.tolist(), chunk.lens.tolist(), strict=True)):
            self.of[row] = number.setdefault(chunk.data[a : a + n].tobytes(), len(number))
        sets = [np.unique(np.concatenate(parts)) if (parts := list(shingle_hashes(t, size))) else np.zeros(0, np.uint64) for t in number]
        self.n = np.array([len(s) for s in sets], np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.total = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
        self.mixed = np.array([(s * s + (s >> np.uint64(7))).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)

    def by_shard(self, shards: int):
        """Distinct shingles with their number of sets, the place of each shingle of ``flat``, and (shard, places)."""
        unique, inverse, count = np.unique(self.flat, return_inverse=True, return_counts=True)
        return unique, inverse, count, by_shard((unique % np.uint64(shards)).astype(np.int64))


def _offer(size: int, shards: int):
    """A chunk: its shingles with their number of sets, to the shards of their hashes."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                unique, _, count, parts = Sets(Chunk.of(batch, k), size).by_shard(shards)
                rows = [(s, batch.column("chunk")[k].as_py(), squeeze(gaps(unique[g]), small(count[g]))) for s, g in parts]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), MOVED_TYPES, strict=True)], ["shard", "chunk", "blob"])
                del unique, parts, rows
                trim()

    return run


MOVED, MOVED_TYPES = "shard long, chunk long, blob binary", (pa.int64(), pa.int64(), pa.binary())


def _counted(table: pa.Table) -> pa.Table:
    """A shard: in how many sets of all chunks each shingle is, for each chunk in the order in which it has sent them."""
    parts = [spread(b.as_py()) for b in table.column("blob")]
    hashes = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
    _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    df = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)[inverse]
    at = np.cumsum([0, *(len(h) for h in hashes)])
    blobs = [squeeze(small(df[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return pa.table({"shard": table.column("shard"), "chunk": table.column("chunk"), "blob": pa.array(blobs, pa.binary())})


MARKS = "uid long, id long, n long, total long, mixed long, fp long, h array<long>, k array<int>, s array<long>"


def _uid(chunk: int) -> int:
    """The number of a chunk's first row: 23 bits for the partition, 20 for the chunk in it, 20 for the row in that."""
    part, number = chunk >> 32, chunk & 0xFFFFFFFF
    if part >= 1 << 23 or number >= 1 << 20:
        raise ValueError("more chunks than row numbers have room for")
    return part << 40 | number << 20


def _marked(size: int, similarity: float, shards: int):
    """A chunk: for every row its number, its set's size, two order-free hashes and fingerprint, and for a set that may be like another
    its blocks: shingle h at place k, rarest first, as far as similar sets must share one (``h`` null: none)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        rows = []
        replies = dict(zip(right.column("shard").to_pylist(), right.column("blob"), strict=True))
        for c in range(left.num_rows):  # one
            chunk = Chunk.of(left, c)
            sets = Sets(chunk, size)
            unique, inverse, _, parts = sets.by_shard(shards)
            df = np.ones(len(unique), np.int64)
            for s, g in parts:
                df[g] = spread(replies[s].as_py())[0]
            df, owner = df[inverse], np.repeat(np.arange(len(sets.n)), sets.n)
            order = np.lexsort((sets.flat, df, owner))
            place = np.arange(len(order)) - sets.start[owner] + 1
            n = sets.n[owner]
            block = (place <= n - np.ceil(n * similarity - 1e-9) + 1) & (df[order] > 1)
            hashes, places, whose = sets.flat[order][block].view(np.int64), place[block], owner[block]
            fps = np.array([majority(sets.flat[i : min(i + STEP, a + m)] for i in range(a, a + m, STEP)) for a, m in zip(sets.start.tolist(), sets.n.tolist(), strict=True)], np.uint64).view(np.int64)
            cut = np.searchsorted(whose, np.arange(len(sets.n) + 1)).tolist()
            first, seen = _uid(left.column("chunk")[c].as_py()), set()
            for row, (i, k) in enumerate(zip(chunk.ids.tolist(), sets.of.tolist(), strict=True)):
                mine = slice(cut[k], cut[k + 1]) if k not in seen and cut[k + 1] > cut[k] else None
                seen.add(k)
                whole = sets.flat[sets.start[k] : sets.start[k] + sets.n[k]].view(np.int64)
                mark = (first + row, i, int(sets.n[k]), int(sets.total[k]), int(sets.mixed[k]), int(fps[k]))
                rows.append((*mark, hashes[mine], places[mine], whole) if mine else (*mark, None, None, None))
        kinds = [*[pa.int64()] * 6, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = ["uid", "id", "n", "total", "mixed", "fp", "h", "k", "s"]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 9, kinds, strict=True)], names=names)

    return run


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole sets are within the Hamming distance that the similarity allows."""
    left, right = sets.select(F.col("i").alias("a"), F.col("s").alias("x")), sets.select(F.col("i").alias("b"), F.col("s").alias("y"))
    apart = F.size("x") + F.size("y") - 2 * F.size(F.array_intersect("x", "y"))
    near = apart <= (1 - similarity) / (1 + similarity) * (F.size("x") + F.size("y")) + 1e-9
    return pairs.join(left, "a").join(right, "b").where(near).select("a", "b")


def _may_be(x: str, y: str, similarity: float) -> Column:
    """Whether rows ``x`` and ``y`` of one block (n shingles, the block at place k) can belong to similar sets."""
    sizes = F.least(f"{x}.n", f"{y}.n") >= similarity * F.greatest(f"{x}.n", f"{y}.n") - 1e-9
    common = similarity / (1 + similarity) * (F.col(f"{x}.n") + F.col(f"{y}.n")) - 1e-9
    return sizes & (F.least(F.expr(f"{x}.n - {x}.k"), F.expr(f"{y}.n - {y}.k")) + 1 >= common)


def _level() -> Column:
    return F.floor(F.log("n") / F.log(F.lit(RATIO)) + 1e-9)


def _stars(of: DataFrame, turn: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of different groups: each member of a crowded block with one of its size class.

    First that is the member with the fewest rarer shingles, which is most like what the others
    have in common, then another one each turn.
    """
    first = F.struct(F.col("k") / F.col("n"), "i") if turn == 0 else F.struct(F.xxhash64("i", F.lit(turn)), F.col("i"))
    at = of.withColumn("level", _level())
    hubs = at.groupBy("h", "level").agg(F.count("*").alias("m"), F.min("g").alias("low"), F.max("g").alias("high"), F.min_by(F.struct("i", "g", "n", "k"), first).alias("y"))
    hubs = hubs.where((F.col("m") > CROWD) & (F.col("low") < F.col("high"))).select("h", "level", "y")
    met = at.alias("x").join(hubs, ["h", "level"]).where((F.col("x.g") != F.col("y.g")) & _may_be("x", "y", similarity))
    return met.select(F.least("x.i", "y.i").alias("a"), F.greatest("x.i", "y.i").alias("b")).distinct()


def _open(of: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``of`` that some row of another group in their block may be similar to.

    Sizes and places leave to a row partners of ``cap = (n - k + 1) / share - n`` shingles at
    most.  So of all rows in reach, the largest cap and the smallest size decide, each for the
    two groups that are best in it, as one of them may be the row's own.
    """
    share = similarity / (1 + similarity)
    rows = of.withColumns({"level": _level(), "cap": (F.col("n") - F.col("k") + 1) / share - F.col("n")})
    near = rows.select("h", "g", "n", "cap", F.explode(F.array(*(F.col("level") + d for d in (-1, 0, 1)))).alias("level"))
    by_group = near.groupBy("h", "level", "g").agg(F.max("cap").alias("cap"), F.min("n").alias("n"))
    best = by_group.groupBy("h", "level").agg(F.max(F.struct("cap", "g")).alias("c1"), F.min(F.struct("n", "g")).alias("n1"))
    other = by_group.join(best, ["h", "level"]).groupBy("h", "level", "c1", "n1").agg(
        F.max(F.when(F.col("g") != F.col("c1.g"), F.col("cap"))).alias("c2"), F.min(F.when(F.col("g") != F.col("n1.g"), F.col("n"))).alias("n2")
    )
    cap = F.when(F.col("g") == F.col("c1.g"), F.col("c2")).otherwise(F.col("c1.cap"))
    least = F.when(F.col("g") == F.col("n1.g"), F.col("n2")).otherwise(F.col("n1.n"))
    kept = rows.join(other.where("c2 is not null"), ["h", "level"]).where((cap + 1e-6 >= F.col("n")) & (least <= F.col("cap") + 1e-6))
    return kept.select("h", "i", "g", "n", "k")


def _across(of: DataFrame, similarity: float) -> DataFrame:
    """Every pair (a, b) of different groups that shares a block and may be similar.

    A block of many sets is dealt to several tasks: its left side at random, its right side to all.
    """
    rows = stored(_open(of, similarity))
    parts = rows.groupBy("h").agg(F.ceil(F.count("*") / SALT).cast("int").alias("parts"))
    rows = rows.join(parts, "h")
    x = rows.withColumn("salt", F.pmod(F.xxhash64("i"), "parts").cast("int"))
    y = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = x.alias("x").join(y.alias("y"), ["h", "salt"]).where(F.expr("x.i < y.i and x.g != y.g") & _may_be("x", "y", similarity))
    return met.select(F.col("x.i").alias("a"), F.col("y.i").alias("b")).distinct()


def _by_fingerprint(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets (i, fp) that join all fingerprints within 2 bits: ``links``, and each set with the least of its own fingerprint."""
    nodes = stored(sets.groupBy("fp").agg(F.min("i").alias("rep")))
    equal = sets.select("i", "fp").join(nodes, "fp").where("i != rep").select(F.col("rep").alias("a"), F.col("i").alias("b"))
    return equal.unionByName(links(nodes).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def _linked(blocks: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, component) of all sets that are linked, from blocks (h, i, n, k) and sets (i, fp, s).

    SimHash pairs are checked first; sets that those leave in different groups meet by stars, then as pairs.
    """
    tried = stored(_by_fingerprint(sets))
    found = stored(_similar(tried, sets, similarity))
    groups = components(found)
    for turn in range(TURNS + 1):
        of = blocks.join(groups, F.col("i") == F.col("node"), "left").select("h", "i", "n", "k", F.coalesce("component", "i").alias("g"))
        of = stored(of)
        pairs = _stars(of, turn, similarity) if turn < TURNS else _across(of, similarity)
        pairs = stored(pairs.join(tried, ["a", "b"], "left_anti"))
        new = stored(_similar(pairs, sets, similarity))
        found = found.unionByName(new)
        tried = tried.unionByName(pairs)
        some = turn < TURNS and not new.isEmpty()
        if not some and turn < TURNS:  # no star links any more: the pairs that are left
            new = stored(_similar(_across(of, similarity).join(tried, ["a", "b"], "left_anti"), sets, similarity))
            found = found.unionByName(new)
        discard(of)
        groups = components(found)
        if not some:
            return groups
    return groups


def _members(chunks: DataFrame, size: int, similarity: float) -> DataFrame:
    """(uid, id, c, component_id): every row of the chunks with its component and the smallest id in that."""
    spark = chunks.sparkSession
    shards = max(2 * shuffle_partitions(spark), -(-chunks.count() * CHUNK_BYTES // SHARD_BYTES))
    offered = chunks.mapInArrow(_offer(size, shards), MOVED)
    counted = offered.groupBy("shard").applyInArrow(_counted, MOVED)
    marks = stored(chunks.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(_marked(size, similarity, shards), MARKS))
    same = ["n", "total", "mixed"]
    nodes = stored(marks.groupBy(*same).agg(F.min("uid").alias("node"), F.min("id").alias("least")))
    shown = marks.where("h is not null").join(nodes.select(F.col("node").alias("uid")), "uid", "left_semi")
    blocks = shown.select(F.col("uid").alias("i"), "n", F.explode(F.arrays_zip("h", "k")).alias("at")).select("at.h", "i", "n", "at.k")
    met = blocks.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h")
    blocks = stored(blocks.join(met, "h", "left_semi"))
    sets = stored(shown.join(blocks.select(F.col("i").alias("uid")).distinct(), "uid", "left_semi").select(F.col("uid").alias("i"), "fp", "s"))
    linked = _linked(blocks, sets, similarity)
    joined = nodes.join(linked, "node", "left").withColumn("c", F.coalesce("component", "node"))
    named = joined.join(joined.groupBy("c").agg(F.min("least").alias("component_id")), "c").select(*same, "c", "component_id")
    return marks.select("uid", "id", *same).join(named, same).select("uid", "id", "c", "component_id")


def near_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id) for every row: groups of texts linked at ``similarity`` or more.

    Similarity is the Jaccard index of the sets of shingles of ``size`` words (A-Z lower-cased); a
    shorter text is one shingle.  SimHash fingerprints within 2 bits are linked first, if the whole
    sets confirm it; then the exact way for what 64 bits cannot tell.  Every pair of different sets that reaches it is linked, directly
    or over others: see above for the blocks, and ``_linked`` for the order of work.  Crowded
    blocks are linked by stars, which contracts large groups of near copies; then only pairs of
    different groups are made.  Whole sets are verified by their Hamming distance.

    Defined cases: texts without words are alike; equal sets are one node, however many rows; rows
    are told apart by their place, so null and repeated ids are no links; component_id is the least
    id of a group, null only if all its ids are null; repeated rows stay; other columns are
    ignored; no rows give no rows.
    """
    found = _members(packed(docs, CHUNK_BYTES, doc_id, text), size, similarity)
    plain = lambda name: F.when(F.col(name) != LAST, F.col(name))
    return found.select(plain("id").alias("doc_id"), plain("component_id").alias("component_id"))


def near_unique(docs: DataFrame, size: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One whole row of each group of ``near_groups``: that with the smallest id, and of equal ids one of them.

    Defined cases: as for ``near_groups``; a null id is kept only if no row of its group has one; all
    columns come back as they were (a null text too), whatever their names, if JSON can hold them.
    """
    others = [c for c in docs.columns if c not in (doc_id, text)]
    carry = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)] + [F.col(text).isNull().alias("none")]
    kinds = ", ".join([*(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(others)), "none boolean"])
    chunks = packed(docs, CHUNK_BYTES, doc_id, text, carry)
    found = _members(chunks, size, similarity)
    kept = found.groupBy("c").agg(F.min(F.struct("id", "uid")).alias("first")).select("first.uid")
    part, number = F.shiftright("uid", 40), F.shiftright("uid", 20).bitwiseAND((1 << 20) - 1)
    kept = kept.select((F.shiftleft(part, 32) + number).alias("chunk"), F.col("uid").bitwiseAND((1 << 20) - 1).alias("row"))

    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        rows = np.sort(right.column("row").to_numpy())
        if not len(rows):
            return pa.table({"i": pa.array([], pa.int64()), "t": pa.array([], pa.string()), "rest": pa.array([], pa.string())})
        chunk = Chunk.of(left)
        texts = [chunk.data[a : a + n].tobytes().decode("utf-8", "replace") for a, n in zip(chunk.starts[rows].tolist(), chunk.lens[rows].tolist(), strict=True)]
        return pa.table({
            "i": pa.array([None if i == LAST else i for i in chunk.ids[rows].tolist()], pa.int64()),
            "t": pa.array(texts, pa.string()),
            "rest": pa.array([chunk.carry[r] for r in rows.tolist()], pa.string()),
        })

    made = chunks.groupBy("chunk").cogroup(kept.groupBy("chunk")).applyInArrow(pick, "i long, t string, rest string")
    made = made.withColumn("rest", F.from_json("rest", kinds))
    back = {doc_id: F.col("i").cast(docs.schema[doc_id].dataType), text: F.when(~F.col("rest.none"), F.col("t"))}
    back |= {c: F.col(f"rest.c{k}") for k, c in enumerate(others)}
    return made.select(*(back[c].alias(c) for c in docs.columns))
