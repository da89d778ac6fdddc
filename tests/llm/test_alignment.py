import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tracemill.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [
    " ", "  ", "\n", " \n ", "\t", "the", " tokens", "a", "é", "12", "٣", "²", ".", "\x1c", "\x85", "\xa0", "　", "​", "'s", "▁", "ﬁ",
    "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "😀", "aaaa", "日本", "_", "naïve", "Å", "\0", "ation",
]


@pytest.fixture(scope="module")
def libraries():
    from tracemill.llm.bpe import byte_characters

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    back = {c: x for x, c in byte_characters().items()}

    def tokens(text):
        one = a.encode(" " + text, add_special_tokens=False).ids
        two = b.encode(text)
        raw_a = [bytes(back[c] for c in a.id_to_token(i)) for i in one]
        raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in two for p in [b.id_to_piece(i)]]
        return list(zip(one, raw_a, strict=True)), list(zip(two, raw_b, strict=True))

    return tokens


def brute(rows, tokens):
    """Every pair of tokens of a document is asked whether it ends together."""
    made = []
    for doc_id, text in rows:
        one, two = tokens(text) if text else ([], [])
        said = (" " + text).encode() if text else b""
        if b"".join(t for _, t in one) != said or b"".join(t for _, t in two) != said:
            one, two = [], []
        ends_a = [(sum(len(t) for _, t in one[: k + 1]), i) for k, (i, _) in enumerate(one)]
        ends_b = [(sum(len(t) for _, t in two[: k + 1]), i) for k, (i, _) in enumerate(two)]
        links = [(a, b) for e, a in ends_a for f, b in ends_b if e == f]
        groups, i, j = [], 0, 0
        for cut in sorted({e for e, _ in ends_a} & {f for f, _ in ends_b}):
            m, n = sum(e <= cut for e, _ in ends_a), sum(f <= cut for f, _ in ends_b)
            groups.append(",".join(str(x) for _, x in ends_a[i:m]) + "|" + ",".join(str(x) for _, x in ends_b[j:n]))
            i, j = m, n
        made.append((doc_id, len(one), len(two), groups, links))
    count = Counter(x for *_, links in made for x in links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (d, a, b, len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for d, a, b, g, x in made
    ]


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_against_brute_force(spark, libraries):
    pick = random.Random(3)
    rows = [(k, "".join(pick.choice(PARTS) for _ in range(pick.randint(0, 12)))) for k in range(400)]
    rows += [(None, "the cat"), (None, "the cat"), (7, "the cat"), (500, None), (501, ""), (502, " "), (503, "a "), (504, "  a"), (505, "a  ")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, pairs string, chunk long").repartition(3)
    got = rows_of(alignment.align_documents(docs, A, B, chunk_chars=300))
    assert got == sorted(brute(rows, libraries), key=str)
    assert got == rows_of(alignment.align_documents(docs, A, B))


def test_documents_against_brute_force(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 1500")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], libraries)
    assert rows_of(alignment.align_documents(docs, A, B)) == sorted(want, key=str)
    assert sum(w[1] > 0 for w in want) > 50


def test_long_texts_and_no_rows(spark, libraries):
    long = "word and word " * 20_000 + "x" * 30_000
    docs = spark.createDataFrame([(1, long), (2, "y" * 50_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in alignment.align_documents(docs, A, B).collect()}
    for i, text in ((1, long), (2, "y" * 50_000)):
        one, two = libraries(text)
        assert (got[i]["n_a"], got[i]["n_b"]) == (len(one), len(two))
        ends_a, ends_b, at = set(), set(), 0
        for _, t in one:
            ends_a.add(at := at + len(t))
        at = 0
        for _, t in two:
            ends_b.add(at := at + len(t))
        assert got[i]["n_groups"] == got[i]["n_links"] == len(ends_a & ends_b)
    assert alignment.align_documents(docs.limit(0), A, B).count() == 0


def test_the_cache_starts_anew(monkeypatch, spark, libraries):
    monkeypatch.setattr(alignment, "CACHE", 5)
    rows = [(k, t) for k, t in enumerate(["one two three four five six", "six seven eight", "one two", "ﬁ ▁"] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert rows_of(alignment.align_documents(docs, A, B, chunk_chars=30)) == sorted(brute(rows, libraries), key=str)


def test_groups_are_scanned_from_labels():
    a, b = alignment.groups_of(b"..*A.B.*BB*")
    assert (a.tolist(), b.tolist()) == ([1, 2, 1], [1, 2, 3])
