import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tracemill.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string"
PARTS = [" ", "  ", "\n", "\t", "a", "the", "é", "1", "٣", "²", ".", "\x1c", "\x85", "\xa0", "　", "​", "'s", "'ll", "<|endoftext|>", "\0", "\0\0", "😀", "aaaa", "日", "\x0b", "_"]


def test_same_ids_as_the_library():
    library, codec, pick = Tokenizer.from_file(PATH), bpe.Codec(PATH), random.Random(5)
    texts = ["".join(pick.choice(PARTS) for _ in range(pick.randint(0, 14))) for _ in range(3000)]
    texts += ["a" * 4000, "ab" * 3000, "", " ", "\n" * 300, "\0\0<|endoftext|>", "\0\0"]
    ids, n = codec.encode(texts)
    ends = np.cumsum(n)
    for k, text in enumerate(texts):
        theirs = library.encode(text, add_special_tokens=False).ids
        assert ids[ends[k] - n[k] : ends[k]].tolist() == theirs, repr(text)
        assert codec.decode(np.array(theirs, np.int64)) == library.decode(theirs, skip_special_tokens=False)


def test_documents(spark):
    rows = [(1, "Hello there", None), (1, "Hello there", "x"), (2, None, None), (None, "", None), (3, "x " * 300_000, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, bpe.encode_documents(docs, PATH).collect()), key=str)
    library, sha = Tokenizer.from_file(PATH), lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode())))
    assert got == sorted(want, key=str)
    back = bpe.decode_ids(bpe.encode_documents(docs, PATH, ids=True).select("ids", "doc_id"), PATH).collect()
    assert sorted(r["decoded"] for r in back) == sorted(t or "" for _, t, _ in rows)
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    codec, library = bpe.Codec(PATH), Tokenizer.from_file(PATH)
    for text in ["one two three four", "five six seven", "one two"]:
        assert codec.encode([text])[0].tolist() == library.encode(text).ids


def test_long_words_as_the_library():
    pick, codec, library = random.Random(11), bpe.Codec(PATH), Tokenizer.from_file(PATH)
    letters = ["abcdefghijklmnopqrstuvwxyz", "etaoin", "ab", "éàü", "日本語中", "0123456789", "=-_/"]
    texts = ["".join(pick.choices(l, k=n)) for l in letters for n in (bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 3000)]
    texts += ["x" * 5001, "the" * 2000, "".join(pick.choices(letters[0], k=200_000)), "\U0001f600" * 400, " " * 3000]
    for text in texts:
        assert codec.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    short = [t for t in texts if len(t.encode()) < 4000]
    for a, b in zip(codec.merge_rounds([t.encode() for t in short]), map(codec.merge_long, (t.encode() for t in short)), strict=True):
        assert a.tolist() == b.tolist()


def test_cache_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 5000)
    codec, library = bpe.Codec(PATH), Tokenizer.from_file(PATH)
    for k in range(20):
        text = f"{k} " + "ab" * 1000
        assert codec.encode([text])[0].tolist() == library.encode(text).ids
        assert codec.held < 5000 + 40_000
