import hashlib

import pytest
from pyspark.sql import functions as F

from tracemill.llm import warc

SCHEMA = "page_id long, url string, html string, data string"


def plain(rows):
    first = {}
    for i, _, h, *_ in rows:
        key = h or ""
        if len(key.encode()) >= 100:
            first[key] = min(first.get(key, warc.LAST), warc.LAST if i is None else i)
    out = []
    for i, _, h, *_ in rows:
        raw = (h or "").encode()
        to = first.get(h or "")
        revisit = to is not None and to < (warc.LAST if i is None else i)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (3, "http://a/é \r\nX: y", "x" * 100, "c"), (1, "http://a/", "x" * 100, "c"), (2, None, "x" * 99, "c"), (5, "u", "x" * 99, None),
    (7, "u", None, None), (8, "u", "", None), (9, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20, None), (None, "u", "x" * 100, None),
    (None, "u", "z" * 200, None), (None, "u", "z" * 200, None), (10, "u", "é" * 5000, None), (11, "v" * 3000, "é" * 5000, None), (1, "again", "x" * 100, None),
]


@pytest.mark.parametrize("chunk_bytes", [7, 1000, 1 << 16])
def test_round_trip(spark, chunk_bytes):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(map(tuple, warc.round_trip(pages, chunk_bytes=chunk_bytes).collect()), key=str) == plain(ROWS)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archive_is_a_warc_file(spark):
    archive = warc.write_archive(spark.createDataFrame(ROWS, SCHEMA), chunk_bytes=50).cache()
    numbers = sorted({r["archive"] for r in archive.collect()})
    raw = b"".join(b for n in numbers for b in warc.archive_bytes(archive, n))
    seen = 0
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        size = int(fields[b"Content-Length"])
        assert head.startswith(b"WARC/1.1") and rest[size : size + 4] == b"\r\n\r\n"
        raw, seen = rest[size + 4 :], seen + 1
    assert seen == len(ROWS)


def test_lost_and_changed_chunks_are_errors(spark):
    archive = warc.write_archive(spark.createDataFrame(ROWS, SCHEMA), chunk_bytes=200).cache()
    lost = archive.where(~((F.col("chunk") == 1) & ~F.col("last")))
    changed = archive.withColumn("data", F.when(F.col("chunk") == 1, F.lit(b"x")).otherwise(F.col("data")))
    for bad in (lost, changed, archive.where("not last")):
        with pytest.raises(Exception, match="chunk|ends early"):
            warc.read_archive(bad).count()
