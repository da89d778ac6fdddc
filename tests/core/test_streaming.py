import os
import shutil

import pytest
from pyspark.sql import functions as F

from tracemill.streaming.batches import BatchTable, ChunkAppend, RunningCounts

SCHEMA = "id long, kind string, value double"


def rows(spark):
    return spark.range(600).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("k"), F.col("id") % 3)).alias("kind"), F.when(F.col("id") % 7 > 0, F.col("id") / 4).alias("value"))


def land(spark, folder, low, high, files):
    rows(spark).where(F.col("id").between(low, high - 1)).repartition(files, "id").write.mode("append").parquet(folder)


def run(spark, folder, checkpoint, handler, fail_at=None):
    """One process of the stream over what has landed; ``fail_at`` breaks it after that batch is written, before it is committed."""

    def guarded(batch, number):
        handler(batch, number)
        if number == fail_at:
            raise RuntimeError("broken on purpose")

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    query = stream.writeStream.foreachBatch(guarded).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if fail_at is None:
        query.awaitTermination()
    else:
        with pytest.raises(Exception, match="broken on purpose"):
            query.awaitTermination()


def counted(df):
    return sorted((tuple(r) for r in df.select("kind", "n", "total").collect()), key=str)


def test_counters_go_on_after_a_restart(spark, tmp_path):
    folder, checkpoint, state = (str(tmp_path / n) for n in ("in", "checkpoint", "state"))
    fresh = lambda: RunningCounts(state, ["kind"], {"total": "value"})
    want = rows(spark).groupBy("kind").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    land(spark, folder, 0, 300, 3)
    run(spark, folder, checkpoint, fresh(), fail_at=1)  # written, not committed: delivered again
    run(spark, folder, checkpoint, fresh())
    assert counted(fresh().now(spark)) == counted(want.sparkSession.createDataFrame(rows(spark).where("id < 300").collect(), SCHEMA).groupBy("kind").agg(F.count("*").alias("n"), F.sum("value").alias("total")))
    land(spark, folder, 300, 600, 2)
    run(spark, folder, checkpoint, fresh())
    assert counted(fresh().now(spark)) == counted(want)
    assert len(BatchTable(state).batches(spark)) == 2


def test_a_half_written_batch_is_not_there(spark, tmp_path):
    state = str(tmp_path / "state")
    keep = RunningCounts(state, ["kind"], {})
    keep(rows(spark).where("id < 100"), 0)
    keep(rows(spark).where("id >= 100"), 1)
    os.remove(f"{state}/batch=1/_SUCCESS")
    again = RunningCounts(state, ["kind"], {})
    assert again.table.batches(spark) == [0]
    again(rows(spark).where("id >= 100"), 1)
    again(rows(spark).where("id >= 100"), 1)
    again(rows(spark).limit(0), 2)
    assert {r["kind"]: r["n"] for r in again.now(spark).collect()} == {r["kind"]: r["count"] for r in rows(spark).groupBy("kind").count().collect()}


def test_chunks_go_on_after_a_restart(spark, tmp_path):
    folder, checkpoint, out = (str(tmp_path / n) for n in ("in", "checkpoint", "out"))
    fresh = lambda: ChunkAppend(out, ["id"], 70)
    land(spark, folder, 0, 200, 2)
    run(spark, folder, checkpoint, fresh(), fail_at=0)
    run(spark, folder, checkpoint, fresh())
    land(spark, folder, 200, 600, 2)
    run(spark, folder, checkpoint, fresh())
    got = fresh().now(spark).collect()
    assert sorted(r["id"] for r in got) == list(range(600)) and sorted(r["number"] for r in got) == list(range(600))
    assert all(r["chunk"] == r["number"] // 70 for r in got)
    by_batch = {}
    for r in sorted(got, key=lambda r: r["number"]):
        by_batch.setdefault(r["batch"], []).append(r["id"])
    assert all(ids == sorted(ids) for ids in by_batch.values()) and list(by_batch) == sorted(by_batch)
    shutil.rmtree(f"{out}/manifest/batch={max(by_batch)}")  # not whole: it and its rows are not there
    assert fresh().now(spark).count() == 600 - len(by_batch[max(by_batch)])


def test_chunks_of_no_rows(spark, tmp_path):
    keep = ChunkAppend(str(tmp_path / "out"), ["id"], 10)
    keep(rows(spark).limit(0), 0)
    keep(rows(spark).where("id < 25"), 1)
    assert keep.now(spark).groupBy("chunk").count().orderBy("chunk").collect() == [(0, 10), (1, 10), (2, 5)]
