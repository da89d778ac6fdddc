"""State of a stream as tables keyed by batch, so that it outlives a restart and counts each batch once.

Every handler here is given to ``foreachBatch``.  It writes what a batch gives to a folder named by the batch id, replacing
what a broken attempt left there, and builds only on whole folders of earlier batches.  A batch that is delivered
again therefore writes the same again, in this or another process; a new handler over the same folder goes on.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracemill.operators.store import discard, stored


class BatchTable:
    """A table in folders ``batch=<id>``; a folder is there once it is whole."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def batches(self, spark: SparkSession) -> list[int]:
        """The ids of whole batches, in order."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        files = top.getFileSystem(conf)
        found = []
        if files.exists(top):
            for status in files.listStatus(top):
                name = re.fullmatch(r"batch=(\d+)", status.getPath().getName())
                if name and files.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                    found.append(int(name[1]))
        return sorted(found)

    def put(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def at(self, spark: SparkSession, batches: list[int], schema) -> DataFrame:
        """The rows of these batches, with ``batch``."""
        if not batches:
            return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("int"))
        return spark.read.schema(schema).option("basePath", self.path).parquet(*(f"{self.path}/batch={b}" for b in batches))

    def drop(self, spark: SparkSession, batches: list[int]) -> None:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for b in batches:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={b}")
            at.getFileSystem(conf).delete(at, True)


class RunningCounts:
    """Running counters by key: ``n`` rows and the sums of columns, after every batch those of all rows so far.

    The state after a batch is a table of its own, of one row a key; the two last are kept, so that the last batch can be
    delivered again.  A null key is a key; a null value adds nothing.
    """

    def __init__(self, path: str, keys: list[str], sums: dict[str, str]):
        self.table, self.keys, self.sums = BatchTable(path), keys, sums

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        new = rows.groupBy(*self.keys).agg(F.count("*").alias("n"), *(F.sum(F.coalesce(F.expr(x), F.lit(0))).alias(c) for c, x in self.sums.items()))
        kept = self.table.batches(spark)
        before = [b for b in kept if b < batch]
        every = new.unionByName(self.table.at(spark, before[-1:], new.schema).drop("batch"))
        total = every.groupBy(*self.keys).agg(*(F.sum(c).cast(new.schema[c].dataType).alias(c) for c in ("n", *self.sums)))
        self.table.put(total, batch)
        self.table.drop(spark, before[:-1])

    def now(self, spark: SparkSession) -> DataFrame:
        """The counters after the last whole batch."""
        last = self.table.batches(spark)[-1:]
        return spark.read.parquet(f"{self.table.path}/batch={last[0]}")


class ChunkAppend:
    """Appends the rows of batches to chunks of ``chunk_rows`` and numbers them through; a manifest tells what is there.

    Rows of a batch are numbered in the order of ``order``, which must tell them apart, behind all rows of earlier
    batches; chunk k holds the numbers from k * chunk_rows on, in one file for each batch that reaches into it.
    """

    MANIFEST = "first long, n long"

    def __init__(self, path: str, order: list[str], chunk_rows: int):
        self.rows, self.manifest = BatchTable(f"{path}/rows"), BatchTable(f"{path}/manifest")
        self.order, self.chunk_rows = order, chunk_rows

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        before = [b for b in self.manifest.batches(spark) if b < batch]
        first = self.manifest.at(spark, before, self.MANIFEST).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long")).first()[0]
        # ranges of the order are written once, so that their sizes and their rows are of one run
        ranged = stored(rows.repartitionByRange(*self.order).sortWithinPartitions(*self.order).withColumn("__range", F.spark_partition_id()))
        sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))  # one row a range
        ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("__range", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
        inside = F.row_number().over(Window.partitionBy("__range").orderBy(*self.order)) - 1
        numbered = ranged.withColumn("number", inside).join(F.broadcast(starts), "__range")
        numbered = numbered.withColumn("number", (F.col("number") + F.col("__ahead") + first).cast("long")).drop("__range", "__ahead")
        chunked = numbered.withColumn("chunk", F.floor(F.col("number") / self.chunk_rows))
        chunked.repartition("chunk").write.mode("overwrite").partitionBy("chunk").parquet(f"{self.rows.path}/batch={batch}")
        self.manifest.put(sizes.agg(F.lit(first).cast("long").alias("first"), F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("n")), batch)
        discard(ranged)

    def now(self, spark: SparkSession) -> DataFrame:
        """All rows of whole batches with ``number``, ``chunk`` and ``batch``."""
        whole = self.manifest.batches(spark)
        filled = [b for b in whole if self.manifest.at(spark, [b], self.MANIFEST).first()["n"]]
        return spark.read.option("basePath", self.rows.path).parquet(*(f"{self.rows.path}/batch={b}" for b in filled))
