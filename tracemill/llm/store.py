"""Written and bucketed tables in the folder that the whole cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.operators.store import discard, scratch, stored

__all__ = ["bucketed", "discard", "scratch", "shuffle_partitions", "stored"]


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """The same rows as a table bucketed by ``key``: later groupings by it need no shuffle of this side."""
    spark = df.sparkSession
    path = scratch(spark)
    name = f"tracemill_{path.rsplit('/', 1)[1]}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
