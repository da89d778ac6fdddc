"""Written tables in the folder that the whole cluster shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``; a job that loses an
executor reads those files again.  Only where the setting is missing (a local test) does
this module choose a folder itself.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path below the shared folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("on a cluster, set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tracemill-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tracemill/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written once and read from there."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._scratch = path
    return read


def discard(*tables: DataFrame) -> None:
    """Deletes the files of ``stored`` tables that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
