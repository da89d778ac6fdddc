"""Seals over files and shards: digests of what was written, verified before it is read."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def file_digest(path: str, step: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(step):
            h.update(part)
    return h.hexdigest()


def seal(path: str, inputs: list[str], status: str = "complete") -> None:
    """Writes the digests of local inputs to a new file."""
    with open(path, "x", encoding="utf-8") as f:
        json.dump({"status": status, "inputs": {p: file_digest(p) for p in inputs}}, f, indent=1, sort_keys=True)


def broken(path: str) -> list[str]:
    """Inputs of a seal that are missing or have changed."""
    with open(path, encoding="utf-8") as f:
        inputs = json.load(f)["inputs"]
    return [p for p, d in inputs.items() if not os.path.exists(p) or file_digest(p) != d]


def files_below(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of the files below a path of any store that are not empty; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))


def file_digests(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with ``sha256``: each file is streamed block by block on an executor, whatever its size.

    Paths have a scheme that pyarrow opens, or none.  A file that cannot be read has a null digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_streamed_digest(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(made, pa.string())], [*batch.schema.names[1:], "sha256"])

    rest = files.drop("sha256")
    return rest.repartition(path).select(F.col(path).alias("__path"), "*").mapInArrow(run, rest.schema.add("sha256", "string"))


def _streamed_digest(path: str, step: int = 4 << 20) -> str | None:
    local = re.sub("^file:/+", "/", path)
    store, at = (fs.LocalFileSystem(), local) if ":/" not in local else fs.FileSystem.from_uri(quote(path, safe=":/"))
    h = hashlib.sha256()
    try:
        with store.open_input_stream(at) as f:
            while part := f.read(step):
                h.update(part)
    except OSError:
        return None
    return h.hexdigest()


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of the files below a path of any store."""
    return file_digests(files_below(spark, path)).select("path", "sha256")


# Shards and their manifest

#: Columns of a manifest: a row for each file of each shard.
MANIFEST = "shard string, name string, bytes long, rows long, sha256 string, status string, config_sha256 string, schema string"


def _name(path: Column) -> Column:
    """A file's place below the folder of data."""
    return F.regexp_extract(path, r"/data/(.*)$", 1)


def _shard(path: Column) -> Column:
    return F.regexp_extract(path, r"/data/shard=([^/]*)/", 1)


def write_shards(rows: DataFrame, root: str, shard: Column, config: str) -> None:
    """Writes ``rows`` as shards below ``root``/data, then their manifest; ``config`` says by which settings they were made."""
    rows.withColumn("shard", shard.cast("string")).write.mode("errorifexists").partitionBy("shard").parquet(f"{root}/data")
    write_manifest(rows.sparkSession, root, rows.schema.json(), config)


def write_manifest(spark: SparkSession, root: str, schema: str, config: str) -> None:
    """The manifest of the shards that lie below ``root``/data: digests and row counts are taken from the files."""
    counts = spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{root}/data").groupBy(_name(F.col("_metadata.file_path")).alias("name")).agg(F.count("*").alias("rows"))
    found = file_digests(files_below(spark, f"{root}/data")).select(_shard(F.col("path")).alias("shard"), _name(F.col("path")).alias("name"), "bytes", "sha256")
    made = found.join(counts, "name", "left").withColumns({"rows": F.coalesce("rows", F.lit(0)), "status": F.lit("complete"), "config_sha256": F.sha2(F.lit(config), 256), "schema": F.lit(schema)})
    made.select(*(c.split()[0] for c in MANIFEST.split(", "))).write.mode("errorifexists").json(f"{root}/manifest")


def shard_faults(spark: SparkSession, root: str, config: str, expected: DataFrame | None = None) -> DataFrame:
    """(shard, name, reason) of everything that keeps a shard from being used; no rows: all is as it was written.

    Reasons: incomplete, other_config, missing_file, unlisted_file, changed_file, and missing_shard for a shard of
    ``expected`` (one column) that the manifest does not have.  Digests are taken anew, each file on one executor.
    """
    said = spark.read.schema(MANIFEST).json(f"{root}/manifest").drop("schema", "rows")
    found = file_digests(files_below(spark, f"{root}/data")).select(_shard(F.col("path")).alias("lies_in"), _name(F.col("path")).alias("at"), "bytes", F.col("sha256").alias("digest")).withColumnRenamed("bytes", "size")
    both = said.join(found, said["name"] == found["at"], "full")
    reason = (
        F.when(F.col("at").isNull(), "missing_file")
        .when(F.col("name").isNull(), "unlisted_file")
        .when(~F.col("status").eqNullSafe("complete"), "incomplete")
        .when(~F.col("config_sha256").eqNullSafe(F.sha2(F.lit(config), 256)), "other_config")
        .when(~F.col("digest").eqNullSafe(F.col("sha256")) | ~F.col("size").eqNullSafe(F.col("bytes")), "changed_file")
    )
    faults = both.select(F.coalesce("shard", "lies_in").alias("shard"), F.coalesce("name", "at").alias("name"), reason.alias("reason")).where("reason is not null")
    if expected is not None:
        wanted = expected.select(F.col(expected.columns[0]).cast("string").alias("shard")).distinct()
        absent = wanted.join(said.select("shard").distinct(), "shard", "left_anti")
        faults = faults.unionByName(absent.select("shard", F.lit(None).cast("string").alias("name"), F.lit("missing_shard").alias("reason")))
    return faults


def shard_union(spark: SparkSession, root: str, config: str) -> DataFrame:
    """The rows of all shards without a fault, with ``shard``; files of other shards are not opened.

    The driver holds the names of the shards, as it does for any partitioned table that Spark lists.
    """
    said = spark.read.schema(MANIFEST).json(f"{root}/manifest")
    bad = shard_faults(spark, root, config).select("shard").distinct()
    good = [r["shard"] for r in said.select("shard").distinct().join(bad, "shard", "left_anti").orderBy("shard").collect()]
    schema = StructType.fromJson(json.loads(said.select("schema").first()["schema"])).add("shard", "string")
    if not good:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/data").parquet(*(f"{root}/data/shard={s}" for s in good))


def row_digest(df: DataFrame) -> Column:
    """Digest of a row's columns in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
