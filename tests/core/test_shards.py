import glob
import hashlib
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tracemill.operators import lineage as ln

CONFIG = '{"seed": 1}'


@pytest.fixture
def root(spark, tmp_path):
    rows = spark.range(900).select("id", (F.col("id") % 7).alias("v"), F.lit(None).cast("string").alias("note"))
    ln.write_shards(rows.repartition(3), str(tmp_path / "run"), F.col("id") % 6, CONFIG)
    return str(tmp_path / "run")


def faults(spark, root, **more):
    return {(r["shard"], r["reason"]) for r in ln.shard_faults(spark, root, more.pop("config", CONFIG), **more).collect()}


def ids(spark, root):
    return sorted(r["id"] for r in ln.shard_union(spark, root, CONFIG).collect())


def one(root, shard):
    return sorted(glob.glob(f"{root}/data/shard={shard}/*.parquet"))[0]


def edit_manifest(root, change):
    """The manifest with its rows changed; left out where the change gives nothing."""
    rows = [json.loads(line) for p in glob.glob(f"{root}/manifest/*.json") for line in open(p)]
    shutil.rmtree(f"{root}/manifest")
    os.mkdir(f"{root}/manifest")
    with open(f"{root}/manifest/part-0.json", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in map(change, rows) if r)


def test_whole_shards(spark, root):
    assert faults(spark, root) == set() and ids(spark, root) == list(range(900))
    got = ln.shard_union(spark, root, CONFIG)
    assert got.columns == ["id", "v", "note", "shard"] and got.where("cast(id % 6 as string) != shard").count() == 0
    said = [json.loads(line) for p in glob.glob(f"{root}/manifest/*.json") for line in open(p)]
    assert sum(r["rows"] for r in said) == 900
    for r in said:
        with open(f"{root}/data/{r['name']}", "rb") as f:
            assert hashlib.sha256(f.read()).hexdigest() == r["sha256"]


def test_each_fault_leaves_out_its_shard_alone(spark, root):
    raw = bytearray(open(one(root, 1), "rb").read())
    raw[len(raw) // 2] ^= 255
    open(one(root, 1), "wb").write(raw)
    os.remove(one(root, 2))
    shutil.copy(one(root, 0), f"{root}/data/shard=3/part-extra.parquet")
    edit_manifest(root, lambda r: r | {"status": "running"} if r["shard"] == "4" else r)
    got = faults(spark, root, expected=spark.createDataFrame([("0",), ("5",), ("6",)], "k string"))
    assert got == {("1", "changed_file"), ("2", "missing_file"), ("3", "unlisted_file"), ("4", "incomplete"), ("6", "missing_shard")}
    assert ids(spark, root) == [i for i in range(900) if i % 6 in (0, 5)]


def test_other_settings_and_forgotten_shards(spark, root):
    assert faults(spark, root, config="{}") == {(str(i), "other_config") for i in range(6)}
    assert ln.shard_union(spark, root, "{}").count() == 0
    edit_manifest(root, lambda r: None if r["shard"] == "2" else r)
    assert faults(spark, root) == {("2", "unlisted_file")} and ids(spark, root) == [i for i in range(900) if i % 6 != 2]


def test_streamed_digests(spark, tmp_path):
    (tmp_path / "a b").write_bytes(b"x" * 9_000_000)
    (tmp_path / "empty").write_bytes(b"")
    rows = spark.createDataFrame([(str(tmp_path / n), n, "old") for n in ("a b", "empty", "gone")], "path string, n string, sha256 string")
    got = {r["n"]: r["sha256"] for r in ln.file_digests(rows).collect()}
    assert got == {"a b": hashlib.sha256(b"x" * 9_000_000).hexdigest(), "empty": hashlib.sha256(b"").hexdigest(), "gone": None}
    assert {os.path.basename(r["path"]) for r in ln.digests(spark, str(tmp_path)).collect()} == {"a b"}  # empty files are not listed
