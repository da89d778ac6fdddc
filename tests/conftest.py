import os
import tempfile

import pytest
from pyspark.sql import SparkSession

_SCRATCH = tempfile.mkdtemp(prefix="tracemill-tests-")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master(f"local[{min(8, os.cpu_count() or 1)}]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.warehouse.dir", f"{_SCRATCH}/warehouse")
        .config("spark.checkpoint.dir", f"{_SCRATCH}/checkpoints")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
