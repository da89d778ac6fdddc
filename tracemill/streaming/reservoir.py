"""The k rows of least priority of a stream, merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tracemill.operators.store import scratch
from tracemill.streaming.batches import BatchTable


class BottomK:
    """State for ``foreachBatch``: after each batch ``path`` holds the k least rows so far, in a folder of that batch.

    ``priority`` orders rows, ``ties`` break equal ones.  A batch that is delivered again changes nothing, as equal
    rows are one.  With a ``folder`` of its own the state outlives a restart: a new object over it goes on.
    """

    def __init__(self, k: int, priority: str, *ties: str, folder: str | None = None):
        self.k, self.order, self.path = k, [priority, *ties], None
        self.table = BatchTable(folder) if folder else None

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        if self.table is None:
            self.table = BatchTable(scratch(spark))
        before = [b for b in self.table.batches(spark) if b < batch_id]
        every = rows.unionByName(self.table.at(spark, before[-1:], rows.schema).drop("batch"))
        self.table.put(every.distinct().orderBy(*self.order).limit(self.k), batch_id)
        self.table.drop(spark, before[:-1])
        self.path = f"{self.table.path}/batch={batch_id}"
