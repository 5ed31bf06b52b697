"""Continuous flattening of export requests into the store."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.envelope import FLATTEN
from ..sources.store import Promoted, append


def start_ingest(lines: DataFrame, root: str, table: str, checkpoint: str,
                 trigger: dict | None = None, promote: Promoted = ()) -> StreamingQuery:
    """Streams requests (``value`` column) of one signal into its table.

    Flattening and writing are those of the batch path, so both can feed one
    table. A micro-batch is named after the checkpoint and its number: repeated
    after a failure, it replaces what it wrote before.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(rows: DataFrame, number: int) -> None:
        append(rows, root, table, promote, batch=f"s-{stream}-{number}")

    return (FLATTEN[table](lines).writeStream.foreachBatch(write).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
