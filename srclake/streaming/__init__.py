"""Incremental maintenance over streams (an extension: batch maintenance is what operators.maintenance has)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import maintenance


def maintain(changes: DataFrame, read_facts, write_facts, checkpoint: str, key: str = "file_id") -> StreamingQuery:
    """Each micro-batch of new fact rows replaces those of its files: read_facts() -> table, write_facts(df) stores it.

    write_facts must not overwrite what read_facts reads from (write a new version and switch)."""

    def apply(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            write_facts(maintenance.cleaned(read_facts(), batch.select(key), key).unionByName(batch))

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
