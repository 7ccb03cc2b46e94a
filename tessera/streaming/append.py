"""Continuous indexing: passages that arrive are added under frozen centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.build import Index


def append_stream(tokens: DataFrame, index: Index, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of (pid, pos, emb) to an index table; a batch that is replayed replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        index.add(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return tokens.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
