"""Feeding the panel store from a stream of files.

The batch store already merges a new delivery into the touched years; here the
deliveries arrive as micro-batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from paneltide.sources.panel_store import write_by_year


def upsert_stream(stream: DataFrame, root: str, checkpoint: str,
                  also_by: Sequence[str] = ()) -> StreamingQuery:
    """Merge every available micro-batch into the store, then stop.

    The merge keeps one row per key, so a batch repeated after a failure
    changes nothing.
    """
    def merge(batch: DataFrame, _number: int) -> None:
        write_by_year(batch, root, also_by=also_by)

    return (stream.writeStream.foreachBatch(merge).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
