"""Streaming apply of an op log: each micro-batch becomes a run of a store, once, however often it is tried."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.store import Store


def apply_stream(log: DataFrame, store: Store, checkpoint: str, source: str = "stream") -> None:
    """Apply all input that is there now. Newest means highest seq, so late rows with a lower seq lose.

    The edit that adds a batch's run carries the batch's number, and a number that is there already is skipped.
    """

    def one(batch: DataFrame, number: int) -> None:
        if number not in store.applied_batches(source):
            store.flush(batch.select("seq", "op", "k", "v"), source=source, batch=number)

    query = log.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
