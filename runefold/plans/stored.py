"""Queries that go through a store: runs, compaction, versions, copies and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..operators import fold
from ..sources.store import SCHEMA, Leveled, SizeTiered, Store, place
from ..streaming.apply import apply_stream
from .catalog import OPLOG
from .registry import register

_LIVE = OPLOG + "SELECT k, v FROM newest WHERE op = 'put'"


def filled(spark, sf_dir, runs: int = 8, **settings) -> Store:
    """A store of the op log's runs, a flush each."""
    store = Store(spark, place(spark, "store"), **settings)
    log = schema.oplog(spark, sf_dir)
    for run in range(runs):
        store.flush(log.where(F.col("run") == run))
    return store


@register("store_live", _LIVE)
def _live(spark, sf_dir):
    return filled(spark, sf_dir).read()


@register("store_as_of_version", OPLOG + "SELECT k, arg_max(coalesce(v, ''), seq) AS v FROM oplog WHERE run < 3 GROUP BY k HAVING arg_max(op, seq) = 'put'")
def _as_of(spark, sf_dir):
    return filled(spark, sf_dir, 5).read(3)


@register("store_point_get", OPLOG + "SELECT k, v FROM newest WHERE op = 'put' AND k = 'u7'")
def _get(spark, sf_dir):
    return filled(spark, sf_dir).get("u7")


@register("store_leveled", OPLOG + "SELECT k, v, true AS idle FROM newest WHERE op = 'put'")
def _leveled(spark, sf_dir):
    """Live view after leveled compaction until idle."""
    store = filled(spark, sf_dir)
    store.compact_all(Leveled())
    return store.read().withColumn("idle", F.lit(not store.compact_once(Leveled())))


@register("store_tiered", _LIVE)
def _tiered(spark, sf_dir):
    store = filled(spark, sf_dir)
    store.compact_all(SizeTiered(3))
    return store.read()


@register("store_compacted_entries", OPLOG + "SELECT k, seq, op, v FROM newest WHERE op = 'put'")
def _compacted(spark, sf_dir):
    """What one run holds after a full compaction: no tombstones, nothing old."""
    store = filled(spark, sf_dir)
    store.compact()
    store.vacuum()
    return store.entries().select("k", "seq", "op", "v")


@register("store_files", OPLOG + "SELECT run + 1 AS number, 0::INTEGER AS level, min(k) AS min_key, max(k) AS max_key FROM oplog GROUP BY run")
def _files(spark, sf_dir):
    return filled(spark, sf_dir).file_table().drop("bytes")


@register("store_space_freed", "SELECT 1::BIGINT AS files, true AS smaller")
def _space(spark, sf_dir):
    store = filled(spark, sf_dir)
    before = store.space()
    store.compact()
    return spark.createDataFrame([(len(store.files()), store.space() < before)], "files long, smaller boolean")


@register("store_snapshot_restored", _LIVE)
def _restored(spark, sf_dir):
    """A snapshot of one store, restored over another that held something else."""
    store, copy = filled(spark, sf_dir), place(spark, "snapshot")
    store.snapshot(copy)
    other = filled(spark, sf_dir, 1)
    other.restore(copy)
    return other.read()


@register("store_log_flushes", OPLOG + "SELECT k, v, true AS flushed FROM newest WHERE op = 'put'")
def _log(spark, sf_dir):
    """Writes through the log of a store that flushes at 64 KB: reads see runs and log alike."""
    store = Store(spark, place(spark, "store"), threshold=64 << 10)
    log = schema.oplog(spark, sf_dir)
    for run in range(8):
        store.write(log.where(F.col("run") == run))
    return store.read().withColumn("flushed", F.lit(len(store.files()) > 0))


@register("stream_apply", _LIVE)
def _stream(spark, sf_dir):
    """The op log read as a stream of files, a micro-batch for each two of them, into a store."""
    at = place(spark, "ops")
    schema.oplog(spark, sf_dir).select("seq", "op", "k", "v").repartition(6, F.col("seq")).write.parquet(at)
    store = Store(spark, place(spark, "store"))
    apply_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(at), store, place(spark, "checkpoint"))
    return store.read()


@register("stream_state", OPLOG + "SELECT k, seq, op, v FROM newest")
def _state(spark, sf_dir):
    """The same by a stateful operator: a key's newest operation is its state, and each change of it is an output row."""
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    class Newest(StatefulProcessor):
        """Takes and gives rows: a data frame for each key, in and out, costs more than its operations."""

        def init(self, handle):
            self.state = handle.getValueState("newest", "seq long, op string, v string")

        def handleInputRows(self, key, rows, timer):
            top = max(rows, key=lambda r: r["seq"])
            held = self.state.get()
            if held is None or held[0] < top["seq"]:
                value = (top["seq"], top["op"], top["v"])
                self.state.update(value)
                yield Row(k=key[0], seq=value[0], op=value[1], v=value[2])

        def close(self):
            pass

    at, out = place(spark, "ops"), place(spark, "changes")
    schema.oplog(spark, sf_dir).select("seq", "op", "k", "v").repartition(6, F.col("seq")).write.parquet(at)
    log = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(at)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        changes = log.groupBy("k").transformWithState(Newest(), "k string, seq long, op string, v string", "append", "none")
        changes.writeStream.option("checkpointLocation", place(spark, "checkpoint")).trigger(availableNow=True).start(path=out, format="parquet", outputMode="append").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return fold.newest(spark.read.parquet(out)).select("k", "seq", "op", "v")
