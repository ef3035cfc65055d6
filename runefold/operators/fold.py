"""Folds of an op log (seq, op, k, v): the newest operation of each key wins; a tombstone hides it.

All are one hash aggregation with map-side combining, so a hot key costs one row a map task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(log: DataFrame) -> DataFrame:
    """k, seq, op, v of the last operation of each key, tombstones included."""
    return log.groupBy("k").agg(F.max("seq").alias("seq"), F.max_by("op", "seq").alias("op"), F.max_by("v", "seq").alias("v"))


def live(log: DataFrame) -> DataFrame:
    """k, v of the keys that are not deleted. The filter stays above the fold: a tombstone must win first."""
    return newest(log).where("op = 'put'").select("k", "v")


def tombstones(log: DataFrame) -> DataFrame:
    return newest(log).where("op = 'delete'").select("k", "seq")


def as_of(log: DataFrame, condition: Column) -> DataFrame:
    """The live view of the operations that a version saw."""
    return live(log.where(condition))


def get(log: DataFrame, key: str) -> DataFrame:
    """One row (k, found, v) for a key; the filter reaches the scan."""
    hit = live(log.where(F.col("k") == key))
    one = log.sparkSession.range(1).select(F.lit(key).alias("k"))
    return one.join(hit, "k", "left").select("k", F.col("v").isNotNull().alias("found"), "v")


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """k, state (live, deleted or unknown), v of each asked key."""
    state = F.when(F.col("op") == "put", "live").when(F.col("op") == "delete", "deleted").otherwise("unknown")
    return keys.join(newest(log.join(keys, "k", "left_semi")), "k", "left").select("k", state.alias("state"), "v")


def versions(log: DataFrame) -> DataFrame:
    """Each operation with the value before it."""
    w = Window.partitionBy("k").orderBy("seq")
    return log.select("k", "seq", "op", "v", F.lag("v").over(w).alias("before"), F.lag("op").over(w).alias("op_before"))


def merge(runs: DataFrame, bottom: bool) -> DataFrame:
    """One run from several: newest entries; at the bottom level tombstones go, elsewhere they are carried."""
    merged = newest(runs).select("k", "seq", "op", "v")
    return merged.where("op = 'put'") if bottom else merged


def run_metadata(log: DataFrame) -> DataFrame:
    return log.groupBy("run").agg(
        F.count(F.lit(1)).alias("entries"), F.min("k").alias("min_key"), F.max("k").alias("max_key"), F.max("seq").alias("max_seq"),
        F.sum(F.when(F.col("op") == "delete", 1).otherwise(0)).alias("tombstones"), F.sum(F.length("k") + F.coalesce(F.length("v"), F.lit(0))).alias("bytes"),
    )


#: What a memtable counts for an entry besides its key and value (fixed values): a flat part, and a byte for a tombstone.
ENTRY_COST, TOMBSTONE = 64, 1


def entry_size() -> Column:
    """Bytes that an operation adds to a memtable; an overwrite adds its own."""
    value = F.when(F.col("op") == "delete", F.lit(TOMBSTONE)).otherwise(F.coalesce(F.octet_length("v"), F.lit(0)))
    return (F.octet_length("k") + value + ENTRY_COST).cast("long")


def flush_generations(log: DataFrame, threshold: int) -> DataFrame:
    """Memtable generations: sizes add up in seq order and a generation ends with the entry that reaches the threshold.

    The reset-sum is sequential, so it runs over sizes alone, as one ordered stream of two numbers a row.
    """
    rows = log.select("seq", entry_size().alias("size"))

    def run(batches):
        generation, held = 0, 0
        for pdf in batches:
            ends = np.cumsum(pdf["size"].to_numpy()) + held
            out = np.empty(len(ends), np.int64)
            at = 0
            base = 0
            while at < len(ends):  # a step a generation, not a row
                stop = int(np.searchsorted(ends, base + threshold)) + 1
                out[at:stop] = generation
                if stop > len(ends):
                    break
                generation, base, at = generation + 1, int(ends[stop - 1]), stop
            held = int(ends[-1]) - base if len(ends) else held
            yield pdf.assign(generation=out)[["seq", "generation"]]

    return rows.repartition(1).sortWithinPartitions("seq").mapInPandas(run, "seq long, generation long")


def ordered(log: DataFrame) -> DataFrame:
    """All newest entries, tombstones included, by key: a range-partitioned sort."""
    return newest(log).orderBy("k")


def is_empty(log: DataFrame) -> DataFrame:
    """One row: whether no key is live."""
    return live(log).limit(1).agg((F.count(F.lit(1)) == 0).alias("empty"))


def stats(log: DataFrame, unflushed: Column) -> DataFrame:
    """One row: runs, size of the memtable (operations for which ``unflushed`` holds) and its entries, tombstones counted."""
    return log.agg(
        F.count_distinct(F.when(~unflushed, F.col("run"))).alias("sstables"), F.coalesce(F.sum(F.when(unflushed, entry_size())), F.lit(0)).alias("approx_size"),
        F.count_distinct(F.when(unflushed, F.col("k"))).alias("memtable_len"),
    )
