"""Manifest replay and compaction planning over file tables (number, level, min_key, max_key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def live_files(edits: DataFrame) -> DataFrame:
    """Files that no later edit deletes: adds and deletes meet in one aggregation."""
    adds = edits.where("added is not null").select(F.col("added").alias("number"), F.col("edit_no").alias("a"), F.lit(None).cast("long").alias("d"))
    gone = edits.where("deleted is not null").select(F.col("deleted").alias("number"), F.lit(None).cast("long").alias("a"), F.col("edit_no").alias("d"))
    last = adds.unionAll(gone).groupBy("number").agg(F.max("a").alias("a"), F.max("d").alias("d"))
    return last.where("a is not null and (d is null or d <= a)").select("number", F.col("a").alias("edit_no"))


def orphans(present: DataFrame, live: DataFrame) -> DataFrame:
    """Files on disk that no version names."""
    return present.join(live, "number", "left_anti")


def cells(files: DataFrame, size: int = 500) -> DataFrame:
    """``files`` with ``cell``, a row for each of the key ranges that a file's range touches, and the ``first`` of them: files that meet share one.

    The key space is cut at every ``size``-th of the files' least keys, so a cell holds no more of them as tables grow (but for
    equal keys); the driver sees these cuts only. Any ordered key type will do.
    """
    import numpy as np
    import pyarrow as pa

    def every(batches):
        seen = 0
        for batch in batches:
            yield batch.take(pa.array(range(-seen % size, batch.num_rows, size), pa.int64()))
            seen += batch.num_rows

    keys = files.select("min_key").where("min_key is not null")
    cut = keys.repartitionByRange(1 + keys.count() // 250_000, "min_key").sortWithinPartitions("min_key").mapInArrow(every, keys.schema)
    cuts = np.array(sorted({r[0] for r in cut.collect()}), object)

    def placed(batches):
        for batch in batches:
            for name, key in (("first", "min_key"), ("last", "max_key")):
                column = batch.column(key).to_pylist()
                at = np.zeros(len(column), np.int32)
                known = [i for i, k in enumerate(column) if k is not None]
                at[known] = np.searchsorted(cuts, np.array([*(column[i] for i in known), None], object)[:-1], "right")
                batch = batch.append_column(name, pa.array(at))
            yield batch

    schema = T.StructType([*files.schema.fields, T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
    return files.mapInArrow(placed, schema).withColumn("cell", F.explode(F.sequence("first", "last"))).drop("last")


def _meet(lower: Column) -> Column:
    """Whether two ranges meet, in a join of their levels and cells."""
    return lower & (F.col("a_min") <= F.col("b_max")) & (F.col("b_min") <= F.col("a_max"))


def overlaps(files: DataFrame) -> DataFrame:
    """upper, lower, level: pairs of a file and one of the next level whose key ranges meet.

    An equality join on cells; a pair that shares several counts in the first.
    """
    rows = cells(files)
    a = rows.select(F.col("number").alias("upper"), F.col("level").alias("lv"), F.col("min_key").alias("a_min"), F.col("max_key").alias("a_max"), F.col("first").alias("fa"), "cell")
    b = rows.select(F.col("number").alias("lower"), (F.col("level") - 1).alias("lv"), F.col("min_key").alias("b_min"), F.col("max_key").alias("b_max"), F.col("first").alias("fb"), "cell")
    both = a.join(b, ["lv", "cell"]).where(_meet(F.lit(True)))
    return both.where(F.col("cell") == F.greatest("fa", "fb")).select("upper", "lower", F.col("lv").alias("level"))


def bottom_most(files: DataFrame) -> DataFrame:
    """number, level, bottom_most: whether no file of any deeper level has a range that meets the file's.

    Like ``overlaps``, an equality join on cells.
    """
    rows = cells(files)
    upper = rows.select("number", F.col("level").alias("lv"), F.col("min_key").alias("a_min"), F.col("max_key").alias("a_max"), "cell")
    deeper = rows.select(F.col("level").alias("dl"), F.col("min_key").alias("b_min"), F.col("max_key").alias("b_max"), "cell").distinct()
    covered = upper.join(deeper, (upper["cell"] == deeper["cell"]) & _meet(F.col("dl") > F.col("lv")), "left_semi").select("number").distinct().withColumn("covered", F.lit(True))
    return files.join(covered, "number", "left").select("number", "level", F.col("covered").isNull().alias("bottom_most"))


def levels_overlap(files: DataFrame) -> DataFrame:
    """level, a, b: pairs of files of one level from 1 down whose ranges meet; must be empty."""
    ranges = files.where("level >= 1").select("level", "number", "min_key", "max_key")
    order = Window.partitionBy("level").orderBy("min_key", "number")
    # along rising least keys, a file meets an earlier one if the greatest key so far reaches it
    reach = F.max(F.struct("max_key", "number")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return ranges.withColumn("reach", reach).where("reach.max_key >= min_key").select("level", F.col("reach.number").alias("a"), F.col("number").alias("b"))


def pick_leveled(files: DataFrame, trigger: int, budget: int = 4) -> DataFrame:
    """number, level, output_level, bottom_most of the files that the next leveled compaction merges; none if it is idle.

    Level 0 is drained once it has ``trigger`` files; else the first level with more than ``budget`` files promotes the one
    of least ``min_key`` (ties: the least number). Files of the next level that meet the combined range of those go with
    them. The merge is bottom-most if no file below its output meets the range of all its inputs. Inputs are newest first:
    by level, then by falling number.
    """
    counts = files.groupBy("level").agg(F.count(F.lit(1)).alias("n"))  # a row a level
    full = counts.where(((F.col("level") == 0) & (F.col("n") >= trigger)) | ((F.col("level") > 0) & (F.col("n") > budget)))
    at = F.broadcast(full.agg(F.min("level").alias("at")))  # one row, null if idle
    known = files.crossJoin(at).where("at is not null")
    first = known.where("level = at").agg(F.min(F.struct("min_key", "number")).alias("first"))  # one row
    known = known.crossJoin(F.broadcast(first)).withColumn("primary", F.expr("level = at and (at = 0 or number = first.number)"))

    def hull(rows: DataFrame, low: str, high: str) -> DataFrame:
        return F.broadcast(rows.agg(F.min("min_key").alias(low), F.max("max_key").alias(high)))  # one row

    known = known.crossJoin(hull(known.where("primary"), "p_min", "p_max"))
    inputs = known.where("primary or (level = at + 1 and min_key <= p_max and p_min <= max_key)")
    below = known.where("level > at + 1").crossJoin(hull(inputs, "m_min", "m_max")).where("min_key <= m_max and m_min <= max_key")
    none = F.broadcast(below.agg((F.count(F.lit(1)) == 0).alias("bottom_most")))  # one row
    return inputs.crossJoin(none).select("number", "level", (F.col("at") + 1).alias("output_level"), "bottom_most")


def pick_tiered(files: DataFrame, min_run: int, ratio: float = 1.5) -> DataFrame:
    """number, bytes, output_level (0), bottom_most of the files that the next size-tiered compaction merges; none if it is idle.

    In order of size (ties: number), a bucket grows while the next file is within ``ratio`` of its average, rounded down, or
    that is 0; the first bucket that ends with ``min_run`` files is merged. It is bottom-most if it holds all files. The walk
    reads one row for each size on the driver, a few at a time; files of one size are taken together.
    """
    start = end = None  # (bytes, place among the files of that size)
    n = total = files_seen = 0
    done = False
    for size, count in files.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).orderBy("bytes").toLocalIterator():
        files_seen += count
        place = 0
        while place < count and not done:
            average = total // n if n else size
            if n and average and not average / ratio <= size <= average * ratio:
                if n >= min_run:
                    done = True
                    break
                n = total = 0
            if not n:
                start = (size, place)
            # once the average is positive, more files of the size that it just took in stay similar
            take = count - place if size == 0 or (n == 0 or average) else 1
            n, total, place = n + take, total + take * size, place + take
            end = (size, place - 1)
    if n < min_run:
        return files.select("number", "bytes", F.lit(0).alias("output_level"), F.lit(False).alias("bottom_most")).limit(0)
    chosen = files.where((F.col("bytes") >= start[0]) & (F.col("bytes") <= end[0]))
    edge = Window.partitionBy("bytes").orderBy("number")
    if chosen.count() != n:  # a bucket that begins or ends among files of one size
        chosen = chosen.withColumn("place", F.row_number().over(edge) - 1)
        chosen = chosen.where(((F.col("bytes") > start[0]) | (F.col("place") >= start[1])) & ((F.col("bytes") < end[0]) | (F.col("place") <= end[1])))
    return chosen.select("number", "bytes", F.lit(0).alias("output_level"), F.lit(n == files_seen).alias("bottom_most"))
