"""Shared pieces of the training-data operators: shared-folder tables and Arrow batch plumbing."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where a local session names none (tests) a temporary folder is made and set; a cluster must name one.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names the folder that the cluster shares")
        place = "file://" + tempfile.mkdtemp(prefix="runefold-shared-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_local = threading.local()


def _scratch() -> list[list[str]]:
    """The tables to be removed of each ``scratch`` that this thread is in."""
    if not hasattr(_local, "places"):
        _local.places = []
    return _local.places


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` writes inside are removed at the end; a result must be written with ``keep`` before."""
    _scratch().append([])
    try:
        yield
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for place in _scratch().pop():
            path(place).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path(place), True)


def stored(df: DataFrame, name: str, codec: str = "zstd", keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if _scratch() and not keep:
        _scratch()[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ids(df: DataFrame, name: str) -> DataFrame:
    """``stored`` for tables that are a few hundredths of the texts or sets that share the setting, in fewer files.

    Each file costs the executor that writes it a few processes where Hadoop sets permissions by ``chmod`` (``file:`` without
    native code), and a process that starts shows for a moment all of the JVM's memory as its own.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.coalesce(max(8, parts // 4)), name)


#: Rows up to which ``spread_join`` broadcasts.
BROADCAST_ROWS = 200_000


def spread_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equality join for keys of which one may hold a third of ``big``; ``small`` is stored and has few rows a key.

    A small side within ``BROADCAST_ROWS`` is broadcast, so the big one stays where it is. Beyond that both sides are dealt
    straight from tables, so adaptive execution can split a hot partition of the big side.
    """
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)
    bounds = bounds[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(bounds: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes; a longer row stands alone."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def give_back() -> None:
    """Return freed memory to the system: workers wait for the next task beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


@cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return None


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose tasks give their memory back at the end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


def map_text(
    df: DataFrame,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Rows of ``df`` (columns ``keep``; None: all) with ``fields`` computed from the text column.

    ``make`` builds the batch function once in each task. Rows keep their partition: no shuffle.
    """
    names = df.columns if keep is None else list(keep)
    if clash := {f.name.lower() for f in fields} & {n.lower() for n in names}:
        raise ValueError(f"columns {sorted(clash)} exist already: rename them or leave them out of keep")
    source = df.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{text}`").alias("__rf_text"))
    schema = T.StructType([*source.schema.fields[:-1], *fields])
    out_names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            made = work(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=out_names)
            del batch, made
            give_back()

    return map_arrow(source, run, schema)
