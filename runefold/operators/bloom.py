"""Membership filters: block-free Bloom filters as (run, word, bits) rows, with md5 double hashing.

Bit positions come from two halves of one md5, so any SQL engine can rebuild them. Ten bits a key and seven hashes
give about one false positive in a hundred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY, HASHES, WORD = 10, 7, 32


def _hashes(df: DataFrame) -> DataFrame:
    h = F.md5(F.col("k"))
    part = lambda a: F.conv(F.substring(h, a, 8), 16, 10).cast("long")
    return df.withColumns({"h1": part(1), "h2": part(9)})


def _bits(df: DataFrame) -> DataFrame:
    """A row for each of a key's bit positions in a filter of ``m`` bits."""
    rows = _hashes(df).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(HASHES - 1))))
    return rows.withColumn("bit", F.expr("(h1 + i * h2) % m"))


def sizes(entries: DataFrame) -> DataFrame:
    """run, m: filter size in bits, by the number of its distinct keys."""
    return entries.groupBy("run").agg((F.count_distinct("k") * BITS_PER_KEY).alias("m"))


def build(entries: DataFrame) -> DataFrame:
    """run, m, word, bits of the filter of each run."""
    keys = entries.select("run", "k").distinct().join(sizes(entries), "run")
    bits = _bits(keys).select("run", "m", F.expr(f"bit div {WORD}").alias("word"), F.expr(f"shiftleft(1L, int(bit % {WORD}))").alias("b"))
    return bits.groupBy("run", "m", "word").agg(F.bit_or("b").alias("bits"))


def probe(filters: DataFrame, keys: DataFrame) -> DataFrame:
    """run, k, may_contain of each key against each run."""
    runs = filters.select("run", "m").distinct()
    asked = _bits(keys.crossJoin(F.broadcast(runs))).select("run", "k", F.expr(f"bit div {WORD}").alias("word"), F.expr(f"shiftleft(1L, int(bit % {WORD}))").alias("b"))
    found = asked.join(filters.select("run", "word", "bits"), ["run", "word"], "left")
    return found.groupBy("run", "k").agg(F.min((F.coalesce("bits", F.lit(0)).bitwiseAND(F.col("b")) != 0).cast("int")).cast("boolean").alias("may_contain"))
