"""Fault replay and test reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs


def torn_prefix(log: DataFrame, torn_at: int) -> DataFrame:
    """Operations that survive if the log is torn in the record with seq ``torn_at``: all before it."""
    return log.where(F.col("seq") < torn_at)


def test_matrix(events: DataFrame) -> DataFrame:
    """suite, test, status, events of test events (suite, test, pos, action): the last pass, fail or skip counts; missing if there is none."""
    ended = F.col("action").isin("pass", "fail", "skip")
    last = events.groupBy("suite", "test").agg(F.max_by(F.when(ended, F.col("action")), F.when(ended, F.col("pos"))).alias("status"), F.count(F.lit(1)).alias("events"))
    return last.select("suite", "test", F.coalesce("status", F.lit("missing")).alias("status"), "events")


def tail(trace: DataFrame, n: int) -> DataFrame:
    """The last n operations: a top-n report."""
    return trace.orderBy(F.desc("seq")).limit(n)


def append_with_fault(target: int, kind: str, calls: int) -> bytes:
    """What is left of a log of ``calls`` records whose file fails at call ``target`` and loses all after it; a torn write keeps half a record."""
    file = b"".join(codecs.encode("put", f"k{call}".encode(), b"v") for call in range(1, min(target, calls + 1)))
    raw = codecs.encode("put", f"k{target}".encode(), b"v")
    return file + raw[: len(raw) // 2] if kind == "TornWrite" and target <= calls else file


def survivors(target: pd.Series, kind: pd.Series, calls: int, seen: dict) -> list[int]:
    """Records that recovery keeps under each schedule; ``seen`` holds those played already, at most one for each call and kind."""
    out = []
    for schedule in zip(target, kind):
        if schedule not in seen:
            seen[schedule] = len(codecs.decode(append_with_fault(*schedule, calls)))
        out.append(seen[schedule])
    return out
