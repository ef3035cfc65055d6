"""Linearizability of register histories: necessary checks in SQL form, and the full search for each key."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESULT = "key string, ok boolean, operations long"


def stale_reads(writes: DataFrame, gets: DataFrame) -> DataFrame:
    """Gets (k, id, obs) of a put that a later write had replaced before the get began.

    For each observed put only the earliest end of a write that began after it matters: a running minimum over a key's
    writes and put ends in falling order of time, no join of writes with writes.
    """
    seen = gets.join(writes.where("kind = 'put'").select("k", F.col("id").alias("obs"), F.col("e").alias("pe")), ["k", "obs"])
    puts = seen.select("k", "obs", F.col("pe").alias("at"), F.lit(None).cast("long").alias("ne")).distinct()
    rows = writes.select("k", F.lit(None).cast("long").alias("obs"), F.col("s").alias("at"), F.col("e").alias("ne")).unionByName(puts)
    # the range ends before the put's own time: a write must begin after it
    later = Window.partitionBy("k").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -1)
    first = rows.withColumn("first", F.min("ne").over(later)).where("obs is not null and first is not null").select("k", "obs", "first")
    return seen.join(first, ["k", "obs"]).where("first < s").select("k", "id").distinct()


def future_reads(writes: DataFrame, gets: DataFrame) -> DataFrame:
    """Gets of a put that began after the get had ended."""
    puts = writes.where("kind = 'put'").select("k", F.col("id").alias("obs"), F.col("s").alias("ps"))
    return gets.join(puts, ["k", "obs"]).where("e < ps").select("k", "id").distinct()


def unwritten_reads(writes: DataFrame, gets: DataFrame) -> DataFrame:
    puts = writes.where("kind = 'put'").select("k", F.col("id").alias("obs"))
    return gets.where("obs is not null").join(puts, ["k", "obs"], "left_anti").select("k", "id")


def check_register(ops: list[tuple], unknown_end: str = "recorded") -> bool:
    """Whether operations (kind, ok, start, end, arg, found, data) of one register have a linear order.

    Depth-first over sets of placed operations with memory: an operation may come next if it starts before every
    unplaced one has ended. Writes of unknown outcome may be left out; unknown reads say nothing. Such a write, if it took
    effect, did so before its recorded end, or with ``unknown_end="open"`` at any time after its start.
    """
    todo = sorted((o for o in ops if o[1] or o[0] != "get"), key=lambda o: (o[2], o[3]))
    n = len(todo)
    must = [i for i in range(n) if todo[i][1]]
    ends = [o[3] if o[1] or unknown_end == "recorded" else float("inf") for o in todo]
    # state: first unplaced operation, places beyond it that are taken, register value
    start = (0, 0, None)
    seen, stack = {start}, [start]
    while stack:
        low, mask, value = stack.pop()
        while low < n and mask & 1:
            low, mask = low + 1, mask >> 1
        if not any(not mask >> (must[j] - low) & 1 for j in range(bisect_left(must, low), len(must))):
            return True
        limit, i = float("inf"), low
        choices = []
        while i < n and todo[i][2] <= limit:
            if not mask >> (i - low) & 1:
                choices.append(i)
                limit = min(limit, ends[i])
            i += 1
        for i in choices:
            kind, known, begin, _, arg, found, data = todo[i]
            if begin > limit:
                continue
            after = arg if kind == "put" else None if kind == "delete" else value
            steps = []
            if kind != "get" or (value is not None) == bool(found) and (not found or value == data):
                steps.append(after)
            if not known:
                steps.append(value)  # it never took effect
            for new in steps:
                state = (low, mask | 1 << (i - low), new)
                a, m = state[0], state[1]
                while m & 1:
                    a, m = a + 1, m >> 1
                state = (a, m, new)
                if state not in seen:
                    seen.add(state)
                    stack.append(state)
    return not must


def check(history: DataFrame, unknown_end: str = "recorded") -> DataFrame:
    """key, ok, operations: keys are independent, so each is searched in a task of its own. Unknown reads stay out of the shuffle."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = ["kind", "ok", "start_ns", "end_ns", "arg", "found", "data"]
        rows = [tuple(None if pd.isna(v) else v for v in r) for r in pdf[columns].itertuples(index=False)]
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "ok": [check_register(rows, unknown_end)], "operations": [len(rows)]})

    return history.groupBy("key").applyInPandas(one, RESULT)


def dump(history: DataFrame, keys: DataFrame, clock: str = "HH:mm:ss.SSSSSS") -> DataFrame:
    """key, line number, line: the operations of ``keys`` by start, one a line, as one reads them to see why no order exists.

    Times are ns since the epoch, shown in UTC to the microsecond.
    """
    time = lambda c: F.date_format(F.timestamp_micros(F.floor(F.col(c) / 1000)), clock)
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    what = (
        F.when(F.col("kind") == "put", F.rpad(F.concat(F.lit("PUT   arg="), quoted("arg")), 32, " "))
        .when(F.col("kind") == "delete", F.rpad(F.lit("DELETE"), 32, " "))
        .otherwise(F.rpad(F.concat(F.lit("GET   result="), F.when(F.col("found"), quoted("data")).otherwise("absent")), 32, " "))
    )
    outcome = F.when(F.col("ok"), "(ok)").otherwise("(UNKNOWN)")
    rows = history.join(keys.select("key").distinct(), "key", "left_semi")
    place = F.row_number().over(Window.partitionBy("key").orderBy("start_ns", "op_id"))  # a key that fails is read by a person
    line = F.concat(F.lit("["), time("start_ns"), F.lit(" .. "), time("end_ns"), F.lit("] "), what, F.lit(" "), outcome)
    return rows.select("key", place.alias("n"), line.alias("line"))
