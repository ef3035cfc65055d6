"""Operator 7: chat formatting by quotation linking.

A line that begins with ``>`` signs (spaces may stand between them) is quoted, once for each sign. Runs of lines of
one level are passages; they, and each of their lines, are hashed after normalisation (lower case, letters and digits
only, single spaces). An author's own lines and whole messages are originals. Quoted passages of all levels are joined to the
earliest original of the conversation with that hash, if it is earlier than the quote. A message replies to the original that
most of its linked characters of the lowest level with a link come from (ties: the earliest): level 1 is what it answers; where
that text is unknown, a deeper level names the nearest ancestor that is known. Threads follow replies to their first message by
pointer doubling; a conversation is ordered by thread, then turn, so each message follows the one it replies to, and
``position`` counts its messages in that order from 0.

A hot conversation, thread or passage is no hot task: what is joined to has one row a key (``spread_join``), and positions
are counted within ranges of the sorted rows and carried over from range to range.

Defined results: a null text is empty; quotes of unknown text are cut but link nothing; without quotes a message
starts its own thread. Rows that repeat a conversation and turn are all returned, linked alike by that pair (what any of them
quotes counts for all) and in order of their text; null conversations or turns are never linked and have no position. Very
long texts are read whole. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, spread_join, stored

_QUOTE = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_WORD = re.compile(r"[\W_]+")


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes, and its passages as (level, text); level 0 is the author's own."""
    passages: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        found = _QUOTE.match(line)
        level = found[1].count(">") if found else 0
        rest = line[found.end() :] if found else line
        if not passages or passages[-1][0] != level:
            passages.append((level, []))
        passages[-1][1].append(rest)
    own = "\n".join("\n".join(lines).strip("\n") for level, lines in passages if level == 0).strip("\n")
    return own, [(level, "\n".join(lines)) for level, lines in passages]


def digest(passage: str) -> str | None:
    """Hash of a normalised passage; none if it has no letter or digit."""
    plain = _WORD.sub(" ", passage.lower()).strip()
    return hashlib.sha256(plain.encode()).hexdigest()[:32] if plain else None


_PASSAGE = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("digest", T.StringType()), T.StructField("size", T.LongType())])
_FIELDS = [
    T.StructField("clean", T.StringType(), False),
    T.StructField("quoted", T.ArrayType(_PASSAGE), False),
    T.StructField("own", T.ArrayType(T.StringType()), False),
    T.StructField("depth", T.IntegerType(), False),
]


def parsed(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    def one(text: str | None) -> tuple[str, list[dict], list[str], int]:
        own, passages = parse(text or "")
        quoted = []
        for level, body in passages:
            if level:
                for part in dict.fromkeys([body, *body.split("\n")]):
                    if key := digest(part):
                        quoted.append({"level": level, "digest": key, "size": len(part)})
        originals = [digest(x) for x in dict.fromkeys([own, *(b for lv, b in passages if not lv), *own.split("\n")])]
        return own, quoted, [x for x in dict.fromkeys(originals) if x], max(level for level, _ in passages)

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            rows = [one(x) for x in column.to_pylist()]
            kind = pa.list_(pa.struct([("level", pa.int32()), ("digest", pa.string()), ("size", pa.int64())]))
            kinds = (pa.string(), kind, pa.list_(pa.string()), pa.int32())
            return [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]

        return work

    return map_text(df, _FIELDS, make, text, keep)


def replies_of(known: DataFrame) -> DataFrame:
    """c, t, reply_to, level of the messages that quote an earlier one; stored."""
    # earliest author of each passage: one row a passage, however often it is repeated
    origin = known.select("c", "t", F.explode("own").alias("digest")).groupBy("c", "digest").agg(F.min("t").alias("origin"))
    quoted = known.select("c", "t", F.explode("quoted").alias("q")).select("c", "t", "q.level", "q.digest", "q.size").distinct()
    linked = spread_join(quoted, stored(origin, "origins"), ["c", "digest"]).where("origin < t")
    sizes = linked.groupBy("c", "t", "level", "origin").agg(F.sum("size").alias("size"))
    best = sizes.groupBy("c", "t").agg(F.max(F.struct((-F.col("level")).alias("near"), "size", (-F.col("origin")).alias("less"))).alias("b"))
    return stored(best.select("c", "t", (-F.col("b.less")).alias("reply_to"), (-F.col("b.near")).alias("level")), "replies")


def threads_of(replies: DataFrame) -> DataFrame:
    """c, t, thread (the first message that the replies lead to) of each message that replies; stored."""
    roots = replies.select("c", "t", F.col("reply_to").alias("thread"))
    while True:  # each round doubles the steps taken
        step = roots.select("c", F.col("t").alias("thread"), F.col("thread").alias("next"))
        jumped = spread_join(roots, step, ["c", "thread"], "left")
        jumped = stored(jumped.select("c", "t", F.coalesce("next", "thread").alias("thread"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = jumped.select("c", "t", "thread")
        if jumped.where("moved").isEmpty():
            return roots


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``position``: the place of each in its conversation c, by thread, t and text."""
    order = [F.asc_nulls_last("thread"), F.asc_nulls_last("t"), "clean"]  # what has no position comes last
    ranges = rows.repartitionByRange("c", *order).withColumn("part", F.spark_partition_id())
    ranges = stored(ranges, "ranges")
    counts = ranges.groupBy("c", "part").agg(F.count(F.lit(1)).alias("n"))  # at most a row a conversation and range
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("c", "part").orderBy(*order)) - 1
    out = ranges.withColumn("place", place).join(before.drop("n"), ["c", "part"], "left")
    return out.withColumn("position", F.when(F.col("c").isNotNull() & F.col("t").isNotNull(), F.col("before") + F.col("place")))


def conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text (without quotes), quotes, quote_depth, reply_to, reply_level, thread, position of each row."""
    rows = df.select(F.col(f"`{conv}`").alias("c"), F.col(f"`{turn}`").cast("long").alias("t"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    rows = stored(parsed(rows, "text", ["c", "t", "role"]), "messages")
    replies = replies_of(rows.where("c is not null and t is not null"))
    marks = stored(replies.join(threads_of(replies), ["c", "t"]), "marks")
    out = spread_join(rows, marks, ["c", "t"], "left").withColumn("thread", F.coalesce("thread", "t"))
    out = placed(out.select("c", "t", "role", "clean", F.size("quoted").alias("quotes"), "depth", "reply_to", "level", "thread"))
    return out.select(
        F.col("c").alias(conv), F.col("t").alias(turn), "role", F.col("clean").alias("text"), "quotes", F.col("depth").alias("quote_depth"),
        "reply_to", F.col("level").alias("reply_level"), "thread", "position",
    )


def ordered(df: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Rows of ``conversations`` in reading order, by a range-partitioned sort."""
    return df.orderBy(conv, "position")
