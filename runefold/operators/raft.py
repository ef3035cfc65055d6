"""Replicated-log analysis over raftlog rows (node, idx, term)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def commit_index(matches: DataFrame, group: str, quorum: int) -> DataFrame:
    """Largest index that ``quorum`` nodes of each group have reached: the quorum-th largest match."""
    w = Window.partitionBy(group).orderBy(F.desc("match"), "node")
    return matches.withColumn("r", F.row_number().over(w)).where(F.col("r") == quorum).select(group, F.col("match").alias("commit"))


def guarded_commit(matches: DataFrame, log: DataFrame, group: str, quorum: int, term: int, before: DataFrame | None = None) -> DataFrame:
    """Commit index with the term guard: only an entry of the leader's own term commits by counting, and it never falls.

    ``before`` has each group's commit so far (column ``before``); without it, 0.
    """
    at = commit_index(matches, group, quorum).join(log, F.col("commit") == F.col("idx"), "left")
    at = at.withColumn("before", F.lit(0)) if before is None else at.join(before, group, "left")
    reached = F.when(F.col("term") == term, F.col("commit")).otherwise(F.lit(0))
    return at.select(group, F.greatest(F.coalesce("before", F.lit(0)), reached).alias("commit"))


def quorum(nodes: int) -> int:
    return nodes // 2 + 1


def agreement(leader: DataFrame, followers: DataFrame) -> DataFrame:
    """Follower entries beside the leader's: node, idx, term, lead_term, differs. What the leader does not have yet is no conflict."""
    lead = leader.select("idx", F.col("term").alias("lead_term"))
    return followers.join(lead, "idx", "left").select("node", "idx", "term", "lead_term", F.coalesce(F.col("term") != F.col("lead_term"), F.lit(False)).alias("differs"))


def first_conflict(leader: DataFrame, followers: DataFrame) -> DataFrame:
    """node, idx of the first entry that differs from the leader's."""
    return agreement(leader, followers).where("differs").groupBy("node").agg(F.min("idx").alias("conflict"))


def match_index(leader: DataFrame, followers: DataFrame) -> DataFrame:
    """Length of the prefix that each follower shares with the leader: one aggregation, no running sum."""
    ends = agreement(leader, followers).groupBy("node").agg(
        F.min(F.when(F.col("differs"), F.col("idx"))).alias("bad"), F.max(F.when(F.col("lead_term").isNotNull(), F.col("idx"))).alias("last")
    )
    return ends.select("node", F.coalesce(F.col("bad") - 1, F.col("last"), F.lit(0)).alias("match"))


def conflict_hint(followers: DataFrame, probes: DataFrame) -> DataFrame:
    """node, prev, conflict_term, conflict_index of the probes (node, prev, prev_term) that followers reject.

    A log that ends before ``prev`` answers term 0 and the index after its end; one with another term there answers that
    term and the first index of the term's run.
    """
    ends = followers.groupBy("node").agg(F.max("idx").alias("last"))
    at = followers.select("node", F.col("idx").alias("prev"), F.col("term").alias("own"))
    asked = probes.join(F.broadcast(ends), "node").join(at, ["node", "prev"], "left").where("own is null or own <> prev_term")
    # terms never fall along a log, so a term's first index is its run's
    terms = followers.join(F.broadcast(asked.select("node", F.col("own").alias("term")).distinct()), ["node", "term"], "left_semi").groupBy("node", "term").agg(F.min("idx").alias("hint"))
    out = asked.join(terms.withColumnRenamed("term", "own"), ["node", "own"], "left")
    return out.select("node", "prev", F.coalesce("own", F.lit(0)).alias("conflict_term"), F.coalesce("hint", F.col("last") + 1).alias("conflict_index"))


def merged(leader: DataFrame, followers: DataFrame) -> DataFrame:
    """Follower logs after they take the leader's entries.

    A log is cut only at its first entry of another term; without one it keeps all it has, even past the leader's end.
    """
    ends = agreement(leader, followers).groupBy("node").agg(F.min(F.when(F.col("differs"), F.col("idx"))).alias("bad"), F.max("idx").alias("last"))
    ends = F.broadcast(ends.select("node", F.coalesce(F.col("bad"), F.col("last") + 1).alias("cut")))  # a row a node
    kept = followers.join(ends, "node").where("idx < cut").select("node", "idx", "term")
    taken = leader.join(ends, F.col("idx") >= F.col("cut")).select("node", "idx", "term")
    return kept.union(taken)


def outcomes(proposals: DataFrame, log: DataFrame, applied: int, offset: int = 0) -> DataFrame:
    """Adds outcome to proposals (idx, term) waiting at a node that has ``applied`` entries, the first ``offset`` of them compacted.

    ok: applied in the term it was proposed in; ErrProposalLost: another entry took its place, or it is compacted away;
    ErrProposeTimeout: not applied.
    """
    at = proposals.join(log.select("idx", F.col("term").alias("__own")), "idx", "left")
    kept = F.coalesce((F.col("idx") >= offset) & (F.col("term") == F.col("__own")), F.lit(False))
    out = F.when(F.col("idx") > applied, "ErrProposeTimeout").when(kept, "ok").otherwise("ErrProposalLost")
    return at.withColumn("outcome", out).drop("__own")


def batches(log: DataFrame, size: int) -> DataFrame:
    return log.withColumn("batch", F.expr(f"(idx - 1) div {size}")).groupBy("batch").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count(F.lit(1)).alias("n"))


def votes(ballots: DataFrame, nodes: int) -> DataFrame:
    """term, candidate, votes, elected by majority."""
    tally = ballots.groupBy("term", "candidate").agg(F.count_distinct("voter").alias("votes"))
    return tally.withColumn("elected", F.col("votes") * 2 > nodes)


def two_leaders(leaders: DataFrame) -> DataFrame:
    """Terms with more than one leader: must be empty."""
    return leaders.groupBy("term").agg(F.count_distinct("node").alias("leaders")).where("leaders > 1")


#: Entries that a task of ``log_matching`` holds, about.
TASK = 500_000


def log_matching(logs: DataFrame, block: int = 4096, entries: int | None = None) -> DataFrame:
    """Indexes and terms that two logs share although an earlier entry differs: must be empty.

    Each entry carries the sum of the hashes up to it; equal (idx, term) must have one sum. Sums of blocks of indexes come
    first, so no window holds more than a block, or a row a block. The blocks are dealt once over tasks, as many as there are
    entries for (``entries``, about; they are counted if it is not given), and all nodes' entries of a block meet in one.
    """
    parts = max(logs.sparkSession.sparkContext.defaultParallelism, (logs.count() if entries is None else entries) // TASK + 1)
    steps = logs.select("node", "idx", "term", F.xxhash64("idx", "term").cast("decimal(38,0)").alias("h"), F.expr(f"idx div {block}").alias("b")).repartition(parts, "b")
    sums = steps.groupBy("node", "b").agg(F.sum("h").alias("whole"))
    before = F.sum("whole").over(Window.partitionBy("node").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    sums = F.broadcast(sums.select("node", "b", F.coalesce(before, F.lit(0).cast("decimal(38,0)")).alias("before")))  # a row a block and node
    within = F.sum("h").over(Window.partitionBy("node", "b").orderBy("idx"))
    steps = steps.withColumn("within", within).join(sums, ["node", "b"]).withColumn("prefix", F.col("before") + F.col("within"))
    return steps.groupBy("b", "idx", "term").agg(F.count_distinct("prefix").alias("prefixes")).where("prefixes > 1").drop("b")


def up_to_date(term: str, idx: str, own_term: str, own_idx: str) -> Column:
    """Whether a log that ends at (idx, term) is at least as new as one's own: the term decides, then the length."""
    return F.struct(F.col(term), F.col(idx)) >= F.struct(F.col(own_term), F.col(own_idx))


def grants(requests: DataFrame) -> DataFrame:
    """Adds granted to vote requests (term, candidate, last_term, last_idx, own_term, voted_for, own_last_term, own_last_idx).

    A stale term is denied; a newer term clears the vote already given; a log behind one's own is denied.
    """
    free = (F.col("term") > F.col("own_term")) | F.col("voted_for").isNull() | (F.col("voted_for") == F.col("candidate"))
    newer = up_to_date("last_term", "last_idx", "own_last_term", "own_last_idx")
    return requests.withColumn("granted", (F.col("term") >= F.col("own_term")) & free & newer)


def next_batches(log: DataFrame, follower: DataFrame, entries: int, size: int) -> DataFrame:
    """node, first, last, n, bytes of the next batch for each follower (node, match) from a log (idx, bytes).

    It ends at ``entries`` or before the total passes ``size``; the first entry always goes. Only the ``entries`` that
    can be in a batch are joined, so that the running sum is over a bounded group.
    """
    wanted = follower.select("node", F.explode(F.sequence(F.col("match") + 1, F.col("match") + entries)).alias("idx"))
    w = Window.partitionBy("node").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.join(wanted, "idx").withColumn("total", F.sum("bytes").over(w)).withColumn("before", F.col("total") - F.col("bytes"))
    sent = rows.where((F.col("total") <= size) | (F.col("before") == 0))
    return sent.groupBy("node").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


def follower_commit(messages: DataFrame) -> DataFrame:
    """Adds new_commit to append messages (commit, leader_commit, prev, n): no further than what they confirm, never back."""
    return messages.withColumn("new_commit", F.greatest("commit", F.least(F.col("leader_commit"), F.col("prev") + F.col("n"))))


def snapshot_plan(follower: DataFrame, threshold: int, offset: Column) -> DataFrame:
    """node, snapshots, needs_snapshot: how many a follower took itself, and whether its next entry is compacted away."""
    return follower.select("node", F.floor(F.col("match") / threshold).alias("snapshots"), (F.col("match") < offset).alias("needs_snapshot"))


def compacted(log: DataFrame, node_offsets: DataFrame) -> DataFrame:
    """Entries after each node's snapshot offset; node_offsets has a row a node and is broadcast."""
    return log.join(F.broadcast(node_offsets), "node").where("idx > offset").select("node", "idx", "term")


def gaps(log: DataFrame) -> DataFrame:
    """node, missing: entries absent between a log's first and last, found without ordering it; must be empty."""
    spans = log.groupBy("node").agg(F.min("idx").alias("a"), F.max("idx").alias("b"), F.count_distinct("idx").alias("n"))
    return spans.select("node", (F.col("b") - F.col("a") + 1 - F.col("n")).alias("missing")).where("missing > 0")


def divergent(logs: DataFrame) -> DataFrame:
    """idx, terms of the entries on which nodes differ: must be empty for committed ones."""
    return logs.groupBy("idx").agg(F.count_distinct("term").alias("terms")).where("terms > 1")
