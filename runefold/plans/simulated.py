"""Queries over simulated clusters, a run for each nation's key as seed, and over fault schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..operators import faults, linearize
from ..simulation import cluster, random
from .registry import register

_SEEDS = "SELECT n_nationkey::BIGINT AS seed FROM nation"


def seeds(spark, sf_dir):
    """Seeds spread over tasks: a run takes a tenth of a second."""
    return schema.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("seed")).repartition(8, "seed")


def _of(spark, sf_dir, name):
    return cluster.tables(seeds(spark, sf_dir), name)


def _none(spark, sf_dir, found, name="violations"):
    """seed, violations: rows of ``found`` a seed, 0 where there are none."""
    counts = found.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    return schema.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("seed")).join(counts, "seed", "left").select("seed", F.coalesce("n", F.lit(0)).alias(name))


_CLEAN = f"SELECT seed, 0::BIGINT AS violations FROM ({_SEEDS})"
_CAUGHT = f"SELECT seed, true AS caught FROM ({_SEEDS})"


def two_leaders(leaders):
    return leaders.groupBy("seed", "term").agg(F.count_distinct("node").alias("n")).where("n > 1")


def unstable(committed):
    return committed.groupBy("seed", "idx").agg(F.count_distinct("term").alias("n")).where("n > 1")


def apart(logs):
    """Entries on which the logs of a run differ where they overlap."""
    return logs.groupBy("seed", "idx").agg(F.count_distinct("term").alias("n")).where("n > 1")


def unmatched(logs):
    """seed, node, other: pairs of logs that share an entry after one that they do not. Nodes are few, so pairs at an index are."""
    one = logs.select("seed", "node", "idx", "term").distinct()
    pairs = one.join(one.select("seed", F.col("node").alias("other"), "idx", F.col("term").alias("t")), ["seed", "idx"]).where("node < other")
    same = F.col("term") == F.col("t")
    ends = pairs.groupBy("seed", "node", "other").agg(F.min(F.when(~same, F.col("idx"))).alias("apart"), F.max(F.when(same, F.col("idx"))).alias("again"))
    return ends.where("again > apart").select("seed", "node", "other")


def over_caps(trace, entries=8, size=512):
    return trace.where((F.col("entries") > entries) | (F.col("bytes") > size) & (F.col("entries") > 1))


def lost(acked, committed):
    """Acknowledged writes that no node has committed."""
    return acked.join(committed.select("seed", "idx").distinct(), ["seed", "idx"], "left_anti")


def diverged(status):
    return status.groupBy("seed").agg(F.count_distinct("last", "applied", "state").alias("n")).where("n > 1")


def _register(name, check, inputs, damage):
    """The check on runs as they are, which finds nothing, and on damaged ones, which it must catch for every seed."""
    register(f"sim_{name}", _CLEAN)(lambda spark, sf_dir: _none(spark, sf_dir, check(*[_of(spark, sf_dir, t) for t in inputs])))

    def damaged(spark, sf_dir):
        rows = [_of(spark, sf_dir, t) for t in inputs]
        return _none(spark, sf_dir, check(damage(rows[0]), *rows[1:])).select("seed", (F.col("violations") > 0).alias("caught"))

    register(f"sim_caught_{name}", _CAUGHT)(damaged)


_register("one_leader_per_term", two_leaders, ["leaders"], lambda t: t.union(t.withColumn("node", F.col("node") + 1)))
_register("committed_stable", unstable, ["committed"], lambda t: t.withColumn("term", F.expr("if(node = 3 and idx % 10 = 0, term + 1, term)")))
_register("logs_identical", apart, ["logs"], lambda t: t.withColumn("term", F.expr("if(node = 2, term + 1, term)")))
_register("log_matching", unmatched, ["committed"], lambda t: t.withColumn("term", F.expr("if(node = 2 and idx < 40, 0, term)")))
_register("batch_caps", over_caps, ["trace"], lambda t: t.withColumn("entries", F.col("entries") * 9))
_register("acked_survive", lost, ["acked", "committed"], lambda t: t.withColumn("idx", F.col("idx") + 1_000_000))
_register("convergence", diverged, ["status"], lambda t: t.withColumn("state", F.expr("if(node = 4, '{}', state)")))


def _history(spark, sf_dir):
    rows = _of(spark, sf_dir, "history")
    return rows.withColumn("key", F.concat_ws("/", "seed", "key"))


def _bad_seeds(history):
    checked = linearize.check(history.drop("seed")).where("not ok")
    return checked.select(F.split("key", "/")[0].cast("long").alias("seed"))


@register("sim_linearizable", _CLEAN)
def _linearizable(spark, sf_dir):
    return _none(spark, sf_dir, _bad_seeds(_history(spark, sf_dir)))


@register("sim_caught_stale_cache", _CAUGHT)
def _stale_cache(spark, sf_dir):
    """Reads answered from a cache that is never refreshed after a key's first value: caught for every seed."""
    from pyspark.sql import Window

    rows = _history(spark, sf_dir)
    first = F.first(F.when((F.col("kind") == "put") & F.col("ok"), F.col("arg")), True).over(Window.partitionBy("key"))
    stale = rows.withColumn("first", first).withColumns({"data": F.expr("if(kind = 'get', first, data)"), "found": F.expr("if(kind = 'get', first is not null, found)")})
    return _none(spark, sf_dir, _bad_seeds(stale.drop("first"))).select("seed", (F.col("violations") > 0).alias("caught"))


@register("sim_workload_mix", f"SELECT seed, true AS all_kinds, 4::BIGINT AS keys, true AS unique_puts, true AS some_unknown FROM ({_SEEDS})")
def _mix(spark, sf_dir):
    """What the clients did: all kinds about equally often, unique values, some outcomes unknown after a leader was killed."""
    h = _of(spark, sf_dir, "history")
    share = lambda kind: F.count_if(F.col("kind") == kind) / F.count(F.lit(1))
    out = h.groupBy("seed").agg(
        F.least(share("put"), share("delete"), share("get")).alias("least"), F.count_distinct("key").alias("keys"),
        (F.count_distinct("arg") == F.count("arg")).alias("unique_puts"), (F.count_if(~F.col("ok")) > 0).alias("some_unknown"),
    )
    return out.select("seed", (F.col("least") > 0.2).alias("all_kinds"), "keys", "unique_puts", "some_unknown")


@register("sim_status", f"SELECT seed, 5::BIGINT AS nodes, 1::BIGINT AS leaders, 4::BIGINT AS followers, true AS all_applied, true AS hints_agree FROM ({_SEEDS})")
def _status(spark, sf_dir):
    s = _of(spark, sf_dir, "status")
    return s.groupBy("seed").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("role") == "leader").alias("leaders"), F.count_if(F.col("role") == "follower").alias("followers"),
        F.bool_and(F.col("applied") == F.col("commit")).alias("all_applied"), (F.count_distinct("leader") == 1).alias("hints_agree"),
    )


@register("sim_trace_tail", f"SELECT seed, 300::BIGINT AS kept, 300::BIGINT AS span, true AS told FROM ({_SEEDS})")
def _trace_tail(spark, sf_dir):
    """The last messages of each run, as many as a trace keeps, each with a line on what it said."""
    t = _of(spark, sf_dir, "trace")
    last = t.groupBy("seed").agg(F.max("seq").alias("top"))
    kept = t.join(F.broadcast(last), "seed").where(F.col("seq") > F.col("top") - cluster.TRACE_KEPT)
    said = F.col("detail").rlike("^(RequestVote|granted|heartbeat|AppendEntries|success|rejected|InstallSnapshot)")
    return kept.groupBy("seed").agg(F.count(F.lit(1)).alias("kept"), (F.max("seq") - F.min("seq") + 1).alias("span"), F.bool_and(said).alias("told"))


@register("sim_snapshots_installed", f"SELECT seed, true AS sent, true AS below_log FROM ({_SEEDS})")
def _snapshots(spark, sf_dir):
    """Followers that fell behind the leader's log were caught up by snapshots; all logs begin after a snapshot at the end."""
    sent = _of(spark, sf_dir, "trace").groupBy("seed").agg((F.count_if(F.col("type") == "snap") > 0).alias("sent"))
    return sent.join(_of(spark, sf_dir, "status").groupBy("seed").agg((F.min("offset") > 0).alias("below_log")), "seed")


@register("sim_leader_found", f"SELECT seed, start::BIGINT AS start, true AS found, true AS in_time FROM ({_SEEDS}), range(1, 6) t(start)")
def _found(spark, sf_dir):
    """The leader that a client finds from each node by hints, after the old leader was killed."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = []
            for seed in pdf["seed"].tolist():
                for start in range(1, 6):
                    c = cluster.Cluster(seed)
                    while c.leader() is None:
                        c.tick()
                    c.crash(c.leader())
                    node, took = cluster.find_leader(c, start)
                    rows.append((seed, start, node is not None and node == c.leader(), took <= 30))
            yield pd.DataFrame(rows, columns=["seed", "start", "found", "in_time"])

    return seeds(spark, sf_dir).mapInPandas(run, "seed long, start long, found boolean, in_time boolean")


@register("client_status_codes", "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 200 WHEN 4 THEN 400 ELSE 503 END::INTEGER AS status, CASE WHEN o_orderkey % 5 IN (1, 2, 3) THEN o_custkey % 5 END AS leader FROM orders")
def _codes(spark, sf_dir):
    """What clients are told: 200, 503 with the leader where another try may help, 400 for a request that is wrong."""
    o = schema.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.expr("element_at(array('ok', 'ErrNotLeader', 'ErrProposalLost', 'ErrProposeTimeout', 'BadRequest'), int(o_orderkey % 5) + 1)").alias("outcome"),
        F.expr("o_custkey % 5").alias("hint"),
    )
    again = F.col("outcome").isin("ErrNotLeader", "ErrProposalLost", "ErrProposeTimeout")
    return o.select("id", F.when(F.col("outcome") == "ok", 200).when(again, 503).otherwise(400).alias("status"), F.when(again, F.col("hint")).alias("leader"))


@register("node_config_errors", "SELECT o_orderkey AS id, NOT (o_orderkey % 7 = 0 OR o_orderkey % 7 > 5 OR o_custkey % 4 = 0 OR o_custkey % 4 >= o_custkey % 9) AS valid FROM orders")
def _configs(spark, sf_dir):
    """Whether settings (node of five, heartbeat, election) are accepted."""
    import pandas as pd

    from ..simulation.replica import Config

    def valid(node: int, heartbeat: int, election: int) -> bool:
        try:
            Config(node, (1, 2, 3, 4, 5), election, heartbeat).check()
        except ValueError:
            return False
        return True

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "valid": [valid(*v) for v in zip(pdf["node"], pdf["heartbeat"], pdf["election"])]})

    rows = schema.table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "o_orderkey % 7 as node", "o_custkey % 4 as heartbeat", "o_custkey % 9 as election")
    return rows.mapInPandas(run, "id long, valid boolean")


_MIX = "WITH s AS (SELECT o_orderkey AS id, ((o_custkey::UHUGEINT + 3 * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT) AS z FROM orders), a AS (SELECT id, (xor(z, z // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM s), b AS (SELECT id, (xor(z, z // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM a)"


@register("splitmix_numbers", _MIX + " SELECT id, xor(z, z // 2147483648::UHUGEINT)::VARCHAR AS third, (xor(z, z // 2147483648::UHUGEINT) % 30)::BIGINT AS below FROM b")
def _splitmix(spark, sf_dir):
    """The third number of each seed's stream, and below 30."""
    import pandas as pd

    def third(seed: int) -> int:
        stream = random.SplitMix(seed)
        return [stream.next() for _ in range(3)][-1]

    def run(batches):
        for pdf in batches:
            made = [third(s) for s in pdf["seed"].tolist()]
            yield pd.DataFrame({"id": pdf["id"], "third": [str(x) for x in made], "below": [x % 30 for x in made]})

    rows = schema.table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "o_custkey as seed")
    return rows.mapInPandas(run, "id long, third string, below long")


@register("fault_schedules", "SELECT o_orderkey AS seed, 1 + o_orderkey % 30 AS target, CASE WHEN o_orderkey % 2 = 0 THEN 'TornWrite' ELSE 'Fail' END AS kind, o_orderkey % 30 AS survivors FROM orders")
def _schedules(spark, sf_dir):
    """Thirty records appended through a file that fails once, at the seed's target, and loses all after it; what recovery keeps."""
    import pandas as pd

    def run(batches):
        seen = {}  # a schedule's outcome depends on its target and kind alone: each is played once a task
        for pdf in batches:
            target, kind = 1 + pdf["seed"] % 30, (pdf["seed"] % 2).map({0: "TornWrite", 1: "Fail"})
            yield pd.DataFrame({"seed": pdf["seed"], "target": target, "kind": kind, "survivors": faults.survivors(target, kind, 30, seen)})

    rows = schema.table(spark, sf_dir, "orders").selectExpr("o_orderkey as seed")
    return rows.mapInPandas(run, "seed long, target long, kind string, survivors long")
