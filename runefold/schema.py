"""Canonical schemas, and the derivation of log-structured data from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPLOG = "seq long, op string, k string, v string, run int"
HISTORY = "key string, op_id long, kind string, ok boolean, start_ns long, end_ns long, arg string, found boolean, data string"
FILE = "number long, level int, min_key string, max_key string"
RAFT_LOG = "node int, idx long, term long"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts and deletes of ``events`` in eight contiguous runs; ``error`` events are tombstones."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    top = e.agg((F.max("event_id") + 1).alias("top"))  # one row
    dead = F.col("event_type") == "error"
    return e.crossJoin(F.broadcast(top)).select(
        F.col("event_id").alias("seq"),
        F.when(dead, "delete").otherwise("put").alias("op"),
        F.concat(F.lit("u"), F.col("user_id")).alias("k"),
        F.when(~dead, F.concat(F.lit("v"), F.col("event_id"))).alias("v"),
        F.expr("int(event_id * 8 div top)").alias("run"),
    )


def leader_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("idx"), F.expr("1 + o_orderkey div 1000").alias("term"))


def follower_logs(spark: SparkSession, sf_dir: str, followers: int = 4) -> DataFrame:
    """Each node stops short by 137 entries times its number and has a stale term on its tail; one more node is 50 entries ahead."""
    log = leader_log(spark, sf_dir)
    n = F.broadcast(log.agg(F.count(F.lit(1)).alias("n"), F.max("term").alias("top")))  # one row
    nodes = log.join(n).withColumn("node", F.explode(F.sequence(F.lit(1), F.lit(followers + 1))))
    ahead = nodes.where(F.col("node") == followers + 1)
    nodes = nodes.where(F.col("node") <= followers).where("idx <= n - node * 137")
    nodes = nodes.select("node", "idx", F.expr("if(idx > n - node * 300, term - 1, term)").alias("term"))
    extra = spark.range(1, 51).join(n).select(F.lit(followers + 1).alias("node"), F.expr("n + id").alias("idx"), F.col("top").alias("term"))
    return nodes.unionByName(ahead.select("node", "idx", "term")).unionByName(extra)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register operations of ``events``: id, k, kind, s(tart), e(nd); writes of a key are in order of id."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 40).alias("k"),
        F.expr("case when event_id % 3 = 0 then 'put' when event_id % 3 = 2 and event_id % 2 = 0 then 'delete' else 'get' end").alias("kind"),
        F.expr("10 * event_id").alias("s"),
        F.expr("10 * event_id + (7919 * event_id) % 50").alias("e"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key ranges of runs, for overlap queries: a file for each order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("number"),
        F.expr("int(o_custkey % 4)").alias("level"),
        F.expr("lpad(string(o_custkey), 8, '0')").alias("min_key"),
        F.expr("lpad(string(o_custkey + o_orderkey % 50), 8, '0')").alias("max_key"),
    )


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version edits: a file added for each order, an earlier one deleted by every third."""
    return table(spark, sf_dir, "orders").select(
        F.expr("o_orderkey div 10").alias("edit_no"), F.col("o_orderkey").alias("added"), F.expr("if(o_orderkey % 3 = 0, o_orderkey - 15, null)").alias("deleted")
    )
