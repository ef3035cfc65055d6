"""The registered queries over the driver tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import codecs
from ..operators import bloom, faults, fold, linearize, manifest, raft
from .registry import ORACLE_SQL, QUERIES, register  # noqa: F401

OPLOG = """WITH oplog AS (
  SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, 'u' || user_id AS k,
    CASE WHEN event_type <> 'error' THEN 'v' || event_id END AS v, (event_id * 8 // (SELECT max(event_id) + 1 FROM events))::INTEGER AS run
  FROM events),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM oplog) WHERE rn = 1)
"""
RAFT = """WITH leader AS (SELECT o_orderkey + 1 AS idx, 1 + o_orderkey // 1000 AS term FROM orders), total AS (SELECT count(*) AS n FROM orders),
followers AS (
  SELECT node::INTEGER AS node, idx, CASE WHEN idx > n - node * 300 THEN term - 1 ELSE term END AS term
  FROM leader, total, (SELECT unnest([1, 2, 3, 4]) AS node) WHERE idx <= n - node * 137
  UNION ALL SELECT 5, idx, term FROM leader UNION ALL SELECT 5, n + i, (SELECT max(term) FROM leader) FROM total, range(1, 51) t(i)),
conflicts AS (SELECT f.node, min(f.idx) AS conflict FROM followers f JOIN leader l USING (idx) WHERE f.term <> l.term GROUP BY f.node),
lasts AS (SELECT node, max(idx) AS last FROM followers GROUP BY node),
cuts AS (SELECT node, coalesce(conflict, last + 1) AS cut FROM lasts LEFT JOIN conflicts USING (node)),
ends AS (SELECT node, coalesce(conflict - 1, least(last, n)) AS match FROM lasts LEFT JOIN conflicts USING (node), total),
merged AS (SELECT node, idx, term FROM followers JOIN cuts USING (node) WHERE idx < cut UNION ALL SELECT node, l.idx, l.term FROM cuts JOIN leader l ON l.idx >= cut)
"""
HISTORY = """WITH h AS (
  SELECT event_id AS id, user_id % 40 AS k, 10 * event_id AS s, 10 * event_id + (7919 * event_id) % 50 AS e,
    CASE WHEN event_id % 3 = 0 THEN 'put' WHEN event_id % 3 = 2 AND event_id % 2 = 0 THEN 'delete' ELSE 'get' END AS kind FROM events),
w AS (SELECT * FROM h WHERE kind <> 'get'), wl AS (SELECT *, lag(id) OVER (PARTITION BY k ORDER BY id) AS prev FROM w),
g AS (SELECT h.*, (SELECT CASE WHEN h.id % 97 < 5 THEN arg_max(wl.prev, wl.id) ELSE max(wl.id) END FROM wl WHERE wl.k = h.k AND wl.id < h.id) AS obs FROM h WHERE kind = 'get')
"""
FILES = """WITH RECURSIVE f AS (SELECT o_orderkey AS number, (o_custkey % 4)::INTEGER AS level, lpad(o_custkey::VARCHAR, 8, '0') AS min_key,
  lpad((o_custkey + o_orderkey % 50)::VARCHAR, 8, '0') AS max_key FROM orders)
"""


def simple(name: str, make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A query over the op log."""
    register(name, OPLOG + sql)(lambda spark, sf_dir: make(schema.oplog(spark, sf_dir)))


simple("kv_live_view", fold.live, "SELECT k, v FROM newest WHERE op = 'put'")
simple("kv_live_count", lambda log: fold.live(log).agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM newest WHERE op = 'put'")
simple("kv_point_get", lambda log: fold.get(log, "u7"), "SELECT 'u7' AS k, v IS NOT NULL AS found, v FROM (SELECT 1) LEFT JOIN (SELECT v FROM newest WHERE op = 'put' AND k = 'u7') ON true")
simple("kv_point_get_deleted", lambda log: fold.get(log, "u8"), "SELECT 'u8' AS k, v IS NOT NULL AS found, v FROM (SELECT 1) LEFT JOIN (SELECT v FROM newest WHERE op = 'put' AND k = 'u8') ON true")
simple(
    "kv_multi_get",
    lambda log: fold.multi_get(log, log.sparkSession.range(0, 400, 7).select(F.concat(F.lit("u"), F.col("id")).alias("k"))),
    "SELECT a.k, CASE op WHEN 'put' THEN 'live' WHEN 'delete' THEN 'deleted' ELSE 'unknown' END AS state, v FROM (SELECT 'u' || i AS k FROM range(0, 400, 7) t(i)) a LEFT JOIN newest USING (k)",
)
simple("kv_as_of_version", lambda log: fold.as_of(log, F.col("run") <= 3), "SELECT k, arg_max(coalesce(v, ''), seq) AS v FROM oplog WHERE run <= 3 GROUP BY k HAVING arg_max(op, seq) = 'put'")
simple("kv_tombstones", fold.tombstones, "SELECT k, seq FROM newest WHERE op = 'delete'")
simple("kv_version_history", fold.versions, "SELECT k, seq, op, v, lag(v) OVER w AS before, lag(op) OVER w AS op_before FROM oplog WINDOW w AS (PARTITION BY k ORDER BY seq)")
_RUNS = "FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM oplog WHERE run BETWEEN 2 AND 5) WHERE r = 1"
simple("merge_carry", lambda log: fold.merge(log.where("run between 2 and 5"), False), f"SELECT k, seq, op, v {_RUNS}")
simple("merge_bottom", lambda log: fold.merge(log.where("run between 2 and 5"), True), f"SELECT k, seq, op, v {_RUNS} AND op = 'put'")
simple(
    "run_metadata", fold.run_metadata,
    "SELECT run, count(*) AS entries, min(k) AS min_key, max(k) AS max_key, max(seq) AS max_seq, sum((op = 'delete')::INT)::BIGINT AS tombstones, sum(length(k) + coalesce(length(v), 0))::BIGINT AS bytes FROM oplog GROUP BY run",
)
#: Boundaries by recursion over generations: each ends with the first entry whose running size reaches the threshold.
_FLUSH = OPLOG.replace("WITH oplog", "WITH RECURSIVE oplog") + """, sized AS (SELECT seq, sum(length(k) + CASE WHEN op = 'delete' THEN 1 ELSE length(v) END + 64) OVER (ORDER BY seq) AS total FROM oplog),
ends AS (SELECT 0::BIGINT AS generation, (SELECT min(seq) FROM sized WHERE total >= 4096) AS last, (SELECT min(total) FROM sized WHERE total >= 4096) AS base
  UNION ALL SELECT generation + 1, (SELECT min(seq) FROM sized WHERE total >= base + 4096), (SELECT min(total) FROM sized WHERE total >= base + 4096) FROM ends WHERE last IS NOT NULL)
SELECT seq, (SELECT min(generation) FROM ends WHERE last >= seq OR last IS NULL) AS generation FROM sized"""
register("flush_generations", _FLUSH)(lambda spark, sf_dir: fold.flush_generations(schema.oplog(spark, sf_dir), 4096))
simple("fault_torn_prefix", lambda log: fold.live(faults.torn_prefix(log, 777)), "SELECT k, arg_max(coalesce(v, ''), seq) AS v FROM oplog WHERE seq < 777 GROUP BY k HAVING arg_max(op, seq) = 'put'")
simple("trace_tail", lambda log: faults.tail(log.select("seq", "op", "k"), 50), "SELECT seq, op, k FROM oplog ORDER BY seq DESC LIMIT 50")

_BLOOM = """, ks AS (SELECT DISTINCT run, k FROM oplog), m AS (SELECT run, count(*) * 10 AS m FROM ks GROUP BY run),
pos AS (SELECT run, k, m, (('0x' || substr(md5(k), 1, 8))::BIGINT + i * ('0x' || substr(md5(k), 9, 8))::BIGINT) % m AS bit FROM ks JOIN m USING (run), range(7) t(i)),
words AS (SELECT run, m, bit // 32 AS word, bit_or(1::BIGINT << (bit % 32)::INT) AS bits FROM pos GROUP BY run, m, word)
"""
simple("bloom_build", bloom.build, _BLOOM + "SELECT run, m, word, bits FROM words")
_ASKED = """, asked AS (SELECT 'u' || i AS k FROM range(0, 400, 7) t(i)),
ap AS (SELECT run, k, (('0x' || substr(md5(k), 1, 8))::BIGINT + i * ('0x' || substr(md5(k), 9, 8))::BIGINT) % m AS bit FROM asked, m, range(7) t(i)),
hit AS (SELECT ap.run, ap.k, bool_and(coalesce(bits, 0) & (1::BIGINT << (bit % 32)::INT) <> 0) AS may_contain FROM ap LEFT JOIN words w ON w.run = ap.run AND w.word = bit // 32 GROUP BY ALL)
"""


def _probe(log: DataFrame) -> DataFrame:
    return bloom.probe(bloom.build(log), log.sparkSession.range(0, 400, 7).select(F.concat(F.lit("u"), F.col("id")).alias("k")))


simple("bloom_probe", _probe, _BLOOM + _ASKED + "SELECT run, k, may_contain FROM hit")
simple(
    "bloom_skip_report", lambda log: _probe(log).groupBy("k").agg(F.sum(F.col("may_contain").cast("int")).alias("runs_read"), F.sum((~F.col("may_contain")).cast("int")).alias("runs_skipped")),
    _BLOOM + _ASKED + "SELECT k, sum(may_contain::INT)::BIGINT AS runs_read, sum((NOT may_contain)::INT)::BIGINT AS runs_skipped FROM hit GROUP BY k",
)


@register("manifest_live_set", "WITH e AS (SELECT o_orderkey // 10 AS edit_no, o_orderkey AS added, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - 15 END AS deleted FROM orders) SELECT added AS number, edit_no FROM e a WHERE NOT EXISTS (SELECT 1 FROM e d WHERE d.deleted = a.added AND d.edit_no > a.edit_no)")
def _live_set(spark, sf_dir):
    return manifest.live_files(schema.edits(spark, sf_dir))


@register("manifest_orphans", "SELECT o_orderkey AS number FROM orders WHERE o_orderkey + 15 IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) AND (o_orderkey + 15) // 10 > o_orderkey // 10")
def _orphans(spark, sf_dir):
    edits = schema.edits(spark, sf_dir)
    return manifest.orphans(edits.select(F.col("added").alias("number")), manifest.live_files(edits).select("number"))


register("compaction_overlap", FILES + "SELECT a.number AS upper, b.number AS lower, a.level FROM f a JOIN f b ON b.level = a.level + 1 AND a.min_key <= b.max_key AND b.min_key <= a.max_key")(
    lambda spark, sf_dir: manifest.overlaps(schema.files(spark, sf_dir))
)
register("compaction_bottom_most", FILES + ", covered AS (SELECT DISTINCT a.number FROM f a JOIN f b ON b.level > a.level AND a.min_key <= b.max_key AND b.min_key <= a.max_key) SELECT number, level, covered.number IS NULL AS bottom_most FROM f LEFT JOIN covered USING (number)")(
    lambda spark, sf_dir: manifest.bottom_most(schema.files(spark, sf_dir))
)
#: The lowest level that is full (level 0 with 4 files, others with more than 4); of a level from 1 down the file of least key
#: goes, with the next level's files in its range; bottom-most if no file further down is in the range of all of them.
_LEVELED = """, full_at AS (SELECT min(level) AS lv FROM (SELECT level, count(*) AS n FROM f GROUP BY level) WHERE level = 0 AND n >= 4 OR level > 0 AND n > 4),
prim AS (SELECT * FROM f, full_at WHERE level = lv AND (lv = 0 OR number = (SELECT arg_min(number, (min_key, number)) FROM f, full_at WHERE level = lv))),
ins AS (SELECT number, level, min_key, max_key, lv FROM prim UNION ALL
  SELECT f.number, f.level, f.min_key, f.max_key, lv FROM f, full_at WHERE f.level = lv + 1 AND f.min_key <= (SELECT max(max_key) FROM prim) AND f.max_key >= (SELECT min(min_key) FROM prim))
SELECT number, level, (lv + 1)::INTEGER AS output_level,
  NOT EXISTS (SELECT 1 FROM f, full_at WHERE f.level > lv + 1 AND f.min_key <= (SELECT max(max_key) FROM ins) AND f.max_key >= (SELECT min(min_key) FROM ins)) AS bottom_most FROM ins"""
#: The walk over rising sizes, a step a size: files of one size are alike. The average is rounded down.
_TIERED = """, sized AS (SELECT number, (number % 97 + 1)::BIGINT AS bytes FROM f),
steps AS (SELECT bytes, count(*) AS c, row_number() OVER (ORDER BY bytes) AS r FROM sized GROUP BY bytes),
walk AS (SELECT 0::BIGINT AS r, 0::BIGINT AS n, 0::BIGINT AS total, 0::BIGINT AS lo, 0::BIGINT AS hi, false AS done
  UNION ALL SELECT s.r, CASE WHEN e.ends THEN w.n WHEN e.alike THEN w.n + s.c ELSE s.c END, (CASE WHEN e.ends THEN w.total WHEN e.alike THEN w.total + s.c * s.bytes ELSE s.c * s.bytes END)::BIGINT,
    CASE WHEN e.ends OR e.alike AND w.n > 0 THEN w.lo ELSE s.bytes END, CASE WHEN e.ends THEN w.hi ELSE s.bytes END, e.ends
  FROM walk w JOIN steps s ON s.r = w.r + 1, LATERAL (SELECT w.n = 0 OR w.total // greatest(w.n, 1) = 0 OR (s.bytes <= w.total // greatest(w.n, 1) * 1.5 AND s.bytes >= (w.total // greatest(w.n, 1)) / 1.5) AS alike) a,
    LATERAL (SELECT a.alike, NOT a.alike AND w.n >= 200 AS ends) e WHERE NOT w.done),
chosen AS (SELECT n, lo, hi FROM walk ORDER BY done DESC, r DESC LIMIT 1)
SELECT number, bytes, 0::INTEGER AS output_level, n = (SELECT count(*) FROM f) AS bottom_most FROM sized, chosen WHERE n >= 200 AND bytes BETWEEN lo AND hi"""
register("compaction_pick_leveled", FILES + _LEVELED)(lambda spark, sf_dir: manifest.pick_leveled(schema.files(spark, sf_dir), 4))
register("compaction_pick_promoted", FILES.replace("FROM orders)", "FROM orders WHERE o_custkey % 4 > 0)") + _LEVELED)(
    lambda spark, sf_dir: manifest.pick_leveled(schema.files(spark, sf_dir).where("level > 0"), 4)
)
register("compaction_pick_tiered", FILES + _TIERED)(
    lambda spark, sf_dir: manifest.pick_tiered(schema.files(spark, sf_dir).select("number", F.expr("number % 97 + 1").alias("bytes")), 200)
)
register("compaction_levels_overlap", FILES + ", pairs AS (SELECT a.level, a.number AS a, b.number AS b, b.min_key, b.max_key, a.max_key AS reach FROM f a JOIN f b ON a.level = b.level AND a.level >= 1 AND (a.min_key, a.number) < (b.min_key, b.number)), best AS (SELECT level, arg_max(a, (reach, a)) AS a, b, max(reach) AS reach, any_value(min_key) AS min_key FROM pairs GROUP BY level, b) SELECT level, a, b FROM best WHERE reach >= min_key")(
    lambda spark, sf_dir: manifest.levels_overlap(schema.files(spark, sf_dir))
)
register("sparse_index_seek", OPLOG + ", b AS (SELECT k AS first_key, (rn2 - 1) // 16 AS block FROM (SELECT k, row_number() OVER (ORDER BY k) AS rn2 FROM newest) WHERE (rn2 - 1) % 16 = 0) SELECT n.k, max(b.first_key) AS first_key FROM newest n JOIN b ON b.first_key <= n.k GROUP BY n.k")(
    lambda spark, sf_dir: _seek(fold.newest(schema.oplog(spark, sf_dir)))
)


def _seek(run: DataFrame) -> DataFrame:
    """Block of each key in a sorted run with every sixteenth key indexed: an as-of lookup by a running maximum.

    A run is one file of bounded size, so it is ordered in one task.
    """
    from pyspark.sql import Window

    w = Window.orderBy("k")
    rows = run.select("k", F.row_number().over(w).alias("r"))
    marked = rows.withColumn("mark", F.when((F.col("r") - 1) % 16 == 0, F.col("k")))
    return marked.select("k", F.last("mark", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("first_key"))


def _matches(spark, sf_dir):
    o = schema.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.withColumn("node", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("match", F.expr("(o_custkey * node) % 97"))


_MATCH = "WITH m AS (SELECT o_orderkey, node, (o_custkey * node) % 97 AS match FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS node)), c AS (SELECT o_orderkey, match AS commit FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY match DESC) AS r FROM m) WHERE r = 3)"
register("raft_commit_index", _MATCH + " SELECT * FROM c")(lambda spark, sf_dir: raft.commit_index(_matches(spark, sf_dir), "o_orderkey", 3))
register("raft_commit_guarded", _MATCH + " SELECT o_orderkey, greatest(o_custkey % 50, CASE WHEN commit BETWEEN 1 AND 1000 AND commit <= (SELECT max(o_orderkey) + 1 FROM orders) THEN commit ELSE 0 END) AS commit FROM c JOIN orders USING (o_orderkey)")(
    lambda spark, sf_dir: raft.guarded_commit(
        _matches(spark, sf_dir), schema.leader_log(spark, sf_dir), "o_orderkey", raft.quorum(5), 1, schema.table(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_custkey % 50").alias("before"))
    )
)
register("raft_first_conflict", RAFT + "SELECT node, conflict FROM conflicts")(lambda spark, sf_dir: raft.first_conflict(schema.leader_log(spark, sf_dir), schema.follower_logs(spark, sf_dir)))
register("raft_match_index", RAFT + "SELECT node, match FROM ends")(lambda spark, sf_dir: raft.match_index(schema.leader_log(spark, sf_dir), schema.follower_logs(spark, sf_dir)))
_PROBES = ", probes AS (SELECT node, prev, term AS prev_term FROM (SELECT node, n AS prev FROM lasts, total UNION ALL SELECT node, n - 200 * node FROM lasts, total) p JOIN leader ON idx = prev)"
register("raft_conflict_hint", RAFT + _PROBES + " SELECT p.node, prev, coalesce(f.term, 0) AS conflict_term, coalesce((SELECT min(idx) FROM followers g WHERE g.node = p.node AND g.term = f.term), last + 1) AS conflict_index FROM probes p JOIN lasts USING (node) LEFT JOIN followers f ON f.node = p.node AND f.idx = prev WHERE f.term IS NULL OR f.term <> prev_term")(
    lambda spark, sf_dir: raft.conflict_hint(schema.follower_logs(spark, sf_dir), _probes(spark, sf_dir))
)


def _probes(spark, sf_dir):
    """Probes at the leader's end and a bit before it."""
    log = schema.leader_log(spark, sf_dir)
    n = log.agg(F.count(F.lit(1)).alias("n"))
    nodes = spark.range(1, 6).select(F.col("id").cast("int").alias("node")).join(F.broadcast(n))
    at = nodes.select("node", F.explode(F.expr("array(n, n - 200 * node)")).alias("prev"))
    return log.join(F.broadcast(at), F.col("idx") == F.col("prev")).select("node", "prev", F.col("term").alias("prev_term"))


register("raft_merge_result", RAFT + "SELECT node, idx, term FROM merged")(lambda spark, sf_dir: raft.merged(schema.leader_log(spark, sf_dir), schema.follower_logs(spark, sf_dir)))
register("raft_apply_committed", OPLOG + "SELECT k, arg_max(coalesce(v, ''), seq) AS v FROM oplog WHERE seq + 1 <= (SELECT count(*) * 3 // 4 FROM events) GROUP BY k HAVING arg_max(op, seq) = 'put'")(
    lambda spark, sf_dir: _applied(spark, sf_dir)
)


def _applied(spark, sf_dir):
    log = schema.oplog(spark, sf_dir)
    commit = F.broadcast(log.agg(F.expr("count(1) * 3 div 4").alias("commit")))  # one row
    return fold.live(log.crossJoin(commit).where("seq + 1 <= commit"))


register("raft_batches", RAFT + "SELECT (idx - 1) // 64 AS batch, min(idx) AS first, max(idx) AS last, count(*) AS n FROM leader GROUP BY ALL")(lambda spark, sf_dir: raft.batches(schema.leader_log(spark, sf_dir), 64))


def _ballots(spark, sf_dir):
    return schema.table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 7").alias("term"), F.expr("o_custkey % 3").alias("candidate"), F.expr("o_orderkey % 7").alias("voter"))


_BALLOTS = "WITH b AS (SELECT o_orderkey // 7 AS term, o_custkey % 3 AS candidate, o_orderkey % 7 AS voter FROM orders), t AS (SELECT term, candidate, count(DISTINCT voter) AS votes, count(DISTINCT voter) * 2 > 7 AS elected FROM b GROUP BY ALL)"
register("raft_vote_tally", _BALLOTS + " SELECT * FROM t")(lambda spark, sf_dir: raft.votes(_ballots(spark, sf_dir), 7))
register("raft_invariant_leader_per_term", _BALLOTS + " SELECT term, count(*) AS leaders FROM t WHERE elected GROUP BY term HAVING count(*) > 1")(
    lambda spark, sf_dir: raft.two_leaders(raft.votes(_ballots(spark, sf_dir), 7).where("elected").select("term", F.col("candidate").alias("node")))
)
register("raft_invariant_log_matching", RAFT + ", r AS (SELECT idx, term, sum(hash(idx * 1000003 + term)) OVER (PARTITION BY node ORDER BY idx) AS h FROM merged) SELECT idx, term, count(DISTINCT h) AS prefixes FROM r GROUP BY ALL HAVING count(DISTINCT h) > 1")(
    lambda spark, sf_dir: raft.log_matching(raft.merged(*_logs(spark, sf_dir)), entries=6 * schema.leader_log(spark, sf_dir).count())
)
register("raft_proposal_outcome", RAFT + "SELECT l.idx, CASE WHEN l.idx > n - 400 THEN 'ErrProposeTimeout' WHEN l.idx >= 500 AND f.term = l.term THEN 'ok' ELSE 'ErrProposalLost' END AS outcome FROM leader l JOIN total ON true LEFT JOIN followers f ON f.idx = l.idx AND f.node = 2")(
    lambda spark, sf_dir: _outcomes(spark, sf_dir)
)


def _outcomes(spark, sf_dir):
    """What clients of node 2 learn of the leader's proposals; its first 499 entries are compacted away, its last 400 not applied."""
    log = schema.leader_log(spark, sf_dir)
    return raft.outcomes(log, schema.follower_logs(spark, sf_dir).where("node = 2"), log.count() - 400, 500).select("idx", "outcome")


register("raft_violated_log_matching", RAFT + ", bad AS (SELECT node, idx, CASE WHEN idx = 1000 * node THEN 0 ELSE term END AS term FROM followers WHERE node < 3), r AS (SELECT idx, term, sum(hash(idx * 1000003 + term)) OVER (PARTITION BY node ORDER BY idx) AS h FROM bad) SELECT idx, term, count(DISTINCT h) AS prefixes FROM r GROUP BY ALL HAVING count(DISTINCT h) > 1")(
    lambda spark, sf_dir: raft.log_matching(schema.follower_logs(spark, sf_dir).where("node < 3").withColumn("term", F.expr("if(idx = 1000 * node, 0, term)")))
)
register("raft_violated_leader_per_term", "WITH b AS (SELECT o_orderkey // 100 AS term, o_custkey % 3 AS candidate FROM orders) SELECT term, count(DISTINCT candidate) AS leaders FROM b GROUP BY term HAVING count(DISTINCT candidate) > 1")(
    lambda spark, sf_dir: raft.two_leaders(schema.table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 100").alias("term"), F.expr("o_custkey % 3").alias("node")))
)


def _logs(spark, sf_dir):
    return schema.leader_log(spark, sf_dir), schema.follower_logs(spark, sf_dir)


register("raft_divergent_entries", RAFT + "SELECT idx, count(DISTINCT term) AS terms FROM (SELECT idx, term FROM followers UNION ALL SELECT idx, term FROM leader) GROUP BY idx HAVING count(DISTINCT term) > 1")(
    lambda spark, sf_dir: raft.divergent(schema.follower_logs(spark, sf_dir).select("idx", "term").union(schema.leader_log(spark, sf_dir)))
)
register("raft_invariant_logs_identical", RAFT + "SELECT idx, count(DISTINCT term) AS terms FROM merged GROUP BY idx HAVING count(DISTINCT term) > 1")(
    lambda spark, sf_dir: raft.divergent(raft.merged(*_logs(spark, sf_dir)))
)
register("raft_invariant_committed_stable", RAFT + ", seen AS (SELECT f.idx, f.term FROM followers f JOIN ends USING (node) WHERE f.idx <= match UNION ALL SELECT idx, term FROM leader) SELECT idx, count(DISTINCT term) AS terms FROM seen GROUP BY idx HAVING count(DISTINCT term) > 1")(
    lambda spark, sf_dir: _committed_stable(*_logs(spark, sf_dir))
)
register("raft_log_gaps", "SELECT o_custkey AS node, max(o_orderkey) - min(o_orderkey) + 1 - count(DISTINCT o_orderkey) AS missing FROM orders GROUP BY o_custkey HAVING missing > 0")(
    lambda spark, sf_dir: raft.gaps(schema.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("idx")))
)
register("raft_compacted_log", RAFT + "SELECT f.node, f.idx, f.term FROM followers f JOIN ends USING (node) WHERE f.idx > match // 100 * 100")(
    lambda spark, sf_dir: raft.compacted(schema.follower_logs(spark, sf_dir), raft.match_index(*_logs(spark, sf_dir)).select("node", F.expr("match div 100 * 100").alias("offset")))
)
register("raft_snapshot_plan", RAFT + "SELECT node, match // 100 AS snapshots, match < 14500 AS needs_snapshot FROM ends")(
    lambda spark, sf_dir: raft.snapshot_plan(raft.match_index(*_logs(spark, sf_dir)), 100, F.lit(14500))
)
register("raft_next_batches", RAFT + ", e AS (SELECT o_orderkey + 1 AS idx, length(o_orderpriority) + 20 AS bytes FROM orders), b AS (SELECT node, e.idx, bytes, sum(bytes) OVER (PARTITION BY node ORDER BY e.idx) AS total, row_number() OVER (PARTITION BY node ORDER BY e.idx) AS r FROM ends JOIN e ON e.idx > match) SELECT node, min(idx) AS first, max(idx) AS last, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM b WHERE r <= 64 AND (total <= 1500 OR r = 1) GROUP BY node")(
    lambda spark, sf_dir: raft.next_batches(
        schema.table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("idx"), (F.length("o_orderpriority") + 20).alias("bytes")), raft.match_index(*_logs(spark, sf_dir)), 64, 1500
    )
)
register("raft_follower_commit", "SELECT o_orderkey, node, CASE WHEN bound > match THEN bound ELSE match END AS new_commit FROM (SELECT o_orderkey, node, (o_custkey * node) % 97 AS match, CASE WHEN o_custkey % 89 < o_orderkey % 80 + node THEN o_custkey % 89 ELSE o_orderkey % 80 + node END AS bound FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS node))")(
    lambda spark, sf_dir: raft.follower_commit(
        _matches(spark, sf_dir).select("o_orderkey", "node", F.col("match").alias("commit"), F.expr("o_custkey % 89").alias("leader_commit"), F.expr("o_orderkey % 80").alias("prev"), F.col("node").alias("n"))
    ).select("o_orderkey", "node", "new_commit")
)
_REQUEST = {
    "term": "o_orderkey % 5", "candidate": "o_custkey % 3", "last_term": "o_custkey % 4", "last_idx": "o_orderkey % 11", "own_term": "o_custkey % 5",
    "voted_for": "CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 3 END", "own_last_term": "o_orderkey % 4", "own_last_idx": "o_custkey % 13",
}
register(
    "raft_vote_grants",
    f"SELECT o_orderkey, CASE WHEN term < own_term THEN false WHEN term = own_term AND voted_for IS NOT NULL AND voted_for <> candidate THEN false WHEN last_term <> own_last_term THEN last_term > own_last_term ELSE last_idx >= own_last_idx END AS granted FROM (SELECT o_orderkey, {', '.join(f'{v} AS {k}' for k, v in _REQUEST.items())} FROM orders)",
)(lambda spark, sf_dir: raft.grants(schema.table(spark, sf_dir, "orders").select("o_orderkey", *[F.expr(v).alias(k) for k, v in _REQUEST.items()])).select("o_orderkey", "granted"))


def _committed_stable(leader, followers):
    """What followers have of their agreed prefix, beside the leader's log."""
    at = raft.match_index(leader, followers)  # a row a node is broadcast
    agreed = followers.join(F.broadcast(at), "node").where("idx <= match").select("idx", "term")
    return raft.divergent(agreed.union(leader.select("idx", "term")))


def _history(spark, sf_dir):
    """Writes, and gets with the write each observed: the last one before it, or for corrupted gets the one before that."""
    from pyspark.sql import Window

    h = schema.history(spark, sf_dir)
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    wid = F.when(F.col("kind") != "get", F.col("id"))
    rows = h.withColumn("last", F.last(wid, True).over(w))
    # a write's predecessor, carried forward to the gets that follow the write
    prev = F.last(F.when(F.col("kind") != "get", F.struct(F.col("last").alias("p"))), True).over(w)
    rows = rows.withColumn("obs", F.when(F.col("id") % 97 < 5, prev["p"]).otherwise(F.col("last")))
    return h.where("kind <> 'get'"), rows.where("kind = 'get'").select("id", "k", "s", "e", "obs")


register("lin_stale_reads", HISTORY + "SELECT DISTINCT g.k, g.id FROM g JOIN w p ON p.k = g.k AND p.id = g.obs AND p.kind = 'put' JOIN w n ON n.k = g.k AND p.e < n.s AND n.e < g.s")(lambda spark, sf_dir: linearize.stale_reads(*_history(spark, sf_dir)))
register("lin_future_reads", HISTORY + "SELECT DISTINCT g.k, g.id FROM g JOIN w p ON p.k = g.k AND p.id = g.obs AND p.kind = 'put' WHERE g.e < p.s")(lambda spark, sf_dir: linearize.future_reads(*_history(spark, sf_dir)))
register("lin_unwritten_reads", HISTORY + "SELECT g.k, g.id FROM g WHERE obs IS NOT NULL AND NOT EXISTS (SELECT 1 FROM w WHERE w.k = g.k AND w.id = g.obs AND w.kind = 'put')")(lambda spark, sf_dir: linearize.unwritten_reads(*_history(spark, sf_dir)))
register("lin_history_stats", HISTORY + "SELECT k, count(*) AS operations, sum((kind = 'put')::INT)::BIGINT AS puts, max(e - s) AS longest FROM h GROUP BY k")(
    lambda spark, sf_dir: schema.history(spark, sf_dir).groupBy("k").agg(F.count(F.lit(1)).alias("operations"), F.sum((F.col("kind") == "put").cast("int")).alias("puts"), F.max(F.expr("e - s")).alias("longest"))
)


register("lin_check", "SELECT (user_id % 40)::VARCHAR AS key, true AS ok, count(*) AS operations FROM events GROUP BY ALL")(lambda spark, sf_dir: linearize.check(_register_history(spark, sf_dir)))


_TORN = OPLOG + """SELECT 'seg' || (seq // 512) AS path, seq % 512 AS n, op, k, v FROM oplog
WHERE NOT ((seq // 512) % 3 = 0 AND (seq % 512 = 511 OR seq = (SELECT max(seq) FROM oplog)))"""


@register("wal_recover", _TORN)
def _wal_recover(spark, sf_dir):
    """Binary logs of 512 records, every third torn within its last record, and what recovery keeps of them."""
    logs = codecs.segments(schema.oplog(spark, sf_dir), 512)
    torn = F.expr("if(int(substr(path, 4)) % 3 = 0, substr(content, 1, length(content) - 1), content)")
    return codecs.recover(logs.withColumn("content", torn)).select("path", "n", "op", F.col("k").cast("string").alias("k"), F.col("v").cast("string").alias("v"))


@register("test_matrix", "WITH e AS (SELECT 's' || conv_id % 5 AS suite, 't' || conv_id AS test, turn, CASE turn % 4 WHEN 0 THEN 'run' WHEN 1 THEN 'pass' WHEN 2 THEN 'output' ELSE 'fail' END AS action FROM conversations) SELECT suite, test, coalesce(arg_max(action, turn) FILTER (action IN ('pass', 'fail', 'skip')), 'missing') AS status, count(*) AS events FROM e GROUP BY ALL")
def _test_matrix(spark, sf_dir):
    c = schema.table(spark, sf_dir, "conversations")
    action = F.expr("element_at(array('run', 'pass', 'output', 'fail'), int(turn % 4) + 1)").alias("action")
    return faults.test_matrix(c.select(F.expr("concat('s', conv_id % 5)").alias("suite"), F.expr("concat('t', conv_id)").alias("test"), F.col("turn").alias("pos"), action))


def _register_history(spark, sf_dir):
    """The history in which each operation takes effect at its start, as rows of the checker."""
    from pyspark.sql import Window

    h = schema.history(spark, sf_dir)
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") != "get", F.struct("kind", "id")), True).over(w)
    rows = h.withColumn("last", last).withColumn("found", F.coalesce(F.col("last.kind") == "put", F.lit(False)))
    return rows.select(
        F.col("k").cast("string").alias("key"), F.col("id").alias("op_id"), "kind", F.lit(True).alias("ok"), F.col("s").alias("start_ns"), F.col("e").alias("end_ns"),
        F.when(F.col("kind") == "put", F.col("id").cast("string")).alias("arg"), "found", F.when(F.col("found"), F.col("last.id").cast("string")).alias("data"),
    )


def _corrupted_history(spark, sf_dir):
    """Keys divisible by 4 read back a value that nobody wrote, once for each operation whose id is divisible by 50."""
    bad = F.expr("kind = 'get' and op_id % 50 = 1 and key % 4 = 0")
    return _register_history(spark, sf_dir).withColumns({"found": F.expr("found") | bad, "data": F.when(bad, "never").otherwise(F.col("data"))})


_BAD_KEYS = "SELECT DISTINCT user_id % 40 AS k FROM events WHERE event_id % 50 = 1 AND user_id % 4 = 0 AND NOT (event_id % 3 = 0 OR event_id % 3 = 2 AND event_id % 2 = 0)"
register("lin_check_corrupted", f"SELECT (user_id % 40)::VARCHAR AS key, user_id % 40 NOT IN ({_BAD_KEYS}) AS ok, count(*) AS operations FROM events GROUP BY ALL")(
    lambda spark, sf_dir: linearize.check(_corrupted_history(spark, sf_dir))
)
register(
    "lin_violation_dump",
    HISTORY + f""", o AS (SELECT h.id, h.k, h.kind, s, e, CASE WHEN h.id % 50 = 1 AND h.k % 4 = 0 THEN 'never' ELSE (SELECT CASE WHEN kind = 'put' THEN wl.id::VARCHAR END FROM wl WHERE wl.k = h.k AND wl.id < h.id ORDER BY wl.id DESC LIMIT 1) END AS seen
  FROM h WHERE k IN ({_BAD_KEYS})),
t AS (SELECT *, '[' || strftime(make_timestamp(s // 1000), '%H:%M:%S.%f') || ' .. ' || strftime(make_timestamp(e // 1000), '%H:%M:%S.%f') || '] ' AS span FROM o)
SELECT k::VARCHAR AS key, row_number() OVER (PARTITION BY k ORDER BY s, id)::INTEGER AS n, span || rpad(CASE kind WHEN 'put' THEN 'PUT   arg="' || id || '"' WHEN 'delete' THEN 'DELETE'
  ELSE 'GET   result=' || coalesce('"' || seen || '"', 'absent') END, 32, ' ') || ' (ok)' AS line FROM t""",
)(lambda spark, sf_dir: _dump(spark, sf_dir))


def _dump(spark, sf_dir):
    history = _corrupted_history(spark, sf_dir)
    return linearize.dump(history, linearize.check(history).where("not ok"))


simple("kv_ordered_scan", fold.ordered, "SELECT k, seq, op, v FROM newest")
simple("kv_is_empty", lambda log: fold.is_empty(log), "SELECT count(*) = 0 AS empty FROM newest WHERE op = 'put'")
simple(
    "kv_engine_stats", lambda log: fold.stats(log, F.col("run") >= 6),
    "SELECT count(DISTINCT run) FILTER (run < 6) AS sstables, coalesce(sum(length(k) + CASE WHEN op = 'delete' THEN 1 ELSE length(v) END + 64) FILTER (run >= 6), 0)::BIGINT AS approx_size, count(DISTINCT k) FILTER (run >= 6) AS memtable_len FROM oplog",
)
simple("memtable_sizes", lambda log: log.select("seq", fold.entry_size().alias("bytes")), "SELECT seq, (length(k) + CASE WHEN op = 'delete' THEN 1 ELSE length(v) END + 64)::BIGINT AS bytes FROM oplog")
simple("merge_interleaved", lambda log: fold.merge(log.where("run in (1, 6)"), True).orderBy("k"), "SELECT k, seq, op, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM oplog WHERE run IN (1, 6)) WHERE r = 1 AND op = 'put'")
simple("merge_of_nothing", lambda log: fold.merge(log.where("run < 0"), False), "SELECT k, seq, op, v FROM oplog WHERE run < 0")
