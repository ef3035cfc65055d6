"""Fixtures of the key-value, log and history semantics."""

import pytest
from pyspark.sql import functions as F

from runefold.functions import codecs
from runefold import schema
from runefold.operators import faults, fold, linearize, manifest, raft
from runefold.sources.store import Store
from runefold.streaming.apply import apply_stream

LOG = "seq long, op string, k string, v string"


def live(spark, *ops):
    rows = [(i, *o) for i, o in enumerate(ops)]
    return {r["k"]: r["v"] for r in fold.live(spark.createDataFrame(rows, LOG)).collect()}


def test_fold(spark):
    assert live(spark, ("put", "k", "1"), ("put", "k", "2")) == {"k": "2"}
    assert live(spark, ("put", "k", "1"), ("delete", "k", None)) == {}
    assert live(spark, ("delete", "k", None), ("put", "e", "")) == {"e": ""}
    assert live(spark, ("put", "k", "1"), ("delete", "k", None), ("put", "k", "back")) == {"k": "back"}
    assert live(spark) == {}


def test_merge_carries_or_drops_tombstones(spark):
    runs = spark.createDataFrame([(1, "put", "k", "old"), (2, "delete", "k", None)], LOG)
    assert fold.merge(runs, bottom=True).count() == 0
    assert [r["op"] for r in fold.merge(runs, bottom=False).collect()] == ["delete"]


def test_manifest(spark):
    e = spark.createDataFrame([(1, 1, None), (2, 2, None), (3, 3, 1), (3, None, 2)], "edit_no long, added long, deleted long")
    assert {r["number"] for r in manifest.live_files(e).collect()} == {3}


RANGES = [(i, i % 4, f"{37 * i % 900:08d}", f"{37 * i % 900 + i % 150:08d}") for i in range(120)]


def meets(a, b):
    return a[2] <= b[3] and b[2] <= a[3]


def test_files_are_all_orders_and_overlap_as_by_brute_force(spark, tmp_path):
    orders = [(i, 31 * i % 2000) for i in (0, 1999, 2000, 2001, 2002, 9000, 70_000)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert {r["number"] for r in schema.files(spark, str(tmp_path)).collect()} == {i for i, _ in orders}
    found = [tuple(r) for r in manifest.overlaps(spark.createDataFrame(RANGES, schema.FILE)).collect()]
    assert sorted(found) == sorted((a[0], b[0], a[1]) for a in RANGES for b in RANGES if b[1] == a[1] + 1 and meets(a, b))


def test_bottom_most_looks_at_each_deeper_file(spark):
    gap = [(1, 0, "00000100", "00000110"), (2, 1, "00000000", "00000010"), (3, 1, "00000900", "00000910"), (4, 3, "00000905", "00000906")]
    for files in (gap, RANGES):
        found = {r["number"]: r["bottom_most"] for r in manifest.bottom_most(spark.createDataFrame(files, schema.FILE)).collect()}
        assert found == {a[0]: not any(b[1] > a[1] and meets(a, b) for b in files) for a in files}


def leveled(files, trigger, budget):
    """The reference's rule, file by file: inputs, output level, bottom-most."""
    first = [f for f in files if f[1] == 0]
    level = 0
    if len(first) < trigger:
        over = [n for n in range(1, max(f[1] for f in files) + 1) if sum(f[1] == n for f in files) > budget]
        if not over:
            return None
        level = over[0]
        first = [min((f for f in files if f[1] == level), key=lambda f: (f[2], f[0]))]
    hull = lambda fs: (0, 0, min(f[2] for f in fs), max(f[3] for f in fs))
    inputs = first + [f for f in files if f[1] == level + 1 and meets(f, hull(first))]
    below = [f for f in files if f[1] > level + 1 and meets(f, hull(inputs))]
    return sorted(f[0] for f in inputs), level + 1, not below


def test_leveled_pick_is_the_references(spark):
    k = lambda number, level, low, high: (number, level, f"{low:08d}", f"{high:08d}")
    one = [k(10, 1, 10, 30), k(11, 1, 40, 60), k(12, 1, 70, 90), k(20, 2, 20, 20), k(21, 2, 260, 260)]
    deep = [k(10, 1, 10, 30), k(11, 1, 40, 60), k(30, 3, 20, 20)]
    for files, trigger, budget in ((one, 100, 2), (deep, 100, 1), (one, 100, 4), ([k(i, 0, i, i) for i in range(4)], 4, 4), (RANGES, 4, 4), (RANGES, 31, 4), (RANGES, 31, 30)):
        rows = manifest.pick_leveled(spark.createDataFrame(files, schema.FILE), trigger, budget).collect()
        found = (sorted(r["number"] for r in rows), rows[0]["output_level"], rows[0]["bottom_most"]) if rows else None
        assert found == leveled(files, trigger, budget)


def tiered(files, min_run, ratio):
    bucket, total = [], 0
    for number, size in sorted(files, key=lambda f: (f[1], f[0])):
        average = total // len(bucket) if bucket else size
        if bucket and average and not average / ratio <= size <= average * ratio:
            if len(bucket) >= min_run:
                break
            bucket, total = [], 0
        bucket.append(number)
        total += size
    return (sorted(bucket), len(bucket) == len(files)) if len(bucket) >= min_run else None


def test_tiered_pick_is_the_references(spark):
    sizes = ([10, 11, 12, 400], [0, 0, 0], [0, 0, 5, 5, 5, 5, 90], [0, 0, 0, 1, 1, 1, 1, 7, 7, 7, 7, 30], [1, 9, 9, 9, 10, 12, 14, 17, 20, 70], [1, 5, 30], [100] * 7 + [260] * 5)
    for some in sizes:
        files = [(3 * i % 31, size) for i, size in enumerate(some)]
        for min_run in (3, 4):
            rows = manifest.pick_tiered(spark.createDataFrame(files, "number long, bytes long"), min_run, 1.5).collect()
            found = (sorted(r["number"] for r in rows), rows[0]["bottom_most"]) if rows else None
            assert found == tiered(files, min_run, 1.5), (some, min_run)


def test_commit_and_conflicts(spark):
    m = spark.createDataFrame([("g", n, x) for n, x in enumerate([9, 7, 5, 3, 1])], "g string, node int, match long")
    assert raft.commit_index(m, "g", 3).first()["commit"] == 5
    leader = spark.createDataFrame([(1, 1), (2, 5), (3, 5)], "idx long, term long")
    follower = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 2), (1, 4, 2)], "node int, idx long, term long")
    assert raft.first_conflict(leader, follower).first()["conflict"] == 2
    assert raft.match_index(leader, follower).first()["match"] == 1
    hint = raft.conflict_hint(follower, spark.createDataFrame([(1, 3, 5)], "node int, prev long, prev_term long")).first()
    assert (hint["conflict_term"], hint["conflict_index"]) == (2, 2)
    assert sorted(tuple(r)[1:] for r in raft.merged(leader, follower).collect()) == [(1, 1), (2, 5), (3, 5)]


def P(v, a, b, ok=True):
    return ("put", ok, a, b, v, None, None)


def D(a, b):
    return ("delete", True, a, b, None, None, None)


def G(v, a, b, ok=True):
    return ("get", ok, a, b, None, v is not None, v)


@pytest.mark.parametrize(
    ("ops", "good"),
    [
        ([P("1", 0, 10), G("1", 20, 30)], True),
        ([P("1", 0, 10), P("2", 20, 30), G("2", 40, 50)], True),
        ([P("1", 0, 20), P("2", 10, 30), G("1", 40, 50)], True),
        ([P("1", 0, 20), P("2", 10, 30), G("2", 40, 50)], True),
        ([P("1", 0, 20), G(None, 5, 15)], True),
        ([P("1", 0, 20), G("1", 5, 15)], True),
        ([P("1", 0, 10), D(20, 30), G(None, 40, 50)], True),
        ([G(None, 0, 10)], True),
        ([P("1", 0, 10), P("2", 20, 30), G("1", 40, 50)], False),
        ([G("1", 0, 10), P("1", 20, 30)], False),
        ([P("1", 0, 10), D(20, 30), G("1", 40, 50)], False),
        ([P("1", 0, 10), P("2", 20, 30, False), G("1", 40, 50)], True),
        ([P("1", 0, 10), P("2", 20, 30, False), G("2", 40, 50)], True),
        ([P("1", 0, 10), P("2", 20, 30, False), G("3", 40, 50)], False),
        ([P("1", 0, 10), G(None, 15, 18, False), G("1", 20, 30)], True),
    ],
)
def test_linearizable(ops, good):
    assert linearize.check_register(ops) is good


def test_log_codec_and_torn_tail(spark):
    assert codecs.crc32c(b"123456789") == 0xE3069283
    one, two = codecs.encode("put", b"a", b"1"), codecs.encode("delete", b"b")
    assert [r[:3] for r in codecs.decode(one + two)] == [("put", b"a", b"1"), ("delete", b"b", None)]
    for cut in range(len(two)):
        assert len(list(codecs.decode(one + two[:cut]))) == 1
    bad = bytearray(one + two + one)
    bad[len(one) + 9] ^= 1
    assert len(list(codecs.decode(bytes(bad)))) == 1
    logs = spark.createDataFrame([("x", bytearray(one + two[:5]))], "path string, content binary")
    assert codecs.recover(logs).select("op", "end").collect() == [("put", len(one))]
    assert faults.torn_prefix(spark.range(9).withColumnRenamed("id", "seq"), 4).count() == 4


def test_store_versions_and_late_rows(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.read().count() == 0
    store.flush(spark.createDataFrame([(1, "put", "a", "1"), (2, "put", "b", "2")], LOG))
    store.flush(spark.createDataFrame([(3, "delete", "a", None), (0, "put", "b", "late")], LOG))
    read = lambda v=None: {r["k"]: r["v"] for r in store.read(v).collect()}
    assert read() == {"b": "2"} and read(1) == {"a": "1", "b": "2"}
    assert store.get("b").collect() == [("b", "2")]
    store.compact()
    assert read() == {"b": "2"} and len(store.files()) == 1
    assert store.vacuum() == [1, 2]
    # an old level must not hide a newer run
    store.flush(spark.createDataFrame([(9, "put", "b", "NEW")], LOG))
    store.compact()
    assert read() == {"b": "NEW"}


def test_stream_apply(spark, tmp_path):
    spark.createDataFrame([(1, "put", "a", "1"), (2, "delete", "a", None), (3, "put", "b", "2")], LOG).write.parquet(f"{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/s")
    apply_stream(spark.readStream.schema(LOG).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/c")
    assert store.read().collect() == [("b", "2")]
    assert store.entries().where(F.col("op") == "delete").count() == 1


def test_a_log_that_is_longer_without_conflict_is_kept(spark):
    leader = spark.createDataFrame([(1, 1), (2, 1)], "idx long, term long")
    follower = spark.createDataFrame([(1, i, 1) for i in (1, 2, 3)] + [(2, 1, 1), (2, 2, 1), (2, 3, 1), (2, 4, 1)], "node int, idx long, term long")
    assert raft.first_conflict(leader, follower).count() == 0
    assert sorted(tuple(r) for r in raft.merged(leader, follower).collect()) == [(1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 1, 1), (2, 2, 1), (2, 3, 1), (2, 4, 1)]
    probes = spark.createDataFrame([(1, 9, 4), (2, 2, 1)], "node int, prev long, prev_term long")
    assert [tuple(r) for r in raft.conflict_hint(follower, probes).collect()] == [(1, 9, 0, 4)]


def test_conflict_hint_names_the_first_index_of_the_term(spark):
    follower = spark.createDataFrame([(1, i, 1 if i == 1 else 2) for i in range(1, 41)], "node int, idx long, term long")
    assert tuple(raft.conflict_hint(follower, spark.createDataFrame([(1, 40, 7)], "node int, prev long, prev_term long")).first()) == (1, 40, 2, 2)


def test_log_matching_fires_on_logs_that_agree_again(spark):
    logs = [(1, i, 1) for i in range(1, 30)] + [(2, i, 0 if i == 9 else 1) for i in range(1, 30)]
    found = raft.log_matching(spark.createDataFrame(logs, "node int, idx long, term long"), block=4)
    assert sorted(r["idx"] for r in found.collect()) == list(range(10, 30))


def test_commit_never_falls_and_outcomes(spark):
    m = spark.createDataFrame([("a", n, 1) for n in range(3)] + [("b", n, 2) for n in range(3)], "g string, node int, match long")
    log = spark.createDataFrame([(1, 1), (2, 3)], "idx long, term long")
    before = spark.createDataFrame([("a", 1), ("b", 0)], "g string, before long")
    assert {r["g"]: r["commit"] for r in raft.guarded_commit(m, log, "g", raft.quorum(3), 3, before).collect()} == {"a": 1, "b": 2}
    proposals = spark.createDataFrame([(1, 1), (2, 2), (2, 3), (9, 3)], "idx long, term long")
    assert [r["outcome"] for r in raft.outcomes(proposals, log, 5).orderBy("idx", "term").collect()] == ["ok", "ErrProposalLost", "ok", "ErrProposeTimeout"]


def test_unknown_writes_end_as_recorded_unless_open():
    ops = [P("1", 0, 10), P("2", 20, 30, False), G("1", 40, 50), G("2", 60, 70)]
    assert linearize.check_register(ops) is False and linearize.check_register(ops, "open") is True


def test_long_histories_take_time_in_proportion():
    import time

    took = []
    for n in (4000, 16000):
        ops = [P(str(i // 2), 10 * i, 10 * i + 9) if i % 2 == 0 else G(str(i // 2), 10 * i, 10 * i + 9) for i in range(n)]
        began = time.perf_counter()
        assert linearize.check_register(ops)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]


def test_stale_reads_by_brute_force(spark):
    import random

    rng = random.Random(4)
    writes = [(rng.randrange(3), i, rng.choice(["put", "put", "delete"]), t := rng.randrange(400), t + rng.randrange(30)) for i in range(150)]
    gets = [(rng.randrange(3), 1000 + i, t := rng.randrange(450), t + 5, rng.randrange(150)) for i in range(200)]
    expect = {(k, i) for k, i, s, e, o in gets for k1, i1, kind, s1, e1 in writes if (k1, i1, kind) == (k, o, "put") and any(k2 == k and e1 < s2 and e2 < s for k2, _, _, s2, e2 in writes)}
    w = spark.createDataFrame(writes, "k long, id long, kind string, s long, e long")
    g = spark.createDataFrame(gets, "k long, id long, s long, e long, obs long")
    assert {tuple(r) for r in linearize.stale_reads(w, g).collect()} == expect and expect


def test_overlaps_take_keys_of_any_kind(spark):
    files = [(1, 0, "a", "m"), (2, 1, "k", "z"), (3, 1, "n", "o"), (4, 1, "", "a")]
    assert sorted(tuple(r) for r in manifest.overlaps(spark.createDataFrame(files, schema.FILE)).collect()) == [(1, 2, 0), (1, 4, 0)]


def test_last_event_of_a_test_counts(spark):
    events = [("s", "t", 0, "fail"), ("s", "t", 1, "pass"), ("s", "t", 2, "output"), ("s", "u", 0, "run")]
    found = {r["test"]: (r["status"], r["events"]) for r in faults.test_matrix(spark.createDataFrame(events, "suite string, test string, pos long, action string")).collect()}
    assert found == {"t": ("pass", 3), "u": ("missing", 1)}


def test_up_to_date_compares_term_then_length(spark):
    ends = [(3, 2), (9, 2), (1, 2), (1, 5), (99, 1), (0, 0)]
    rows = spark.createDataFrame([(i, t, 3, 2) for i, t in ends], "i long, t long, own_i long, own_t long")
    found = {(r.i, r.t): r.ok for r in rows.withColumn("ok", raft.up_to_date("t", "i", "own_t", "own_i")).collect()}
    assert [found[e] for e in ends] == [True, True, False, True, False, False]


def test_next_batches_keep_both_caps_and_send_the_first(spark):
    log = spark.createDataFrame([(i, 900 if i == 4 else 100) for i in range(1, 41)], "idx long, bytes long")
    follower = spark.createDataFrame([(1, 0), (2, 3), (3, 10), (4, 40)], "node int, match long")
    found = {r.node: (r.first, r.last, r.bytes) for r in raft.next_batches(log, follower, 8, 512).collect()}
    assert found == {1: (1, 3, 300), 2: (4, 4, 900), 3: (11, 15, 500)}
    assert raft.next_batches(log, follower.where("node = 3"), 4, 10_000).first().n == 4


def test_follower_commits_no_further_than_confirmed(spark):
    rows = spark.createDataFrame([(0, 5, 2, 0), (3, 1, 0, 1), (1, 9, 4, 3)], "commit long, leader_commit long, prev long, n long")
    assert [r.new_commit for r in raft.follower_commit(rows).collect()] == [2, 3, 7]


def test_gaps_and_compaction(spark):
    log = spark.createDataFrame([(1, i, 1) for i in (1, 2, 4, 7)] + [(2, i, 1) for i in (5, 6)], "node int, idx long, term long")
    assert [(r.node, r.missing) for r in raft.gaps(log).collect()] == [(1, 3)]
    offsets = spark.createDataFrame([(1, 2), (2, 6)], "node int, offset long")
    assert sorted(r.idx for r in raft.compacted(log, offsets).collect()) == [4, 7]


def test_torn_segments_recover_their_whole_prefix(spark):
    log = spark.createDataFrame([(i, "delete" if i % 3 == 0 else "put", f"k{i}", None if i % 3 == 0 else f"v{i}") for i in range(30)], "seq long, op string, k string, v string")
    torn = codecs.segments(log, 10).selectExpr("path", "if(path = 'seg1', substr(content, 1, length(content) - 3), content) as content")
    found = sorted((r.path, r.n, r.op, bytes(r.k).decode(), r.v and bytes(r.v).decode()) for r in codecs.recover(torn).collect())
    assert found == sorted((f"seg{i // 10}", i % 10, "delete" if i % 3 == 0 else "put", f"k{i}", None if i % 3 == 0 else f"v{i}") for i in range(30) if i != 19)


def test_each_fault_schedule_is_played_once_a_task(monkeypatch):
    import pandas as pd

    played = []
    decode = codecs.decode
    monkeypatch.setattr(codecs, "decode", lambda data: played.append(data) or decode(data))
    seeds, seen = pd.Series(range(6000)), {}
    target, kind = 1 + seeds % 30, (seeds % 2).map({0: "TornWrite", 1: "Fail"})
    assert [faults.survivors(target[a : a + 2000], kind[a : a + 2000], 30, seen) for a in (0, 2000, 4000)] == [[s % 30 for s in range(a, a + 2000)] for a in (0, 2000, 4000)]
    assert len(played) == 30  # thirty schedules are in these seeds, whatever their number
    assert faults.survivors(pd.Series([31, 31, 2]), pd.Series(["TornWrite", "Fail", "TornWrite"]), 30, {}) == [30, 30, 1]


def test_cells_hold_no_more_files_as_tables_grow(spark):
    for n in (2000, 20_000):
        files = spark.range(n).selectExpr("id as number", "int(id % 4) as level", "lpad(string(id * 7919 % 100003), 8, '0') as min_key", "lpad(string(id * 7919 % 100003 + 9), 8, '0') as max_key")
        assert manifest.cells(files, 50).groupBy("cell").count().agg(F.max("count")).first()[0] < 110
        a, b = (files.selectExpr(f"number as n{x}", f"level as l{x}", f"min_key as lo{x}", f"max_key as hi{x}") for x in "ab")
        want = a.join(b, F.expr("lb = la + 1 and loa <= hib and lob <= hia"))
        assert n > 2000 or {r[:2] for r in want.select("na", "nb").collect()} == {r[:2] for r in manifest.overlaps(files).collect()}


def test_log_files_are_replayed_in_many_tasks_however_small(spark, tmp_path):
    from runefold.plans import formats

    spark.range(60_000).select(F.col("id").alias("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    found = formats._log_replay(spark, str(tmp_path))
    assert found.withColumn("task", F.spark_partition_id()).agg(F.count_distinct("task")).first()[0] > 8
    assert [tuple(r) for r in found.orderBy("log").limit(4).collect()] == [(0, 100, None), (1, 99, None), (2, 0, None), (3, None, "OutOfSequence")]


def test_log_files_of_a_task_do_not_grow_with_the_log(spark, monkeypatch):
    monkeypatch.setattr(codecs, "PART", 40)
    for n in (400, 4000):
        log = spark.range(n).selectExpr("id as seq", "'put' as op", "concat('k', id) as k", "'v' as v")
        logs = codecs.segments(log, 4)
        assert logs.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 40
        assert [r["k"] for r in codecs.recover(logs).select(F.expr("int(substr(path, 4))").alias("s"), "n", F.col("k").cast("string")).orderBy("s", "n").collect()] == [f"k{i}" for i in range(n)]


def test_log_matching_deals_blocks_over_as_many_tasks_as_entries_need(spark, monkeypatch):
    monkeypatch.setattr(raft, "TASK", 100, raising=False)
    logs = spark.range(4000).selectExpr("int(id % 2 + 1) as node", "id div 2 + 1 as idx", "if(id in (90, 2400), 9L, 1L) as term")
    found = raft.log_matching(logs, block=4)
    assert found._jdf.queryExecution().optimizedPlan().toString().count(", 41") >= 2  # tasks of the one shuffle, read twice
    assert {r[:] for r in found.collect()} == {(i, 1, 2) for i in range(47, 2001) if i != 1201}
