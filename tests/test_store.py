"""The store: writers at once, torn edits, sizes, compaction to the end, copies, replayed batches."""

import pytest

from runefold.sources.store import Conflict, Leveled, SizeTiered, Store
from runefold.streaming.apply import apply_stream

LOG = "seq long, op string, k string, v string"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s")


def rows(spark, *ops):
    return spark.createDataFrame([(s, "put" if v is not None else "delete", k, v) for s, k, v in ops], LOG)


def view(store, version=None):
    return {r["k"]: r["v"] for r in store.read(version).collect()}


def test_two_writers_both_keep_their_runs(spark, store):
    other = Store(spark, store.path)
    make = store._commit

    def late(edit):
        if not other.files():
            other.flush(rows(spark, (1, "a", "other")))  # gets the number that this writer was about to take
        return make(edit)

    store._commit = late
    store.flush(rows(spark, (2, "b", "mine")))
    assert view(store) == {"a": "other", "b": "mine"} and sorted(f["number"] for f in store.files()) == [1, 2]


def test_a_number_is_taken_once(spark, store, tmp_path):
    store.flush(rows(spark, (1, "a", "1")))
    seen = []

    def make(edits):
        seen.append(len(edits))
        if len(seen) == 1:
            Store(spark, store.path).flush(rows(spark, (2, "b", "2")))
        return {"added": [], "deleted": []}

    assert store._commit(make) == 3 and seen == [1, 2]
    assert len(list((tmp_path / "s/manifest").glob("*.json"))) == 3 and view(store) == {"a": "1", "b": "2"}


def test_torn_edits_are_ignored(spark, store, tmp_path):
    store.flush(rows(spark, (1, "a", "1")))
    store.flush(rows(spark, (2, "b", "2")))
    (tmp_path / "s/manifest/00000002.json").write_text('{"added": [{"num')
    again = Store(spark, store.path)
    assert view(again) == {"a": "1", "b": "2"}
    again.flush(rows(spark, (3, "c", "3")))
    assert view(Store(spark, store.path)) == {"a": "1", "b": "2", "c": "3"}


def test_null_keys_are_refused(spark, store):
    with pytest.raises(Exception, match="a key is null"):
        store.flush(rows(spark, (1, None, "1")))
    assert store.version() == 0
    store.flush(rows(spark, (1, "", "")))
    assert view(store) == {"": ""} and store.get("").count() == 1


def test_empty_flush_adds_no_run(spark, store):
    store.flush(rows(spark, (1, "a", "1")).limit(0))
    assert store.files() == [] and store.flush_log() is None and not store.compact_once(Leveled())


def test_log_is_flushed_by_size_and_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", threshold=4096)
    done = [store.write(rows(spark, *[(20 * j + i, f"k{20 * j + i:05}", "x" * 40) for i in range(20)])) for j in range(6)]
    # 110 bytes an operation: 20 of them are 2,200, 40 reach the threshold
    assert [v is not None for v in done] == [False, True] * 3 and len(store.files()) == 3
    assert len(view(store)) == 120
    store.flush_log()
    assert len(view(store)) == 120 and store.memtable().count() == 0
    assert Store(spark, store.path).memtable_size() == 0


def test_versions_stay_readable_until_vacuum(spark, store):
    for i in range(5):
        store.flush(rows(spark, (i, "k", str(i))))
    store.compact()
    assert view(store) == {"k": "4"} and view(store, 2) == {"k": "1"}
    assert store.vacuum() == [1, 2, 3, 4, 5] and view(store) == {"k": "4"}


def test_newer_runs_win_over_deeper_ones(spark, store):
    """Five disjoint runs of level 1, then a newer value in level 0: one compaction must not bring the old one back."""
    for i in range(5):
        store.flush(rows(spark, (2 * i, f"{'abcde'[i]}0", "old"), (2 * i + 1, f"{'abcde'[i]}1", "old")))
        store._merge([store.files()[0]["number"]], 1, False)
    store.flush(rows(spark, (99, "a0", "NEW")))
    assert store.compact_once(Leveled()) and store.get("a0").first()["v"] == "NEW" and len(view(store)) == 10


def test_tombstones_are_carried_until_the_bottom(spark, store):
    store.flush(rows(spark, (1, "k", "v")))
    store._merge([1], 2, True)
    store.flush(rows(spark, (2, "k", None)))
    assert store.compact_once(Leveled(trigger=1))
    assert view(store) == {} and store.entries().where("op = 'delete'").count() == 1
    store.compact()
    assert store.entries().count() == 0 and store.files() == []


def test_many_runs_of_the_same_keys_shrink(spark, store):
    for i in range(12):
        store.flush(rows(spark, *[(10 * i + j, f"k{j}", str(i)) for j in range(10)]))
    before = store.space()
    assert store.compact_all(SizeTiered()) >= 1
    assert len(store.files()) <= 3 and store.space() * 3 < before and view(store) == {f"k{j}": "11" for j in range(10)}


def test_compaction_of_gone_inputs_fails(spark, store):
    store.flush(rows(spark, (1, "a", "1")))
    store.flush(rows(spark, (2, "a", "2")))
    other = Store(spark, store.path)
    make = store._commit
    store._commit = lambda edit: (other.compact(), make(edit))[1]
    with pytest.raises(Conflict):
        store.compact()
    assert view(Store(spark, store.path)) == {"a": "2"}


def test_snapshots_and_adoption(spark, store, tmp_path):
    store.flush(rows(spark, (1, "a", "1"), (2, "b", "2")))
    store.write(rows(spark, (3, "b", None)))
    store.snapshot(f"file://{tmp_path}/copy")
    other = Store(spark, f"file://{tmp_path}/other")
    other.flush(rows(spark, (9, "z", "gone")))
    other.restore(f"file://{tmp_path}/copy")
    assert view(other) == {"a": "1"} and {f["level"] for f in other.files()} == {0}


def test_a_batch_that_comes_again_changes_nothing(spark, store, tmp_path):
    rows(spark, (1, "a", "1"), (2, "b", "2")).write.parquet(f"{tmp_path}/in")
    for again in range(2):  # a lost checkpoint brings the same batch again
        apply_stream(spark.readStream.schema(LOG).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/c{again}")
    assert len(store.files()) == 1 and view(store) == {"a": "1", "b": "2"}


def test_stream_state_takes_rows_not_a_frame_for_each_key(spark, tmp_path, monkeypatch):
    from pyspark.sql.group import GroupedData

    from runefold.plans import stored

    def refuse(*a, **k):
        raise AssertionError("a data frame for each key")

    monkeypatch.setattr(GroupedData, "transformWithStateInPandas", refuse)
    spark.range(60).selectExpr("id as event_id", "id % 7 as user_id", "if(id % 5 = 4, 'error', 'view') as event_type").write.parquet(str(tmp_path / "events.parquet"))
    got = {tuple(r) for r in stored._state(spark, str(tmp_path)).collect()}
    last = {i % 7: i for i in range(60)}
    assert got == {(f"u{u}", i, "delete" if i % 5 == 4 else "put", None if i % 5 == 4 else f"v{i}") for u, i in last.items()}
