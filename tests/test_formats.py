"""Binary formats on fixed bytes and on damaged ones."""

import random

import numpy as np
import pytest

from runefold.functions import codecs
from runefold.functions.checksum import crc32c, crc32c_ranges
from runefold.functions.layout import DecodeFailed


def fails(make, *args):
    with pytest.raises(DecodeFailed) as caught:
        make(*args)
    return caught.value.args[0]


def test_checksums_of_ranges():
    assert crc32c(b"123456789") == 0xE3069283 and crc32c(b"") == 0
    data = random.Random(1).randbytes(30_000)
    cuts = [(0, 0), (5, 6), (1, 4097), (0, 4096), (7, 12_300), (0, 30_000), (29_990, 30_000)]
    found = crc32c_ranges(np.frombuffer(data, np.uint8), np.array([a for a, _ in cuts]), np.array([b for _, b in cuts]))
    slow = codecs.crc32c
    assert found[:4].tolist() == [slow(data[a:b]) for a, b in cuts[:4]] and found[-1] == slow(data[-10:])
    joined = crc32c_ranges(np.frombuffer(data[7:12_300], np.uint8), np.zeros(1), np.array([12_293]))
    assert found[4] == joined[0]


def test_log_record_bytes():
    raw = codecs.encode("put", b"k", b"vv")
    assert raw[4:].hex() == "0c000000" + "01" + "01000000" + "6b" + "02000000" + "7676" and raw[:4] == crc32c(raw[4:]).to_bytes(4, "little")
    assert codecs.decode_record(codecs.encode("delete", b"")) == ("delete", b"", None, 17)
    assert {fails(codecs.decode_record, raw[:n]) for n in range(len(raw))} == {"Incomplete"}
    assert fails(codecs.decode_record, raw[:-1] + b"x") == "CrcMismatch"
    one, two, three = (codecs.encode("put", k, b"x") for k in (b"1", b"2", b"3"))
    bad = bytearray(two)
    bad[9] ^= 1
    records, end, why = codecs.decode_log(one + bytes(bad) + three)
    assert (len(records), end, why) == (1, len(one), "CrcMismatch")


def test_table_file():
    rows = [("delete" if i % 5 == 0 else "put", f"k{i:05}".encode(), None if i % 5 == 0 else b"x" * (i % 50)) for i in range(2000)]
    table = codecs.Table(codecs.write_table(rows))
    assert list(table.entries()) == rows and len(table.index) > 5
    for op, key, value in rows[::97]:
        table.reads = 0
        assert table.get(key) == (op, value) and table.reads == 1
    table.reads = 0
    assert all(table.get(f"absent{i}".encode()) is None for i in range(500)) and table.reads < 25
    with pytest.raises(ValueError):
        codecs.write_table([("put", b"b", b""), ("put", b"a", b"")])
    raw = bytearray(codecs.write_table(rows))
    foot = codecs.decode_footer(bytes(raw))
    raw[foot["filter_offset"] + 30] ^= 255  # a damaged filter is built again
    assert codecs.Table(bytes(raw)).get(rows[7][1]) == (rows[7][0], rows[7][2])
    assert list(codecs.Table(codecs.write_table([])).entries()) == []
    assert fails(codecs.decode_entry, b"\x01\0\0\0a\x02\x01\0\0\0x") == "Malformed" and fails(codecs.decode_entry, b"\x01\0\0\0a\x05\0\0\0\0") == "BadVtype"


def test_filters():
    assert [codecs.hashes_for(b) for b in (10, 1, 100)] == [7, 1, 8]
    assert not codecs.may_contain(codecs.build_filter([]), b"a")
    keys = [f"key-{i}".encode() for i in range(5000)]
    sketch = codecs.decode_filter(codecs.encode_filter(codecs.build_filter(keys)))
    assert all(codecs.may_contain(sketch, k) for k in keys)
    assert sum(codecs.may_contain(sketch, f"absent-{i}".encode()) for i in range(20_000)) < 1000


def test_manifest_and_snapshots():
    first = {"added": [{"number": 7, "level": 2, "min_key": b"aaa", "max_key": b"mmm"}, {"number": 9, "level": 0, "min_key": b"zzz", "max_key": b"zzz"}], "deleted": [3, 4, 5]}
    raw = codecs.encode_edit(first)
    assert codecs.decode_edits(raw + raw[:-1]) == ([first], len(raw), "Incomplete")
    blob = codecs.pack_files({1: b"one", 3: b""})
    assert codecs.unpack_files(blob) == {1: b"one", 3: b""}
    assert fails(codecs.unpack_files, blob[:-1]) == "CrcMismatch" and fails(codecs.unpack_files, b"") == "CrcMismatch"


def test_replicated_log_files():
    entries = [codecs.encode_raft_entry(1, i, b"c" * i) for i in range(1, 6)]
    whole = b"".join(entries)
    found, end = codecs.replay_raft_log(whole + entries[0][:-1])
    assert [e["idx"] for e in found] == [1, 2, 3, 4, 5] and end == len(whole)
    assert codecs.replay_raft_log(whole, first=4) == ([], 0)  # stale beside its snapshot
    assert fails(codecs.replay_raft_log, entries[0] + entries[2]) == "OutOfSequence"
    snapshot = codecs.encode_snapshot(5, 2, b"data")
    assert codecs.decode_snapshot(snapshot) == {"idx": 5, "term": 2, "data": b"data"}
    assert fails(codecs.decode_snapshot, snapshot + b"!") == "Malformed" and all(fails(codecs.decode_snapshot, snapshot[:n]) for n in range(len(snapshot)))
    assert codecs.decode_hard_state(None) == {"term": 0, "voted_for": 0} and codecs.decode_hard_state(codecs.encode_hard_state(4, 2)) == {"term": 4, "voted_for": 2}


def test_messages_and_commands():
    numbers = [n for n, kind in codecs.MESSAGE if kind == "u64"]
    message = {n: i for i, n in enumerate(numbers)} | {"type": 5, "granted": True, "success": False, "entries": [{"term": 1, "idx": 2, "cmd": b"x" * 3000}, {"term": 1, "idx": 3, "cmd": b""}], "snapshot": b"s" * 4096}
    raw = codecs.encode_message(message)
    got, end = codecs.decode_message(raw + b"next")
    assert end == len(raw) and {k: got[k] for k in message} == message and len(raw) - 8 == 115 + 3020 + 20 + 4096
    for n in range(0, len(raw), 97):
        assert fails(codecs.decode_message, raw[:n])
    command = codecs.encode_command("put", b"k", b"v")
    assert command.hex() == "01" + "01000000" + "6b" + "01000000" + "76" and codecs.decode_command(command) == ("put", b"k", b"v")
    assert fails(codecs.decode_command, command + b"!") == "TrailingBytes" and fails(codecs.decode_command, b"\x09" + command[1:]) == "UnknownOp"


def test_table_files_in_pieces_are_the_files(spark):
    """Many small parts, blocks across several parts, filters in pieces; equal keys of a run stay together."""
    from runefold.sources.tablefiles import TableFiles

    rng = random.Random(3)
    rows = [(i % 3, f"k{i:05}" + "y" * rng.randrange(9), "delete" if i % 5 == 0 else "put", None if i % 5 == 0 else "x" * rng.randrange(90)) for i in range(4000)]
    rows += [(5, "only", "put", "v"), (6, "u", "put", "z" * 9000), (6, "v", "delete", None)]
    runs = spark.createDataFrame(rows, "run int, k string, op string, v string")
    want = {r: codecs.write_table([(op, k.encode(), None if v is None else v.encode()) for n, k, op, v in sorted(rows, key=lambda x: x[1]) if n == r]) for r in (0, 1, 2, 5, 6)}
    tables = TableFiles(runs, part=60, chunk=5)
    pieces = sorted((r["run"], r["kind"], r["number"], bytes(r["raw"])) for r in tables.files().collect())
    assert {r: b"".join(raw for n, *_, raw in pieces if n == r) for r in want} == want
    assert max(len(raw) for *_, raw in pieces) < 20_000 and len(pieces) > 60
    blobs = {r["run"]: r["crc"] for r in tables.packed().collect()}
    assert blobs == {r: int.from_bytes(codecs.pack_files({r: raw})[:4], "little") for r, raw in want.items()}
    index = sorted((r["run"], r["block"], bytes(r["first_key"]), r["offset"], r["size"]) for r in tables.index().collect())
    assert index == [(r, i, e["first_key"], e["offset"], e["size"]) for r, raw in want.items() for i, e in enumerate(codecs.Table(raw).index)]
    asked = ["a", "only", "u", "v", "zz"] + [k for _, k, *_ in rows[::41]]
    got = {(r["run"], r["k"]): (r["op"] and (r["op"], r["v"] and bytes(r["v"])), r["reads"]) for r in tables.probe(asked).collect()}
    for r, raw in want.items():
        table = codecs.Table(raw)
        for k in asked:
            table.reads = 0
            assert got[r, k] == (table.get(k.encode()), table.reads)
    twice = TableFiles(spark.createDataFrame([(1, "a", "put", str(i)) for i in range(900)] + [(1, "b", "put", "x")], "run int, k string, op string, v string"), part=100)
    assert [(r["block"], bytes(r["first_key"])) for r in twice.index().orderBy("block").collect()] == [(0, b"a"), (1, b"b")] and twice.scan().count() == 901


def test_an_index_is_read_in_time_with_its_size():
    import time

    def seconds(n):
        raw = codecs.write_table([("put", f"k{i:07}".encode(), b"x" * 4100) for i in range(n)], 1)
        began = time.process_time()
        assert len(codecs.Table(raw).index) == n
        return time.process_time() - began

    seconds(100)
    assert seconds(8000) < 40 * max(seconds(1000), 0.004)


def test_few_ranges_are_summed_a_byte_at_a_time(monkeypatch):
    from runefold.functions import checksum

    rows = [random.Random(n).randbytes(300 + n) for n in range(120)]
    data = np.frombuffer(b"".join(rows), np.uint8)
    ends = np.cumsum([len(r) for r in rows])
    starts = ends - [len(r) for r in rows]
    want = [crc32c(r) for r in rows]
    steps = []
    monkeypatch.setattr(checksum, "_advance", lambda *a, advance=checksum._advance: steps.append(1) or advance(*a))
    assert [crc32c_ranges(data, starts[n : n + 3], ends[n : n + 3]).tolist() for n in range(0, 120, 3)] == [want[n : n + 3] for n in range(0, 120, 3)] and not steps
    assert crc32c_ranges(data, starts, ends).tolist() == want and steps
    assert crc32c_ranges(data, starts[:0], ends[:0]).tolist() == []
