"""Queries over the binary formats: what is written from the driver tables, and what is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions import codecs
from ..operators import fold
from ..sources.tablefiles import TableFiles
from .catalog import OPLOG
from .registry import register


def le(expr: str, size: int) -> str:
    """SQL: a number as hex of ``size`` little-endian bytes."""
    h = f"lpad(to_hex({expr}), {2 * size}, '0')"
    return " || ".join(f"substr({h}, {2 * k + 1}, 2)" for k in reversed(range(size)))


def text(expr: str) -> str:
    """SQL: length and bytes of an ASCII string as hex; none for null."""
    return f"{le(f'length(coalesce({expr}, chr(0)[2:]))', 4)} || hex(encode(coalesce({expr}, '')))"


#: SQL: CRC32C of the hex text in column ``x`` as little-endian hex, byte by byte over a table made from the polynomial.
CRC = (
    "tab AS (SELECT list(r ORDER BY n) AS t FROM (SELECT n, list_reduce([n] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 2197175160) ELSE c // 2 END) AS r FROM range(256) x(n)))",
    f"(SELECT {le('c', 4)} FROM (SELECT xor(list_reduce([4294967295] || list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS c FROM tab))",
)


def framed(source: str, keep: str, payload: str) -> str:
    """SQL: ``keep`` and ``raw``, the frame of a payload in hex, of ``source`` (a chain of CTEs that ends in ``src``)."""
    body = f"body AS (SELECT {keep}, {le('length(p) // 2', 4)} || p AS x FROM (SELECT {keep}, {payload} AS p FROM src))"
    return f"{source}, {CRC[0]}, {body} SELECT {keep}, {CRC[1]} || x AS raw FROM body"


_OP = "CASE op WHEN 'put' THEN '01' ELSE '02' END"


@register("wal_encode", framed(OPLOG + ", src AS (SELECT * FROM oplog)", "seq", f"{_OP} || {text('k')} || {text('v')}"))
def _wal_encode(spark, sf_dir):
    log = schema.oplog(spark, sf_dir).select("seq", "op", "k", "v")
    rows = codecs.encoded(log, ["op", "k", "v"], lambda op, k, v: codecs.encode(op, k.encode(), (v or "").encode()))
    return rows.select("seq", F.hex("raw").alias("raw"))


#: Damage by the sequence number: a flipped byte, a cut, an unknown operation, a delete with a value.
_DAMAGE = {1: "CrcMismatch", 2: "Incomplete", 3: "InvalidOp", 4: "Malformed"}


@register(
    "wal_decode",
    OPLOG + "SELECT seq, CASE WHEN seq % 10 IN (1, 2, 3, 4) THEN NULL ELSE op END AS op, CASE WHEN seq % 10 IN (1, 2, 3, 4) THEN NULL ELSE k END AS k, CASE WHEN seq % 10 IN (1, 2, 3, 4) THEN NULL ELSE v END AS v,"
    " CASE seq % 10 " + " ".join(f"WHEN {n} THEN '{name}'" for n, name in _DAMAGE.items()) + " END AS err FROM oplog",
)
def _wal_decode(spark, sf_dir):
    def damaged(seq: int, op: str, k: str, v: str | None) -> bytes:
        kind = _DAMAGE.get(seq % 10)
        if kind in ("InvalidOp", "Malformed"):
            return codecs.frame(codecs.pack(codecs.LOG_RECORD, {"op": 9 if kind == "InvalidOp" else 2, "key": k.encode(), "value": b"x"}))
        raw = codecs.encode(op, k.encode(), (v or "").encode())
        return raw[:-1] + bytes([raw[-1] ^ 1]) if kind == "CrcMismatch" else raw[:-1] if kind else raw

    log = schema.oplog(spark, sf_dir).select("seq", "op", "k", "v")
    raw = codecs.encoded(log, ["seq", "op", "k", "v"], damaged).select("seq", "raw")
    got = codecs.decoded(raw, lambda x: codecs.decode_record(x)[:3], "op string, key binary, value binary")
    return got.select("seq", "op", F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"), "err")


_SEGMENTS = OPLOG + """, sized AS (SELECT seq // 512 AS seg, seq, 17 + length(k) + coalesce(length(v), 0) AS n FROM oplog),
s AS (SELECT seg, sum(n) AS total, arg_max(n, seq) AS last FROM sized GROUP BY seg)
"""


def _torn(spark, sf_dir):
    logs = codecs.segments(schema.oplog(spark, sf_dir), 512)
    return logs.withColumn("content", F.expr("if(int(substr(path, 4)) % 3 = 0, substr(content, 1, length(content) - 1), content)"))


@register("wal_valid_lengths", _SEGMENTS + "SELECT 'seg' || seg AS path, (total - CASE WHEN seg % 3 = 0 THEN last ELSE 0 END)::BIGINT AS valid_len, (total - CASE WHEN seg % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS total, CASE WHEN seg % 3 = 0 THEN 'Incomplete' END AS err FROM s")
def _valid(spark, sf_dir):
    return codecs.valid_lengths(_torn(spark, sf_dir))


@register("wal_heal_tail", _SEGMENTS + "SELECT 'seg' || seg AS path, (total - CASE WHEN seg % 3 = 0 THEN last ELSE 0 END)::BIGINT AS size, NULL::VARCHAR AS err FROM s")
def _heal(spark, sf_dir):
    """Healed logs are whole to their end."""
    return codecs.valid_lengths(codecs.healed(_torn(spark, sf_dir))).select("path", F.col("valid_len").alias("size"), "err")


#: A folder listing: logs, tables, tables in the making and other files.
_LISTING = "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'wal-' || lpad(o_custkey::VARCHAR, 6, '0') || '.log' WHEN 1 THEN lpad(o_custkey::VARCHAR, 6, '0') || '.sst' WHEN 2 THEN lpad(o_custkey::VARCHAR, 6, '0') || '.sst.tmp' WHEN 3 THEN 'wal-x' || o_custkey || '.log' ELSE 'MANIFEST' END AS name FROM orders"


def _listing(spark, sf_dir):
    n = "lpad(o_custkey, 6, '0')"
    kinds = [f"concat('wal-', {n}, '.log')", f"concat({n}, '.sst')", f"concat({n}, '.sst.tmp')", "concat('wal-x', o_custkey, '.log')", "'MANIFEST'"]
    name = "case o_orderkey % 5 " + " ".join(f"when {i} then {k}" for i, k in enumerate(kinds)) + " end"
    return schema.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(name).alias("name"))


@register("folder_listing", f"SELECT id, CASE WHEN regexp_full_match(name, 'wal-[0-9]+[.]log') THEN 'segment' WHEN regexp_full_match(name, '[0-9]+[.]sst') THEN 'table' WHEN name LIKE '%.sst.tmp' THEN 'orphan' ELSE 'other' END AS kind, CASE WHEN regexp_full_match(name, 'wal-[0-9]+[.]log|[0-9]+[.]sst') THEN regexp_extract(name, '[0-9]+')::BIGINT END AS number FROM ({_LISTING})")
def _folder(spark, sf_dir):
    """What each file of a store's folder is: segments and tables by number, unfinished tables to be swept."""
    segment, table = F.col("name").rlike("^wal-[0-9]+[.]log$"), F.col("name").rlike("^[0-9]+[.]sst$")
    kind = F.when(segment, "segment").when(table, "table").when(F.col("name").endswith(".sst.tmp"), "orphan").otherwise("other")
    number = F.when(segment | table, F.regexp_extract("name", "([0-9]+)", 1).cast("long"))
    return _listing(spark, sf_dir).select("id", kind.alias("kind"), number.alias("number"))


@register("wal_retained_segments", f"SELECT DISTINCT regexp_extract(name, '[0-9]+')::BIGINT AS number FROM ({_LISTING}) WHERE regexp_full_match(name, 'wal-[0-9]+[.]log') AND regexp_extract(name, '[0-9]+')::BIGINT >= 700")
def _retained(spark, sf_dir):
    """Segments that stay once all below 700 are covered by tables."""
    return _folder(spark, sf_dir).where("kind = 'segment' and number >= 700").select("number").distinct()


def _runs(spark, sf_dir):
    """Runs of orders with the same size of entry: 10-byte keys, 8-byte values, every seventh a tombstone with a value of none."""
    return schema.table(spark, sf_dir, "orders").select(
        F.expr("o_orderkey % 4").alias("run"), F.expr("concat('key', lpad(o_orderkey, 7, '0'))").alias("k"), F.expr("if(o_orderkey % 7 = 0, 'delete', 'put')").alias("op"),
        F.expr("if(o_orderkey % 7 = 0, null, concat('v', lpad(o_custkey, 7, '0')))").alias("v"),
    )


_RUNS = "r AS (SELECT o_orderkey % 4 AS run, 'key' || lpad(o_orderkey::VARCHAR, 7, '0') AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'delete' ELSE 'put' END AS op, CASE WHEN o_orderkey % 7 > 0 THEN 'v' || lpad(o_custkey::VARCHAR, 7, '0') END AS v FROM orders)"


@register("sst_scan", f"WITH {_RUNS} SELECT run, k, op, v FROM r")
def _scan(spark, sf_dir):
    got = TableFiles(_runs(spark, sf_dir)).scan()
    return got.select("run", F.col("k").cast("string").alias("k"), "op", F.col("v").cast("string").alias("v"))


#: Blocks by recursion: each ends with the first entry whose running size reaches the target.
_BLOCKS = f"""WITH RECURSIVE {_RUNS}, sized AS (SELECT run, k, sum(19 + coalesce(length(v), 0)) OVER (PARTITION BY run ORDER BY k) AS total, 19 + coalesce(length(v), 0) AS own FROM r),
blocks AS (SELECT run, 0::INTEGER AS block, 0::BIGINT AS start, min(total) FILTER (total >= 4096)::BIGINT AS stop FROM sized GROUP BY run
  UNION ALL SELECT b.run, b.block + 1, b.stop, (SELECT min(total) FROM sized s WHERE s.run = b.run AND s.total >= b.stop + 4096)::BIGINT FROM blocks b WHERE stop IS NOT NULL)"""


@register("sst_index", _BLOCKS + " SELECT run, block, first_key, start AS \"offset\", (reach - start)::BIGINT AS size FROM (SELECT b.run, b.block, b.start, min(k) AS first_key, max(s.total) AS reach FROM blocks b JOIN sized s ON s.run = b.run AND s.total > b.start AND (b.stop IS NULL OR s.total <= b.stop) GROUP BY b.run, b.block, b.start)")
def _index(spark, sf_dir):
    """The sparse index of each table file, as its footer leads to it."""
    return TableFiles(_runs(spark, sf_dir)).index().withColumn("first_key", F.col("first_key").cast("string"))


_ASKED = [f"key{n:07d}" for n in range(0, 2000, 13)]


@register(
    "sst_point_reads",
    f"WITH {_RUNS}, a AS (SELECT 'key' || lpad(n::VARCHAR, 7, '0') AS k FROM range(0, 2000, 13) t(n)) SELECT run, k, op, v FROM r JOIN a USING (k)",
)
def _point_reads(spark, sf_dir):
    """Markers that point reads find: each in the one run that has it, tombstones included."""
    got = TableFiles(_runs(spark, sf_dir)).probe(_ASKED)
    return got.where("op is not null").select("run", "k", "op", F.col("v").cast("string").alias("v"))


@register("sst_block_reads", f"WITH {_RUNS} SELECT run, count(*) AS present, true AS one_each, true AS few_for_absent FROM r WHERE k IN (SELECT 'key' || lpad(n::VARCHAR, 7, '0') FROM range(0, 2000, 13) t(n)) GROUP BY run")
def _block_reads(spark, sf_dir):
    """Reads of blocks: one for each present key; for absent ones at most one in twenty, as the filter lets pass."""
    got = TableFiles(_runs(spark, sf_dir)).probe(_ASKED)
    found = F.col("op").isNotNull()
    return got.groupBy("run").agg(
        F.count_if(found).alias("present"), F.bool_and(~found | (F.col("reads") == 1)).alias("one_each"),
        (F.sum(F.when(~found, F.col("reads")).otherwise(0)) <= 0.05 * F.count_if(~found) + 3).alias("few_for_absent"),
    )


@register("sst_format_errors", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 1 THEN 'BadMagic' WHEN 2 THEN 'BadVersion' WHEN 3 THEN 'UnexpectedEof' END AS err FROM orders")
def _sst_errors(spark, sf_dir):
    whole = codecs.write_table([("put", b"a", b"1")])

    def damaged(i: int) -> bytes:
        foot = whole[: -codecs.FOOTER_SIZE], whole[-codecs.FOOTER_SIZE :]
        return [whole, foot[0] + foot[1][:24] + b"XXXX" + foot[1][28:], whole[:-1] + b"\x09", whole[-20:]][i % 4]

    ids = schema.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return codecs.decoded(codecs.encoded(ids, ["id"], damaged), lambda x: (codecs.decode_footer(x)["index_size"],), "size long").select("id", "err")


@register("bloom_blocks", OPLOG + ", ks AS (SELECT run, count(DISTINCT k) AS n FROM oplog GROUP BY run), b AS (SELECT unnest([1, 4, 10, 100]) AS bits_per_key) SELECT run, bits_per_key, greatest(1, (n * bits_per_key + 511) // 512)::BIGINT AS blocks, least(8, greatest(1, floor(0.7 * bits_per_key + 0.5)))::BIGINT AS k, (17 + 4 + 64 * greatest(1, (n * bits_per_key + 511) // 512))::BIGINT AS stored FROM ks, b")
def _bloom_blocks(spark, sf_dir):
    """Size, hashes and stored size of blocked filters at several bits a key, as written and read back."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [k.encode() for k in pdf["k"]]
        rows = []
        for bits in (1, 4, 10, 100):
            raw = codecs.encode_filter(codecs.build_filter(keys, bits))
            got = codecs.decode_filter(raw)
            assert all(codecs.may_contain(got, k) for k in keys)
            rows.append((int(pdf["run"].iloc[0]), got["bits_per_key"], got["blocks"], got["k"], len(raw)))
        return pd.DataFrame(rows, columns=["run", "bits_per_key", "blocks", "k", "stored"])

    keys = schema.oplog(spark, sf_dir).select("run", "k").distinct()
    return keys.groupBy("run").applyInPandas(one, "run int, bits_per_key int, blocks long, k long, stored long")


@register("bloom_format_errors", "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 1 THEN 'TooShort' WHEN 2 THEN 'CrcMismatch' WHEN 3 THEN 'BadHashVersion' WHEN 4 THEN 'Malformed' END AS err FROM orders")
def _bloom_errors(spark, sf_dir):
    whole = codecs.build_filter([b"a", b"b"])
    raw = codecs.encode_filter(whole)
    damaged = [raw, raw[:20], raw[:-1] + bytes([raw[-1] ^ 1]), codecs.encode_filter(whole | {"hash_version": 7}), codecs.encode_filter(whole | {"blocks": 5})]
    ids = schema.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return codecs.decoded(codecs.encoded(ids, ["id"], lambda i: damaged[i % 5]), lambda x: (codecs.decode_filter(x)["k"],), "k long").select("id", "err")


@register("bloom_false_positives", OPLOG + "SELECT run, 0::BIGINT AS missed, true AS rate_below_5_percent FROM oplog GROUP BY run")
def _false_positives(spark, sf_dir):
    """No key of a run is denied; of 2,000 others less than one in twenty passes."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [k.encode() for k in pdf["k"]]
        sketch = codecs.build_filter(keys)
        missed = sum(not codecs.may_contain(sketch, k) for k in keys)
        rate = sum(codecs.may_contain(sketch, f"absent-{i}".encode()) for i in range(2000)) / 2000
        return pd.DataFrame({"run": [int(pdf["run"].iloc[0])], "missed": [missed], "rate_below_5_percent": [rate < 0.05]})

    keys = schema.oplog(spark, sf_dir).select("run", "k").distinct()
    return keys.groupBy("run").applyInPandas(one, "run int, missed long, rate_below_5_percent boolean")


_EDITS = "src AS (SELECT o_orderkey // 10 AS edit_no, list({n: o_orderkey, l: o_orderkey % 3, a: 'a' || o_custkey, b: 'b' || o_custkey} ORDER BY o_orderkey) AS adds, list(o_orderkey - 15 ORDER BY o_orderkey) FILTER (o_orderkey % 3 = 0 AND o_orderkey >= 15) AS gone FROM orders GROUP BY ALL)"
_ADDED = f"list_aggregate(list_transform(adds, lambda f: {le('f.n', 8)} || {le('f.l', 4)} || {text('f.a')} || {text('f.b')}), 'string_agg', '')"
_GONE = f"coalesce(list_aggregate(list_transform(gone, lambda d: {le('d', 8)}), 'string_agg', ''), '')"


def _edit_rows(spark, sf_dir):
    o = schema.table(spark, sf_dir, "orders")
    added = F.sort_array(F.collect_list(F.struct("o_orderkey", F.expr("int(o_orderkey % 3)"), F.expr("concat('a', o_custkey)"), F.expr("concat('b', o_custkey)"))))
    gone = F.sort_array(F.collect_list(F.expr("if(o_orderkey % 3 = 0 and o_orderkey >= 15, o_orderkey - 15, null)")))
    return o.groupBy(F.expr("o_orderkey div 10").alias("edit_no")).agg(added.alias("added"), gone.alias("deleted"))  # ten orders an edit


def _edit_bytes(added, deleted) -> bytes:
    files = [{"number": n, "level": lv, "min_key": a.encode(), "max_key": b.encode()} for n, lv, a, b in (tuple(f.values()) if isinstance(f, dict) else tuple(f) for f in added)]
    return codecs.encode_edit({"added": files, "deleted": list(map(int, deleted))})


@register("manifest_encode", framed(f"WITH {_EDITS}", "edit_no", f"{le('len(adds)', 4)} || {_ADDED} || {le('coalesce(len(gone), 0)', 4)} || {_GONE}"))
def _manifest_encode(spark, sf_dir):
    return codecs.encoded(_edit_rows(spark, sf_dir), ["added", "deleted"], _edit_bytes).select("edit_no", F.hex("raw").alias("raw"))


@register("manifest_decode", f"WITH {_EDITS} SELECT edit_no, CASE WHEN edit_no % 4 IN (1, 2) THEN NULL ELSE len(adds) END AS added, CASE WHEN edit_no % 4 IN (1, 2) THEN NULL ELSE coalesce(len(gone), 0) END AS deleted, CASE WHEN edit_no % 4 IN (1, 2) THEN NULL ELSE (SELECT max(o_orderkey) FROM orders WHERE o_orderkey // 10 = edit_no) + 1 END AS next_number, CASE edit_no % 4 WHEN 1 THEN 'Incomplete' WHEN 2 THEN 'CrcMismatch' END AS err FROM src")
def _manifest_decode(spark, sf_dir):
    """Edits read back; a torn or damaged one counts as absent and names its error."""

    def damaged(edit_no, added, deleted) -> bytes:
        raw = _edit_bytes(added, deleted)
        return raw[:-3] if edit_no % 4 == 1 else raw[:-1] + bytes([raw[-1] ^ 8]) if edit_no % 4 == 2 else raw

    def one(raw: bytes) -> tuple:
        edits, _, why = codecs.decode_edits(raw)
        if why:
            raise codecs.DecodeFailed(why)
        return len(edits[0]["added"]), len(edits[0]["deleted"]), 1 + max(f["number"] for f in edits[0]["added"])

    rows = codecs.encoded(_edit_rows(spark, sf_dir), ["edit_no", "added", "deleted"], damaged).select("edit_no", "raw")
    return codecs.decoded(rows, one, "added long, deleted long, next_number long")


@register("snapshot_files", f"WITH {_RUNS} SELECT run, count(*) AS entries, min(k) AS min_key, max(k) AS max_key FROM r GROUP BY run")
def _snapshot(spark, sf_dir):
    """Table files packed into one checked blob a run, unpacked and opened again."""
    tables = TableFiles(_runs(spark, sf_dir))
    return tables.unpacked(tables.packed()).groupBy("run").agg(F.sum("n").alias("entries"), F.min("first").cast("string").alias("min_key"), F.max("last").cast("string").alias("max_key"))


_CMD = f"{_OP} || {text('k')} || {text('v')}"


@register("command_encode", OPLOG + f"SELECT seq, {_CMD} AS raw FROM oplog")
def _command_encode(spark, sf_dir):
    log = schema.oplog(spark, sf_dir).select("seq", "op", "k", "v")
    return codecs.encoded(log, ["op", "k", "v"], lambda op, k, v: codecs.encode_command(op, k.encode(), (v or "").encode())).select("seq", F.hex("raw").alias("raw"))


_CUT = {1: "Short", 2: "Truncated", 3: "TrailingBytes", 4: "UnknownOp"}


@register("command_decode", OPLOG + "SELECT seq, CASE WHEN seq % 10 IN (1, 2, 3, 4) THEN NULL ELSE op END AS op, CASE WHEN seq % 10 IN (1, 2, 3, 4) THEN NULL ELSE k END AS k, CASE seq % 10 " + " ".join(f"WHEN {n} THEN '{e}'" for n, e in _CUT.items()) + " END AS err FROM oplog")
def _command_decode(spark, sf_dir):
    def damaged(seq: int, op: str, k: str, v: str | None) -> bytes:
        raw = codecs.encode_command(op, k.encode(), (v or "").encode())
        return {"Short": raw[:4], "Truncated": raw[:-1], "TrailingBytes": raw + b"!", "UnknownOp": b"\x07" + raw[1:], None: raw}[_CUT.get(seq % 10)]

    raw = codecs.encoded(schema.oplog(spark, sf_dir).select("seq", "op", "k", "v"), ["seq", "op", "k", "v"], damaged).select("seq", "raw")
    got = codecs.decoded(raw, lambda x: codecs.decode_command(x)[:2], "op string, key binary")
    return got.select("seq", "op", F.col("key").cast("string").alias("k"), "err")


_ENTRY = f"{le('1 + seq // 100', 8)} || {le('seq + 1', 8)} || {le('length(c) // 2', 4)} || c"


@register("raft_entry_encode", framed(OPLOG + f", src AS (SELECT *, {_CMD} AS c FROM oplog)", "seq", _ENTRY))
def _raft_entry(spark, sf_dir):
    def one(seq: int, op: str, k: str, v: str | None) -> bytes:
        return codecs.encode_raft_entry(1 + seq // 100, seq + 1, codecs.encode_command(op, k.encode(), (v or "").encode()))

    rows = codecs.encoded(schema.oplog(spark, sf_dir).select("seq", "op", "k", "v"), ["seq", "op", "k", "v"], one)
    return rows.select("seq", F.hex("raw").alias("raw"))


_LOGS = "WITH e AS (SELECT event_id // 100 AS log, event_id % 100 AS n FROM events), c AS (SELECT log, count(*) AS n FROM e GROUP BY log)"


@register("raft_log_replay", _LOGS + " SELECT log, CASE log % 4 WHEN 1 THEN n - 1 WHEN 2 THEN 0 WHEN 3 THEN NULL ELSE n END AS entries, CASE WHEN log % 4 = 3 THEN 'OutOfSequence' END AS err FROM c WHERE n > 50")
def _log_replay(spark, sf_dir):
    """Log files of 100 entries: whole, torn in the last, stale beside their snapshot, and with a gap."""
    import pandas as pd

    def one(log: int, n: int) -> tuple:
        skip = {2: 5, 3: 0}.get(log % 4, 0)
        entries = [codecs.encode_raft_entry(1, skip + i + 1 + (log % 4 == 3 and i > 40), b"c") for i in range(n)]
        raw = b"".join(entries)[: -1 if log % 4 == 1 else None]
        try:
            return log, len(codecs.replay_raft_log(raw)[0]), None
        except codecs.DecodeFailed as error:
            return log, None, error.args[0]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([one(int(log), int(n)) for log, n in zip(pdf["log"], pdf["n"])], columns=["log", "entries", "err"]).astype({"entries": "Int64"})

    rows = schema.table(spark, sf_dir, "events").select(F.expr("event_id div 100").alias("log"))
    big = rows.groupBy("log").agg(F.count(F.lit(1)).alias("n")).where("n > 50")
    # two numbers a log are a small shuffle, but a log takes milliseconds: the number of tasks must not go by bytes
    return big.repartition(4 * spark.sparkContext.defaultParallelism, "log").mapInPandas(run, "log long, entries long, err string")


@register("raft_snapshot_codec", "SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS term, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS data, CASE o_orderkey % 3 WHEN 1 THEN 'CrcMismatch' WHEN 2 THEN 'Incomplete' END AS err FROM orders")
def _raft_snapshot(spark, sf_dir):
    def damaged(idx: int, term: int, data: str) -> bytes:
        raw = codecs.encode_snapshot(idx, term, data.encode())
        return [raw, raw[:-1] + b"\0", raw[:-1]][idx % 3]

    rows = schema.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    raw = codecs.encoded(rows, rows.columns, damaged).select(F.col("o_orderkey").alias("idx"), "raw")

    def read(x: bytes) -> tuple:
        got = codecs.decode_snapshot(x)
        return got["term"], got["data"]

    return codecs.decoded(raw, read, "term long, data binary").withColumn("data", F.col("data").cast("string"))


@register("raft_hard_state", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN o_custkey WHEN 1 THEN 0 END AS term, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 5 WHEN 1 THEN 0 END AS voted_for, CASE o_orderkey % 4 WHEN 2 THEN 'BadLength' WHEN 3 THEN 'CrcMismatch' END AS err FROM orders")
def _hard_state(spark, sf_dir):
    def damaged(i: int, term: int) -> bytes:
        raw = codecs.encode_hard_state(term, i % 5)
        return [raw, b"", raw[:-1], raw[:-1] + bytes([raw[-1] ^ 1])][i % 4]

    rows = schema.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    raw = codecs.encoded(rows, rows.columns, damaged).select(F.col("o_orderkey").alias("id"), "raw")
    # an empty value stands for a missing file
    return codecs.decoded(raw, lambda x: tuple(codecs.decode_hard_state(x or None).values()), "term long, voted_for long")


@register("message_codec", "SELECT o_orderkey AS id, CASE 1 + o_orderkey % 5 WHEN 1 THEN 'vote-req' WHEN 2 THEN 'vote-resp' WHEN 3 THEN 'app-req' WHEN 4 THEN 'app-resp' ELSE 'snap' END AS type, o_custkey % 5 AS sender, o_custkey AS term, o_orderkey % 2 = 0 AS granted, o_orderkey % 3 AS entries, length(o_orderpriority) AS snapshot_bytes, 8 + 115 + (o_orderkey % 3) * 23 + length(o_orderpriority) AS bytes FROM orders")
def _message(spark, sf_dir):
    numbers = [n for n, kind in codecs.MESSAGE if kind == "u64"]

    def one(i: int, customer: int, priority: str) -> bytes:
        entries = [{"term": customer, "idx": i + j, "cmd": b"cmd"} for j in range(i % 3)]
        fields = dict.fromkeys(numbers, 7) | {"type": 1 + i % 5, "sender": customer % 5, "term": customer, "granted": i % 2 == 0, "success": True}
        return codecs.encode_message(fields | {"entries": entries, "snapshot": priority.encode()})

    def read(x: bytes) -> tuple:
        got, end = codecs.decode_message(x)
        return codecs.MESSAGE_TYPES[got["type"]], got["sender"], got["term"], got["granted"], len(got["entries"]), len(got["snapshot"]), end

    rows = schema.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    raw = codecs.encoded(rows, rows.columns, one).select(F.col("o_orderkey").alias("id"), "raw")
    return codecs.decoded(raw, read, "type string, sender long, term long, granted boolean, entries long, snapshot_bytes long, bytes long").drop("err")


@register("message_errors", "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'Incomplete' WHEN 1 THEN 'CrcMismatch' WHEN 2 THEN 'Truncated' WHEN 3 THEN 'TrailingBytes' ELSE 'BadLength' END AS err FROM orders")
def _message_errors(spark, sf_dir):
    numbers = [n for n, kind in codecs.MESSAGE if kind == "u64"]
    whole = codecs.encode_message(dict.fromkeys(numbers, 1) | {"type": 3, "granted": False, "success": False, "entries": [{"term": 1, "idx": 1, "cmd": b"abc"}], "snapshot": b"s"})
    body = whole[8:]
    bad = [whole[:-1], whole[:-1] + b"?", codecs.frame(body[:-3]), codecs.frame(body + b"!"), codecs.frame(b"short")]
    ids = schema.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return codecs.decoded(codecs.encoded(ids, ["id"], lambda i: bad[i % 5]), lambda x: (codecs.decode_message(x)[1],), "bytes long").select("id", "err")


@register("base64_codec", OPLOG + "SELECT seq, to_base64(encode(k || coalesce(v, ''))) AS coded, k || coalesce(v, '') AS back FROM oplog")
def _base64(spark, sf_dir):
    rows = schema.oplog(spark, sf_dir).select("seq", F.base64(F.concat("k", F.coalesce("v", F.lit(""))).cast("binary")).alias("coded"))
    return rows.withColumn("back", F.unbase64("coded").cast("string"))


@register("json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS none FROM events")
def _json(spark, sf_dir):
    return schema.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.none").alias("none"))


@register("json_round_trip", OPLOG + "SELECT seq, op, k, v FROM oplog")
def _json_round_trip(spark, sf_dir):
    """Operations as JSON request bodies and back; a null value is absent."""
    log = schema.oplog(spark, sf_dir)
    rows = log.select(F.to_json(F.struct("seq", "op", "k", "v")).alias("body"))
    return rows.select(F.from_json("body", "seq long, op string, k string, v string").alias("r")).select("r.*")


_PEERS = "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '1=a:7001,2=b:7002' WHEN 1 THEN c_custkey || '=h:' || c_custkey WHEN 2 THEN 'x=h:1' ELSE '5' END AS peers FROM customer"


@register("peer_lists", f"SELECT id, nullif(regexp_extract(p, '^([0-9]+)=(.+)$', 1), '')::BIGINT AS node, nullif(regexp_extract(p, '^([0-9]+)=(.+)$', 2), '') AS address, CASE WHEN NOT regexp_matches(p, '^[^=]+=.+$') THEN 'BadPeer' WHEN NOT regexp_matches(p, '^[0-9]+=') THEN 'BadId' END AS err FROM (SELECT id, unnest(string_split(peers, ',')) AS p FROM ({_PEERS}))")
def _peers(spark, sf_dir):
    """Peer lists like ``1=host:port,2=host:port``, a row a peer, with what is wrong with it."""
    c = schema.table(spark, sf_dir, "customer")
    lists = F.expr("case c_custkey % 4 when 0 then '1=a:7001,2=b:7002' when 1 then concat(c_custkey, '=h:', c_custkey) when 2 then 'x=h:1' else '5' end")
    rows = c.select(F.col("c_custkey").alias("id"), F.explode(F.split(lists, ",")).alias("p"))
    part = lambda i: F.nullif(F.regexp_extract("p", "^([0-9]+)=(.+)$", i), F.lit(""))
    err = F.when(~F.col("p").rlike("^[^=]+=.+$"), "BadPeer").when(~F.col("p").rlike("^[0-9]+="), "BadId")
    return rows.select("id", part(1).cast("long").alias("node"), part(2).alias("address"), err.alias("err"))
