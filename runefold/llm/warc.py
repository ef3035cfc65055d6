"""Operator 6: WARC archives as chunked record tables.

A record is a run of rows (record_id, chunk_no, data, payload_sha256): row 0 holds its WARC header, each further row at most
``CHUNK`` payload bytes and the digest of the payload up to and with that chunk, carried on from chunk to chunk. Readers
take the rows in that order and carry the digest on the same way, so neither side holds a record together; the data of a record's rows, one after another and closed by two line ends, is its WARC form.

Of records with equal payloads of at least ``LEAST`` bytes the one with the least key is a response; the others are
revisits, whose headers name digest, length and that response, and which carry no payload again.

Defined results: a null or empty payload is a response of 0 bytes; a null key is written as such, and is the response
of its group only if no key is there. URLs come back as they were, a null one as null. Very long payloads and URLs are written whole. Rows that repeat a key and a payload are all written; those that repeat the
least key of a group are all responses. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, new_path, stored

CHUNK = 64 << 10
LEAST = 100
#: Bytes of chunk rows that go to Spark together.
BATCH_BYTES = 1 << 20
_END = b"\r\n"

CHUNKS = "record_id string, chunk_no int, data binary, payload_sha256 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_SCHEMA = pa.schema([("record_id", pa.string()), ("chunk_no", pa.int32()), ("data", pa.binary()), ("payload_sha256", pa.string())])


def header(record_id: str, page_id: int | None, url: str | None, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """The header block of a record, up to and with its empty line."""
    target = quote(url, safe=":/?#[]@!$&'()*+,;=-._~") if url is not None else None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:record:{record_id}>"),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Page-ID", page_id),
        ("WARC-Payload-Length", size),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page", refers_to)]
    fields += [("Content-Type", "text/html"), ("Content-Length", 0 if revisit else size)]
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in fields if v is not None)]
    return _END.join(lines) + _END + _END


def parse_header(data: bytes) -> dict[str, str]:
    lines = data.split(_END)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC header")
    return dict(line.decode().split(": ", 1) for line in lines[1:] if line)


def chunk_rows(record_id: str, head: bytes, payload: memoryview) -> Iterator[tuple[str, int, bytes, str]]:
    digest = hashlib.sha256()
    yield record_id, 0, head, digest.hexdigest()
    for k, at in enumerate(range(0, len(payload), CHUNK)):
        part = payload[at : at + CHUNK]
        digest.update(part)
        yield record_id, k + 1, bytes(part), digest.hexdigest()


def write(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", path: str | None = None) -> str:
    """Write a record for each row; returns the table's path."""
    spark = df.sparkSession
    path = path or new_path(spark, "warc")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{url}`").alias("u"), F.encode(F.coalesce(F.col(f"`{payload}`"), F.lit("")), "UTF-8").alias("body"))
    rows = rows.withColumns({"size": F.octet_length("body").cast("long"), "digest": F.sha2("body", 256)})
    # keys and digests only; equal payloads meet as partial minimums
    narrow = rows.where(F.col("size") >= LEAST).select("k", "digest")
    firsts = narrow.groupBy("digest").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = narrow.join(firsts, "digest").where("not (k <=> first)").select(F.col("k").alias("k2"), F.col("digest").alias("d2"), "first").distinct()
    # by key, not by digest, so that a payload which many pages share spreads
    out = rows.join(later, F.col("k").eqNullSafe(F.col("k2")) & (F.col("digest") == F.col("d2")) & (F.col("size") >= LEAST), "left")
    out = out.select("k", "u", "size", "digest", "first", F.col("d2").isNotNull().alias("revisit"), "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0
        for batch in batches:
            keys, urls, sizes, digests, firsts, revisits = (batch.column(i).to_pylist() for i in range(6))
            for i, body in enumerate(batch.column(6)):
                record_id = f"{part:06d}-{n:010d}"
                n += 1
                head = header(record_id, keys[i], urls[i], sizes[i], digests[i], firsts[i], revisits[i])
                content = memoryview(b"") if revisits[i] else memoryview(body.as_buffer())
                for row in chunk_rows(record_id, head, content):
                    held.append(row)
                    size += len(row[2])
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r)) for r in held], _SCHEMA)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r)) for r in held], _SCHEMA)

    map_arrow(out, run, CHUNKS).write.option("compression", "zstd").parquet(path)
    return path


def read_chunks(spark, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of chunk rows in order; one that lacks rows here is named in ``broken`` instead."""
    from urllib.parse import unquote

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "broken"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    current, at, size, head, digest = None, -1, 0, None, hashlib.sha256()

    def finished() -> tuple:
        if head is None or size != int(head["Content-Length"]):
            return (None,) * 6 + (current,)
        found = head["WARC-Payload-Digest"].removeprefix("sha256:")
        if head["WARC-Type"] != "revisit" and digest.hexdigest() != found:
            raise ValueError(f"record {current} is damaged")
        page, to, url = head.get("WARC-Page-ID"), head.get("WARC-Refers-To-Page"), head.get("WARC-Target-URI")
        return (page and int(page), url and unquote(url), int(head["WARC-Payload-Length"]), found, head["WARC-Type"], to and int(to), None)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        done = []
        for record_id, number, data, carried in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
            if record_id != current:
                if current is not None:
                    done.append(finished())
                current, at, size, digest = record_id, number, 0, hashlib.sha256()
                head = parse_header(data.as_py()) if number == 0 else None
            elif head is not None:
                if number != at + 1:
                    head = None  # rows of a table that was dealt anew: the record is mended in the second reading
                else:
                    at = number
                    digest.update(data.as_buffer())
                    size += len(data.as_buffer())
            if head is not None and digest.hexdigest() != carried:
                raise ValueError(f"record {record_id}: chunk {number} is damaged")
        if done:
            yield pack(done)
    if current is not None:
        yield pack([finished()])


def records(spark, path: str) -> DataFrame:
    """One row for each record, its payload read through and checked against the carried digests.

    Files hold a record's rows together and in order, so they are read where they lie. Only records that the border of two
    scan tasks cuts are read again, dealt by record and sorted.
    """
    out = RECORDS + ", broken string"
    read = stored(map_arrow(read_chunks(spark, path), _read, out), "warc-records")
    whole = read.where("broken is null").drop("broken")
    cut = read.where("broken is not null").select(F.col("broken").alias("record_id")).distinct()
    if cut.isEmpty():
        return whole
    again = read_chunks(spark, path).join(cut, "record_id", "left_semi").repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    mended = map_arrow(again, _read, out)
    sound = F.when(F.col("broken").isNotNull(), F.raise_error(F.concat(F.lit("record is not whole: "), "broken"))).otherwise(F.lit(True))
    return whole.union(mended.where(sound.cast("boolean")).drop("broken"))
