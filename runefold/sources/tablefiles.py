"""Table files that are too large for one task: the format of ``codecs.write_table`` in pieces.

A run is cut by key into parts of about ``PART`` entries, packed in order and written once. Where a part's first block begins depends on
what the parts before it left open, so each part says for every such rest how many blocks it ends and what it leaves; these rows, one a
part, are put together by run. A piece is then the whole blocks that begin in a part, with their share of the index. The filter is
built in pieces of ``CHUNK`` blocks. In order, the pieces are the bytes of the file.

Equal keys in a run are all kept, in order of operation and value; a block does not end among them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions.checksum import crc32c, crc32c_joined
from ..functions.layout import DecodeFailed, pack, unpack
from .store import place

PART = 150_000
CHUNK = 4096

_PARTS = "run long, part int, n long, first_key binary, entries binary, ends binary, hashes binary, lead binary, limits array<long>, cuts array<long>, left array<long>"
_PIECES = "run long, part int, block int, at long, content binary, index binary"


class _Part:
    """Entries of a run that one task packs."""

    def __init__(self, run: int, part: int):
        self.run, self.part = run, part
        self.entries, self.sizes, self.new, self.hashes = bytearray(), [], [], []
        self.first = self.last = None

    def add(self, rows: pd.DataFrame) -> None:
        import xxhash

        for k, op, v in zip(rows["k"], rows["op"], rows["v"]):
            key = codecs._text(k)
            raw = codecs.encode_entry(op, key, None if v is None else codecs._text(v))
            self.entries += raw
            self.sizes.append(len(raw))
            self.new.append(key != self.last)
            self.hashes.append(xxhash.xxh3_64_intdigest(key))
            self.first = key if self.first is None else self.first
            self.last = key

    def row(self, target: int) -> pd.DataFrame:
        ends = np.cumsum(self.sizes)[np.array([*self.new[1:], True])]  # of the last entry of each key
        limits, cuts, left = chains(ends, target)
        lead = bytes(self.entries[: limits[-1]])
        raw = np.array(self.hashes, np.uint64).tobytes()
        values = (self.run, self.part, len(self.sizes), self.first, bytes(self.entries), ends.astype(np.int64).tobytes(), raw, lead, limits, cuts, left)
        return pd.DataFrame([values], columns=[f.split()[0] for f in _PARTS.split(", ")])


def chains(ends: np.ndarray, target: int) -> tuple[list[int], list[int], list[int]]:
    """For each place where a part's first block can end: the place, the blocks that end from there on, the bytes after the last."""
    at = np.arange(min(int(np.searchsorted(ends, target)), len(ends) - 1) + 1)
    limits, cuts, going = ends[at], np.ones(len(at), np.int64), np.arange(len(at))
    while len(going):
        after = np.searchsorted(ends, ends[at[going]] + target)
        going, after = going[after < len(ends)], after[after < len(ends)]
        at[going] = after
        cuts[going] += 1
    return limits.tolist(), cuts.tolist(), (ends[-1] - ends[at]).tolist()


def plan(parts: pd.DataFrame, target: int) -> pd.DataFrame:
    """run, part, skip, block, at, tail of a run's parts in which blocks begin: bytes that belong to an earlier block, number and offset
    of the first block of its own, bytes of its last block that lie in later parts."""
    rows, held, block, base = [], 0, 0, 0
    for p in parts.sort_values("part").itertuples():
        limits, lead = list(p.limits), bytes(p.lead)
        j = int(np.searchsorted(limits, target - held))
        ended = j < len(limits)
        skip = 0 if not held else limits[j] if ended else len(lead)
        if skip:
            rows[-1]["tail"].append(lead[:skip])
        left = p.left[j] if ended else held + len(lead)
        begun = (held == 0) + (p.cuts[j] - 1 + (left > 0) if ended else 0)
        if begun:
            rows.append({"run": p.run, "part": p.part, "skip": skip, "block": block, "at": base + skip, "tail": []})
        block, held, base = block + begun, left, base + p.size
    return pd.DataFrame([r | {"tail": b"".join(r["tail"])} for r in rows], columns=["run", "part", "skip", "block", "at", "tail"])


def _blocks(entries: bytes, ends: np.ndarray, skip: int, at: int, tail: bytes, target: int) -> tuple[bytes, bytes]:
    """The bytes of a part's blocks, and of their index entries."""
    content, ends = entries[skip:] + tail, ends[ends > skip] - skip
    index, start = [], 0
    while start < len(content):
        e = int(np.searchsorted(ends, start + target))
        stop = int(ends[e]) if e < len(ends) else len(content)
        (size,) = struct.unpack_from("<I", content, start)
        index.append(pack(codecs.INDEX, {"first_key": content[start + 4 : start + 4 + size], "offset": at + start, "size": stop - start}))
        start = stop
    return content, b"".join(index)


def index_entries(index: bytes) -> list[dict]:
    out, at = [], 0
    while at < len(index):
        entry, at = unpack(codecs.INDEX, index, at, "UnexpectedEof")
        out.append(entry)
    return out


class TableFiles:
    """A table file of each run of (run, k, op, v): ``pieces`` (run, part, block, at, content, index), ``filters`` (run, chunk, blocks, bits,
    crc) and ``feet`` (run, n, head, crc, foot), which are the filter's head and sum and the footer."""

    def __init__(self, runs: DataFrame, bits_per_key: int = 10, part: int = PART, chunk: int = CHUNK, target: int = codecs.BLOCK_TARGET):
        self.spark, self.bits_per_key, self.chunk = runs.sparkSession, max(1, bits_per_key), chunk
        rows = runs.select(F.col("run").cast("long").alias("run"), "k", "op", "v")
        parts = max(self.spark.sparkContext.defaultParallelism, -(-rows.count() // part))
        ordered = rows.repartitionByRange(parts, "run", "k").sortWithinPartitions("run", "k", "op", "v").withColumn("part", F.spark_partition_id())

        def packed(batches) -> Iterator[pd.DataFrame]:
            held = None
            for pdf in batches:
                for run, rows in pdf.groupby("run", sort=False):
                    if held is None or held.run != run:
                        if held is not None:
                            yield held.row(target)
                        held = _Part(int(run), int(rows["part"].iloc[0]))
                    held.add(rows)
            if held is not None:
                yield held.row(target)

        self._parts = self._stored(ordered.mapInPandas(packed, _PARTS), "entries")
        small = self._parts.select("run", "part", "lead", "limits", "cuts", "left", F.expr("octet_length(entries)").alias("size"))  # a row a part
        plans = small.groupBy("run").applyInPandas(lambda pdf: plan(pdf, target), "run long, part int, skip long, block int, at long, tail binary")
        self._sizes = self._parts.groupBy("run").agg(F.sum("n").alias("n"), F.sum(F.expr("octet_length(entries)")).alias("size"))  # a row a run

        def build(batches) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples():
                    content, index = _blocks(bytes(r.entries), np.frombuffer(r.ends, np.int64), r.skip, r.at, bytes(r.tail), target)
                    yield pd.DataFrame([(r.run, r.part, r.block, r.at, content, index)], columns=["run", "part", "block", "at", "content", "index"])

        joined = self._parts.select("run", "part", "entries", "ends").join(F.broadcast(plans), ["run", "part"])
        self.pieces = self._stored(joined.select("run", "part", "entries", "ends", "skip", "block", "at", "tail").mapInPandas(build, _PIECES), "blocks")
        self.filters = self._stored(self._filters(), "filters")
        self.feet = self._feet()

    def _stored(self, rows: DataFrame, name: str) -> DataFrame:
        at = place(self.spark, name)
        rows.write.parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def _filters(self) -> DataFrame:
        bits, chunk = self.bits_per_key, self.chunk

        def dealt(batches) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples():
                    blocks, h = codecs.filter_blocks(r.n, bits), np.frombuffer(r.hashes, np.uint64)
                    to = codecs.filter_places(h, blocks) // chunk
                    order = np.argsort(to, kind="stable")
                    found, first = np.unique(to[order], return_index=True)
                    yield pd.DataFrame([(r.run, int(c), blocks, x.tobytes()) for c, x in zip(found, np.split(h[order], first[1:]))], columns=["run", "chunk", "blocks", "hashes"])

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            number, blocks = int(pdf["chunk"].iloc[0]), int(pdf["blocks"].iloc[0])
            h = np.frombuffer(b"".join(map(bytes, pdf["hashes"])), np.uint64)
            raw = codecs.filter_bits(h, blocks, codecs.hashes_for(bits), number * chunk, min(blocks, (number + 1) * chunk))
            return pd.DataFrame([(int(pdf["run"].iloc[0]), number, blocks, raw, crc32c(raw))], columns=["run", "chunk", "blocks", "bits", "crc"])

        rows = self._parts.select("run", "hashes").join(F.broadcast(self._sizes.select("run", "n")), "run")
        schema = "run long, chunk long, blocks long, hashes binary"
        blocks = F.greatest(F.lit(1), F.expr(f"(n * {bits} + {codecs.BITS_IN_BLOCK - 1}) div {codecs.BITS_IN_BLOCK}"))
        every = self._sizes.select("run", blocks.cast("long").alias("blocks")).select("run", F.explode(F.expr(f"sequence(0L, (blocks - 1) div {chunk})")).alias("chunk"), "blocks", F.expr("cast('' as binary)").alias("hashes"))
        dealt_rows = rows.select("run", "n", "hashes").mapInPandas(dealt, schema).union(every)  # a piece without keys is zeros
        return dealt_rows.groupBy("run", "chunk", "blocks").applyInPandas(one, "run long, chunk long, blocks long, bits binary, crc long")

    def _feet(self) -> DataFrame:
        bits = self.bits_per_key
        sums = self.filters.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("chunk", "crc", F.octet_length("bits").alias("size")))).alias("s"), F.first("blocks").alias("blocks"))
        sums = sums.select("run", "blocks", F.col("s.crc").alias("crcs"), F.col("s.size").alias("sizes"))
        index = self.pieces.groupBy("run").agg(F.sum(F.octet_length("index")).alias("index_size"))

        def foot(batches) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for r in pdf.itertuples():
                    head = pack(codecs.FILTER, {"k": codecs.hashes_for(bits), "blocks": r.blocks, "bits_per_key": bits, "hash_version": codecs.HASH_VERSION, "bits": b""})
                    crc = crc32c(head)
                    for c, n in zip(r.crcs, r.sizes):
                        crc = crc32c_joined(crc, int(c), int(n))
                    size = len(head) + r.blocks * codecs.BITS_IN_BLOCK // 8 + 4
                    where = {"index_offset": r.size + size, "index_size": r.index_size, "filter_offset": r.size, "filter_size": size}
                    rows.append((r.run, r.n, head, struct.pack("<I", crc), pack(codecs.FOOTER, where | {"magic": codecs.MAGIC, "version": codecs.VERSION})))
                yield pd.DataFrame(rows, columns=["run", "n", "head", "crc", "foot"])

        rows = self._sizes.join(sums, "run").join(index, "run").select("run", "n", "size", "blocks", "crcs", "sizes", "index_size")
        return rows.mapInPandas(foot, "run long, n long, head binary, crc binary, foot binary")

    def _begins(self) -> DataFrame:
        """run, part, first_key of each piece."""

        def run(batches) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"run": pdf["run"], "part": pdf["part"], "first_key": [unpack(codecs.INDEX, bytes(x))[0]["first_key"] for x in pdf["index"]]})

        return self.pieces.select("run", "part", "index").mapInPandas(run, "run long, part int, first_key binary")

    def opened(self) -> DataFrame:
        """``pieces`` whose footers are sound and say where the index is."""
        return self.pieces.join(F.broadcast(self.feet.select("run", "foot")), "run")  # a row a run

    def index(self) -> DataFrame:
        """run, block, first_key, offset, size: the sparse index of each file."""

        def run(batches) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples():
                    codecs.decode_footer(bytes(r.foot))
                    rows = [(r.run, r.block + i, e["first_key"], e["offset"], e["size"]) for i, e in enumerate(index_entries(bytes(r.index)))]
                    yield pd.DataFrame(rows, columns=["run", "block", "first_key", "offset", "size"])

        return self.opened().select("run", "block", "index", "foot").mapInPandas(run, "run long, block int, first_key binary, offset long, size long")

    def scan(self) -> DataFrame:
        """run, block, n, op, k, v of all entries."""

        def run(batches) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples():
                    codecs.decode_footer(bytes(r.foot))
                    content, rows = bytes(r.content), []
                    for i, e in enumerate(index_entries(bytes(r.index))):
                        start = e["offset"] - r.at
                        rows += [(r.run, r.block + i, n, op, k, v) for n, (op, k, v) in enumerate(codecs.decode_block(content[start : start + e["size"]]))]
                    yield pd.DataFrame(rows, columns=["run", "block", "n", "op", "k", "v"])

        return self.opened().select("run", "block", "at", "content", "index", "foot").mapInPandas(run, "run long, block int, n int, op string, k binary, v binary")

    def probe(self, keys: list[str]) -> DataFrame:
        """run, k, op, v, reads of ``keys`` (an argument, not data) in each file: op is null for unknown keys, reads counts blocks.

        A key is asked of the one piece of the filter that its block is in, then of the one block that can hold it.
        """
        bits, chunk = self.bits_per_key, self.chunk
        asked = [k.encode() for k in keys]

        def may(batches) -> Iterator[pd.DataFrame]:
            import xxhash

            h = np.array([xxhash.xxh3_64_intdigest(k) for k in asked], np.uint64)
            for pdf in batches:
                for r in pdf.itertuples():
                    raw = bytes(r.bits)
                    if crc32c(raw) != r.crc:
                        raise DecodeFailed("CrcMismatch")
                    here = np.flatnonzero(codecs.filter_places(h, r.blocks) // chunk == r.chunk)
                    sketch = {"bits": raw, "blocks": r.blocks, "k": codecs.hashes_for(bits)}
                    passed = [asked[i] for i in here if codecs.may_contain(sketch, asked[i], r.chunk * chunk)]
                    yield pd.DataFrame({"run": r.run, "key": passed})

        passed = self.filters.mapInPandas(may, "run long, key binary")
        owners = passed.join(F.broadcast(self._begins()), "run").where("first_key <= key").groupBy("run", "key").agg(F.max_by("part", "first_key").alias("part"))
        wanted = owners.groupBy("run", "part").agg(F.collect_list("key").alias("keys"))  # of the keys asked only

        def read(batches) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for r in pdf.itertuples():
                    codecs.decode_footer(bytes(r.foot))
                    content, index = bytes(r.content), index_entries(bytes(r.index))
                    first = np.array([e["first_key"] for e in index], object)
                    for key in map(bytes, r.keys):
                        e = index[int(np.searchsorted(first, key, "right")) - 1]
                        start = e["offset"] - r.at
                        found = [(op, v) for op, k, v in codecs.decode_block(content[start : start + e["size"]]) if k == key]
                        rows += [(r.run, key.decode(), op, v, 1) for op, v in found or [(None, None)]]
                yield pd.DataFrame(rows, columns=["run", "k", "op", "v", "reads"])

        hit = self.opened().join(F.broadcast(wanted), ["run", "part"]).select("run", "at", "content", "index", "foot", "keys").mapInPandas(read, "run long, k string, op string, v binary, reads long")
        every = self._sizes.select("run", F.explode(F.array(*map(F.lit, keys))).alias("k"))
        return every.join(F.broadcast(hit), ["run", "k"], "left").select("run", "k", "op", "v", F.coalesce("reads", F.lit(0)).cast("long").alias("reads"))

    def _shares(self, kind: int) -> DataFrame:
        """run, kind, number, raw: the bytes of the files in order of kind (blocks, filter, index, footer) and number."""
        if kind == 1:
            head = self.feet.select("run", F.lit(1).alias("kind"), F.lit(-1).cast("long").alias("number"), F.col("head").alias("raw"))
            end = self.feet.select("run", F.lit(1), F.lit(1 << 62).cast("long"), "crc")
            return head.union(self.filters.select("run", F.lit(1), "chunk", "bits")).union(end)
        if kind == 3:
            return self.feet.select("run", F.lit(3).alias("kind"), F.lit(0).cast("long").alias("number"), F.col("foot").alias("raw"))
        return self.pieces.select("run", F.lit(kind).alias("kind"), F.col("part").cast("long").alias("number"), F.col("index" if kind else "content").alias("raw"))

    def files(self) -> DataFrame:
        """run, kind, number, raw: all bytes of the files; in order of kind and number they are what ``codecs.write_table`` writes."""
        return self._shares(0).union(self._shares(1)).union(self._shares(2)).union(self._shares(3))

    def packed(self) -> DataFrame:
        """run, size, crc of a checked blob of each file, as ``codecs.pack_files`` makes it; the blob's bytes are ``files``."""

        def sums(batches) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"run": pdf["run"], "kind": pdf["kind"], "number": pdf["number"], "size": pdf["raw"].map(len), "crc": [crc32c(bytes(x)) for x in pdf["raw"]]})

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, run = pdf.sort_values(["kind", "number"]), int(pdf["run"].iloc[0])
            size = int(pdf["size"].sum())
            crc = crc32c(struct.pack("<QQ", run, size))
            for c, n in zip(pdf["crc"], pdf["size"]):
                crc = crc32c_joined(crc, int(c), int(n))
            return pd.DataFrame({"run": [run], "size": [size], "crc": [crc]})

        return self.files().mapInPandas(sums, "run long, kind int, number long, size long, crc long").groupBy("run").applyInPandas(one, "run long, size long, crc long")

    def unpacked(self, blobs: DataFrame) -> DataFrame:
        """run, part, n, first, last: entries, least and greatest key of each piece of files whose blobs (run, size, crc) are sound."""
        again = self.packed().select("run", F.col("size").alias("__size"), F.col("crc").alias("__crc"))
        sound = blobs.join(again, "run").select("run", F.when(F.expr("size = __size and crc = __crc"), "run").otherwise(F.raise_error(F.lit("CrcMismatch"))).alias("sound"))

        def run(batches) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples():
                    codecs.decode_footer(bytes(r.foot))
                    keys = [k for _, k, _ in codecs.decode_block(bytes(r.content))]
                    yield pd.DataFrame([(r.run, r.part, len(keys), keys[0], keys[-1])], columns=["run", "part", "n", "first", "last"])

        rows = self.opened().join(F.broadcast(sound.where("sound is not null")), "run").select("run", "part", "content", "foot")
        return rows.mapInPandas(run, "run long, part int, n long, first binary, last binary")
