"""Operator 2: token-id files in patched frame-of-reference blocks.

A segment (one row of the written table, at most about ``SEGMENT_TOKENS`` ids unless one document is longer) is:

    magic "RFP1", documents u32, ids u32, blocks u32, ids of the shard before it u64
    null flag of each document u8, doc_id i64, ids of each document u32
    start of each block in the data area u32              (the block index)
    blocks of 128 ids: minimum u32, width u8, exceptions u8, 16 * width bytes of packed offsets,
                       place u8 of each exception, whole offset u32 of each exception

Offsets are ids less the block's minimum. The width is the bit length that the ``PERCENTILE`` of the block's
offsets fits in; larger offsets are exceptions. A last block that is not full is filled up with its minimum.

Documents are written in ascending doc_id order: the table is range-partitioned, a partition is a shard, and shards
follow one another. Null ids come first; rows with the same id follow the order of their texts. Null and empty
texts hold the end id alone. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _Slots, blocks, gather, latin_classes
from .common import map_arrow, new_path, string_buffer

MAGIC = b"RFP1"
BLOCK = 128
PERCENTILE = 0.9
SEGMENT_TOKENS = 1 << 18
#: Text bytes that are tokenized together.
TEXT_BYTES = 6 << 20
#: Words whose ids a task keeps from one block to the next, and lines that the library encodes at a time.
KNOWN_WORDS = 800_000
LINES = 32
_HEAD = struct.Struct("<4sIIIQ")

SEGMENTS = "shard int, segment int, n_docs long, n_tokens long, data binary"
DOCUMENTS = "shard int, doc_id long, place long, n_tokens long, ids_crc32 long"


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit length of each unsigned value."""
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.uint8) + np.uint8(1), np.uint8(0))


_BITS16 = _bits(np.arange(1 << 16, dtype=np.uint64))


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """Block starts and block data of unsigned 32-bit ids."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint32), b""
    count = -(-n // BLOCK)
    grid = np.empty(count * BLOCK, np.uint64)
    grid[:n] = ids
    grid[n:] = ids[(count - 1) * BLOCK :].min()
    grid = grid.reshape(count, BLOCK)
    low = grid.min(1)
    grid = grid - low[:, None]
    need = _BITS16[grid] if grid.max() < 1 << 16 else _bits(grid)
    # how many offsets of a block fit in each width; the width is the least that the percentile fits in
    fit = np.bincount((np.arange(count)[:, None] * 33 + need).ravel(), minlength=33 * count).reshape(count, 33).cumsum(1)
    width = (fit < np.ceil(percentile * BLOCK)).sum(1)
    patched = need > width[:, None]
    exceptions = patched.sum(1)
    sizes = 6 + 16 * width + 5 * exceptions
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[(starts[:, None] + np.arange(4)).ravel()] = low.astype("<u4").view(np.uint8)
    out[starts + 4] = width
    out[starts + 5] = exceptions
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        values = np.ascontiguousarray((grid[rows] & np.uint64((1 << w) - 1)).T)
        words = np.zeros((2 * w, len(rows)), np.uint64)
        for j in range(BLOCK):
            word, shift = divmod(j * w, 64)
            words[word] |= values[j] << np.uint64(shift)
            if shift + w > 64:
                words[word + 1] |= values[j] >> np.uint64(64 - shift)
        packed = np.ascontiguousarray(words.T).view(np.uint8)
        out[(starts[rows] + 6)[:, None] + np.arange(16 * w)] = packed
    row, place = np.nonzero(patched)
    if len(row):
        nth = np.arange(len(row)) - (np.cumsum(exceptions) - exceptions)[row]
        at = (starts + 6 + 16 * width)[row]
        out[at + nth] = place
        at = at + exceptions[row] + 4 * nth
        out[(at[:, None] + np.arange(4)).ravel()] = grid[row, place].astype("<u4").view(np.uint8)
    return starts.astype(np.uint32), out.tobytes()


def unpack(starts: np.ndarray, data: bytes) -> np.ndarray:
    """All ids of the blocks at ``starts``, fillers included; any subset of the block index will do."""
    count = len(starts)
    raw = np.frombuffer(data, np.uint8)
    starts = starts.astype(np.int64)
    low = raw[starts[:, None] + np.arange(4)].copy().view("<u4").ravel().astype(np.uint64)
    width, exceptions = raw[starts + 4].astype(np.int64), raw[starts + 5].astype(np.int64)
    grid = np.zeros((count, BLOCK), np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        packed = raw[(starts[rows] + 6)[:, None] + np.arange(16 * w)]
        words = np.ascontiguousarray(packed.view("<u8").T)
        values = np.empty((BLOCK, len(rows)), np.uint64)
        for j in range(BLOCK):
            word, shift = divmod(j * w, 64)
            values[j] = words[word] >> np.uint64(shift)
            if shift + w > 64:
                values[j] |= words[word + 1] << np.uint64(64 - shift)
        grid[rows] = values.T & np.uint64((1 << w) - 1)
    row = np.repeat(np.arange(count), exceptions)
    if len(row):
        nth = np.arange(len(row)) - (np.cumsum(exceptions) - exceptions)[row]
        at = (starts + 6 + 16 * width)[row]
        place = raw[at + nth].astype(np.int64)
        at = at + exceptions[row] + 4 * nth
        grid[row, place] = raw[at[:, None] + np.arange(4)].copy().view("<u4").ravel()
    return (grid + low[:, None]).astype(np.uint32).ravel()


def write_segment(doc_ids: list[int | None], lens: np.ndarray, ids: np.ndarray, before: int) -> bytes:
    starts, data = pack(ids)
    return b"".join(
        (
            _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(starts), before),
            np.array([x is None for x in doc_ids], np.uint8).tobytes(),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            lens.astype("<u4").tobytes(),
            starts.astype("<u4").tobytes(),
            data,
        )
    )


class Segment:
    """Reader of one segment; ``ids(a, b)`` unpacks only the blocks that hold those places."""

    def __init__(self, raw: bytes):
        magic, docs, self.n, count, self.before = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token-id segment")
        at = _HEAD.size
        null = np.frombuffer(raw, np.uint8, docs, at)
        at += docs
        self.doc_ids = [None if m else x for m, x in zip(null.tolist(), np.frombuffer(raw, "<i8", docs, at).tolist())]
        at += 8 * docs
        self.lens = np.frombuffer(raw, "<u4", docs, at).astype(np.int64)
        at += 4 * docs
        self.starts = np.frombuffer(raw, "<u4", count, at)
        self.data = raw[at + 4 * count :]

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        last = self.n if last is None else last
        if first >= last:
            return np.zeros(0, np.uint32)
        a = first // BLOCK
        return unpack(self.starts[a : -(-last // BLOCK)], self.data)[first - a * BLOCK : last - a * BLOCK]


class WordTokenizer:
    """Ids of texts by the tokenizers library, which sees each distinct word of a block once.

    The vocabulary's words end at white space and at changes between letters, digits and other signs, and its
    normaliser does not look beyond a letter. So a Latin-1 text is split into words here and distinct words are
    encoded together; ids of tokens that end a word tell the words apart. Any other text, and one that may hold a
    special token's string, goes to the library as it is.
    """

    def __init__(self, content: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        letters, numbers, space = latin_classes()
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")
        # Latin-1 letters whose lower case is not one Latin-1 letter, or whose composed form differs, take the plain way
        self.odd = "".join(c for c in map(chr, range(256)) if unicodedata.normalize("NFC", c) != c or len(c.lower()) != 1)
        ends = np.zeros(self.library.get_vocab_size(True) + 1, bool)
        for token, i in self.library.get_vocab(True).items():
            ends[i] = token.endswith("</w>")
        self.ends = ends
        self.forget()

    def forget(self) -> None:
        self.slots = _Slots()
        self.ids, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for i in range(0, len(texts), LINES):
            out += [np.array(x.ids, np.int32) for x in self.library.encode_batch_fast(texts[i : i + LINES], add_special_tokens=False)]
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lines = [" ".join(words[i : i + 512]) for i in range(0, len(words), 512)]
        parts = self.plain(lines)
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        closing = np.flatnonzero(self.ends[ids])
        lens = np.diff(np.append(-1, closing))
        if len(lens) != len(words) or int(lens.sum()) != len(ids):
            raise ValueError("the vocabulary does not mark the ends of words")
        return ids, lens

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.slots) > KNOWN_WORDS:
            self.forget()
        slots, known, uses, plain = self.slots, len(self.slots), [], []
        for k, text in enumerate(texts):
            try:
                text.encode("latin-1")
                if "<|" in text:
                    raise ValueError
                pieces = self.words.findall(text.lower())
                uses.append(np.fromiter(map(slots.__getitem__, pieces), np.int32, len(pieces)))
            except ValueError:  # UnicodeEncodeError is one
                plain.append(k)
                uses.append(None)
        ids, lens = self.encode_words(list(islice(slots, known, None)))
        self.ids, self.lens = np.concatenate([self.ids, ids]), np.concatenate([self.lens, lens])
        starts = np.cumsum(self.lens) - self.lens
        out = [None if u is None else gather(u, self.ids, self.lens, starts) for u in uses]
        for k, made in zip(plain, self.plain([texts[k] for k in plain])):
            out[k] = made
        return out


@lru_cache(maxsize=1)
def _tokenizer(content: str) -> WordTokenizer:
    return WordTokenizer(content)


def write(df: DataFrame, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> str:
    """Write the token ids of every text, each followed by ``end_id``, in ascending id order; returns the path."""
    spark = df.sparkSession
    path = path or new_path(spark, "token-ids")
    with open(vocabulary, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())  # a vocabulary file, under 2 MB
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(content.value)
        shard, segment, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, segment, before
            ids = np.concatenate([x for _, x in held])
            data = write_segment([k for k, _ in held], np.array([len(x) for _, x in held]), ids, before)
            row = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([len(held)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())],
                names=["shard", "segment", "n_docs", "n_tokens", "data"],
            )
            held, size, segment, before = [], 0, segment + 1, before + len(ids)
            return row

        for batch in batches:
            keys = batch.column(0).to_pylist()
            _, bounds = string_buffer(batch.column(1))
            for first, last in blocks(bounds, TEXT_BYTES):
                texts = [x or "" for x in batch.column(1).slice(first, last - first).to_pylist()]
                for key, ids in zip(keys[first:last], tokenizer.texts(texts)):
                    if held and size + len(ids) + 1 > SEGMENT_TOKENS:
                        yield flush()
                    held.append((key, np.append(ids, end_id)))
                    size += len(ids) + 1
        if held:
            yield flush()

    map_arrow(rows, run, SEGMENTS).write.option("compression", "none").parquet(path)
    return path


def read_segments(spark, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(path)


def read_documents(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document in the files.

    Shard totals (one row a shard) are added up in order; every id is unpacked on the executors.
    """
    segments = read_segments(spark, path)
    totals = segments.groupBy("shard").agg(F.sum("n_tokens").alias("__n"))
    running = F.sum("__n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("shard", F.coalesce(running, F.lit(0)).alias("__base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                segment = Segment(raw.as_py())
                ids = segment.ids().astype("<u4")
                ends = np.cumsum(segment.lens)
                starts = ends - segment.lens
                view = memoryview(ids.tobytes())
                crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n, pa.int32()), pa.array(segment.doc_ids, pa.int64()), pa.array(starts + segment.before), pa.array(segment.lens), pa.array(crcs, pa.int64())],
                    names=["shard", "doc_id", "place", "n_tokens", "ids_crc32"],
                )

    rows = map_arrow(segments.select("shard", "data"), run, DOCUMENTS)
    return rows.join(bases, "shard").select("doc_id", (F.col("place") + F.col("__base")).alias("start"), "n_tokens", "ids_crc32")
