"""Operator 3: telephony audio columns.

G.711 mu-law and A-law codes are expanded by lookup tables built from their segment rule; IMA ADPCM blocks are decoded
with numpy, one sample step at a time for all blocks of many files together. PCM is resampled by a windowed-sinc filter and
stored as 16-bit little-endian samples; features are computed from the stored samples.

Defined results: a null or empty payload is one block of 64 zero codes; equal payloads have equal stored forms and
features, whatever row they are in; repeated rows give repeated rows. A null file has null facts, samples and features; one
that is no mono WAVE file of a known codec raises an error. Very long payloads are one file and are decoded as a whole. An
empty table gives an empty table. Columns that would clash with new ones raise an error; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, map_arrow, map_text, stored, string_buffer

RATE = 8000
PAD = 64
#: Codecs of texts that are stored as audio.
CODECS = ("mulaw", "alaw", "adpcm")
#: Payload bytes that are decoded together.
DECODE_BYTES = 4 << 20
#: WAVE format tags (fixed values).
TAGS = {"pcm": 1, "alaw": 6, "mulaw": 7, "adpcm": 17}
#: IMA ADPCM step sizes and index changes (fixed values).
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
        157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411,
        1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
        11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = ((code & 15) * 8 + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    segment, low = code >> 4 & 7, (code & 15) * 16 + 8
    size = np.where(segment > 0, low + 256 << np.maximum(segment - 1, 0), low)
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def decode_adpcm(data: np.ndarray, block: int = PAD) -> np.ndarray:
    """Samples (blocks x 2 * block - 7) of mono IMA ADPCM blocks: i16 first sample, u8 step index, u8 unused, codes."""
    raw = data[: len(data) // block * block].reshape(-1, block)
    out = np.empty((2 * (block - 4) + 1, len(raw)), np.int16)
    value = (raw[:, 0].astype(np.int32) | raw[:, 1].astype(np.int32) << 8).astype(np.uint16).view(np.int16).astype(np.int32)
    index = np.minimum(raw[:, 2].astype(np.int32), 88)
    out[0] = value
    codes = np.ascontiguousarray(raw[:, 4:].T)
    for k in range(2 * (block - 4)):
        code = (codes[k >> 1] >> 4 * (k & 1)) & 15
        step = STEPS[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code], 0, 88)
        out[k + 1] = value
    return np.ascontiguousarray(out.T)


def encode_adpcm(pcm: np.ndarray, block: int = PAD) -> bytes:
    """IMA ADPCM blocks of 16-bit samples; the last block is filled up with its last sample."""
    per = 2 * (block - 4) + 1
    count = max(1, -(-len(pcm) // per))
    grid = np.zeros(count * per, np.int32)
    grid[: len(pcm)] = pcm
    if len(pcm):
        grid[len(pcm) :] = pcm[-1]
    grid = grid.reshape(count, per).T
    raw = np.zeros((count, block), np.uint8)
    value = grid[0].copy()
    index = np.minimum(np.searchsorted(STEPS, np.abs(np.diff(grid, axis=0)).mean(0)), 88).astype(np.int32)
    raw[:, 2] = index
    raw[:, :2] = value.astype("<i2").view(np.uint8).reshape(-1, 2)
    for k in range(per - 1):
        step, gap = STEPS[index], grid[k + 1] - value
        left, code, change = np.abs(gap), np.where(gap < 0, 8, 0), STEPS[index] >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            has = left >= part
            code, left, change = code + bit * has, left - part * has, change + part * has
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code], 0, 88)
        raw[:, 4 + (k >> 1)] |= (code << 4 * (k & 1)).astype(np.uint8)
    return raw.tobytes()


def wrap(codec: str, data: bytes, rate: int = RATE, block: int = 1) -> bytes:
    """A mono WAVE file around coded samples."""
    tag, odd = TAGS[codec], len(data) & 1
    bits = {"pcm": 16, "adpcm": 4}.get(codec, 8)
    align = {"pcm": 2, "adpcm": block}.get(codec, 1)
    per = 2 * (block - 4) + 1 if codec == "adpcm" else 1
    extra = struct.pack("<HH", 2, per) if codec == "adpcm" else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", tag, 1, rate, rate * align // per, align, bits) + extra
    samples = len(data) // align * per
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * odd
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwrap(raw: bytes) -> tuple[str, int, int, bytes]:
    """Codec, rate, block size and coded samples of a mono WAVE file."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form, data = 12, None, None
    while at + 8 <= len(raw):
        (size,) = struct.unpack_from("<I", raw, at + 4)
        if raw[at : at + 4] == b"fmt ":
            form = struct.unpack_from("<HHIIHH", raw, at + 8)
        elif raw[at : at + 4] == b"data":
            data = raw[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if form is None or data is None:
        raise ValueError("a WAVE file without format or data")
    return {v: k for k, v in TAGS.items()}[form[0]], form[2], form[4], data


def expand(codec: str, data: bytes | np.ndarray, block: int = PAD) -> np.ndarray:
    """16-bit samples of coded ones."""
    raw = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    if codec == "mulaw":
        return MULAW[raw]
    if codec == "alaw":
        return ALAW[raw]
    if codec == "adpcm":
        return decode_adpcm(raw, block).ravel()
    return raw[: len(raw) // 2 * 2].view("<i2")


def filter_taps(up: int, down: int, half: int = 8) -> np.ndarray:
    """Hann-windowed sinc, cut off at the lower of both rates."""
    wide = half * max(up, down)
    t = np.arange(-wide, wide + 1) / max(up, down)
    taps = np.sinc(t) * (0.5 + 0.5 * np.cos(np.pi * t / half))
    return taps * (up / taps.sum())


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Samples at another rate, rounded and clipped to 16 bits."""
    common = gcd(rate, to)
    up, down = to // common, rate // common
    if up == down or not len(pcm):
        return pcm.astype(np.int16)
    x = np.zeros(len(pcm) * up, np.float64)
    x[::up] = pcm
    taps = filter_taps(up, down)  # symmetric; only the samples that stay are computed
    y = np.lib.stride_tricks.sliding_window_view(np.pad(x, len(taps) // 2), len(taps))[::down] @ taps
    return np.clip(np.rint(y), -32768, 32767).astype(np.int16)


def measures(pcm: np.ndarray) -> str:
    """Root mean square, peak and zero crossings per sample."""
    x = pcm.astype(np.int64)
    rms = float(np.sqrt((x * x).sum() / max(len(x), 1)))
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))) if len(x) > 1 else 0
    return f"rms={rms:.3f},peak={int(np.abs(x).max(initial=0))},zcr={crossings / max(len(x) - 1, 1):.6f}"


def pad(data: bytes, to: int = PAD) -> bytes:
    """Zero bytes up to a positive multiple of ``to``."""
    return data + b"\0" * (max(to, -(-len(data) // to) * to) - len(data))


def codec_of(payload: bytes) -> str:
    """mu-law, A-law or ADPCM, by the payload's CRC-32."""
    return CODECS[zlib.crc32(payload) % len(CODECS)]


def store_text(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``n_bytes`` and ``media``: each text's bytes, padded, as the codes of a WAVE file (``codec_of``); stored."""

    def make():
        def one(data: bytes) -> bytes:
            load = pad(data)
            return wrap(codec_of(load), load, block=PAD)

        def work(column: pa.Array) -> list[pa.Array]:
            raw, bounds = string_buffer(column)
            sizes = np.diff(bounds)
            media = (one(raw[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))
            return [pa.array(sizes, pa.int64()), pa.array(media, pa.binary())]

        return work

    fields = [T.StructField("n_bytes", T.LongType(), False), T.StructField("media", T.BinaryType(), False)]
    return stored(map_text(df, fields, make, text, keep), "audio")


def decoded(files: list[tuple[str, int, int, bytes]], rate: int) -> list[np.ndarray]:
    """Samples at ``rate`` of files (codec, rate, block size, codes); ADPCM blocks of one size are decoded together."""
    together: dict[int, np.ndarray] = {}
    for size in {block for codec, _, block, _ in files if codec == "adpcm"}:
        together[size] = decode_adpcm(np.frombuffer(b"".join(data[: len(data) // size * size] for c, _, b, data in files if (c, b) == ("adpcm", size)), np.uint8), size)
    at = dict.fromkeys(together, 0)
    out = []
    for codec, have, block, data in files:
        if codec == "adpcm":
            n = len(data) // block
            pcm = together[block][at[block] : at[block] + n].ravel()
            at[block] += n
        else:
            pcm = expand(codec, data)
        out.append(resample(pcm, have, rate))
    return out


HEARD = [
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("codec", T.StringType()),
    T.StructField("pcm_rate", T.IntegerType(), False),
    T.StructField("pcm", T.BinaryType()),
]


def to_pcm(df: DataFrame, rate: int = RATE // 2, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (None: all) of ``df`` and ``HEARD`` of its WAVE files: facts, and the samples resampled to ``rate``."""

    def one(files: list[bytes | None]) -> list[tuple]:
        parsed = [unwrap(x) for x in files if x is not None]
        made = zip(parsed, decoded(parsed, rate))
        out = []
        for file in files:
            if file is None:
                out.append((*[None] * 6, rate, None))
                continue
            (codec, _, _, load), pcm = next(made)
            out.append((len(load), hashlib.sha256(load).hexdigest(), zlib.crc32(load[-PAD:]), len(file), hashlib.sha256(file).hexdigest(), codec, rate, pcm.astype("<i2").tobytes()))
        return out

    names = df.columns if keep is None else list(keep)
    if clash := {f.name for f in HEARD} & {n.lower() for n in names}:
        raise ValueError(f"columns {sorted(clash)} exist already: rename them or leave them out of keep")
    source = df.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{media}`").alias("__rf_media"))
    schema = T.StructType([*source.schema.fields[:-1], *HEARD])
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(batch.num_columns - 1)], np.int64)
            for first, last in blocks(np.append(0, np.cumsum(sizes)), DECODE_BYTES):
                part = batch.slice(first, last - first)
                made = zip(*one(part.column(part.num_columns - 1).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(v, k) for v, k in zip(made, kinds)]], names=schema.names)

    return map_arrow(source, run, schema)


def store_pcm(df: DataFrame, rate: int = RATE // 2, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """``to_pcm``, written as a table and read back."""
    return stored(to_pcm(df, rate, media, keep), "audio-pcm")


def features(pcm: DataFrame) -> DataFrame:
    """``feature`` in place of the samples of a table of ``store_pcm``: codec, rate, measures and digest of the samples."""

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            out = []
            for x in column:
                samples = x.as_buffer() if x.is_valid else None
                out.append(None if samples is None else f"{measures(np.frombuffer(samples, '<i2'))},pcm={hashlib.sha256(samples).hexdigest()[:16]}")
            return [pa.array(out, pa.string())]

        return work

    rows = map_text(pcm, [T.StructField("feature", T.StringType())], make, "pcm", [c for c in pcm.columns if c not in ("pcm", "feature")])
    return rows.withColumn("feature", F.concat("codec", F.lit(":rate="), "pcm_rate", F.lit(","), "feature"))


def media_features(df: DataFrame, media: str = "media", keep: list[str] | None = None, rate: int = RATE // 2) -> DataFrame:
    """``df`` with the facts of ``HEARD`` of its files and the ``feature`` of their stored samples."""
    return features(store_pcm(df, rate, media, keep))
