"""Operator 9: language identification by nearest centroid.

A text's vector holds hashed counts of its letters' 1-, 2- and 3-grams (UTF-8 bytes, lower case, everything else one
space), damped, weighted by inverse document frequency and brought to length 1. Each language has several centroids,
clustered by spherical k-means. The nearest centroid by cosine names the language. A text is rejected if its
distance is larger than any that training texts of its language and about its length have, plus ``SLACK``.

Document frequencies cover all training rows. Centroids are fitted on at most about ``SAMPLE`` training rows a language
(chosen by a hash of the id).

Defined results: a null text, and one without letters, is ``und`` with score 0 and rejected. Without any training
rows, and for empty tables, every text with letters is ``und`` with score 0, not rejected. Rows with a null id are
never learned from. Repeated rows give repeated rows; other columns are ignored or carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, map_arrow, map_text, string_buffer

BUCKETS = 4096
CENTROIDS = 4
#: Largest expected number of training rows a language that centroids are fitted on.
SAMPLE = 1500
SLACK = 0.2
BANDS = 24
#: Length bands (powers of two of letter bytes) in which distances are unreliable.
SHORT = 6
_ROWS = 256
_BYTES = 2 << 20

FIELDS = [
    T.StructField("lang_pred", T.StringType(), False),
    T.StructField("score", T.DoubleType(), False),
    T.StructField("rejected", T.BooleanType(), False),
]


def _letters_only() -> np.ndarray:
    """Bytes as they count: ASCII letters in lower case, bytes of other characters as they are, the rest a space."""
    table = np.full(256, 32, np.uint8)
    table[128:] = np.arange(128, 256)
    for a in range(65, 91):
        table[a] = table[a + 32] = a + 32
    return table


_TABLE = _letters_only()


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts (rows x BUCKETS) of lower-cased texts, and their numbers of letter bytes."""
    raws = [t.lower().encode() for t in texts]
    bounds = np.append(0, np.cumsum([len(r) for r in raws]))
    data = np.frombuffer(b"".join(raws), np.uint8)
    b = _TABLE[data].astype(np.uint32)
    # runs of spaces count once
    first = np.append(True, (b[1:] != 32) | (b[:-1] != 32)) if len(b) else np.zeros(0, bool)
    kept = np.append(0, np.cumsum(first))
    bounds, b = kept[bounds], b[first]
    two = b[:-1] << 8 | b[1:] if len(b) > 1 else np.zeros(0, np.uint32)
    three = two[:-1] << 8 | b[2:] if len(b) > 2 else np.zeros(0, np.uint32)
    grams = [((g + np.uint32(0x9E37 * n)) * np.uint32(2654435761) >> np.uint32(20)).astype(np.int64) for n, g in ((1, b), (2, two), (3, three))]
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if e > s:
            out[i] = np.bincount(np.concatenate([grams[0][s:e], grams[1][s : e - 1], grams[2][s : max(s, e - 2)]]), minlength=BUCKETS)
    letters = np.append(0, np.cumsum(b != 32))
    return out, letters[bounds[1:]] - letters[bounds[:-1]]


def has_letter(text: str | None) -> bool:
    return bool(text) and (text.isalpha() or any(map(str.isalpha, text)))


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    far: np.ndarray  # centroids' languages x length bands: largest distance that is accepted

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = []
        for at in range(0, len(texts), _ROWS):
            part = texts[at : at + _ROWS]
            known = [has_letter(t) for t in part]
            if not self.langs:
                out += [("und", 0.0, not k) for k in known]
                continue
            tf, n = counts([t or "" for t in part])
            near = vectors(tf, self.idf) @ self.centroids.T
            best = near.argmax(1)
            band = np.minimum(np.log2(np.maximum(n, 1)).astype(int), BANDS - 1)
            for k, i, c, j in zip(known, range(len(part)), best.tolist(), band.tolist()):
                cosine = float(min(max(near[i, c], 0.0), 1.0))
                out.append((self.langs[c], cosine, 1 - cosine > self.far[c, j]) if k else ("und", 0.0, True))
        return out


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from rows far from one another."""
    chosen = [x.mean(0)]
    for _ in range(min(k, len(x)) - 1):
        chosen.append(x[int(np.argmin(np.max(x @ np.array(chosen).T, axis=1)))])
    c = np.array(chosen)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = (x @ c.T).argmax(1)
        c = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def train(df: DataFrame, learn: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on the rows where ``learn`` holds and text and language are not null."""
    rows = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{doc_id}`").alias("doc_id"), learn.alias("learn"))
    rows = rows.where("learn and text is not null and lang is not null")

    def frequencies(batches):
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            _, bounds = string_buffer(batch.column(0))
            for first, last in blocks(bounds, _BYTES):
                for a in range(first, last, _ROWS):
                    texts = batch.column(0).slice(a, min(_ROWS, last - a)).to_pylist()
                    tf, _ = counts(texts)
                    total += (tf > 0).sum(0)
                    n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS), pa.int32()), pa.array(np.append(n, total), pa.int64())], names=["bucket", "n"])

    # BUCKETS + 1 rows reach the driver, whatever the input
    found = map_arrow(rows.select("text"), frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df_counts = np.zeros(BUCKETS + 1, np.int64)
    for bucket, n in found:
        df_counts[bucket + 1] = n
    idf = np.log((1 + df_counts[0]) / (1 + df_counts[1:])) + 0.2
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((0, BUCKETS)), idf, np.zeros((0, BANDS)))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))])
    pick = (F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(1 << 20)) / (1 << 20)) < share[F.col("lang")]
    names = sorted(sizes)

    def features(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                texts = batch.column(0).slice(a, min(_ROWS, batch.num_rows - a)).to_pylist()
                tf, n = counts(texts)
                cells = [np.flatnonzero(row).astype("<u2") for row in tf]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(a, len(texts)), pa.array(n, pa.int64()),
                        pa.array([c.tobytes() for c in cells], pa.binary()), pa.array([tf[i, c].astype("<f4").tobytes() for i, c in enumerate(cells)], pa.binary()),
                    ],
                    names=["lang", "n", "cells", "tf"],
                )

    langs, centroids, far = [], [], []
    sampled = map_arrow(rows.where(pick).select("text", "lang"), features, "lang string, n long, cells binary, tf binary").distinct()
    got = sorted(((r["lang"], r["n"], bytes(r["cells"]), bytes(r["tf"])) for r in sampled.collect()), key=lambda r: (r[0], r[1], r[2], r[3]))
    for name in names:
        own = [r for r in got if r[0] == name and r[1] > 0]
        if not own:
            continue
        tf = np.zeros((len(own), BUCKETS), np.float32)
        for i, (_, _, cells, values) in enumerate(own):
            tf[i, np.frombuffer(cells, "<u2")] = np.frombuffer(values, "<f4")
        x = vectors(tf, idf)
        c = cluster(x, CENTROIDS)
        distance = 1 - (x @ c.T).max(1)
        band = np.minimum(np.log2(np.array([r[1] for r in own])).astype(int), BANDS - 1)
        limit = np.array([distance[band == b].max(initial=0.0) for b in range(BANDS)])
        # a shorter text may be as far as a longer one; bands without rows take the nearest that has some
        limit = np.maximum.accumulate(limit[::-1])[::-1]
        limit[band.max() + 1 :] = limit[band.max()]
        limit[:SHORT] = 0.95 - SLACK  # a few words say too little: only those with next to nothing known go
        langs += [name] * len(c)
        centroids.append(c)
        far += [limit + SLACK] * len(c)
    if not langs:
        return Model([], np.zeros((0, BUCKETS)), idf, np.zeros((0, BANDS)))
    return Model(langs, np.concatenate(centroids).astype(np.float32), idf.astype(np.float32), np.array(far))


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``df`` with lang_pred, score (cosine to the nearest centroid) and rejected, each name after ``prefix``."""
    whole = df.sparkSession.sparkContext.broadcast(model)  # centroids x BUCKETS floats: a fixed size for each language

    def make():
        m = whole.value

        def work(column: pa.Array) -> list[pa.Array]:
            out = []
            _, bounds = string_buffer(column)
            for first, last in blocks(bounds, _BYTES):
                out += m.predict(column.slice(first, last - first).to_pylist())
            return [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.float64()), pa.array([r[2] for r in out], pa.bool_())]

        return work

    return map_text(df, [T.StructField(prefix + f.name, f.dataType, False) for f in FIELDS], make, text, keep)
