"""Operator 1: quality classifier as a sparse rule ensemble.

Shallow boosted trees are grown on text statistics of labelled rows; every path from a root becomes a conjunctive rule;
a logistic model over the rules is fitted with an L1 penalty; the rules with a weight are compiled into one Spark
column expression over the statistics, which scores all rows inside the JVM.

Fitted on at most ``SAMPLE`` labelled rows (chosen by a hash of the id). Statistics of every row cover its whole text.

Defined results: null and empty texts have all statistics 0 and get the score of those; without usable labels, or
with labels of one class, all scores are the smoothed share of label 1. A document labelled more than once is learned
from once for each distinct label; null labels and null ids are not learned from. Repeated rows give repeated rows; empty tables
give empty tables; other columns are ignored or carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, string_buffer

#: Largest number of labelled rows that the model is fitted on.
SAMPLE = 12_000
TREES, DEPTH, BINS, RATE = 24, 3, 32, 0.4
PENALTY = 0.002
LEAST_LEAF = 20
_PREFIX = "__rf_"

_MASKS: dict[str, bytes] = {
    "alpha": bytes([*range(65, 91), *range(97, 123)]),
    "upper": bytes(range(65, 91)),
    "digit": bytes(range(48, 58)),
    "space": b" \t\r\n\x0b\x0c",
    "newline": b"\n",
    "stop": b".,;:'\"-()?",
    "mark": b"#$%&*@^~=+<>_\\/",
    "bar": b"|[]{}",
    "cry": b"!",
    "high": bytes(range(128, 256)),
}
STATS = ["length", "words", *_MASKS, "word_length", "distinct", "repeated", "distinct_lines", "line_length", "short_words"]


def statistics(column: pa.Array) -> np.ndarray:
    """rows x STATS of a text column. Shares are of the bytes, words or lines of the text; lengths are log(1 + n)."""
    raw, bounds = string_buffer(column)
    n = len(column)
    masks = np.zeros((256, len(_MASKS)), np.int64)
    for j, members in enumerate(_MASKS.values()):
        masks[list(members), j] = 1
    out = np.zeros((n, len(STATS)))
    at = STATS.index("word_length")
    for i, value in enumerate(column):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if a == b:
            continue
        out[i, 2 : 2 + len(_MASKS)] = np.bincount(raw[a:b], minlength=256) @ masks / (b - a)
        text = value.as_py()
        words, lines = text.split(), text.split("\n")
        sizes = list(map(len, words))
        distinct = len(set(words))
        out[i, 0], out[i, 1] = np.log1p(b - a), np.log1p(len(words))
        if words:
            # the share of distinct words falls with length: compared with the square root of the number of words
            out[i, at : at + 3] = sum(sizes) / len(words), distinct / len(words), distinct / len(words) ** 0.5
            out[i, at + 5] = sum(s <= 3 for s in sizes) / len(words)
        out[i, at + 3 : at + 5] = len(set(lines)) / len(lines), np.log1p((b - a) / len(lines))
    return out


def with_statistics(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the columns of ``STATS``, prefixed."""
    fields = [T.StructField(_PREFIX + s, T.DoubleType(), False) for s in STATS]

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            parts = [statistics(column.slice(a, 1024)) for a in range(0, len(column), 1024)] or [np.zeros((0, len(STATS)))]
            x = np.concatenate(parts)
            return [pa.array(np.ascontiguousarray(x[:, j]), pa.float64()) for j in range(x.shape[1])]

        return work

    return map_text(df, fields, make, text, keep)


Rule = tuple[tuple[int, float, float], ...]  # (statistic, above, up to), joined by "and"


def grow(x: np.ndarray, codes: np.ndarray, edges: list[np.ndarray], target: np.ndarray, hess: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """One tree on gradients: the rules of its nodes, and its values for all rows."""
    rules: list[Rule] = []
    value = np.zeros(len(target))

    def split(rows: np.ndarray, bounds: dict[int, tuple[float, float]], depth: int) -> None:
        g, h = target[rows].sum(), hess[rows].sum()
        if bounds:
            rules.append(tuple(sorted((f, lo, hi) for f, (lo, hi) in bounds.items())))
        value[rows] = g / (h + 1.0)
        if depth == DEPTH or len(rows) < 2 * LEAST_LEAF:
            return
        best, where = 1e-6, None
        for f in range(x.shape[1]):
            if not len(edges[f]):
                continue
            c = codes[rows, f]
            gs = np.cumsum(np.bincount(c, target[rows], len(edges[f]) + 1))[:-1]
            hs = np.cumsum(np.bincount(c, hess[rows], len(edges[f]) + 1))[:-1]
            ns = np.cumsum(np.bincount(c, minlength=len(edges[f]) + 1))[:-1]
            gain = gs**2 / (hs + 1.0) + (g - gs) ** 2 / (h - hs + 1.0) - g**2 / (h + 1.0)
            gain[(ns < LEAST_LEAF) | (len(rows) - ns < LEAST_LEAF)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, where = gain[k], (f, k)
        if where is None:
            return
        f, k = where
        cut = float(edges[f][k])
        lo, hi = bounds.get(f, (-np.inf, np.inf))
        left = codes[rows, f] <= k
        split(rows[left], bounds | {f: (lo, min(hi, cut))}, depth + 1)
        split(rows[~left], bounds | {f: (max(lo, cut), hi)}, depth + 1)

    split(np.arange(len(target)), {}, 0)
    return rules, value


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, lo, hi in rule:
        out &= (x[:, f] > lo) & (x[:, f] <= hi)
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1-penalised logistic model over 0/1 columns, by accelerated proximal steps."""
    n, m = r.shape
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v = np.ones(m)
    for _ in range(20):  # largest eigenvalue, for the step length
        v = r.T @ (r @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    step = 1 / (0.25 * (float(np.linalg.norm(r @ v)) ** 2 / n + 1) + 1e-9)
    z, zb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(r @ z + zb, -30, 30)))
        new = z - step * (r.T @ (p - y) / n)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = zb - step * float((p - y).mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return b, w


@dataclass
class Model:
    intercept: float
    rules: list[tuple[Rule, float]]

    def sql(self) -> str:
        """The score as a SQL expression over the statistics."""
        parts = [repr(self.intercept)]
        for rule, weight in self.rules:
            tests = []
            for f, lo, hi in rule:
                name = f"`{_PREFIX}{STATS[f]}`"
                tests += [f"{name} > {lo!r}D"] * (lo > -np.inf) + [f"{name} <= {hi!r}D"] * (hi < np.inf)
            parts.append(f"if({' and '.join(tests)}, {weight!r}D, 0D)")
        return f"1D / (1D + exp(-({' + '.join(parts)})))"

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.intercept + sum((w * holds(r, x) for r, w in self.rules), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Rules from boosted trees, then lasso weights."""
    if len(y) < 2 * LEAST_LEAF or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(share / (1 - share))), [])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
    codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    found: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        rules, value = grow(x, codes, edges, y - p, np.maximum(p * (1 - p), 1e-6))
        found |= dict.fromkeys(rules)
        raw += RATE * np.clip(value, -4, 4)
    columns: dict[bytes, Rule] = {}
    for rule in found:
        on = holds(rule, x)
        if LEAST_LEAF <= on.sum() < len(y):
            columns.setdefault(on.tobytes(), rule)  # rules with the same rows count once
    rules = list(columns.values())
    r = np.stack([holds(rule, x) for rule in rules], 1).astype(np.float64) if rules else np.zeros((len(y), 0))
    b, w = lasso_logistic(r, y.astype(np.float64))
    return Model(float(b), [(rule, float(v)) for rule, v in zip(rules, w) if abs(v) > 1e-9])


def train(
    df: DataFrame, labels: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE
) -> Model:
    """Fit on labelled rows for which ``learn`` (over the labels' id, as column ``doc_id``) holds.

    The sample of ids has at most ``sample`` rows, so it is broadcast; only its texts are looked at.
    """
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & learn).distinct()
    known = known.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "y").limit(sample)
    texts = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = with_statistics(texts.join(F.broadcast(known), "doc_id"), keep=["doc_id", "y"]).distinct()
    # rows may repeat an id: no more than the sample reaches the driver in any case
    rows = rows.orderBy(F.xxhash64("doc_id", F.lit(1)), *rows.columns).limit(sample)
    got = rows.toPandas().sort_values(["doc_id", "y", *[_PREFIX + s for s in STATS]])
    y = (got["y"].to_numpy() > 0).astype(np.int64)
    return fit(got[[_PREFIX + s for s in STATS]].to_numpy(np.float64), y)


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``df`` with the probability of label 1."""
    rows = with_statistics(df, text, keep)
    made = {_PREFIX + s for s in STATS}
    names = [c for c in rows.columns if c not in made]
    return rows.select(*[F.col(f"`{c}`") for c in names], F.expr(model.sql()).alias(name))
