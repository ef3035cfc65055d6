"""Operator 8: byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pieces of a block of documents form a small corpus. An inverted index leads from each mergeable
token pair to the positions where it stands; merges are applied to all those positions at once in rank order and
only the touched neighbours are looked at again. Every block is a map task's own batch, so nothing is shuffled and
memory is bounded by the block, whatever the size of the corpus.

Defined results: a null or empty text has no ids and decodes to an empty text; repeated rows give repeated rows;
an empty table gives an empty table; other columns are ignored (``encode``) or carried along (``keep``).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import blocks, map_text, string_buffer

#: Text bytes that are encoded together.
BLOCK_BYTES = 2 << 20
#: Unicode White_Space, which \s stands for in the library's patterns.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NONE = np.int32(2**31 - 1)

IDS_FIELDS = [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)]
DIGEST_FIELDS = [
    T.StructField("n_tokens", T.LongType(), False),
    T.StructField("ids_sha256", T.StringType(), False),
    T.StructField("decoded_sha256", T.StringType(), False),
]


def latin_classes() -> tuple[str, str, str]:
    """Letters, numbers and white space of Latin-1 as character-class texts, by Unicode category."""
    by = {"L": [], "N": [], "S": []}
    for c in map(chr, range(256)):
        kind = "S" if c in "\t\n\x0b\x0c\r \x85\xa0" else unicodedata.category(c)[0]
        if kind in "LN" or c in "\t\n\x0b\x0c\r \x85\xa0":
            by[kind].append(re.escape(c))
    return "".join(by["L"]), "".join(by["N"]), "".join(by["S"])


class Splitter:
    """Pieces of a text by the tokenizer's pattern; a Latin-1 text takes the faster of two equal patterns."""

    def __init__(self, pattern: str):
        self.wide = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        letters, numbers, space = latin_classes()
        narrow = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]")
        narrow = narrow.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
        narrow = narrow.replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")
        self.narrow = None if r"\p" in narrow else re.compile(narrow)

    def __call__(self, text: str) -> list[str]:
        if self.narrow is not None:
            try:
                text.encode("latin-1")
                return self.narrow.findall(text)
            except UnicodeEncodeError:
                pass
        return self.wide.findall(text)


class MergeReplay:
    """Encoder over a rank table (token bytes to id, lower merges first)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs: dict[int, int] = {}
        early = np.zeros(max(ranks.values()) + 1, bool)
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
                    # a merge that makes `left` or `right` can expose this earlier merge
                    early[left] |= rank < left
                    early[right] |= rank < right
        self.early = early
        codes = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(codes)
        self.codes = codes[order]
        self.code_ranks = np.fromiter(pairs.values(), np.int32, len(pairs))[order]

    @classmethod
    def from_lines(cls, lines: bytes) -> "MergeReplay":
        """From the content of a rank file: base64 token and rank on each line."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a})

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == code, self.code_ranks[at], _NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each word."""
        n = len(words)
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, n)
        rest = np.flatnonzero(whole < 0)
        sizes = np.fromiter((len(words[i]) for i in rest), np.int64, len(rest))
        raw = np.frombuffer(b"".join(words[i] for i in rest), np.uint8)
        symbol, owner = self._replay(self.byte_ids[raw], np.repeat(np.arange(len(rest)), sizes))
        lens = np.ones(n, np.int64)
        lens[rest] = np.bincount(owner, minlength=len(rest))
        ids = np.empty(int(lens.sum()), np.int64)
        starts = np.cumsum(lens) - lens
        ids[starts[whole >= 0]] = whole[whole >= 0]
        if len(rest):
            counts = lens[rest]
            within = np.arange(len(symbol)) - np.repeat(np.cumsum(counts) - counts, counts)
            ids[np.repeat(starts[rest], counts) + within] = symbol
        return ids, lens

    def _replay(self, symbol: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of each owner (word) in rank order; returns those left, with their owners."""
        n = len(symbol)
        if not n:
            return symbol, owner
        symbol, owner = symbol.astype(np.int32), owner.astype(np.int32)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        last = np.append(owner[1:] != owner[:-1], True)
        after[last] = -1
        before[np.append(True, last[:-1])] = -1
        pair_rank = np.full(n, _NONE, np.int32)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(places: np.ndarray) -> None:
            """Look up the pair that starts at each place and enter it into the inverted index."""
            follower = after[places]
            pair_rank[places[follower < 0]] = _NONE
            places = places[follower >= 0]
            found = self._rank(symbol[places], symbol[after[places]])
            pair_rank[places] = found
            places, found = places[found != _NONE], found[found != _NONE]
            if not len(places):
                return
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            for rank, part in zip(found[np.append(0, cuts)].tolist(), np.split(places, cuts) if len(cuts) else [places]):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(heap, rank)

        note(np.arange(n))
        while heap:
            rank = heapq.heappop(heap)
            parts = index.pop(rank)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = at[pair_rank[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                if len(parts) > 1:
                    at = np.unique(at)
                if self.early[rank]:  # the leftmost of each word only; others wait for pairs that come before them
                    first = np.append(True, owner[at[1:]] != owner[at[:-1]])
                    if not first.all():
                        index[rank] = [at[~first]]
                        heapq.heappush(heap, rank)
                        at = at[first]
                else:  # of overlapping places every other one, from the left
                    meets = np.append(False, after[at[:-1]] == at[1:])
                    if meets.any():
                        i = np.arange(len(at))
                        at = at[(i - np.maximum.accumulate(np.where(meets, 0, i))) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            symbol[at] = rank
            after[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            symbol[gone] = -1
            pair_rank[gone] = _NONE
            earlier = before[at]
            touched = np.concatenate([at, earlier[earlier >= 0]])
            note(np.unique(touched) if len(touched) > 1 else touched)
        left = symbol >= 0
        return symbol[left], owner[left]

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of the ids, one after another."""
        return b"".join(map(self.tokens.__getitem__, ids))


class _Slots(dict):
    """Numbers keys in the order in which they come."""

    def __missing__(self, key: str) -> int:
        value = self[key] = len(self)
        return value


def gather(index: np.ndarray, ids: np.ndarray, lens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ids of the pieces ``index`` one after another."""
    counts = lens[index]
    total = int(counts.sum())
    shift = np.repeat(starts[index] - (np.cumsum(counts) - counts), counts)
    return ids[shift + np.arange(total)]


class BlockEncoder:
    """Encodes blocks of texts: distinct pieces first, then each text from its pieces."""

    def __init__(self, lines: bytes, pattern: str):
        self.replay = MergeReplay.from_lines(lines)
        self.split = Splitter(pattern)

    def texts(self, column: pa.Array):
        """The ids of each text of a column, in order."""
        _, bounds = string_buffer(column)
        for first, last in blocks(bounds, BLOCK_BYTES):
            slots = _Slots()
            uses = []
            for text in column.slice(first, last - first).to_pylist():
                pieces = self.split(text) if text else []
                uses.append(np.fromiter(map(slots.__getitem__, pieces), np.int32, len(pieces)))
            ids, lens = self.replay.encode_words([w.encode() for w in slots])
            starts = np.cumsum(lens) - lens
            for use in uses:
                yield gather(use, ids, lens, starts).astype("<u4")


def _lines(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``ids``: the token ids of each whole text.

    The rank file (under 2 MB, a fixed size) goes to the executors as a broadcast.
    """
    lines = df.sparkSession.sparkContext.broadcast(_lines(vocabulary))

    def make():
        encoder = BlockEncoder(lines.value, pattern)
        return lambda column: [pa.array([x.astype(np.int32) for x in encoder.texts(column)], pa.list_(pa.int32()))]

    return map_text(df, IDS_FIELDS, make, text, keep)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``decoded``: the bytes of the token ids of each row; null ids give empty bytes."""
    lines = df.sparkSession.sparkContext.broadcast(_lines(vocabulary))

    def make():
        replay = MergeReplay.from_lines(lines.value)
        return lambda column: [pa.array([replay.decode(x or ()) for x in column.to_pylist()], pa.binary())]

    return map_text(df, [T.StructField("decoded", T.BinaryType(), False)], make, ids, keep)


def round_trip(
    df: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: list[str] | None = None, with_ids: bool = False
) -> DataFrame:
    """Encode and decode each text in one pass; returns the number of ids and digests of ids and decoded bytes.

    ``with_ids`` adds the ids themselves.
    """
    lines = df.sparkSession.sparkContext.broadcast(_lines(vocabulary))

    def make():
        encoder = BlockEncoder(lines.value, pattern)

        def work(column: pa.Array) -> list[pa.Array]:
            counts, digests, texts, kept = [], [], [], []
            for ids in encoder.texts(column):
                counts.append(len(ids))
                if with_ids:
                    kept.append(ids.astype(np.int32))
                digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
                texts.append(hashlib.sha256(encoder.replay.decode(ids.tolist())).hexdigest())
            ids_column = [pa.array(kept, pa.list_(pa.int32()))] * with_ids
            return [*ids_column, pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]

        return work

    return map_text(df, IDS_FIELDS * with_ids + DIGEST_FIELDS, make, text, keep)
