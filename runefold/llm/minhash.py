"""Operator 4: near-duplicate groups by MinHash.

Each document's distinct word shingles are hashed once and dealt into ``BINS`` bins; the least hash of each bin is the
signature (one-permutation hashing). An empty bin borrows from the first filled bin in its own random order of bins
(optimal densification). Bands of ``ROWS`` bins make bucket keys; documents with equal shingle sets count as one.
Within a bucket candidates are stars: each member is paired with the centre, not with every other member. A pair is
linked only if the full sets pass the threshold. Members that end in different groups could still be linked past their
centre. Where a family has few members outside its main group, these meet all its others. Where it has many, linked
ones must share shingles that the family's middle (what half of its members have) lacks, so these shingles deal the
members into smaller families with centres of their own (``narrowed``), until few are outside the main group. Main
members are dealt only where one from outside is (``smaller``). So no link is lost to the star shape, while pairs
stay in proportion to members.

Defined results: a text without words (or null) has no shingles and is linked with nothing; fewer words than the
shingle width make one shingle of all of them. A null id is linked with nothing and its component is null. Rows that
repeat an id with the same text fall together; with another text they are judged by their own text. An empty table
gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, ids, map_arrow, map_text, scratch, spread_join, stored, string_buffer

BINS = 256
ROWS = 5
BANDS = BINS // ROWS
BLOCK_BYTES = 1 << 20
#: Members outside a family's main group up to which they meet all its others; members that a family's middle is made of.
SMALL, WITNESSES = 8, 31
#: 64-bit words of a family's bitmap.
WORDS = 2048

_U = np.uint64
_P, _INVERSE = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, _U), np.full(n, base, _U)]))


class Shingler:
    """Hashed sets of word shingles of blocks of texts."""

    def __init__(self, width: int):
        self.width = width
        self.up, self.down = _powers(_P, 1 << 12), _powers(_INVERSE, 1 << 12)
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True

    def words(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, and the first word of each text (n + 1 values)."""
        n = len(raw)
        if len(self.up) <= n:
            self.up, self.down = _powers(_P, 2 * n), _powers(_INVERSE, 2 * n)
        b = self.lower[raw]
        word = ~self.space[b]
        edge = np.zeros(n + 1, bool)  # a text begins here
        edge[bounds] = True
        starts = np.flatnonzero(word & (np.append(True, ~word[:-1])[:n] | edge[:n]))
        ends = np.flatnonzero(word & (np.append(~word[1:], True)[:n] | edge[1:])) + 1
        prefix = np.append(_U(0), np.cumsum((b.astype(_U) + _U(1)) * self.up[:n]))
        h = mix((prefix[ends] - prefix[starts]) * self.down[starts] + (ends - starts).astype(_U))
        return h, np.searchsorted(starts, bounds)

    def sets(self, raw: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        h, first = self.words(raw, bounds)
        w = self.width
        with np.errstate(over="ignore"):
            seed = _U(w)
            if len(h) >= w:
                rolled = np.full(len(h) - w + 1, seed, _U)
                for k in range(w):
                    rolled = mix(rolled * _P + h[k : len(h) - w + 1 + k])
            out = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                if b - a >= w:
                    out.append(np.unique(rolled[a : b - w + 1]))
                elif b > a:
                    x = np.full(1, b - a, _U)
                    for k in range(a, b):
                        x = mix(x * _P + h[k])
                    out.append(x)
                else:
                    out.append(np.zeros(0, _U))
        return out


def probe_orders() -> np.ndarray:
    """place[bin, other]: at which try an empty bin looks into the other one."""
    rng = np.random.default_rng(4)
    place = np.empty((BINS, BINS), np.int32)
    for b in range(BINS):
        place[b, rng.permutation(BINS)] = np.arange(BINS)
    return place


_PLACE = probe_orders()


def signature(hashes: np.ndarray) -> np.ndarray:
    """One-permutation signature of a set of hashes (sorted, not empty), densified."""
    bins = (hashes >> _U(56)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    full = bins[first]
    out = np.zeros(BINS, _U)
    out[full] = hashes[first]
    if len(full) < BINS:
        empty = np.ones(BINS, bool)
        empty[full] = False
        empty = np.flatnonzero(empty)
        out[empty] = out[full[_PLACE[np.ix_(empty, full)].argmin(1)]]
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """Bucket keys (rows x BANDS) of signatures (rows x BINS)."""
    grid = signatures[:, : BANDS * ROWS].reshape(len(signatures), BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U) * _P, grid.shape[:2])
        for k in range(ROWS):
            key = mix(key * _P + grid[:, :, k])
    return key.view(np.int64)


_SIGNED = [
    T.StructField("n_shingles", T.LongType(), False),
    T.StructField("set_key", T.BinaryType(), True),
    T.StructField("bands", T.ArrayType(T.LongType(), False), True),
]


def signed(df: DataFrame, width: int, text: str, keep: list[str]) -> DataFrame:
    """n_shingles, a digest of the whole set, and the bucket keys of each row."""

    def make():
        shingler = Shingler(width)

        def work(column: pa.Array) -> list[pa.Array]:
            raw, bounds = string_buffer(column)
            sizes, keys, bands = [], [], []
            for first, last in blocks(bounds, BLOCK_BYTES):
                sets = shingler.sets(raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
                for at in range(0, len(sets), 512):
                    part = sets[at : at + 512]
                    made = iter(band_keys(np.stack([signature(s) for s in part if len(s)]))) if any(map(len, part)) else iter(())
                    bands += [next(made) if len(s) else None for s in part]
                sizes += [len(s) for s in sets]
                keys += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            return [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]

        return work

    return map_text(df, _SIGNED, make, text, keep)


def hashed_sets(df: DataFrame, width: int, text: str, keep: list[str]) -> DataFrame:
    """The whole shingle set of each row as sorted 8-byte hashes."""

    def make():
        shingler = Shingler(width)

        def work(column: pa.Array) -> list[pa.Array]:
            raw, bounds = string_buffer(column)
            out = []
            for first, last in blocks(bounds, BLOCK_BYTES):
                out += [s.tobytes() for s in shingler.sets(raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])]
            return [pa.array(out, pa.binary())]

        return work

    return map_text(df, [T.StructField("shingles", T.BinaryType(), False)], make, text, keep)


def _of(sets: DataFrame, rows: DataFrame, name: str, made: str) -> DataFrame:
    """The sets of the documents in column ``name`` of stored ``rows``; others are left out before they are dealt."""
    return sets.select(F.col("doc").alias(name), F.col("shingles").alias(made)).join(rows.select(name).distinct(), name, "left_semi")


def consensus(members: DataFrame, sets: DataFrame) -> DataFrame:
    """family, __c, others, held: hashes that half of (at most ``WITNESSES``) members of each family have; the others' hashes and how many have them."""
    order = Window.partitionBy("family").orderBy(F.desc("weight"), "x")
    some = members.withColumn("r", F.row_number().over(order)).where(F.col("r") <= WITNESSES).select("family", F.col("x").alias("doc"))
    held = some.join(sets, "doc").groupBy("family").agg(F.collect_list("shingles").alias("held"))  # WITNESSES sets at most

    def run(batches):
        for batch in batches:
            out, others, times = [], [], []
            for held in batch.column(1):
                values, counts = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), _U) for x in held.values]), return_counts=True)
                half = 2 * counts >= len(held.values)
                out.append(values[half].tobytes())
                others.append(values[~half].tobytes())
                times.append(counts[~half].astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, pa.binary()) for v in (out, others, times)]], names=["family", "__c", "others", "held"])

    return map_arrow(held, run, "family long, __c binary, others binary, held binary")


def _common(a: pa.Scalar, b: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both sets, and which of the second one's hashes the first one has."""
    s, t = np.frombuffer(a.as_buffer(), _U), np.frombuffer(b.as_buffer(), _U)
    at = np.searchsorted(s, t)
    at[at == len(s)] = 0
    return s, t, s[at] == t


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b), named so in the stored pairs (c, x, a, b) whose full sets have 100 * intersection >= percent * union."""
    rows = pairs.join(_of(sets, pairs, "c", "__c"), "c").join(_of(sets, pairs, "x", "__x"), "x").select("a", "b", "__c", "__x")

    def run(batches):
        for batch in batches:
            keep = []
            for c, x in zip(batch.column(2), batch.column(3)):
                s, t, both = _common(c, x)
                i = int(both.sum())
                keep.append(100 * i >= percent * (len(s) + len(t) - i))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return map_arrow(rows, run, "a long, b long").distinct()


_NARROW = "parent long, family long, x long, comp long, n long, weight long, slack long"


def narrowed(rows: DataFrame, percent: int) -> DataFrame:
    """Smaller families for members x (sets ``__x``) of families with any middle set ``__c``: the columns ``_NARROW``.

    Take x and y of one family, with i(x) hashes in common with the middle. Linked, they have at least
    need = share * (n(x) + n(y)) in common, of which at most i(x) are the middle's. So they share need - i(x) of the
    hashes that the middle lacks, and hence one of the first (as many as there are, less that need, plus 1) in an
    order of all hashes, rare ones first as ``held`` by the middle's members: each such hash makes a new family of the members that have it. Two that do without must both
    be near the middle, and lack together at most middle - need of its hashes: either they lack one in common, and
    each lacked hash makes a new family too; or what both lack adds up to no more than that, and they are linked for
    certain. For these one more family holds the near members with their ``slack`` (null elsewhere): two are linked for
    certain where their slacks add up to 0 or more. ``lo`` is the size of the family's smallest member.
    Where ``seen`` is not null, only families whose bits it has are made.
    """
    share = percent / (100 + percent)
    rows = rows.select("family", "x", "comp", "n", "weight", "lo", "__c", "__x", "seen", "others", "held")

    def run(batches):
        last, bits = None, None
        for batch in batches:
            made_of = []
            plain = zip(*[batch.column(k).to_pylist() for k in (0, 3, 5)])
            for (family, n, lo), c, own, seen, others, held in zip(plain, *[batch.column(k) for k in range(6, 11)]):
                s, t, both = _common(c, own)
                other = max(lo, int(np.ceil(n * percent / 100)))
                need = int(np.ceil(share * (n + other) - 1e-9)) - int(both.sum())
                rest = t[~both]
                known, times = np.frombuffer(others.as_buffer(), _U), np.frombuffer(held.as_buffer(), np.uint8)
                if len(known):
                    at = np.minimum(np.searchsorted(known, rest), len(known) - 1)
                    rest = rest[np.argsort(np.where(known[at] == rest, times[at], 0), kind="stable")]
                marks = [rest[: max(0, len(rest) - max(need, 1) + 1)]]
                slack = None
                if need <= 0:
                    missed = np.setdiff1d(s, t, assume_unique=True)
                    slack = (len(s) - 2 * len(missed)) * (100 + percent) - 2 * percent * n
                    marks += [~missed, np.zeros(1, _U)]
                marks = np.concatenate(marks)
                with np.errstate(over="ignore"):
                    made = mix(mix(marks) + np.array([family], np.int64).view(_U) * _P)
                near = np.zeros(len(made), bool)
                near[len(made) - 1 :] = slack is not None
                if seen.is_valid:
                    if last != family:
                        last, bits = family, np.zeros(WORDS, np.int64)
                        flat = seen.values
                        bits[flat.field(0).to_numpy()] = flat.field(1).to_numpy()
                    hit = (bits.view(_U)[((made >> _U(6)) & _U(WORDS - 1)).astype(np.int64)] >> (made & _U(63))) & _U(1) == 1
                    made, near = made[hit], near[hit]
                made_of.append((made, near, slack or 0))
            for a in range(0, len(made_of), 256):
                part = made_of[a : a + 256]
                times = [len(made) for made, _, _ in part]
                old = [np.repeat(batch.column(k).slice(a, 256).to_numpy(zero_copy_only=False), times) for k in range(5)]
                slacks = pa.array(np.repeat(np.array([slack for _, _, slack in part], np.int64), times), mask=~np.concatenate([near for _, near, _ in part]))
                made = pa.array(np.concatenate([made for made, _, _ in part]).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(old[0]), made, *map(pa.array, old[1:]), slacks], names=["parent", "family", "x", "comp", "n", "weight", "slack"])

    return map_arrow(rows, run, _NARROW)


def bitmaps(made: DataFrame) -> DataFrame:
    """family, seen: a bitmap (its words that are not 0, ``WORDS`` at most) of the new families made of each family."""
    word, bit = F.expr(f"int(shiftright(family, 6) & {WORDS - 1})"), F.expr("bit_or(shiftleft(1L, int(family & 63)))")
    words = made.groupBy(F.col("parent").alias("family"), word.alias("word")).agg(bit.alias("bits"))
    return words.groupBy("family").agg(F.collect_list(F.struct("word", "bits")).alias("seen"))


def smaller(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``narrowed`` of the stored members ``large``, less the families that only a family's main group would have.

    A new link has an end outside the main group. So the few members outside come first, and of the others only what
    may meet these is made. The bitmap lets some too many pass, which costs rows and loses nothing.
    """
    middle = stored(consensus(large, sets), "middle")
    rows = large.join(_of(sets, large, "x", "__x"), "x")
    outside = rows.where("comp <> main").join(middle, "family").withColumn("seen", F.lit(None).cast("array<struct<word:int,bits:long>>"))
    outside = stored(narrowed(outside, percent), "outside")
    middle = stored(middle.join(bitmaps(outside), "family"), "seen")
    return ids(narrowed(rows.where("comp = main").join(middle, "family"), percent).union(outside), "narrow")


def connected(edges: DataFrame) -> DataFrame:
    """doc, comp (least document that can be reached) of each document that has an edge (a, b).

    Alternates large and small stars; each round is a few aggregations and joins and is written to the shared folder.
    """
    edges = ids(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        # done when each document has one edge down, to one that has none
        ends = edges.select(F.col("u").alias("d"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("d").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down > 0 and up > 0").isEmpty():
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = ids(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    comps = edges.select(F.col("u").alias("doc"), F.col("v").alias("comp"))
    return comps.union(edges.select(F.col("v").alias("doc"), F.col("v").alias("comp")).distinct())


def unresolved(families: DataFrame) -> DataFrame:
    """Members of the families that hold more than one group, with the main group, the number outside it, the least size and the centre h."""
    centre = F.max(F.struct("slack", "weight", (-F.col("x")).alias("less"), F.col("comp").alias("b"))).alias("h")
    each = families.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("many"), F.min("n").alias("lo"), centre)
    tops = each.groupBy("family").agg(F.max(F.struct("many", "comp")).alias("m"), F.sum("many").alias("all"), F.min("lo").alias("lo"), F.max("h").alias("h"))
    tops = tops.where("m.many < all").select("family", F.col("m.comp").alias("main"), F.expr("all - m.many").alias("odd"), "lo", "h")
    return families.join(tops, "family").select("family", "x", "comp", "n", "weight", "slack", "main", "odd", "lo", "h")


def relabelled(rows: DataFrame, to: DataFrame, name: str) -> DataFrame:
    """``rows`` with the group in column ``name`` replaced by the one that it is now part of."""
    found = rows.join(to.select(F.col("doc").alias(name), F.col("comp").alias("__to")), name, "left")
    return found.select(*[F.coalesce("__to", name).alias(name) if c == name else F.col(c) for c in rows.columns])


def groups(df: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id of each row, written to the shared folder; tables on the way there are removed."""
    with scratch(df.sparkSession):
        return stored(_groups(df, width, percent, text, doc_id), "groups", keep=True)


def _groups(df: DataFrame, width: int, percent: int, text: str, doc_id: str) -> DataFrame:
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    rows = stored(signed(docs, width, "text", ["doc"]), "signatures")
    usable = rows.where("doc is not null and n_shingles > 0")
    # one representative of each distinct set; stored, so that the joins below are dealt by document or can be split
    classes = ids(usable.groupBy("set_key").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    reps = usable.join(classes.select("set_key", F.col("rep").alias("doc")), ["set_key", "doc"], "left_semi")
    entries = reps.select("doc", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = ids(entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared")
    members = stored(entries.join(shared, "key").distinct(), "buckets")
    # the member with most company is the likeliest original: it comes first as a centre
    weight = members.groupBy("doc").agg(F.sum("size").alias("weight"))
    members = stored(members.join(weight, "doc").select("key", "doc", "n", "weight"), "members")
    wanted = weight.select("doc")
    sets = stored(hashed_sets(docs.join(wanted, "doc", "left_semi"), width, "text", ["doc"]), "sets")

    sizes = members.select(F.col("doc").alias("x"), "n", "weight").distinct()
    centre = ids(members.groupBy("key").agg(F.max(F.struct("weight", (-F.col("doc")).alias("less"))).alias("c")), "centres")
    stars = members.join(centre, "key").select((-F.col("c.less")).alias("c"), F.col("doc").alias("x")).where("c <> x").distinct()
    # a family is a centre and the members of the buckets that it is the centre of
    stars = ids(stars.select("c", "x", F.col("c").alias("a"), F.col("x").alias("b")), "stars")
    comps = ids(connected(linked(stars, sets, percent)), "comps")
    # families around centres of one group become one: a document is dealt with once, not once for each of its bands
    heads = stars.select("c", "x").join(comps.select(F.col("doc").alias("c"), F.col("comp").alias("family")), "c", "left")
    families = heads.select(F.coalesce("family", "c").alias("family"), "x").distinct().join(sizes, "x").join(comps.withColumnRenamed("doc", "x"), "x", "left")
    families = families.select("family", "x", F.coalesce("comp", "x").alias("comp"), "n", "weight", F.lit(None).cast("long").alias("slack"))
    while True:
        open_ = ids(unresolved(families), "open")
        # few outside the main group meet all the rest; where many are, a star comes first and smaller families follow
        many = (F.col("odd") > SMALL) & F.col("slack").isNull()
        counts = open_.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(many, 1)).alias("large")).first()
        if not counts["all"]:
            break
        few = open_.where((F.col("odd") <= SMALL) & F.col("slack").isNull())
        y = few.where("comp <> main").select("family", F.col("x").alias("y"), F.col("comp").alias("ycomp"), F.col("n").alias("yn"))
        pairs = few.join(y, "family").where((F.col("comp") != F.col("ycomp")) & (F.least("n", "yn") * 100 >= F.greatest("n", "yn") * percent))
        pairs = pairs.select(F.least("x", "y").alias("c"), F.greatest("x", "y").alias("x"), F.least("comp", "ycomp").alias("a"), F.greatest("comp", "ycomp").alias("b"))
        # of those near a middle, the one with the most slack is linked with all that are linked for certain
        star = open_.where("comp <> h.b").where(many | (F.col("slack") + F.col("h.slack") >= 0))
        star = star.select(F.least(-F.col("h.less"), "x").alias("c"), F.greatest(-F.col("h.less"), "x").alias("x"), F.least("comp", "h.b"), F.greatest("comp", "h.b"))
        pairs = ids(pairs.union(star).dropDuplicates(["c", "x"]), "pairs")
        links = ids(linked(pairs, sets, percent), "links")
        large = open_.where(many)
        if not links.isEmpty():
            # links join whole groups, so only these are relabelled
            to = ids(connected(links), "to")
            comps = relabelled(comps, to, "comp").union(to.join(comps, "doc", "left_anti"))
            comps = ids(comps, "comps")
            large = ids(relabelled(relabelled(large, to, "comp"), to, "main"), "large")
        if not counts["large"]:
            break
        families = smaller(large, sets, percent).drop("parent")
    # a text without copies or links is its own component and needs no look-up
    named = classes.join(comps.withColumnRenamed("doc", "rep"), "rep", "left").where("copies > 1 or comp <> rep")
    named = ids(named.select("set_key", F.coalesce("comp", "rep").alias("component_id")), "named")
    out = spread_join(rows.select("doc", "n_shingles", "set_key"), named, ["set_key"], "left")
    component = F.when(F.col("doc").isNull(), None).otherwise(F.coalesce("component_id", "doc"))
    return out.select(F.col("doc").alias(doc_id), "n_shingles", component.alias("component_id"))


def deduplicated(df: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` with one row of each group: the one with the least id; rows with a null id all stay.

    Rows that repeat an id are judged by their own texts: of equal ones one stays, different ones stay if their groups
    have no lesser id.
    """
    key = f"`{doc_id}`"
    if df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty():
        found = groups(df, width, percent, text, doc_id)
        gone = found.where(F.col("component_id") != F.col(doc_id)).select(F.col(doc_id).alias("__rf_gone"))
        return df.join(gone, df[key] == gone["__rf_gone"], "left_anti")
    # numbers in order of ids stand for the rows
    numbered = df.where(F.col(key).isNotNull()).orderBy(key, text).withColumn("__rf_row", F.monotonically_increasing_id())
    numbered = stored(numbered, "numbered")
    found = groups(numbered, width, percent, text, "__rf_row")
    gone = found.where("component_id <> __rf_row").select(F.col("__rf_row").alias("__rf_gone"))
    kept = numbered.join(gone, numbered["__rf_row"] == gone["__rf_gone"], "left_anti")
    # texts without shingles are linked with nothing, but of equal rows one stays
    bare = kept.join(found.where("n_shingles = 0").select("__rf_row"), "__rf_row", "left_semi").dropDuplicates([doc_id, text])
    kept = kept.join(found.where("n_shingles > 0").select("__rf_row"), "__rf_row", "left_semi").unionByName(bare)
    return kept.drop("__rf_row").unionByName(df.where(F.col(key).isNull()))
