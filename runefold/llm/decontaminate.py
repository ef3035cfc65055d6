"""Operator 5: benchmark decontamination with DataFrame and SQL functions only.

Texts and benchmark items are lower-cased words of letters and digits. An item of L words leaks into a document if one of
its windows of L words (all of it, if it is shorter) has a weighted similarity of five-word shingles of at least ``percent``:
sum of the lesser counts over sum of the greater counts.

1. Windows. One that is alike has at least ``need`` shingles of the items of its length. So the windows with that many are
   all that matter, wherever their shared shingles stand in the item. Of two windows one word apart of which the first
   begins with no such shingle, the second is as much alike or more, so windows begin at shared shingles, or end with the
   document. The best window of a document is among them.
2. Fingerprints. Windows and items get 64-bit SimHash fingerprints of their words, cut into ``BLOCKS`` blocks. Two that differ
   in at most ``RADIUS`` bits differ in at most ``NEAR`` bits of one block at least. Items are entered under all values
   that near, windows under their own, so the join finds each pair of one length within the radius; a random pair meets
   in one case of eighteen.
3. Beyond the radius. No radius holds every pair that is alike, so windows also meet the items of their length by the item's
   rarest shingles: as many of these as leave the others too few to reach ``percent``. A pair that is alike shares one.
4. The candidates of both ways are verified by the exact weighted similarity.

Texts, windows and items are each judged once for equal contents, so copies and common passages add no work and no hot keys.

Defined results: null and empty texts match nothing; items without words match nothing; items with fewer words than
the shingle width have one shingle of all their words. Of equally similar windows the last counts. Rows that repeat a document's id
are one document in ``leaks``, each with its own text; ``clean`` judges every row by its own text, whatever its id. A null id is
reported as null. Empty tables give an empty table. Very long texts are read whole. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ids, spread_join

WIDTH = 5
BLOCKS, NEAR = 5, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
#: First bits of the blocks of a fingerprint: they cover all 64.
CUTS = [-(-64 * i // BLOCKS) for i in range(BLOCKS + 1)]
#: Shingles of the benchmark up to which it is broadcast; a larger one is joined by shuffle.
BROADCAST_SHINGLES = 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def shingles(width: int) -> Column:
    """Hashes of the shingles of the column ``w``, in order and with repeats; none if it has fewer words."""
    cells = ", ".join(f"w[i + {k}]" for k in range(width))
    return F.expr(f"if(size(w) < {width}, array(), transform(sequence(0, size(w) - {width}), i -> xxhash64({cells})))")


def own_shingles() -> Column:
    """Sorted shingles of an item or window in ``w``: of the column ``width`` words."""
    out = F.expr("cast(array() as array<bigint>)")
    for width in range(1, WIDTH + 1):
        out = F.when(F.col("width") == width, shingles(width)).otherwise(out)
    return F.sort_array(out)


def fingerprint() -> Column:
    """64-bit SimHash of the words in ``w``, each counted as often as it occurs."""
    return F.expr(
        "aggregate(transform(w, x -> xxhash64(x)), transform(sequence(0, 63), b -> 0), "
        "(s, h) -> transform(s, (n, b) -> n + 2 * cast(shiftright(h, b) & 1 as int) - 1), "
        "s -> aggregate(sequence(0, 63), cast(0 as bigint), (f, b) -> f | if(s[b] > 0, shiftleft(cast(1 as bigint), b), cast(0 as bigint))))"
    )


def _block(k: int, name: str) -> str:
    return f"shiftrightunsigned({name}, {CUTS[k]}) & {(1 << CUTS[k + 1] - CUTS[k]) - 1}L"


def own_blocks(name: str) -> Column:
    """(block, bits) of a fingerprint."""
    return F.expr("array(" + ", ".join(f"named_struct('block', {k}, 'bits', {_block(k, name)})" for k in range(BLOCKS)) + ")")


def near_blocks(name: str) -> Column:
    """(block, bits) of all values that differ from a fingerprint's block in at most ``NEAR`` bits."""
    parts = []
    for k in range(BLOCKS):
        flips = [sum(1 << b for b in bits) for n in range(NEAR + 1) for bits in combinations(range(CUTS[k + 1] - CUTS[k]), n)]
        parts.append(f"transform(array({', '.join(f'{x}L' for x in flips)}), m -> named_struct('block', {k}, 'bits', ({_block(k, name)}) ^ m))")
    return F.expr(f"concat({', '.join(parts)})")


def first_block() -> Column:
    """The first block in which the fingerprints f and g are near."""
    return F.expr("case " + " ".join(f"when bit_count(({_block(k, 'f')}) ^ ({_block(k, 'g')})) <= {NEAR} then {k}" for k in range(BLOCKS)) + " end")


def similarity() -> Column:
    """Exact weighted similarity of the sorted shingle lists ``s`` and ``t``: what both have, then what both repeat."""
    again = lambda x: f"filter({x}, (h, i) -> i > 0 and get({x}, i - 1) = h)"
    more = "least(size(filter(s, x -> x = h)), size(filter(t, x -> x = h))) - 1"
    both = f"(size(array_intersect(s, t)) + aggregate(array_intersect({again('s')}, {again('t')}), 0, (n, h) -> n + {more}))"
    return F.expr(f"{both} / (size(s) + size(t) - {both})")


def rare_shingles(items: DataFrame, percent: int) -> DataFrame:
    """ikey, length, g, t, h: of each item, shingles of which a window of its length that is alike has one at least.

    A window that is alike has ``percent`` of the item's shingles at least, repeats counted, also where the document is shorter
    than the item. Shingles are taken from the rarest (over all items of the length) until fewer than that are left.
    """
    each = items.select("ikey", "length", F.size("t").alias("n"), F.explode("t").alias("h")).groupBy("ikey", "length", "n", "h").agg(F.count(F.lit(1)).alias("k"))
    often = each.groupBy("length", "h").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("ikey").orderBy("often", "h").rowsBetween(Window.unboundedPreceding, -1)  # one item's shingles
    each = each.join(often, ["length", "h"]).withColumn("left", F.col("n") - F.coalesce(F.sum("k").over(order), F.lit(0)))
    each = each.where(F.col("left") * 100 >= F.col("n") * percent).select("ikey", "h")
    return each.join(items.select("ikey", "length", "g", "t"), "ikey")


def items_of(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, ikey, length, width, w of the items with words."""
    rows = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), words(F.col(f"`{text}`")).alias("w")).where("size(w) > 0")
    return rows.select("item_id", F.md5(F.array_join("w", " ").cast("binary")).alias("ikey"), F.size("w").alias("length"), F.least(F.size("w"), F.lit(WIDTH)).alias("width"), "w")


def window_starts(percent: int) -> Column:
    """Starts of the windows with enough hits, from the sorted shared places ``hits`` of a document of ``n`` words."""
    own, whole = "(least(n, length) - width + 1)", "(length - width + 1)"
    need = f"int(ceil({percent} * ({own} + {whole}) / {100 + percent}))"
    last = "greatest(0, n - length)"
    begun = f"filter(hits, (p, i) -> p <= {last} and coalesce(get(hits, i + {need} - 1) <= p + {own} - 1, false))"
    ended = f"if(coalesce(get(hits, size(hits) - {need}) >= {last}, false), array({last}), cast(array() as array<int>))"
    return F.expr(f"array_union({begun}, {ended})")


def windows_of(texts: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """key, length, width, start, wkey, w of all windows of ``texts`` (key, text) that have shingles enough of items of their length."""
    entries = ids(items.select("length", "width", F.explode(own_shingles()).alias("h")).distinct(), "item-shingles")
    widths = sorted(r["width"] for r in entries.select("width").distinct().collect())  # 1 to WIDTH at most
    if entries.count() <= BROADCAST_SHINGLES:
        entries = F.broadcast(entries)
    found = None
    for width in widths or [WIDTH]:
        parts = texts.select("key", words(F.col("text")).alias("w"))
        parts = parts.select("key", F.size("w").alias("n"), F.posexplode(shingles(width)).alias("p", "h"))
        hits = parts.join(entries.where(F.col("width") == width), "h").select("key", "n", "length", "width", "p")
        found = hits if found is None else found.union(hits)
    # equal texts have equal hits, which are dropped before they are dealt
    places = found.groupBy("key", "n", "length", "width").agg(F.sort_array(F.collect_set("p")).alias("hits"))
    places = places.select("key", "length", "width", window_starts(percent).alias("starts")).where("size(starts) > 0")
    places = ids(places, "window-places")
    keys = ids(places.select("key").distinct(), "window-texts")
    whole = spread_join(texts, keys, ["key"]).groupBy("key").agg(F.any_value("text").alias("text"))
    rows = whole.select("key", words(F.col("text")).alias("w")).join(places, "key").select("key", "length", "width", "w", F.explode("starts").alias("start"))
    rows = rows.select("key", "length", "width", "start", F.expr("slice(w, start + 1, length)").alias("w"))
    return ids(rows.withColumn("wkey", F.md5(F.concat_ws(" ", F.col("length").cast("string"), F.array_join("w", " ")).cast("binary"))), "windows")


def candidates(windows: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """wkey, ikey, s, t of the pairs that the fingerprints or, beyond ``RADIUS``, the rare shingles find; each pair once."""
    left = windows.select("*", F.explode(own_blocks("f")).alias("b")).select("*", "b.block", "b.bits").drop("b")
    right = items.select("ikey", "length", "g", "t", F.explode(near_blocks("g")).alias("b")).select("ikey", "length", "g", "t", "b.block", "b.bits")
    right = ids(right, "item-blocks")
    distance = F.bit_count(F.col("f").bitwiseXOR(F.col("g")))
    close = spread_join(left, right, ["length", "block", "bits"]).where(distance <= RADIUS)
    close = close.where(first_block() == F.col("block"))  # a pair that meets in several blocks counts in the first
    rare = ids(rare_shingles(items, percent), "item-rare")
    sharing = windows.select("*", F.explode(F.array_distinct("s")).alias("h"))
    far = spread_join(sharing, rare, ["length", "h"]).where(distance > RADIUS)
    return close.select("wkey", "ikey", "s", "t").union(far.select("wkey", "ikey", "s", "t"))


def matches(docs: DataFrame, benchmark: DataFrame, percent: int, text: str, item_id: str, item_text: str) -> DataFrame:
    """key (of a text), item_id, similarity and start of the best window, stored."""
    items = ids(items_of(benchmark, item_id, item_text), "items")
    texts = docs.select(F.col(f"`{text}`").alias("text")).withColumn("key", text_key(F.col("text")))
    places = windows_of(texts, items, percent)
    contents = places.dropDuplicates(["wkey"]).select("wkey", "length", fingerprint().alias("f"), own_shingles().alias("s"))
    contents = ids(contents, "fingerprints")
    known = ids(items.dropDuplicates(["ikey"]).select("ikey", "length", fingerprint().alias("g"), own_shingles().alias("t")), "item-fingerprints")
    verified = candidates(contents, known, percent).withColumn("similarity", similarity()).where(F.col("similarity") * 100 >= percent)
    verified = ids(verified.select("wkey", "ikey", "similarity").distinct(), "verified")
    best = spread_join(places.select("key", "wkey", "start"), verified, ["wkey"]).groupBy("key", "ikey").agg(F.max(F.struct("similarity", "start")).alias("best"))
    named = best.join(items.select("ikey", "item_id").distinct(), "ikey")
    return ids(named.select("key", "item_id", "best.similarity", "best.start"), "leaks")


def leaks(
    docs: DataFrame, benchmark: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """doc_id, item_id, similarity (of the best window), start (its first word) of each item found in a document."""
    found = matches(docs, benchmark, percent, text, item_id, item_text)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_key(F.col(f"`{text}`")).alias("key"))
    best = spread_join(rows, found, ["key"]).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", "start")).alias("best"))
    return best.select(F.col("doc_id").alias(doc_id), "item_id", "best.similarity", "best.start")


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = 80, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item."""
    found = matches(docs, benchmark, percent, text, item_id, item_text).select(F.col("key").alias("__rf_key")).distinct()
    return spread_join(docs.withColumn("__rf_key", text_key(F.col(f"`{text}`"))), ids(found, "leaking"), ["__rf_key"], "left_anti").drop("__rf_key")
