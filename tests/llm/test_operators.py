"""The training-data operators against brute force, round trips and held-out labels."""

import contextlib
import glob
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from runefold.llm import audio, bpe, common, decontaminate, langid, minhash, pfor, quality, queries, quotes, urltree, warc

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "a", "One two three.", "it's we'll 'S", "Ünï ß² ½ 日本語 🎉 x", "\x1c\x1d\x85\xa0z", "a" * 5000, "ab " * 40000, "<|endoftext|> b"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with null and repeated ids and extra columns whose names clash with internal ones."""
    rows = [(i, t, "x", 1.0, 7) for i, t in enumerate(ODD)] + [(None, "no id", None, None, None), (3, "a", "x", 1.0, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, doc long").repartition(3)


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_bpe_equals_library(spark, odd):
    import base64

    import tiktoken

    lines = open(queries.vocabulary("byte_bpe_multi_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    library = tiktoken.Encoding("own", pat_str=queries.split_pattern(), mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.BlockEncoder(lines, queries.split_pattern())
    random.seed(1)
    texts = [t or "" for t in ODD] + ["".join(random.choice("abe nthx\n .,'é0日") for _ in range(300)) for _ in range(200)]
    for text, ids in zip(texts, encoder.texts(pa.array(texts))):
        assert ids.tolist() == library.encode_ordinary(text)
        assert encoder.replay.decode(ids.tolist()) == text.encode()
    out = bpe.round_trip(odd, queries.vocabulary("byte_bpe_multi_50k.tiktoken"), queries.split_pattern(), keep=["doc_id"])
    expect = sorted((i or -1, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts_of(odd))
    assert sorted((r["doc_id"] or -1, r["decoded_sha256"]) for r in out.collect()) == expect
    ids = bpe.encode(odd, queries.vocabulary("byte_bpe_multi_50k.tiktoken"), queries.split_pattern())
    back = bpe.decode(ids, queries.vocabulary("byte_bpe_multi_50k.tiktoken"))
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back.collect())


def test_pfor_blocks_round_trip():
    rng = np.random.default_rng(2)
    for top in (1, 5, 1000, 49408, 2**32):
        for n in (0, 1, 127, 128, 129, 1000):
            ids = rng.integers(0, top, n).astype(np.uint32)
            ids[::50] = top - 1
            starts, data = pfor.pack(ids)
            assert (pfor.unpack(starts, data)[:n] == ids).all()
            raw = pfor.write_segment([5, None], np.array([n, 0]), ids, 9)
            seg = pfor.Segment(raw)
            assert seg.before == 9 and seg.doc_ids == [5, None] and (seg.ids() == ids).all() and (seg.ids(n // 3, n // 2) == ids[n // 3 : n // 2]).all()


def test_token_files(spark, odd):
    from tokenizers import Tokenizer

    name = queries.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(name)
    rows = pfor.read_documents(spark, pfor.write(odd, name, 2)).orderBy("start").collect()
    start = 0
    for row, (i, text) in zip(rows, sorted(texts_of(odd), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert pfor.read_documents(spark, pfor.write(odd.limit(0), name, 2)).count() == 0


def test_audio(spark, odd):
    assert audio.MULAW[0] == -32124 and audio.MULAW[0xFF] == 0 and audio.ALAW[0x55] == -8 and audio.ALAW[0x2A] == -32256
    tone = (8000 * np.sin(np.arange(4000) / 20)).astype(np.int16)
    heard = audio.decode_adpcm(np.frombuffer(audio.encode_adpcm(tone), np.uint8)).ravel()[:4000]
    assert np.sqrt(np.mean((heard.astype(float) - tone) ** 2)) < 400

    def plain(block):  # one block, sample by sample
        value, index = int(np.frombuffer(block[:2], "<i2")[0]), min(block[2], 88)
        out = [value]
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(audio.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + int(audio.INDEX_CHANGE[code])))
                out.append(value)
        return out

    noise = random.Random(3).randbytes(64 * 20)
    assert audio.decode_adpcm(np.frombuffer(noise, np.uint8)).tolist() == [plain(noise[a : a + 64]) for a in range(0, len(noise), 64)]
    half = audio.resample(tone, 8000, 4000)
    assert len(half) == 2000 and np.abs(half[50:-50].astype(int) - tone[::2][50:-50]).max() < 40
    assert audio.unwrap(audio.wrap("mulaw", b"abc")) == ("mulaw", 8000, 1, b"abc")
    rows = audio.media_features(audio.store_text(odd, keep=["doc_id", "text"]), keep=["doc_id", "text", "n_bytes"]).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        load = audio.pad((r["text"] or "").encode())
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(load), hashlib.sha256(load).hexdigest(), zlib.crc32(load[-64:]))
    files = [(1, bytearray(audio.wrap("alaw", b"\x2a" * 800))), (2, None), (3, bytearray(audio.wrap("adpcm", noise[:32] * 2, block=32))), (4, bytearray(audio.wrap("adpcm", noise, block=64)))]
    media = spark.createDataFrame(files, "id int, media binary").coalesce(1)
    found = {r["id"]: r for r in audio.media_features(media, keep=["id"], rate=16000).collect()}
    assert found[2]["feature"] is None and found[2]["payload_bytes"] is None and found[3]["codec"] == "adpcm"
    pcm = {r["id"]: r["pcm"] for r in audio.to_pcm(media, 16000).collect()}
    assert len(pcm[1]) == 3200 and pcm[2] is None and len(pcm[3]) == 2 * 57 * 4 and len(pcm[4]) == 20 * 121 * 4
    with pytest.raises(ValueError):
        audio.store_text(odd.withColumnRenamed("score", "media"))
    assert audio.media_features(audio.store_text(odd.limit(0), keep=["doc_id"])).count() == 0


def test_audio_stores_resampled_pcm(spark, odd, monkeypatch):
    tables = []
    monkeypatch.setattr(audio, "stored", lambda *a, keep=audio.stored, **k: tables.append(keep(*a, **k)) or tables[-1])
    rows = audio.media_features(audio.store_text(odd, keep=["doc_id", "text"]), keep=["doc_id", "text"], rate=2000).collect()
    assert len(tables) == 2 and {r["codec"] for r in rows} == {"mulaw", "alaw", "adpcm"}
    found = {(r["doc_id"], r["text"]): r for r in spark.read.parquet(*tables[1].inputFiles()).collect()}
    for r in rows:
        load = audio.pad((r["text"] or "").encode())
        assert r["codec"] == audio.codec_of(load)
        x = audio.expand(r["codec"], load).astype(float)
        taps = audio.filter_taps(1, 4)
        pcm = np.clip(np.rint(np.convolve(x, taps)[len(taps) // 2 :][: len(x) : 4]), -32768, 32767).astype("<i2")
        have = np.frombuffer(found[r["doc_id"], r["text"]]["pcm"], "<i2")
        assert len(have) == len(pcm) and np.abs(have.astype(int) - pcm).max() <= 1  # sums in another order may round otherwise
        assert r["feature"] == f"{r['codec']}:rate=2000,{audio.measures(have)},pcm={hashlib.sha256(have.tobytes()).hexdigest()[:16]}"


def test_audio_query_stores_pcm_at_the_operators_rate(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(audio, "stored", lambda *a, keep=audio.stored, **k: tables.append(keep(*a, **k)) or tables[-1])
    rows = {r["doc_id"]: r for r in queries.op3_audio(spark, SF).collect()}
    heard = {r["doc_id"]: r for r in spark.read.parquet(*tables[1].inputFiles()).collect()}
    assert len(heard) == len(rows) == len({r["doc_id"] for r in queries.table(spark, SF, "documents").collect()})
    for k, r in heard.items():
        made = r["payload_bytes"] // 64 * 121 if r["codec"] == "adpcm" else r["payload_bytes"]
        samples = np.frombuffer(r["pcm"], "<i2")
        assert len(samples) == -(-made * (audio.RATE // 2) // audio.RATE)
        assert rows[k]["feature"] == f"{r['codec']}:rate=4000,{audio.measures(samples)},pcm={hashlib.sha256(samples.tobytes()).hexdigest()[:16]}"


def shingle_set(text, width):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = [w for w in "".join("\x20" if c in "\t\n\x0b\x0c\r" else c for c in lowered).split("\x20") if w]
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def family(seed, copies, size=60):
    """An original, copies with up to a fifth of their words changed, and others."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(size)]
    texts = [" ".join(base)]
    for _ in range(copies):
        words = list(rng.choice(texts[:5]).split())
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words[: size - rng.randint(0, 6)]))
    return texts


def brute_groups(rows, width):
    sets = [shingle_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return {k: (len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows)}


def test_minhash_equals_brute_force(spark, odd):
    texts = [t for seed in range(6) for t in family(seed, 60)] + [None, "", "a b", "A  b", "a b c d", "a b c"]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    got = minhash.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(rows, 4)
    assert minhash.groups(odd).count() == len(ODD) + 2
    twice = [(1, texts[0], "a"), (1, texts[0], "a"), (1, "quite another text of one id", "b"), (0, "quite another text of one id", "c"), (2, "a text of its own", "d"), (None, texts[0], "e"), (3, None, "f"), (3, None, "g"), (3, "", "h")]
    kept = minhash.deduplicated(spark.createDataFrame(twice, "doc_id long, text string, source string").repartition(3)).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept) == sorted([("1", texts[0]), ("0", twice[3][1]), ("2", twice[4][1]), ("None", texts[0]), ("3", ""), ("3", "")])
    kept = minhash.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, *range(len(ODD))]
    assert minhash.deduplicated(odd.limit(0)).count() == 0


def test_minhash_buckets_find_linked_pairs():
    """Recall of the buckets at the threshold: pairs of sets of 4 to 900 shingles, a share of 0.8 to 0.85 of them in common."""
    rng = np.random.default_rng(2)
    missed = tried = 0
    for n in (4, 5, 9, 16, 30, 60, 150, 400, 900):
        for _ in range(250):
            differ = int(rng.integers(0, max(1, n // 5) + 1))
            union = rng.integers(0, 1 << 64, n, np.uint64)
            cut = differ // 2
            a, b = np.sort(union[: n - cut]), np.sort(union[differ - cut :])
            if 100 * (n - differ) < 80 * n or not len(a) or not len(b):
                continue
            keys = minhash.band_keys(np.stack([minhash.signature(a), minhash.signature(b)]))
            tried += 1
            missed += not (keys[0] == keys[1]).any()
    print("pairs", tried, "missed", missed)
    assert tried > 1500 and missed <= tried // 1000


def test_decontaminate(spark, odd):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [" ".join(word() for _ in range(n)) for n in (3, 20, 40, 41, 60)]
    noise = lambda n: " ".join(word() for _ in range(n))
    near = items[4].split()
    near[30] = "changed"
    docs = {0: noise(100), 1: f"{noise(9)} {items[1].upper()}. {noise(9)}", 2: f"{noise(5)} {' '.join(near)}", 3: items[2], 4: f"{noise(3)} {items[0]}, {noise(4)}", 5: " ".join(items[3].split()[:20]), 6: None}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, bench).collect()}
    assert got == {(1, 1), (2, 4), (3, 2), (4, 0)}
    kept = decontaminate.clean(df.withColumn("f", F.lit(1)), bench)
    assert kept.columns == ["doc_id", "text", "f"] and {r["doc_id"] for r in kept.collect()} == {0, 5, 6}
    assert decontaminate.leaks(df.limit(0), bench).count() == 0 and decontaminate.leaks(odd, bench.limit(0)).count() == 0


def best_windows(text, item, percent=80):
    """(similarity, start) of the best window of the item's length, the last one of equals, by trying all."""
    w, v = text.split(), item.split()
    width = min(5, len(v))
    grams = lambda x: Counter(tuple(x[i : i + width]) for i in range(len(x) - width + 1))
    t, best = grams(v), None
    for start in range(max(1, len(w) - len(v) + 1)):
        g = grams(w[start : start + len(v)])
        both = sum((g & t).values())
        s = both / max(1, sum((g | t).values()))
        if s * 100 >= percent:
            best = max(best or (0, 0), (s, start))
    return best


def altered(rng, word, n):
    """An item of n words and what documents make of it: moved, cut, changed, swapped halves, added words, repeats."""
    w = [word() for _ in range(n)]
    if n % 3 == 0:
        w[2:4] = w[6:8] = ["again"] * 2
    noise = [word() for _ in range(rng.randrange(9))]
    k = rng.randrange(1, n - 1)
    made = [noise + w + noise, noise + w[n // 2 :] + w[: n // 2], noise + w[1:] + [word()], [word()] + w[:-2] + noise, w[:k] + [word()] + w[k:] + noise]
    made += [noise + w[:k] + [word()] + w[k + 1 :], w[: n - n // 12], noise + w + w, w[: n // 2] + noise + w[n // 2 :], noise + w[:k] + w[k + 1 :] + noise]
    return " ".join(w), [" ".join(x) for x in made]


def test_decontaminate_equals_all_windows(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items, docs = [], []
    for i, n in enumerate([3, 5, 9, 14, 15, 18, 21, 25, 30, 33, 36, 40, 47, 51, 59, 100, 140]):
        item, made = altered(rng, word, n)
        items.append((i, item))
        docs += made
    rows = [(i % 160, t) for i, t in enumerate(docs)] + [(None, docs[0]), (None, "clean words only"), (7, None), (8, ""), (500, docs[60]), (500, docs[60])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).repartition(5)
    bench = spark.createDataFrame([*items, items[0], (99, items[4][1])], "item_id long, text string")
    expect = {}
    for d, t in rows:
        for i, item in [*items, (99, items[4][1])]:
            if t and (best := best_windows(t, item)):
                expect[d, i] = max(expect.get((d, i), best), best)
    assert len(expect) > 60
    for radius in (decontaminate.RADIUS, 0):  # 0: the rare shingles find whatever is not the same words
        monkeypatch.setattr(decontaminate, "RADIUS", radius)
        got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in decontaminate.leaks(df, bench).collect()}
        assert got == expect
    kept = sorted((str(r["doc_id"]), str(r["text"])) for r in decontaminate.clean(df, bench).collect())
    assert kept == sorted((str(d), str(t)) for d, t in rows if not (t and any(best_windows(t, item) for _, item in items)))


def test_fingerprints_find_nine_in_ten_alike_windows(spark):
    """Recall of the SimHash index alone: pairs at the threshold or above within the radius, and every one of those found."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    pairs = []
    for n in range(14, 60):
        for _ in range(4):
            item, made = altered(rng, word, n)
            for text in made:
                if best := best_windows(text, item):
                    pairs.append((item, " ".join(text.split()[best[1] : best[1] + n]), n))
    rows = spark.createDataFrame(pairs, "item string, doc string, length int")
    rows = rows.withColumn("w", F.split("item", " ")).withColumn("g", decontaminate.fingerprint()).withColumn("w", F.split("doc", " ")).withColumn("f", decontaminate.fingerprint())
    rows = rows.withColumn("distance", F.bit_count(F.col("f").bitwiseXOR(F.col("g")))).withColumn("at", decontaminate.first_block())
    share, near, met = rows.agg(
        F.avg((F.col("distance") <= decontaminate.RADIUS).cast("int")), F.count_if(F.col("distance") <= decontaminate.RADIUS), F.count_if((F.col("distance") <= decontaminate.RADIUS) & F.col("at").isNotNull())
    ).first()
    print("pairs", len(pairs), "within the radius", share)
    assert share > 0.9 and near == met


def test_small_tables_are_few_files(spark, monkeypatch):
    """Of 64 partitions a table of windows, items, groups or smaller families is 16 files at most; what grows like the sets may have more."""
    places = []
    monkeypatch.setattr(common, "new_path", lambda *a, keep=common.new_path: places.append((a[1], keep(*a))) or places[-1][1])
    monkeypatch.setattr(minhash, "scratch", lambda _: contextlib.nullcontext())
    docs, bench = queries.table(spark, SF, "documents"), queries.table(spark, SF, "benchmark")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 64)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = decontaminate.clean(docs, bench).count()
        kept = minhash.deduplicated(docs).count()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    files = {name: len(glob.glob(f"{place.removeprefix('file://')}/part-*")) for name, place in places}
    assert 0 < rows < docs.count() and 0 < kept < docs.count() and {"windows", "leaks", "buckets"} <= set(files)
    assert {name: n for name, n in files.items() if n > 16}.keys() <= {"signatures", "buckets", "members", "sets", "middle", "outside", "seen", "groups"}


def test_warc(spark, tmp_path):
    big = "x" * 300_000
    pages = [(3, "http://a/b c", big), (1, "http://é/", big), (2, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", big), (7, "u", ""), (8, "http://a/b%20c%zz%", "x" * 2_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    path = warc.write(df)
    chunks = warc.read_chunks(spark, path)
    assert chunks.agg(F.max(F.length("data"))).first()[0] <= warc.CHUNK
    got = {r["page_id"]: r for r in warc.records(spark, path).collect()}
    for k, url, html in pages:
        body = (html or "").encode()
        later = len(body) >= 100 and k not in (1, 8)  # 8 has a payload of its own
        assert (got[k]["payload_bytes"], got[k]["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
        assert (got[k]["record_type"], got[k]["refers_to"], got[k]["url"]) == ("revisit" if later else "response", 1 if later else None, url)
    cut = f"{tmp_path}/cut"  # rows dealt at random: every record is mended
    chunks.repartition(5, F.rand(1)).write.parquet(cut)
    assert {r["page_id"] for r in warc.records(spark, cut).collect()} == set(got)
    assert warc.records(spark, warc.write(df.limit(0))).count() == 0


def test_quotes(spark):
    rows = [
        (1, 0, "user", "First thing.\nSecond thing here."),
        (1, 1, "assistant", "Unrelated."),
        (1, 2, "user", "> second THING, here\nI reply."),
        (1, 3, "user", "> > First thing.\n> I reply.\nDeeper."),
        (1, 4, "user", "> never written\nHm."),
        (1, 5, "user", "> also unknown\n>> Unrelated.\nPast it."),
        (2, 0, "user", None), (2, 1, "user", ">>"), (None, 0, "user", "> First thing."), (1, 2, "user", "> second thing here\nAgain."), (1, None, "user", "> First thing."),
        (3, 0, "a", "same line\nmine"), (3, 1, "b", "same line\nother"), (3, 2, "c", "> same line\nties go to the earliest"), (3, 3, "c", "> mine\n> other\nas long as each othe"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("thread", F.lit("clash")).repartition(3)
    got = [(r["conv_id"], r["turn"], r["text"], r["quote_depth"], r["reply_to"], r["reply_level"], r["thread"], r["position"]) for r in quotes.ordered(quotes.conversations(df)).collect()]
    assert sorted(got, key=repr) == sorted(
        [
            (1, 0, "First thing.\nSecond thing here.", 0, None, None, 0, 0), (1, 2, "Again.", 1, 0, 1, 0, 1), (1, 2, "I reply.", 1, 0, 1, 0, 2),
            (1, 3, "Deeper.", 2, 2, 1, 0, 3), (1, 1, "Unrelated.", 0, None, None, 1, 4), (1, 5, "Past it.", 2, 1, 2, 1, 5), (1, 4, "Hm.", 1, None, None, 4, 6),
            (2, 0, "", 0, None, None, 0, 0), (2, 1, "", 2, None, None, 1, 1), (None, 0, "", 1, None, None, 0, None), (1, None, "", 1, None, None, None, None),
            (3, 0, "same line\nmine", 0, None, None, 0, 0), (3, 1, "same line\nother", 0, None, None, 1, 2), (3, 2, "ties go to the earliest", 1, 0, 1, 0, 1), (3, 3, "as long as each othe", 1, 1, 1, 1, 3),
        ], key=repr,
    )
    assert quotes.conversations(df.limit(0)).count() == 0


def quoting(rng, texts):
    """Messages of one conversation, each with the earlier one that it answers: quoted with what that one quotes, to three levels."""
    lines, parents = [], []
    for i, text in enumerate(texts):
        body = [(0, x) for x in text.split("\n")]
        parent = rng.randrange(i) if i and rng.random() < 0.8 else None
        edited = False
        if parent is not None:
            quoted = [(level + 1, x) for level, x in lines[parent] if level < 3]
            edited = rng.random() < 0.2 and any(level == 2 for level, _ in quoted)
            if edited:  # what it answers was rewritten, so only deeper levels are known
                quoted = [(level, f"rewritten {i} {j}" if level == 1 else x) for j, (level, x) in enumerate(quoted)]
            body = quoted + body
        lines.append(body)
        parents.append(parents[parent] if edited else parent)
    return ["\n".join((">" * level + " " + x) if level else x for level, x in body) for body in lines], parents


def test_quotes_link_every_level_of_a_quoting_corpus(spark):
    rng = random.Random(6)
    rows, expect, own = [], {}, {}
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").orderBy("conv_id", "turn").collect()
    chats = defaultdict(list)
    for r in table:
        chats[r["conv_id"] % 40].append(r["text"])
    for c, texts in chats.items():
        texts = [f"message {c} {i}\n{t}" for i, t in enumerate(texts)]
        made, parents = quoting(rng, texts)
        for t, (text, parent) in enumerate(zip(made, parents)):
            rows.append((c, t, "user", text))
            expect[c, t], own[c, t] = parent, texts[t]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {(r["conv_id"], r["turn"]): r for r in quotes.conversations(df).collect()}
    assert len(got) == len(rows) and any(r["reply_level"] == 2 for r in got.values())
    hit = sum(got[k]["reply_to"] == parent for k, parent in expect.items())
    print("quoting corpus", len(rows), "linked as made", hit)
    assert hit == len(rows)
    for c in chats:
        mine = sorted((r["position"], k[1]) for k, r in got.items() if k[0] == c)
        assert [p for p, _ in mine] == list(range(len(mine)))
        place = {t: p for p, t in mine}
        assert all(expect[c, t] is None or place[expect[c, t]] < place[t] for t in place)
    assert all(got[k]["text"] == own[k].strip("\n") for k in got)


def test_url_filter(spark):
    urls = [
        None, "nothing", "HTTP://A.Net/x?q", "http://a.net", "http://Example.NET/en/1#t", "http://b.example.net/fr/", "http://example.com/de/5", "http://notexample.com/de/5",
        "http://x.org/fr/a", "http://x.org/en/a", "http://example.com?u=http://a.net/",
    ]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urltree.judge(df, queries.URL_RULES).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("a.net", "/x", "net/", "block"), 3: ("a.net", "", None, "allow"),
        4: ("example.net", "/en/1", "example.net/en/", "allow"), 5: ("b.example.net", "/fr/", "net/", "block"), 6: ("example.com", "/de/5", "example.com/de/", "block"),
        7: ("notexample.com", "/de/5", None, "allow"), 8: ("x.org", "/fr/a", "org/fr/", "allow"), 9: ("x.org", "/en/a", None, "allow"), 10: ("example.com", "", None, "allow"),
    }
    rows = [(i, f"http://h.x/spam/{i}", "block") for i in range(9)] + [(20 + i, f"http://h.x/good/{i}", "allow") for i in range(9)] + [(40, "http://h.x/spam/77", None), (41, "http://h.x/good/77", None), (42, "http://h.x/new/1", None)]
    verdict = {r["page_id"]: r["verdict"] for r in urltree.judge(spark.createDataFrame(rows, "page_id long, url string, label string"), [], label="label").collect()}
    assert (verdict[40], verdict[41], verdict[42]) == ("block", "allow", "allow")
    assert urltree.judge(df.limit(0), queries.URL_RULES).count() == 0


def test_unlabelled_urls_are_judged_by_the_tree_of_rule_labels(spark):
    rules = [urltree.Rule("block", f"h.x/shop/{s}/") for s in ("pills", "bets", "wins")] + [urltree.Rule("allow", f"h.x/{s}/") for s in ("news", "help")]
    rules += [urltree.Rule("block", "one.x/de/"), urltree.Rule("block", "two.x/a/"), urltree.Rule("block", "two.x/b/")]
    paths = {
        "h.x": [f"shop/{s}/{i}" for s in ("pills", "bets", "wins") for i in range(4)] + [f"{s}/{i}" for s in ("news", "help") for i in range(4)] + ["shop/loans/7", "shop/loans/more/9.html", "blog/7"],
        "one.x": [f"de/{i}" for i in range(20)] + ["en/7"],
        "two.x": [f"{s}/{i}" for s in "ab" for i in range(4)] + ["c/7"],
        "none.x": ["en/7"],
    }
    rows = [(f"http://{h}/{p}",) * 2 for h, ps in paths.items() for p in ps]
    got = {r["page_id"][7:]: r for r in urltree.judge(spark.createDataFrame(rows, "page_id string, url string"), rules).collect()}
    free = {k: (r["verdict"], r["template"], round(r["purity"], 3)) for k, r in got.items() if r["rule"] is None}
    assert free == {
        "h.x/shop/loans/7": ("block", "/shop/{*}/{n}", 0.929), "h.x/shop/loans/more/9.html": ("block", "/shop/{*}*", 0.929), "h.x/blog/7": ("allow", "/{*}/{n}", 0.1),
        "one.x/en/7": ("allow", "/en/{n}", 0.5), "two.x/c/7": ("block", "/{*}/{n}", 0.9), "none.x/en/7": ("allow", "/en/{n}", 0.5),
    }
    assert (got["h.x/shop/bets/1"]["template"], got["h.x/news/1"]["template"], got["one.x/de/1"]["template"]) == ("/shop/{*}/{n}", "/{*}/{n}", "/de/{n}")


def shape(segment):
    """A segment as part of a template, by plain string rules."""
    found = re.fullmatch(r"(.+?)(\.[A-Za-z][A-Za-z0-9]{0,4})?", segment, re.S)
    if not found:
        return segment
    base, ext = found[1], found[2] or ""
    if re.fullmatch(r"\d{4}-\d\d-\d\d", base):
        return "{date}" + ext
    if base.isdigit():
        return "{n}" + ext
    if len(base) >= 8 and re.fullmatch(r"[0-9A-Fa-f-]+", base) and re.search(r"\d", base):
        return "{hex}" + ext
    if not set(base) & set(".{}") and (re.search(r"\d", base) or len(base) >= 24):
        return ("{id}" if re.search(r"\d", base) else "{slug}") + ext
    return segment


def brute_verdicts(pages):
    """verdict, purity of each (key, host, path, label) by dictionaries of all nodes."""
    plain = lambda p: "/".join(shape(x) for x in p.split("/"))
    counts = defaultdict(lambda: [0, 0])
    for _, host, path, label in pages:
        c = counts[host, plain(path)]
        c[0] += label is not None
        c[1] += label == "block"

    def nodes(host, template):
        s, names = template[1:].split("/"), host.split(".")
        for i, x in enumerate(s):
            if x and not x.startswith("{"):
                yield (4, 1, i), (host, tuple(s[:i]), tuple(s[i + 1 :])), x
            yield (4, 0, i), (host, tuple(s[:i])), x
        if any(x and not x.startswith("{") for x in s):
            for k in range(min(3, len(names)) + 1):
                yield (k, 2, 0), (".".join(names[len(names) - k :]), template), names[-k - 1] if k < len(names) else ""

    tree = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for (host, template), (n, b) in counts.items():
        if host and n:
            for rank, key, branch in nodes(host, template):
                tree[rank, key][branch][0] += n
                tree[rank, key][branch][1] += b
    purity = {}
    for (host, template), (n, b) in counts.items():
        best = None
        for rank, key, branch in nodes(host, template) if host else ():
            known = tree.get((rank, key), {})
            if len(known) < 2:
                continue
            nn, nb = (sum(v[j] for v in known.values()) for j in (0, 1))
            p = nb / nn
            like = {k: v for k, v in known.items() if abs(v[1] / v[0] - p) <= 2 * math.sqrt(p * (1 - p) / v[0]) + 1e-9}
            if n == 0:
                best = max(best or (rank, nn, nb), (rank, nn, nb))
            elif rank[1] == 1 and branch in like and len(like) >= 2:
                best = max(best or (rank,), (rank, sum(v[0] for v in like.values()), sum(v[1] for v in like.values())))
        m, c = best[1:] if best else (n, b)
        purity[host, template] = (c + 1) / (m + 2)
    return {k: purity[host, plain(path)] if host else None for k, host, path, _ in pages}


def test_url_tree_equals_brute_force(spark):
    rng = random.Random(3)
    parts = ["news", "shop", "de", "en", "17", "2024-05-06", "a1b2c3d4e5", "x9", "page.html", "5.html", "", "averyveryverylongslugsegment"]
    hosts = ["a.one.x", "b.one.x", "one.x", "two.x", "deep.a.two.x", "c.y", "z", "m.c.y"]
    rows = []
    for i in range(1500):
        host = rng.choice(hosts)
        path = "/" + "/".join(rng.choice(parts) for _ in range(rng.randrange(4)))
        spam = ("shop" in path or "de" in path) != (rng.random() < 0.05)
        rows.append((i, host, path, None if rng.random() < 0.6 or host == "z" and spam else "block" if spam else "allow"))
    rows.append((2000, "h", "/" + "/".join(["s"] * 300) + "/7" * 300, None))
    df = spark.createDataFrame([(k, f"http://{h}{p}", label) for k, h, p, label in [*rows, rows[0]]] + [(None, "http://c.y/de", None)], "page_id long, url string, label string")
    got = [r for r in urltree.judge(df, [], label="label").collect() if r["page_id"] is not None]
    expect = brute_verdicts([*rows, rows[0], (-1, "c.y", "/de", None)])
    assert len(got) == len(rows) + 1 and any(r["verdict"] == "block" for r in got)
    for r in got:
        assert abs(r["purity"] - expect[r["page_id"]]) < 1e-9 and r["verdict"] == ("block" if r["purity"] >= 0.8 else "allow"), r


def test_url_parts_and_rules_equal_sql(spark):
    sf = "/root/testdata/sf0.01"
    sql = f"""WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3 :] ELSE '' END AS rest FROM '{sf}/pages.parquet'),
    h AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
    r AS (SELECT * FROM (VALUES ('net/', 'net', '/'), ('example.net/en/', 'example.net', '/en/'), ('example.com/de/', 'example.com', '/de/'), ('org/fr/', 'org', '/fr/')) v(rule, dom, pre))
    SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule FROM h LEFT JOIN r ON (host = dom OR ends_with(host, '.' || dom)) AND starts_with(path, pre) GROUP BY ALL"""
    expect = duckdb.sql(sql).fetchall()
    got = queries.op10_url_filter(spark, sf)
    assert sorted(map(tuple, got.select("page_id", "host", "path", "rule").collect()), key=repr) == sorted(expect, key=repr)
    free = got.where("rule is null").groupBy("verdict").count().collect()
    assert {r["verdict"] for r in free} == {"allow", "block"}  # the tree decides URLs without a rule


def test_language_and_quality_held_out(spark, odd):
    sf = "/root/testdata/sf0.01"
    got = queries.op9_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98
    got = queries.op1_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["quality"] == got["predicted"]).mean() > 0.93
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs, F.lit(True))
    found = {r["doc_id"]: (r["__lang_pred"], r["__score"], r["__rejected"]) for r in langid.predict(odd, model, keep=["doc_id"], prefix="__").collect()}
    assert found[0] == found[1] == found[2] == ("und", 0.0, True) and found[6][2]
    empty = langid.train(docs.limit(0), F.lit(True))
    assert langid.predict(odd, empty, keep=["doc_id"], prefix="__").where("__lang_pred <> 'und'").count() == 0
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels, F.lit(True))
    x = quality.statistics(pa.array([t for _, t in texts_of(odd)]))
    scored = [r["__s"] for r in quality.score(odd, model, keep=["doc_id"], name="__s").collect()]
    assert np.allclose(sorted(scored), sorted(model.predict(x))) and all(0 <= s <= 1 for s in scored)
    none = quality.train(docs, labels.limit(0), F.lit(True))
    assert {r["__s"] for r in quality.score(odd, none, name="__s").collect()} == {0.5}


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    state = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, state, SF)
        assert kept.columns == docs.columns
        assert kept.join(state, "doc_id", "left_anti").count() == 0
        state = kept
    assert {r["doc_id"] for r in state.select("doc_id").collect()} == {r["doc_id"] for r in out.collect()}
    assert 0 < out.count() < docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in out.collect())


def test_pipeline_stages_take_odd_rows(spark, odd):
    for rows in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, SF).columns == rows.columns
            stage(spark, rows, SF).count()
