"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, decontaminate, langid, minhash, pfor, quality, quotes, urltree, warc
from .common import fold

URL_RULES = [
    urltree.Rule("block", "net/"),
    urltree.Rule("allow", "example.net/en/"),
    urltree.Rule("block", "example.com/de/"),
    urltree.Rule("allow", "org/fr/"),
]
QUALITY_FOLDS, LANG_FOLDS = 5, 3
QUALITY_LEAST = 0.3


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, parts: int, remainder: int) -> Column:
    """Rows that are never learned from; a null id counts as one of them."""
    return F.coalesce(fold(doc_id, parts) == remainder, F.lit(True))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), QUALITY_FOLDS, 0))
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), QUALITY_FOLDS, 0).alias("held_out"), "score", (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = pfor.write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)
    return pfor.read_documents(spark, path)


def op3_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = audio.store_text(table(spark, sf_dir, "documents"), keep=["doc_id"])
    rows = audio.media_features(media, keep=["doc_id", "n_bytes"])
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minhash.groups(table(spark, sf_dir, "documents"), width=4, percent=80)
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write(table(spark, sf_dir, "pages"))
    return warc.records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), split_pattern(), keep=["doc_id"])


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), LANG_FOLDS, 1)
    model = langid.train(docs, ~out)
    return langid.predict(docs, model, keep=["doc_id"]).select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge(table(spark, sf_dir, "pages"), URL_RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_token_files, op3_audio, op4_minhash, op5_decontaminate, op6_warc, op7_quotes, op8_bpe, op9_langid, op10_url_filter)
}
OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3]))) END AS s
  FROM words
), shingles AS (SELECT doc_id, unnest(s) AS g FROM sets), sizes AS (SELECT doc_id, len(s) AS n FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)
), sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS r FROM sym UNION SELECT reach.doc_id, sym.b FROM reach JOIN sym ON sym.a = reach.r)
SELECT doc_id, n::BIGINT AS n_shingles, coalesce((SELECT min(r) FROM reach WHERE reach.doc_id = sizes.doc_id), doc_id) AS component_id,
  coalesce((SELECT min(r) FROM reach WHERE reach.doc_id = sizes.doc_id), doc_id) = doc_id AS kept
FROM sizes
"""
OP5_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
items AS (SELECT item_id, w, len(w) AS length FROM b WHERE len(w) >= 5),
entries AS (SELECT item_id, length, unnest(range(1, length - 3)) AS q, w FROM items),
ec AS (SELECT item_id, length, concat_ws(' ', w[q], w[q + 1], w[q + 2], w[q + 3], w[q + 4]) AS g, count(*) AS k FROM entries GROUP BY ALL),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5),
dg AS (SELECT doc_id, len(w) AS n, p - 1 AS p, concat_ws(' ', w[p], w[p + 1], w[p + 2], w[p + 3], w[p + 4]) AS g FROM dp),
hits AS (SELECT doc_id, n, p, g, item_id, length, k FROM dg JOIN ec USING (g)),
-- every window of the item's length that has the shared shingle: its first word, from 0
placed AS (SELECT doc_id, item_id, n, length, p, g, k, unnest(range(greatest(0, least(n - length, p - length + 5)), greatest(0, least(n - length, p)) + 1)) AS start FROM hits),
meets AS (SELECT doc_id, item_id, n, length, start, g, k, count(DISTINCT p) AS c FROM placed WHERE p BETWEEN start AND start + length - 5 GROUP BY ALL),
met AS (SELECT doc_id, item_id, start, least(n, length) - 4 AS wn, length - 4 AS en, sum(least(k, c)) AS i FROM meets GROUP BY ALL),
sim AS (SELECT doc_id, item_id, start, i::DOUBLE / (wn + en - i)::DOUBLE AS similarity FROM met),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start DESC) AS r FROM sim WHERE 100 * similarity >= 80)
SELECT doc_id, item_id, similarity, start::INTEGER AS start FROM best WHERE r = 1
"""
OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
ORACLE_SQL: dict[str, str] = {"op4_minhash": OP4_SQL, "op5_decontaminate": OP5_SQL, "op6_warc": OP6_SQL}
