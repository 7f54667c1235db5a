"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontam, langid, pipeline, quality, sharding, simhash, substring, tokenfile, toxicity
from .common import table, tokenizer


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicate_components(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", 0.5)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", 0.3)


def op9_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_digest(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_digest(table(spark, sf_dir, "documents"), width=20)


def pipeline_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": pipeline.run}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return pipeline_queries() | {f.__name__: f for f in (op1_simhash, op2_toxicity, op3_ann, op4_bpe, op5_sharding, op6_langid, op7_decontam, op8_quality, op9_tokenfile, op10_substring)}


def oracle_sql() -> dict[str, str]:
    return {"op5_sharding": op5_sql(), "op10_substring": OP10_SQL} | ({} if pipeline.ORACLE_SQL is None else {"pipeline": pipeline.ORACLE_SQL})


def op5_sql(shards: int = 40, slots: int = sharding.SLOTS) -> str:
    """Slots by md5, the two maps as lists, places by windows, and crc32 byte by byte from its polynomial."""
    now = sharding.slot_map(shards, slots)
    return rf"""
WITH t AS (
  SELECT list(list_reduce(list_prepend(CAST(n AS BIGINT), list_transform(range(8), lambda k: 0::BIGINT)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY n) AS tab FROM range(256) AS r(n)
), maps AS (
  SELECT unnest(range({slots})) AS vslot, unnest({now}) AS shard, unnest({sharding.grown(now, shards)}) AS grown_shard
), d AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % {slots} AS vslot FROM documents
), coded AS (
  SELECT *, list_transform(list_filter(string_split(regexp_replace(hex(text), '(..)', '\1 ', 'g'), ' '), lambda h: h <> ''), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM d
), summed AS (
  SELECT doc_id, size, vslot, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM coded, t
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY vslot, doc_id, size, text_crc32) - 1 AS slot, grown_shard, CAST(vslot AS INTEGER) AS vslot,
       CAST(sum(size) OVER (PARTITION BY vslot) AS BIGINT) AS vslot_bytes
FROM summed JOIN maps USING (vslot)"""


#: Words, windows and removal as the contract states them, by plain window equality.
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS key
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)
), ranked AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY key ORDER BY doc_id, s) AS nth FROM windows
), gone AS (
  SELECT doc_id, list(s) AS starts FROM ranked WHERE nth > 1 GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d
), covered AS (
  SELECT DISTINCT doc_id, s + k AS i FROM (SELECT doc_id, unnest(starts) AS s FROM gone), range(20) AS r(k)
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS text, count(*) AS n
  FROM words LEFT JOIN covered ON words.doc_id = covered.doc_id AND words.i = covered.i
  WHERE covered.i IS NULL GROUP BY words.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
