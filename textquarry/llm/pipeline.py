"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is written as Parquet and read again.
All stages but the last keep the columns of documents, whatever their names. Nulls, empty and very long texts, repeated rows,
ties and empty tables are as each operator's docstring says.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, langid, simhash, substring
from .common import shared_dir, table, tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in which no language makes up a third of the words, go."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id: documents whose SimHash fingerprints
    differ by three bits at most, as op1_simhash links them, and those of similar sets of shingles that fingerprints miss."""
    return simhash.drop_near_duplicates(docs, printed=3, distance=3)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 20 words that an earlier document has are cut out; every document stays."""
    return substring.remove_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other numbers and names, go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document that is left. Null and empty texts have no tokens;
    repeated rows, and rows of one id or none, have a row each; an empty table has none; further columns are ignored."""
    return bpe.encode_digest(docs, tokenizer("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontaminate),
    ("bpe encoding and decoding", encode),
]

#: Language models, similarity joins and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
