"""The documents table read as a survey: five files, a user for each five documents, labels for ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabularies import RATING_LABELS
from ..sources.tables import submission

FILES = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns as a survey's file has them. Of seven rows one has an unknown label and one none.

    textquarry.spread, where a session sets it, is a number of partitions that rows are dealt over first: for files of fewer
    row groups than cores, which Spark cannot split. It is unset otherwise, at any size.
    """
    labels = F.array(*map(F.lit, [*RATING_LABELS, "Other", None]))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    if spread := spark.conf.get("textquarry.spread", None):
        d = d.repartition(int(spread))
    return d.select(F.floor(F.col("doc_id") / FILES).cast("long").alias("user_id"), (F.col("doc_id") % FILES).cast("long").alias("file_id"), F.concat(F.lit("Is this about "), "source", F.lit(" in "), "lang", F.lit("?")).alias("Question"), F.col("text").alias("Response 1"), labels[(F.col("doc_id") % 7).cast("int")].alias("Rating"))


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, file_id, question, text, rating of the rated rows."""
    return submission(raw(spark, sf_dir))


SQL = r"""
survey AS (
  SELECT * FROM (
    SELECT doc_id // 5 AS user_id, doc_id % 5 AS file_id, 'Is this about ' || source || ' in ' || lang || '?' AS question,
           regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS text,
           CASE WHEN doc_id % 7 < 5 THEN CAST(doc_id % 7 + 1 AS DOUBLE) END AS rating
    FROM documents
  ) WHERE rating IS NOT NULL
), worded AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*') AS w FROM survey
)"""
