"""Submissions in, results out. Column roles are found by name at plan time; nothing is read to find them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats, text
from ..functions.vocabularies import FAMILY_PLACES, PLACES, QUESTION_PATTERN, RATING_COLUMN, RATING_PLACES, RESPONSE_PATTERN, SHARE_COLUMNS


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def scratch(spark: SparkSession, label: str = "stored") -> str:
    """A new path in the folder of spark.checkpoint.dir, which all executors share.

    Where that is unset, a session in one process takes a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not context._jsc.sc().isLocal():
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="textquarry-"))
        folder = context._jsc.sc().getCheckpointDir().get()
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """df written once as Parquet to a scratch folder, with the writer's options, and read from there."""
    path = scratch(df.sparkSession)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c, re.IGNORECASE)]


def require(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV file with a header; missing paths are named before anything runs."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def with_ordinal(df: DataFrame, order: list[str], name: str = "user_id", scratch: str | None = None) -> DataFrame:
    """Rows numbered from 0 along a key, without one global sort: ranges are sorted apart and offset by their counts.

    The ranges' bounds come from a sample, so both readings of them must be of one evaluation: df is written to `scratch`,
    a folder that all executors share, and read again; without one it is persisted, and an evaluation that was lost with an
    executor is made anew from the same bounds as long as the session lives.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    if scratch:
        ranged.write.mode("overwrite").parquet(scratch)
        ranged = df.sparkSession.read.schema(ranged.schema).parquet(scratch)
    else:
        ranged = ranged.persist(StorageLevel.DISK_ONLY_2)
    numbered = ranged.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    # a row for each range
    counts = ranged.groupBy("_part").count()
    offsets = counts.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return numbered.join(offsets, "_part").withColumn(name, (F.col("_before") + F.col("_nth")).cast("long")).drop("_part", "_nth", "_before")


def submission(df: DataFrame, file_id: int | None = None, strict: bool = False, stripped: bool = True, distinct_columns: bool = False) -> DataFrame:
    """Keys, question, text and rating of a raw table; unrated rows are left out before any feature is computed.

    `distinct_columns` merges response columns of equal content once. A numeric rating is clipped to 1..5, a label mapped.
    """
    responses = columns_like(df, RESPONSE_PATTERN)
    if not responses:
        raise ValueError("no response column")
    require(df, RATING_COLUMN)
    questions = columns_like(df, QUESTION_PATTERN)
    cells = [F.col(f"`{c}`") for c in responses]
    merged = text.strip(F.array_join(F.array_distinct(F.array(*(F.coalesce(c.cast("string"), F.lit("")) for c in cells))), " ")) if distinct_columns else text.merge(*cells, stripped=stripped)
    label = F.col(f"`{RATING_COLUMN}`")
    textual = isinstance(df.schema[RATING_COLUMN].dataType, T.StringType)
    rating = (stats.strict_rating_of_label(label) if strict else stats.rating_of_label(label)) if textual else stats.clip(label.cast("double"))
    keys = [F.col("user_id")] if "user_id" in df.columns else []
    file = [F.lit(file_id).cast("long").alias("file_id")] if file_id is not None else [F.col("file_id")] if "file_id" in df.columns else []
    out = df.select(*keys, *file, (text.merge(*(F.col(f"`{c}`") for c in questions)) if questions else F.lit("")).alias("question"), merged.alias("text"), rating.alias("rating"))
    return out.where(F.col("rating").isNotNull() & ~F.isnan("rating"))


def read_submissions(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Files stacked, file_id their place in the list, user_id the row's place in its file."""
    for p in paths:
        if not exists(spark, p):
            raise FileNotFoundError(p)
    out = None
    for k, path in enumerate(paths):
        # rows of a CSV file with line breaks in its cells are found from its beginning, so one task reads it, and what it
        # numbers from 0 is the place in the file
        raw = read_csv(spark, path).coalesce(1).withColumn("user_id", F.monotonically_increasing_id())
        one = submission(raw, k, **options)
        out = one if out is None else out.unionByName(one)
    return out


def read_master(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A feature table, CSV or Parquet by its name, with the columns asked for."""
    df = read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)
    return require(df, *columns).select(*columns) if columns else df


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """Rows, per-user tables, feature tables and predictions, as Parquet or as CSV with a header."""
    writer = df.write.mode(mode)
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def round_columns(df: DataFrame, places: dict[str, int]) -> DataFrame:
    """Columns rounded half to even, as output files have them."""
    return df.select(*(F.bround(F.col(c), places[c]).alias(c) if c in places else F.col(c) for c in df.columns))


def places_of(df: DataFrame, family: str | None = None) -> dict[str, int]:
    """Decimal places of a family's real columns: predictions and ratings' means two, shares four, others by the family."""
    real = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    own = FAMILY_PLACES.get(family, PLACES)
    return {c: RATING_PLACES if c.startswith("pred") or c.endswith("avg_rating") else PLACES if c in SHARE_COLUMNS else own for c in real if c != "rating"}


def write_family(df: DataFrame, path: str, family: str | None = None, kind: str = "csv") -> None:
    """A family's rows as its output files have them: keys, rating, features and predictions, rounded."""
    write(round_columns(df, places_of(df, family)), path, kind)
