"""Features of texts that arrive in a stream, and rollups over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import surface


def feature_stream(texts: DataFrame, column: str = "text") -> DataFrame:
    """Families without a model, row by row: the batch projection as it is, since none of them keeps state."""
    return surface.readability(surface.sentence_length(texts, column), column)


def windowed_rollup(events: DataFrame, time: str = "ts", user: str = "user_id", value: str = "value", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean and number of a user's values in windows of event time; what comes later than `late` is dropped."""
    w = F.window(F.col(time), window)
    return events.withWatermark(time, late).groupBy(w.alias("w"), F.col(user)).agg(F.avg(value).alias("mean_value"), F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), user, "mean_value", "n")
