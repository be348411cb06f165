"""Frontiers of a stream: the running best of each group by day, as records arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_best(stream: DataFrame, *, time: str = "ts", delay: str = "7 days") -> DataFrame:
    """The best score of each group and day, with a watermark after which a day is final.

    Only day totals are kept as state, so it grows with days within the watermark, not with rows.
    """
    days = stream.withWatermark(time, delay).groupBy("benchmark_id", "is_laggard", F.window(time, "1 day").alias("w"))
    return days.agg(F.max("score").alias("score")).select("benchmark_id", "is_laggard", F.col("w.start").cast("date").alias("date"), "score")


def frontier_of_days(days: DataFrame) -> DataFrame:
    """Strict records among final days: a batch step over the table that ``daily_best`` is written to."""
    from ..operators.frontier import strict_records

    return strict_records(days.withColumn("model", F.col("date")))
