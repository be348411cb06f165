"""Canonical frames on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import to_canonical

#: The date on which open gaps are read.
AS_OF = "2001-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scored records: urgent and high priorities trail."""
    return to_canonical(
        table(spark, sf_dir, "orders"),
        {"benchmark_id": "o_orderstatus", "model": "o_orderkey", "date": F.col("o_orderdate").cast("date"), "score": "o_totalprice", "score_std": (F.col("o_orderkey") % 5) * 100.0, "is_laggard": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")},
    )


def with_draws(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a column ``draws``: those of the vector that the record's number picks, null for many."""
    draws = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pick"), F.col("embedding").cast("array<double>").alias("draws"))
    return rows.join(draws, F.col("model") % 101 == F.col("pick"), "left").drop("pick")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored records without deviations: even users trail."""
    return to_canonical(
        table(spark, sf_dir, "events"),
        {"benchmark_id": "event_type", "model": "event_id", "date": F.col("ts").cast("date"), "score": "value", "is_laggard": F.col("user_id") % 2 == 0},
    )


def as_of():
    return F.lit(AS_OF).cast("date")
