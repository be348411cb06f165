"""Greedy spacing: which of many values can be labelled without crowding."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import log10


def spaced(rows: DataFrame, by: str, value: str, least: float = 0.4) -> DataFrame:
    """The values of each ``by``, ascending, that lie ``least`` decades or more above the last one taken.

    All groups take their next value in one round, the least of those that lie far enough above their last one, so
    tables of any size are only aggregated, and none of their values gathered.  There are as many rounds as the
    longest group has labels, a few for each decade that its values span.  The labels taken, and nothing else, pass
    through the driver.
    """
    x = F.col(value).cast("double")
    values = rows.filter(x > 0).select(by, x.alias(value), log10(x).alias("_log"))
    if not least > 0:
        return values.select(by, value).distinct()
    values = values.persist()
    try:
        taken, spark = [], rows.sparkSession
        new = values.groupBy(by).agg(F.min(value).alias(value), F.min("_log").alias("_log"))
        while (last := new.toArrow()).num_rows or not taken:
            taken.append(last)
            before = F.broadcast(spark.createDataFrame(last).toDF("_by", "_last", "_last_log"))  # a row for each group
            beyond = values.join(before, F.col(by).eqNullSafe(F.col("_by"))).filter((F.col(value) > F.col("_last")) & (F.col("_log") - F.col("_last_log") >= least))
            new = beyond.groupBy(by).agg(F.min(value).alias(value), F.min("_log").alias("_log"))
    finally:
        values.unpersist()
    return spark.createDataFrame(pa.concat_tables(taken)).select(by, value)


def packed(rows: DataFrame, by: list[str], start: str, end: str, order: list[str], *, lanes: int = 2, gap: float = 4.0) -> DataFrame:
    """Adds ``lane`` (from 0), the first one that is free for the interval from ``start`` to ``end``, or null.

    Rows are taken by ``order``, and a lane is free from ``gap`` after the end of what it took last.  With as many
    lanes as intervals that ever overlap, none is left out.  The rows of a group are labels of a frontier; a fold over
    them carries the end of each lane.
    """
    ends = F.array_repeat(F.lit(float("-inf")), lanes)
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.struct(*rows.columns).alias("_row"), F.col(start).cast("double").alias("_a"), F.col(end).cast("double").alias("_z"))))

    def step(state, x):
        free = F.array_position(F.transform(state["ends"], lambda e: ~(x["_a"] < e + gap)), F.lit(True)).cast("int") - 1
        taken = F.transform(state["ends"], lambda e, i: F.when(i == free, x["_z"]).otherwise(e))
        return F.struct(taken.alias("ends"), F.concat(state["lanes"], F.array(F.when(free >= 0, free))).alias("lanes"))

    start_state = F.struct(ends.alias("ends"), F.array().cast("array<int>").alias("lanes"))
    groups = rows.groupBy(*by).agg(ordered.alias("all")).withColumn("lanes", F.aggregate("all", start_state, step)["lanes"])
    out = groups.select(F.explode(F.arrays_zip(F.col("all._row").alias("row"), F.col("lanes").alias("lane"))).alias("x"))
    return out.select("x.row.*", "x.lane")
