"""Exact order statistics of many groups at once, without sorting their rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketch that bounds a percentile, how many of its errors the bounds lie apart from it, and rows up to
#: which a group is its own bin.
ACCURACY, ERRORS, WHOLE = 20_000, 4, 10_000


def _same(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, (p.eqNullSafe(q) for p, q in zip(a, b, strict=True)))


def exact_percentile(rows: DataFrame, by: list[str], value: str, p: float, name: str) -> DataFrame:
    """``by`` and ``name``: the percentile ``p`` (0 to 1) of the known values of each group, interpolated linearly.

    A mergeable sketch of each group gives bounds of its own about the percentile.  A second pass counts the rows
    below them, and each value between them; of these counts, which are a few of 10,000 rows, the values at both
    sides of the percentile are read.  The bounds meet the rows on salted keys, so a group of any size is
    counted by all tasks.  Should the sketch err more than it may, the query fails rather than answer wrongly.
    """
    rows = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("x"))
    off = ERRORS / ACCURACY
    sketch = F.percentile_approx("x", [max(0.0, p - off), min(1.0, p + off)], ACCURACY)
    bounds = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("z"), sketch.alias("b"))
    few = F.col("n") <= WHOLE
    at = F.lit(p) * (F.col("n") - 1)
    bounds = bounds.select(*(F.col(c).alias(f"_{c}") for c in by), F.when(few, F.col("a")).otherwise(F.col("b")[0]).alias("low"), F.when(few, F.col("z")).otherwise(F.col("b")[1]).alias("high"), at.alias("at"))

    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = bounds.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.hash("x"), F.lit(salts)))
    both = dealt.join(salted, (F.col("salt") == F.col("_salt")) & _same([F.col(c) for c in by], [F.col(f"_{c}") for c in by])).filter("x <= high")
    counts = both.groupBy(*by, "at", F.when(F.col("x") >= F.col("low"), F.col("x")).alias("v")).agg(F.count("*").alias("m"))  # null: all those below

    order = Window.partitionBy(*by).orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("m").over(order)
    placed = counts.withColumns({"before": upto - F.col("m"), "upto": upto, "k": F.floor("at")})
    here = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("upto")), F.col("v")))
    out = placed.groupBy(*by, "at", "k").agg(here(F.col("k")).alias("lower"), here(F.col("k") + 1).alias("upper"))
    exact = F.when(F.col("at") == F.col("k"), F.col("lower")).otherwise((F.col("k") + 1 - F.col("at")) * F.col("lower") + (F.col("at") - F.col("k")) * F.col("upper"))
    return out.select(*by, F.when(exact.isNotNull(), exact).otherwise(F.raise_error(F.lit("the bounds of a percentile miss it")).cast("double")).alias(name))
