"""Gaussian-kernel smoothing of dated values, with a bootstrap interval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resample import held, resampled

#: Kernel weights, one for each grid date and date of a point, that are broadcast at most.
MOST_BROADCAST = 200_000


def kernel_smooth(points: DataFrame, by: list[str], *, date: str = "date", value: str = "value", bandwidth: float = 60.0, step: int = 7, min_weight: float = 2.0) -> DataFrame:
    """Kernel-weighted means on a grid of ``step`` days; null where the weights add up to less than ``min_weight``."""
    points = points.filter(F.col(date).isNotNull() & F.col(value).isNotNull()).select(*by, F.col(date).alias("d"), F.col(value).cast("double").alias("v"))
    bounds = points.groupBy(*by).agg(F.min("d").alias("a"), F.max("d").alias("z"))
    grid = bounds.select(*by, F.explode(F.sequence("a", "z", F.expr(f"interval {step} days"))).alias("grid_date"))
    weight = F.exp(-0.5 * F.pow(F.datediff("grid_date", "d") / F.lit(bandwidth), 2.0))
    joined = grid.join(points, by) if by else grid.crossJoin(points)  # a grid by one pool of accepted points
    sums = joined.withColumn("w", weight).groupBy(*by, "grid_date").agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("v")).alias("t"))
    return sums.select(*by, "grid_date", F.when(F.col("weight") >= min_weight, F.col("t") / F.col("weight")).alias("mean"), "weight")


def kernel_smooth_bootstrap(points: DataFrame, by: list[str], *, date: str = "date", value: str = "value", bandwidth: float = 60.0, step: int = 7, n_boot: int = 5000, ci: float = 0.90, min_weight: float = 2.0, seed: int = 0) -> DataFrame:
    """The smoother with the interval of its resampled means: ``lo`` and ``hi``.

    A draw whose points weigh less than ``min_weight`` at a grid date has no say there.  What a draw takes is summed
    by date first, so the work is draws times dates times grid, in tasks by draw.
    """
    points = held(points.filter(F.col(date).isNotNull() & F.col(value).isNotNull()).select(*by, F.lit(0).alias("_all"), F.col(date).alias("d"), F.col(value).cast("double").alias("v")))
    keys = [*by, "_all"]
    days = points.groupBy(*keys).agg(F.min("d").alias("a"), F.max("d").alias("z"), F.collect_set("d").alias("days"))
    grid = days.select(*keys, F.explode(F.sequence("a", "z", F.expr(f"interval {step} days"))).alias("grid_date"), "days")
    kernel = grid.select(*keys, "grid_date", F.explode("days").alias("d"))
    kernel = kernel.withColumn("w", F.exp(-0.5 * F.pow(F.datediff("grid_date", "d") / F.lit(bandwidth), 2.0)))
    size = days.agg(F.sum(F.size("days") * (F.datediff("z", "a") / step + 1))).first()[0] or 0
    taken = resampled(points, keys, [F.col("d"), F.col("v")], n_boot, seed).groupBy(*keys, "draw", "d").agg(F.sum("times").alias("c"), F.sum(F.col("times") * F.col("v")).alias("t"))
    weighed = taken.join(F.broadcast(kernel) if size <= MOST_BROADCAST else kernel, [*keys, "d"]).groupBy(*keys, "draw", "grid_date").agg(F.sum(F.col("w") * F.col("c")).alias("weight"), F.sum(F.col("w") * F.col("t")).alias("t"))
    means = weighed.withColumn("m", F.when(F.col("weight") >= min_weight, F.col("t") / F.col("weight")))
    ends = means.groupBy(*keys, "grid_date").agg(F.percentile("m", F.lit((1 - ci) / 2)).alias("lo"), F.percentile("m", F.lit((1 + ci) / 2)).alias("hi"))
    smooth = kernel_smooth(points, keys, date="d", value="v", bandwidth=bandwidth, step=step, min_weight=min_weight)
    return smooth.join(ends, [*keys, "grid_date"], "left").select(*by, "grid_date", "mean", "lo", "hi")
