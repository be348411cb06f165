"""The current gap, from matched gaps and the ages of leaders that nobody has matched yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Coefficients of a published rational approximation of the error function (error below 1.5e-7).
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def normal_cdf(z: Column) -> Column:
    """The normal distribution function by that approximation, in built-in functions."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + ERF_P * x)
    poly = t * (ERF[0] + t * (ERF[1] + t * (ERF[2] + t * (ERF[3] + t * ERF[4]))))
    half = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, 1.0 - half).otherwise(half)


def lognormal_prior(gaps: DataFrame, by: list[str]) -> DataFrame:
    """Mean and deviation (0.1 at least) of the logarithms of positive matched gaps, and the prior's mean."""
    log = F.when(F.col("matched") & (F.col("gap_months") > 0), F.ln(F.when(F.col("gap_months") > 0, F.col("gap_months"))))
    g = gaps.groupBy(*by).agg(F.avg(log).alias("mu"), F.greatest(F.stddev_samp(log), F.lit(0.1)).alias("sigma"), F.count(log).alias("n_positive"))
    return g.withColumn("prior_mean", F.exp(F.col("mu") + F.col("sigma") * F.col("sigma") / 2))


def expected_beyond(c: Column, mu: Column, sigma: Column) -> Column:
    """E[X | X > c] of a log-normal X; twice c where next to nothing lies beyond."""
    log_c = F.ln(F.when(c > 0, c))
    survival = 1.0 - normal_cdf((log_c - mu) / sigma)
    mean = F.exp(mu + sigma * sigma / 2)
    beyond = mean * normal_cdf((mu + sigma * sigma - log_c) / sigma) / F.when(survival >= 1e-10, survival)
    return F.when(c <= 0, mean).when(survival < 1e-10, 2 * c).otherwise(beyond)


def current_gap(gaps: DataFrame, by: list[str], *, survival: bool = True, prior_from_first_match: bool = False) -> DataFrame:
    """Estimate the current gap of each group from a first-catch-up table.

    Ages of unmatched leaders are censored gaps: each is replaced by its expectation under the prior, and these
    are averaged with the ages as weights, but never below the oldest age.  With fewer than three (positive)
    matched gaps it is the larger of the oldest age and their 75th percentile, or 1.5 times the oldest age.
    """
    if prior_from_first_match:
        first = gaps.filter("matched").groupBy(*by).agg(F.min("lag_date").alias("first_match"))
        gaps = gaps.join(first, by, "left")
        prior_rows = gaps.withColumn("matched", F.col("matched") & (F.col("lead_date") >= F.col("first_match")))
    else:
        prior_rows = gaps
    matched, months_ = F.col("matched"), F.col("gap_months")
    pool = prior_rows.groupBy(*by).agg(F.count_if(matched).alias("n_matched"), F.count_if(matched & (months_ > 0)).alias("n_pos"), F.percentile(F.when(matched, months_), F.lit(0.75)).alias("p75"), F.percentile(F.when(matched & (months_ > 0), months_), F.lit(0.75)).alias("p75_pos"))
    open_ = gaps.filter(~matched).groupBy(*by).agg(F.max("gap_months").alias("oldest"), F.count("*").alias("n_open"), F.sort_array(F.collect_list("gap_months"), asc=False).alias("ages"))
    expected = gaps.filter(~matched & (months_ > 0)).join(lognormal_prior(prior_rows, by), by).withColumn("e", expected_beyond(F.col("gap_months"), F.col("mu"), F.col("sigma")))
    expected = expected.groupBy(*by).agg((F.sum(F.col("e") * F.col("gap_months")) / F.sum("gap_months")).alias("average"), F.max("prior_mean").alias("prior_mean"))
    g = gaps.select(*by).distinct().join(pool, by, "left").join(open_, by, "left").join(expected, by, "left")
    oldest = F.col("oldest")
    few, few_pos = F.col("n_matched") < 3, F.col("n_pos") < 3
    heuristic = lambda p: F.coalesce(F.greatest(oldest, p), oldest * 1.5)
    ratio = oldest / F.col("prior_mean")
    mle = F.coalesce(F.greatest(F.col("average"), oldest), oldest * 1.3)
    if survival:
        estimate = F.when(oldest.isNull(), 0.0).when(few, F.when(F.col("p75").isNull(), oldest * 1.5).otherwise(heuristic(F.col("p75")))).when(few_pos, F.when(F.col("p75_pos").isNull(), oldest * 1.5).otherwise(heuristic(F.col("p75_pos")))).otherwise(mle)
        method = F.when(oldest.isNull(), "no_unmatched").when(few, "insufficient_data_heuristic").when(few_pos, "insufficient_positive_data").otherwise("survival_analysis_mle")
        confidence = F.when(oldest.isNull(), "high").when(few | few_pos | F.col("average").isNull(), "low").when(ratio < 1.5, "high").when(ratio < 2.5, "medium").otherwise("low")
    else:
        estimate = F.coalesce(oldest, F.lit(0.0))
        method = F.when(oldest.isNull(), "no_unmatched").otherwise("oldest_unmatched")
        confidence = F.when(oldest.isNull() | (F.col("n_open") >= 2), "high").otherwise("medium")
    return g.select(*by, estimate.alias("estimated_gap"), F.coalesce(oldest, F.lit(0.0)).alias("min_gap"), confidence.alias("confidence"), method.alias("method"), F.coalesce(F.size("ages"), F.lit(0)).cast("bigint").alias("n_unmatched"))


def lognormal_density(prior: DataFrame, by: list[str], low: float, high: float, points: int = 200) -> DataFrame:
    """The log-normal density of each group's prior (``mu``, ``sigma``) on an even grid: ``i``, ``x`` and ``density``.
    A group without a prior has none."""
    step = (high - low) / (points - 1)
    grid = prior.filter("mu is not null").select(*by, "mu", "sigma", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint"))).alias("i"))
    grid = grid.withColumn("x", F.lit(low) + F.col("i") * F.lit(step))
    z = (F.ln(F.col("x")) - F.col("mu")) / F.col("sigma")
    return grid.select(*by, "i", "x", (F.exp(-z * z / 2) / (F.col("x") * F.col("sigma") * F.sqrt(F.lit(2 * 3.141592653589793)))).alias("density"))
