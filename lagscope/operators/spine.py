"""Calendar spines: gaps as of each day or month, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MATCH_TOLERANCE, months
from .frontier import strict_records
from .match import caught_up, paired, sides


def _in_force(records: DataFrame, name: str) -> DataFrame:
    """Records with the day before the next one of their benchmark, until when they are the best."""
    after = F.lead(f"{name}_date").over(Window.partitionBy("benchmark_id").orderBy(f"{name}_date"))
    return records.withColumn("until", F.date_sub(after, 1))


def daily_gap(front: DataFrame, *, threshold: float | Column = MATCH_TOLERANCE, start: Column | None = None, end: Column | None = None, draws: str | None = None) -> DataFrame:
    """For each benchmark and day of the window: the time since the latest leader record that the day's best
    laggard has caught up with (``gap_months``), the same by score alone (``strict_months``), and the score
    between the best of both groups and the best laggard (``vertical``).

    The window runs from the first day that both groups have a record to the last date, unless given.  A day on
    which no leader is caught up with counts from the first leader.  ``draws``: an array column of paired draws.
    """
    leaders, laggards = sides(strict_records(front))
    bounds = leaders.groupBy("benchmark_id").agg(F.min("lead_date").alias("first_lead"), F.max("lead_date").alias("last_lead"))
    bounds = bounds.join(laggards.groupBy("benchmark_id").agg(F.min("lag_date").alias("first_lag")), "benchmark_id")
    last = front.groupBy("benchmark_id").agg(F.max("date").alias("last"))
    bounds = bounds.join(last, "benchmark_id").select("benchmark_id", (start if start is not None else F.greatest("first_lead", "first_lag")).alias("ws"), (end if end is not None else F.col("last")).alias("we"))
    spans = _in_force(laggards, "lag").join(bounds, "benchmark_id")
    a, z = F.greatest("lag_date", "ws"), F.least(F.coalesce("until", "we"), "we")
    # a pair of records is judged once, then counted on each of its days
    caught = caught_up(F.col("lag_score"), F.col("lag_score_std"), F.col("lead_score"), F.col("lead_score_std"), threshold=threshold, probability=paired(draws, "lag", "lead"))
    pairs = spans.filter(a <= z).join(leaders, "benchmark_id").select("benchmark_id", "lag_model", "lag_score", "lead_date", "lead_score", a.alias("a"), z.alias("z"), caught.alias("caught"))
    open_ = pairs.filter(F.greatest("a", "lead_date") <= F.col("z")).withColumn("day", F.explode(F.sequence(F.greatest("a", "lead_date"), "z")))
    per_day = open_.groupBy("benchmark_id", "day", "lag_model", "lag_score").agg(
        F.max(F.when(F.col("caught"), F.col("lead_date"))).alias("ref"), F.max(F.when(F.col("lag_score") > F.col("lead_score"), F.col("lead_date"))).alias("ref_strict"),
        F.min("lead_date").alias("first"), F.max("lead_score").alias("best"),
    )
    since = lambda ref: months(F.datediff("day", F.coalesce(ref, "first")))
    return per_day.select("benchmark_id", "day", "lag_model", since("ref").alias("gap_months"), since("ref_strict").alias("strict_months"), (F.greatest("best", "lag_score") - F.col("lag_score")).alias("vertical"))


def gap_metrics(daily: DataFrame) -> DataFrame:
    """Mean, deviation and 90 % interval of the daily gaps of each benchmark."""
    low_high = lambda c: F.percentile(c, F.array(F.lit(0.05), F.lit(0.95)))
    out = daily.groupBy("benchmark_id").agg(
        F.avg("gap_months").alias("avg_gap_months"), F.avg("strict_months").alias("avg_strict_months"), F.coalesce(F.stddev_samp("gap_months"), F.lit(0.0)).alias("gap_std"),
        low_high("gap_months").alias("t"), F.avg("vertical").alias("avg_vertical"), low_high("vertical").alias("v"), F.min("day").alias("window_start"), F.max("day").alias("window_end"), F.count("*").alias("n_days"),
    )
    t, v = F.col("t"), F.col("v")
    return out.withColumns({"gap_low": t[0], "gap_high": t[1], "vertical_low": v[0], "vertical_high": v[1]}).drop("t", "v")


def vertical_daily(front: DataFrame) -> DataFrame:
    """Best leader less best laggard of each day on which both groups have a record."""
    return daily_gap(front).select("benchmark_id", "day", "vertical")


def month_spine(bounds: DataFrame, first: str, last: str) -> DataFrame:
    """Month steps from ``first`` to ``last``; a step's day never exceeds the shortest month met so far."""
    number = F.expr(f"explode(sequence(0, greatest(0, cast(months_between(trunc({last}, 'MM'), trunc({first}, 'MM')) as int))))")
    steps = bounds.withColumn("i", number).withColumn("month", F.add_months(F.trunc(first, "MM"), F.col("i")))
    so_far = Window.partitionBy("benchmark_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    day = F.least(F.dayofmonth(first), F.min(F.dayofmonth(F.last_day("month"))).over(so_far))
    return steps.withColumn("day", F.date_add("month", day - 1)).filter(F.col("day") <= F.col(last)).drop("i", "month")


def historical_gap(front: DataFrame, as_of: Column, *, threshold: float | Column = MATCH_TOLERANCE, draws: str | None = None) -> DataFrame:
    """Month by month from half a year after the first record: how long after the first leader of its level the
    best laggard came, and whether it had caught up with the best leader.  Months in which a group is empty are
    left out; no leader at the level means 0 and matched.  ``draws``: an array column of paired draws."""
    bounds = front.groupBy("benchmark_id").agg(F.add_months(F.min("date"), 6).alias("first")).withColumn("last", as_of).filter("first <= last")
    spine = month_spine(bounds, "first", "last").select("benchmark_id", "day")
    leaders, laggards = sides(front)

    def best(rows: DataFrame, name: str) -> DataFrame:
        own = [c for c in rows.columns if c != "benchmark_id"]
        joined = spine.join(rows, "benchmark_id").filter(F.col(f"{name}_date") <= F.col("day"))
        key = F.struct(-F.col(f"{name}_score"), f"{name}_date", f"{name}_model")
        return joined.groupBy("benchmark_id", "day").agg(F.min_by(F.struct(*own), key).alias("r")).select("benchmark_id", "day", "r.*")

    now = best(laggards, "lag").join(best(leaders, "lead"), ["benchmark_id", "day"])
    level = leaders.select("benchmark_id", F.col("lead_date").alias("l_date"), F.col("lead_score").alias("l_score"), F.col("lead_score_std").alias("l_std"), *([F.col(f"lead_{draws}").alias(f"l_{draws}")] if draws else []))
    reached = now.join(level, "benchmark_id").filter((F.col("l_date") <= F.col("day")) & caught_up(F.col("l_score"), F.col("l_std"), F.col("lag_score"), F.col("lag_score_std"), threshold=threshold, probability=paired(draws, "l", "lag")))
    first = reached.groupBy("benchmark_id", "day").agg(F.min("l_date").alias("at_level"))
    out = now.join(first, ["benchmark_id", "day"], "left")
    gap = F.coalesce(F.greatest(F.lit(0.0), months(F.datediff("lag_date", "at_level"))), F.lit(0.0))
    matched = F.col("at_level").isNull() | caught_up(F.col("lag_score"), F.col("lag_score_std"), F.col("lead_score"), F.col("lead_score_std"), threshold=threshold, probability=paired(draws, "lag", "lead"))
    return out.select("benchmark_id", "day", gap.alias("gap_months"), matched.alias("matched"), F.col("lead_model").alias("reference_model"), F.col("lead_score").alias("reference_score"), F.col("lag_model").alias("laggard_model"), F.col("lag_score").alias("laggard_score"))


def statistics(front: DataFrame, gaps: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per benchmark: averages (0 where a group is missing), the current vertical gap and match counts."""
    best = front.groupBy("benchmark_id").agg(F.max(F.when(F.col("is_laggard"), F.col("score"))).alias("lag"), F.max(F.when(~F.col("is_laggard"), F.col("score"))).alias("lead"))
    counts = gaps.groupBy("benchmark_id").agg(F.count_if("matched").alias("total_matched"), F.count_if(~F.col("matched")).alias("total_unmatched"))
    out = best.join(metrics, "benchmark_id", "left").join(counts, "benchmark_id", "left")
    zero = ["avg_gap_months", "avg_strict_months", "gap_std", "gap_low", "gap_high", "avg_vertical", "vertical_low", "vertical_high", "total_matched", "total_unmatched", "n_days"]
    return out.select("benchmark_id", F.coalesce(F.col("lead") - F.col("lag"), F.lit(0.0)).alias("current_vertical_gap"), *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in zero))
