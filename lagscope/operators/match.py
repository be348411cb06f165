"""Catching up: the predicate, first catch-up joins and their relatives.

Inputs of the joins are frontiers, which hold about ln n of n rows, so pairs within a benchmark
are few; an equality on ``benchmark_id`` stands in every join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CAUGHT_UP_PROBABILITY, MATCH_TOLERANCE, Z_ONE_SIDED_05, months


def match_method(behind_std: Column, ahead_std: Column, probability: Column | None = None) -> Column:
    """Which criterion holds for a pair: "bootstrap" with paired draws, "analytical" with usable deviations, else "threshold"."""
    usable = behind_std.isNotNull() & ahead_std.isNotNull() & ((behind_std > 0) | (ahead_std > 0))
    plain = F.when(usable, F.lit("analytical")).otherwise(F.lit("threshold"))
    return plain if probability is None else F.when(probability.isNotNull(), F.lit("bootstrap")).otherwise(plain)


def caught_up(behind: Column, behind_std: Column, ahead: Column, ahead_std: Column, *, threshold: float | Column = MATCH_TOLERANCE, z: float = Z_ONE_SIDED_05, probability: Column | None = None) -> Column:
    """Whether a score plausibly equals one ahead of it."""
    method = match_method(behind_std, ahead_std, probability)
    analytical = ahead - behind <= z * F.sqrt(behind_std * behind_std + ahead_std * ahead_std)
    plain = F.when(method == "analytical", analytical).otherwise(behind >= ahead - threshold)
    return plain if probability is None else F.when(probability.isNotNull(), probability >= CAUGHT_UP_PROBABILITY).otherwise(plain)


def prob_exceeds(a: Column, b: Column) -> Column:
    """Share of paired draws in which a exceeds b, over pairs of finite draws; null without any."""
    pairs = F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: _finite(p["x"]) & _finite(p["y"]))
    above = F.size(F.filter(pairs, lambda p: p["x"] > p["y"])).cast("double")
    return F.try_divide(above, F.when(a.isNotNull() & b.isNotNull(), F.size(pairs)))


def paired(draws: str | None, behind: str, ahead: str) -> Column | None:
    """The share of draws in which one side's exceed the other's; without a column of draws, none."""
    return prob_exceeds(F.col(f"{behind}_{draws}"), F.col(f"{ahead}_{draws}")) if draws else None


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def sides(df: DataFrame, leader: str = "lead", laggard: str = "lag") -> tuple[DataFrame, DataFrame]:
    """Leaders and laggards with prefixed columns."""

    def side(flag: bool, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in ("benchmark_id", "is_laggard")]
        return df.filter(F.col("is_laggard") == flag).select("benchmark_id", *(F.col(c).alias(f"{name}_{c}") for c in rest))

    return side(False, leader), side(True, laggard)


def first_catchup(front: DataFrame, as_of: Column, *, threshold: float | Column = MATCH_TOLERANCE, draws: str | None = None) -> DataFrame:
    """For each leader on a frontier, the earliest later laggard that caught up with it.

    Unmatched leaders stay, with their age at ``as_of`` as the gap.  ``draws``: an array column of paired draws.
    """
    leaders, laggards = sides(front)
    probability = paired(draws, "lag", "lead")
    stds = F.col("lag_score_std"), F.col("lead_score_std")
    caught = caught_up(F.col("lag_score"), stds[0], F.col("lead_score"), stds[1], threshold=threshold, probability=probability)
    laggards = laggards.withColumnRenamed("benchmark_id", "lag_benchmark")
    pairs = leaders.join(laggards, (F.col("benchmark_id") == F.col("lag_benchmark")) & (F.col("lag_date") > F.col("lead_date")) & caught, "left")
    lag = F.struct("lag_model", "lag_date", "lag_score", match_method(*stds, probability).alias("match_type"))
    first = F.min_by(lag, F.when(F.col("lag_date").isNotNull(), F.struct("lag_date", -F.col("lag_score"), "lag_model"))).alias("m")
    found = pairs.groupBy("benchmark_id", "lead_model", "lead_date", "lead_score").agg(first)
    days = F.datediff(F.coalesce("m.lag_date", as_of), "lead_date")
    return found.select(
        "benchmark_id", "lead_model", "lead_date", "lead_score", "m.lag_model", "m.lag_date", "m.lag_score",
        days.cast("bigint").alias("gap_days"), months(days).alias("gap_months"), F.col("m.lag_date").isNotNull().alias("matched"),
        F.when(F.col("m.lag_date").isNotNull(), F.col("m.match_type")).alias("match_type"),
    )


def frontier_match_map(records: DataFrame, *, threshold: float | Column = MATCH_TOLERANCE, draws: str | None = None) -> DataFrame:
    """For each strict laggard record, the earliest strict leader record that had reached its level.

    ``draws``: an array column of paired draws.
    """
    leaders, laggards = sides(records)
    reached = caught_up(F.col("lead_score"), F.col("lead_score_std"), F.col("lag_score"), F.col("lag_score_std"), threshold=threshold, probability=paired(draws, "lead", "lag"))
    leaders = leaders.withColumnRenamed("benchmark_id", "lead_benchmark")
    pairs = laggards.join(leaders, (F.col("benchmark_id") == F.col("lead_benchmark")) & reached, "left")
    return pairs.groupBy("benchmark_id", "lag_model").agg(F.min_by("lead_model", "lead_date").alias("lead_model"))


def match_map(matches: DataFrame) -> DataFrame:
    """One map of laggard to leader per benchmark, from ``frontier_match_map``; a frontier bounds its size."""
    return matches.groupBy("benchmark_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lag_model", "lead_model")))).alias("matches"))


def with_matched_flag(leaders: DataFrame, gaps: DataFrame, matched: bool) -> DataFrame:
    """Leaders that the gap table calls matched (or not): a semi join."""
    keys = gaps.filter(F.col("matched") == matched).select("benchmark_id", F.col("lead_model").alias("model"))
    return leaders.join(keys, ["benchmark_id", "model"], "left_semi")


def preserve_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows, and the old rows of keys that the new ones lack."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def nearest_event(points: DataFrame, events: DataFrame, by: str = "benchmark_id") -> DataFrame:
    """For each point the event nearest in time; of equally near ones the earlier, then the lesser model.

    Only the last event up to the point and the first after it can be nearest, and windows over both tables
    together find these, so no point meets all events.
    """
    p = points.select(by, "date", F.col("model").alias("point"), F.lit(None).cast(events.schema["model"].dataType).alias("event"))
    e = events.groupBy(by, "date").agg(F.min("model").alias("event")).select(by, "date", F.lit(None).cast(points.schema["model"].dataType).alias("point"), "event")
    order = Window.partitionBy(by).orderBy("date")
    known = F.when(F.col("event").isNotNull(), F.struct("date", "event"))
    both = p.unionByName(e)
    both = both.withColumns({"back": F.last(known, True).over(order.rangeBetween(Window.unboundedPreceding, 0)), "ahead": F.first(known, True).over(order.rangeBetween(0, Window.unboundedFollowing))})
    take_back = F.col("ahead").isNull() | (F.datediff("date", "back.date") <= F.datediff("ahead.date", "date"))
    near = F.when(F.col("back").isNotNull() & take_back, F.col("back")).otherwise(F.col("ahead"))
    out = both.filter("point is not null").withColumn("near", near)
    return out.select(by, F.col("point").alias("model"), "date", F.col("near.event").alias("event_model"), F.col("near.date").alias("event_date"))


def previous_gap(gaps: DataFrame) -> DataFrame:
    """Each gap with the one before it, by leader date."""
    order = Window.partitionBy("benchmark_id").orderBy("lead_date", "lead_model")
    return gaps.withColumn("prev_gap_months", F.lag("gap_months").over(order))


def step_vertices(gaps: DataFrame) -> DataFrame:
    """Vertices of the step line through the gaps: at each date the value held so far, then the new one."""
    order = Window.partitionBy("benchmark_id").orderBy("lead_date", "lead_model")
    held = gaps.withColumn("held", F.lag("gap_months").over(order))
    points = F.array(F.struct(F.lit(0).alias("step"), F.col("held").alias("value")), F.struct(F.lit(1).alias("step"), F.col("gap_months").alias("value")))
    return held.select("benchmark_id", "lead_date", "lead_model", F.explode(points).alias("p")).select("benchmark_id", "lead_date", "lead_model", "p.step", "p.value").filter("value is not null")
