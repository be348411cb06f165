"""Trend lines, trend gaps and the release-lag bracket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import months
from .frontier import strict_records
from .match import sides
from .resample import held, resampled

DAYS_PER_YEAR = 365.25
#: The logit clip, the longest projection and the range of date ordinals.
LOGIT_CLIP, MAX_FORWARD_MONTHS, MAX_ORDINAL = 0.1, 240.0, 3652059
#: Ordinal of 1970-01-01.
EPOCH = 719163


def transformed(score: Column, transform: str) -> Column:
    """The score in fit space: "linear", "logit" of a percentage (clipped) or "log"."""
    if transform == "linear":
        return score.cast("double")
    if transform == "logit":
        p = F.least(F.greatest(score, F.lit(LOGIT_CLIP)), F.lit(100 - LOGIT_CLIP))
        return F.ln(p / (100.0 - p))
    if transform == "log":
        return F.ln(F.when(score > 0, score))
    raise ValueError(f"unknown transform: {transform}")


def ordinal(date: Column) -> Column:
    return (F.unix_date(date) + EPOCH).cast("double")


def _line(x: Column, y: Column, name: str, when: Column | None = None) -> list[Column]:
    """Slope and mean point of y on x; days count from 2000-01-01 so that sums stay exact."""
    near = x - 730120.0
    if when is not None:
        near, y = F.when(when, near), F.when(when, y)
    ok = y.isNotNull()
    return [F.regr_slope(y, near).alias(f"{name}_slope"), F.avg(F.when(ok, near)).alias(f"{name}_x"), F.avg(y).alias(f"{name}_y"), F.countDistinct(F.when(ok, near)).alias(f"{name}_days"), F.count(y).alias(f"{name}_n")]


def trends(df: DataFrame, by: list[str], *, bounded: bool = False) -> DataFrame:
    """Linear and exponential (or, for bounded percentages, logit) growth per year of each group.

    Groups need two dates.  Without two dates of positive scores the exponential figures are 0 % and 1.
    """
    x, score = ordinal(F.col("date")), F.col("score")
    df = df.filter("date is not null and score is not null")
    aggs = [*_line(x, score, "lin"), *_line(x, transformed(score, "logit" if bounded else "log"), "bent"), F.min("date").alias("start_date"), F.max("date").alias("end_date")]
    out = df.groupBy(*by).agg(*aggs).filter("lin_days >= 2" + ("" if bounded else " and bent_n > 0"))
    at = lambda d: F.col("lin_y") + F.col("lin_slope") * (ordinal(F.col(d)) - 730120.0 - F.col("lin_x"))
    k = F.when(F.col("bent_days") >= 2, F.col("bent_slope") * DAYS_PER_YEAR).otherwise(0.0)
    none = F.lit(None).cast("double")
    bent = {"percent_per_year": none, "multiple_per_year": none, "doubling_years": none, "logit_per_year": F.col("bent_slope") * DAYS_PER_YEAR} if bounded else {"percent_per_year": (F.exp(k) - 1) * 100, "multiple_per_year": F.exp(k), "doubling_years": F.when(k > 0, F.ln(F.lit(2.0)) / F.when(k > 0, k)), "logit_per_year": none}
    return out.select(*by, F.col("lin_n").alias("n"), (F.col("lin_slope") * DAYS_PER_YEAR).alias("absolute_per_year"), *(v.alias(c) for c, v in bent.items()), "start_date", at("start_date").alias("start_score"), "end_date", at("end_date").alias("end_score"))


def with_periods(df: DataFrame, by: list[str], fixed: Column | None = None) -> DataFrame:
    """Rows tagged "overall", and "early" or "recent" about the middle of their group's dates where the group
    spans over a year with six rows and three on each side; about ``fixed``, where given and inside the span,
    with two on each side."""
    df = df.filter("date is not null and score is not null")
    span = df.groupBy(*by).agg(F.min("date").alias("a"), F.max("date").alias("z"), F.count("*").alias("n"))
    span = span.withColumn("cut", F.date_add("a", F.floor(F.datediff("z", "a") / 2).cast("int")) if fixed is None else fixed)
    tagged = df.join(span, by).withColumn("period", F.when(F.col("date") < F.col("cut"), "early").otherwise("recent"))
    side = tagged.groupBy(*by).agg(F.count_if(F.col("period") == "early").alias("n_early"), F.count_if(F.col("period") == "recent").alias("n_recent"))
    least = 3 if fixed is None else 2
    wide = (F.datediff("z", "a") > 365) & ((F.col("n") >= 6) if fixed is None else (F.col("a") < F.col("cut")) & (F.col("cut") < F.col("z")))
    split = tagged.join(side, by).filter(wide & (F.col("n_early") >= least) & (F.col("n_recent") >= least))
    return df.withColumn("period", F.lit("overall")).unionByName(split.select(*df.columns, "period"))


def trend_gap(front: DataFrame, transform: str = "linear", *, min_points: int = 3, as_of: Column | None = None) -> DataFrame:
    """The time between the trend lines of both frontiers: backwards from the laggards' level to when the leaders'
    line had it, its change per year, and forwards to when the laggards' line reaches the leaders' best."""
    rows = front.filter("date is not null and score is not null").withColumns({"x": ordinal(F.col("date")), "y": transformed(F.col("score"), transform)}).filter("y is not null")
    lag = F.col("is_laggard")
    g = rows.groupBy("benchmark_id").agg(*_line(F.col("x"), F.col("y"), "lag", lag), *_line(F.col("x"), F.col("y"), "lead", ~lag), F.max("x").alias("last"), F.max(F.when(~lag, F.col("y"))).alias("best"))
    g = g.filter(f"lag_n >= {min_points} and lead_n >= {min_points} and lag_days >= 2 and lead_days >= 2 and lead_slope > 0")
    now = (F.col("last") if as_of is None else ordinal(as_of)) - 730120.0
    level = F.col("lag_y") + F.col("lag_slope") * (now - F.col("lag_x"))
    then = F.col("lead_x") + (level - F.col("lead_y")) / F.col("lead_slope")
    cross = F.when(F.col("lag_slope") > 0, F.col("lag_x") + (F.col("best") - F.col("lag_y")) / F.when(F.col("lag_slope") > 0, F.col("lag_slope")))
    forward = months(cross - now)
    fits = (forward <= MAX_FORWARD_MONTHS) & (cross + 730120.0 >= 1) & (cross + 730120.0 <= MAX_ORDINAL)
    return g.select(
        "benchmark_id", F.col("lag_n").alias("n_laggard"), F.col("lead_n").alias("n_leader"), (F.col("lag_slope") * DAYS_PER_YEAR).alias("laggard_per_year"), (F.col("lead_slope") * DAYS_PER_YEAR).alias("leader_per_year"),
        months(now - then).alias("backward_months"), ((1 - F.col("lag_slope") / F.col("lead_slope")) * 12).alias("change_months_per_year"), F.when(fits, forward).alias("forward_months"),
        F.when(fits, F.date_from_unix_date(F.round(cross + 730120.0 - EPOCH).cast("int"))).alias("catchup_date"),
    )


def trend_gap_bootstrap(front: DataFrame, transform: str = "linear", *, n_boot: int = 2000, seed: int = 0, min_for_ci: int = 8, min_valid: int = 100, forward_share: float = 0.9, as_of: Column | None = None) -> DataFrame:
    """90 % intervals of the trend gap from resampled frontiers; null where a side has fewer than ``min_for_ci``
    rows, where fewer than ``min_valid`` draws have a rising leaders' line and two dates a side, and, forwards,
    where fewer than ``forward_share`` of them catch up in time.

    Each draw resamples both sides on their own.  Lines come from the sums of a draw's rows, weighted by how often
    it takes them; sums of days are integers, so whether a side has two dates is exact.
    """
    rows = front.filter("date is not null and score is not null").select("benchmark_id", "is_laggard", "model", (F.unix_date("date") + EPOCH - 730120).cast("bigint").alias("x"), transformed(F.col("score"), transform).alias("y"), F.col("score").alias("s")).filter("y is not null")
    rows = held(rows)
    facts = rows.groupBy("benchmark_id").agg(F.max("x").alias("last"), F.max(F.when(~F.col("is_laggard"), F.col("y"))).alias("best"), F.least(F.count_if("is_laggard"), F.count_if(~F.col("is_laggard"))).alias("fewest"))
    now = F.col("last") if as_of is None else F.unix_date(as_of) + EPOCH - 730120
    taken = resampled(rows.join(facts.filter(F.col("fewest") >= min_for_ci).select("benchmark_id"), "benchmark_id", "left_semi"), ["benchmark_id", "is_laggard"], [F.col("x"), F.col("s").desc(), F.col("model")], n_boot, seed)
    w, x, y, lag = F.col("times"), F.col("x"), F.col("y"), F.col("is_laggard")
    sums = {"n": w, "x": w * x, "xx": w * x * x, "y": w * y, "xy": w * x * y}
    lines = taken.groupBy("benchmark_id", "draw").agg(*(F.sum(F.when(side, v)).alias(f"{name}_{k}") for name, side in (("lag", lag), ("lead", ~lag)) for k, v in sums.items()))
    for name in ("lag", "lead"):
        n, sx, sxx, sy, sxy = (F.col(f"{name}_{k}") for k in sums)
        spread = n * sxx - sx * sx
        lines = lines.withColumns({f"{name}_slope": F.when(spread > 0, (n * sxy - sx * sy) / F.when(spread > 0, spread)), f"{name}_ax": sx / n, f"{name}_ay": sy / n})
    lines = lines.filter("lag_slope is not null and lead_slope > 0").join(facts, "benchmark_id")
    level = F.col("lag_ay") + F.col("lag_slope") * (now - F.col("lag_ax"))
    ahead = months(F.col("lag_ax") + (F.col("best") - F.col("lag_ay")) / F.when(F.col("lag_slope") > 0, F.col("lag_slope")) - now)
    found = {"backward": months(now - F.col("lead_ax") - (level - F.col("lead_ay")) / F.col("lead_slope")), "change": (1 - F.col("lag_slope") / F.col("lead_slope")) * 12, "forward": F.when(ahead <= MAX_FORWARD_MONTHS, ahead)}
    ends = [F.percentile(k, F.lit(q)).alias(f"{k}_{e}") for k in found for e, q in (("low", 0.05), ("high", 0.95))]
    out = lines.withColumns(found).groupBy("benchmark_id").agg(F.count("*").alias("n_valid"), F.count("forward").alias("n_forward"), *ends)
    out = facts.select("benchmark_id").join(out, "benchmark_id", "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0).cast("bigint")))
    enough = F.col("n_valid") >= min_valid
    caught = (F.col("n_forward") >= min_valid) & (F.col("n_forward") >= forward_share * F.col("n_valid"))
    return out.select("benchmark_id", "n_valid", *(F.when(caught if k == "forward" else enough, F.col(f"{k}_{e}")).alias(f"{k}_{e}") for k in found for e in ("low", "high")))


def lag_bracket(front: DataFrame, transform: str = "linear", *, as_of: Column | None = None) -> DataFrame:
    """The adjacent leaders around the laggards' best: months since the one above (under), since the one at or
    below (over), and since the point between them where the level was crossed (central)."""
    rows = front.filter("date is not null and score is not null" + (" and score > 0" if transform == "log" else ""))
    last = rows.groupBy("benchmark_id").agg(F.max("date").alias("last"))
    leaders, laggards = sides(strict_records(rows))
    best = laggards.groupBy("benchmark_id").agg(F.max_by(F.struct(F.col("lag_model").alias("model"), F.col("lag_score").alias("score")), "lag_score").alias("lag"))
    both = leaders.join(best, "benchmark_id")
    row = F.struct(F.col("lead_model").alias("model"), F.col("lead_date").alias("date"), F.col("lead_score").alias("score"))
    under = F.col("lead_score") <= F.col("lag.score")
    g = both.groupBy("benchmark_id", "lag").agg(F.max_by(F.when(under, row), F.when(under, F.col("lead_score"))).alias("below"), F.min_by(F.when(~under, row), F.when(~under, F.col("lead_score"))).alias("above"))
    g = g.join(last, "benchmark_id").withColumn("now", F.col("last") if as_of is None else as_of)
    since = lambda c: months(F.datediff("now", F.col(f"{c}.date")))
    t = lambda c: transformed(F.col(f"{c}.score"), transform)
    span = t("above") - t("below")
    share = F.when(span <= 0, 0.0).otherwise(F.least(F.greatest((t("lag") - t("below")) / F.when(span > 0, span), F.lit(0.0)), F.lit(1.0)))
    passed = F.datediff("now", "below.date") - F.datediff("above.date", "below.date") * share
    leads = F.col("above").isNull()
    zero = lambda c: F.when(leads, F.lit(0.0)).otherwise(c)
    return g.select(
        "benchmark_id", F.col("lag.model").alias("lag_model"), F.col("lag.score").alias("lag_score"), leads.alias("laggard_leads"), (F.col("below").isNull() & ~leads).alias("censored"),
        F.col("below.model").alias("below_model"), F.col("above.model").alias("above_model"), zero(since("above")).alias("under_months"), zero(since("below")).alias("over_months"), zero(months(F.floor(passed))).alias("central_months"),
    )
