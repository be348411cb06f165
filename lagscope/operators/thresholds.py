"""Score thresholds: who crossed first, accepted pairs and pooled medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import months
from .classify import differs_two_sided
from .frontier import strict_records
from .selection import exact_percentile
from .smooth import kernel_smooth_bootstrap


def auto_grid(df: DataFrame) -> DataFrame:
    """``benchmark_id`` and ``threshold``: steps of 0.05 for shares, of 5 for percentages, else 19 inner points
    between the least (0 at least) and the greatest score."""
    low, high = F.greatest(F.min("score"), F.lit(0.0)), F.max("score")
    bounds = df.filter("score is not null").groupBy("benchmark_id").agg(low.alias("low"), high.alias("high"))
    step = lambda k: F.transform(F.sequence(F.lit(1), F.lit(19)), lambda i: i * F.lit(k))
    spread = F.transform(F.sequence(F.lit(1), F.lit(19)), lambda i: F.col("low") + i * ((F.col("high") - F.col("low")) / 20))
    grid = F.when(F.col("high") <= 1.05, step(0.05)).when(F.col("high") <= 110, step(5.0)).otherwise(spread)
    return bounds.select("benchmark_id", F.explode(grid).alias("threshold"))


def validity_floor(df: DataFrame) -> DataFrame:
    """The 10th percentile of each benchmark's scores."""
    return exact_percentile(df, ["benchmark_id"], "score", 0.1, "floor")


def threshold_datapoints(df: DataFrame, as_of: Column, *, accepted: list[float] | None = None, settings: DataFrame | None = None) -> DataFrame:
    """First crossers of each threshold that a leader has reached, with the gap or, while open, the gap so far.

    Valid: in ``accepted`` (to six decimals), or above the benchmark's floor.  Of the thresholds of one pair of
    crossers with a valid one, the highest is accepted.

    ``settings``: a row a benchmark at most, with ``benchmark_id`` and, null where the rule above holds, ``accepted``
    and ``thresholds`` (arrays) and ``floor``; it takes the place of ``accepted``.
    """
    df = df.filter("date is not null and score is not null and is_laggard is not null")
    records = strict_records(df)
    floors = validity_floor(df)
    if settings is None:
        grid = auto_grid(df).join(floors, "benchmark_id").withColumn("allowed", F.array(*map(F.lit, accepted)).cast("array<double>") if accepted is not None else F.lit(None).cast("array<double>"))
    else:
        own = settings.select("benchmark_id", F.col("accepted").alias("allowed"), F.col("thresholds").alias("own"), F.col("floor").alias("own_floor"))
        given = own.filter("own is not null").select("benchmark_id", F.explode("own").alias("threshold"))
        grid = auto_grid(df).join(given, "benchmark_id", "left_anti").unionByName(given)
        grid = grid.join(floors, "benchmark_id").join(own.drop("own"), "benchmark_id", "left").withColumn("floor", F.coalesce("own_floor", "floor")).drop("own_floor")
    hits = grid.join(records, "benchmark_id").filter("score >= threshold")
    lag = F.col("is_laggard")
    first = lambda side: F.min_by(F.when(side, F.struct("model", "date")), F.when(side, F.struct("date", -F.col("score"), "model")))
    both = hits.groupBy("benchmark_id", "threshold", "floor", "allowed").agg(first(~lag).alias("lead"), first(lag).alias("lag")).filter("lead is not null")
    both = both.join(df.groupBy("benchmark_id").agg(F.bool_or("is_laggard").alias("has_lag")).filter("has_lag"), "benchmark_id")
    listed = F.array_contains(F.transform("allowed", lambda x: F.round(x, 6)), F.round("threshold", 6))
    valid = F.when(F.col("allowed").isNotNull(), listed).otherwise(F.col("threshold") > F.col("floor"))
    days = F.datediff("lag.date", "lead.date").cast("bigint")
    rows = both.select(
        "benchmark_id", "threshold", "floor", F.col("lead.model").alias("lead_model"), F.col("lead.date").alias("lead_date"), F.col("lag.model").alias("lag_model"), F.col("lag.date").alias("lag_date"),
        days.alias("gap_days"), months(days).alias("gap_months"), F.when(F.col("lag").isNull(), months(F.datediff(as_of, "lead.date"))).alias("gap_months_so_far"),
        (F.col("lag").isNotNull() & valid).alias("valid"), F.col("lag").isNull().alias("still_open"),
    )
    pair = Window.partitionBy("benchmark_id", "lead_model", "lag_model")
    last = F.row_number().over(pair.orderBy(F.col("threshold").desc())) == 1
    return rows.withColumn("accepted", ~F.col("still_open") & last & F.max("valid").over(pair))


def threshold_summary(points: DataFrame) -> DataFrame:
    accepted = F.when(F.col("accepted"), F.col("gap_months"))
    return points.groupBy("benchmark_id").agg(F.count("*").alias("n_thresholds"), F.count_if("valid").alias("n_valid"), F.count_if("accepted").alias("n_accepted"), F.count_if("still_open").alias("n_still_open"), F.median(accepted).alias("median_gap_months"))


def pooled_medians(points: DataFrame, access: Column) -> DataFrame:
    """Medians of accepted gaps over all kept benchmarks, and by data access, in one pass of grouping sets."""
    pool = points.filter("accepted").withColumn("access", access).filter("access is not null")
    sets = pool.groupingSets([[], ["access"]], "access")
    return sets.agg(F.median("gap_months").alias("median_gap_months"), F.count("*").alias("n_datapoints"), F.countDistinct("benchmark_id").alias("n_benchmarks"), F.grouping("access").alias("is_overall")).select(F.when(F.col("is_overall") == 1, "overall").otherwise(F.col("access")).alias("pool"), "median_gap_months", "n_datapoints", "n_benchmarks")


def threshold_config(points: DataFrame, settings: DataFrame) -> DataFrame:
    """What holds for each benchmark of ``settings``: whether its datapoints are pooled (``keep``, no by default), its
    ``access``, the floor in use, and the thresholds that its settings list, if any."""
    floors = points.groupBy("benchmark_id").agg(F.max("floor").alias("used"))
    own = settings.join(floors, "benchmark_id", "left")
    listed = lambda c: F.when(F.size(c) > 0, F.col(c))
    return own.select("benchmark_id", F.coalesce("keep", F.lit(False)).alias("keep"), "access", F.coalesce("used", "floor").alias("floor"), listed("thresholds").alias("thresholds"), listed("accepted").alias("accepted"))


def threshold_pool(points: DataFrame, settings: DataFrame) -> DataFrame:
    """The accepted datapoints of benchmarks that are kept, in the pool ``overall`` and, where it is known, in that of
    their data access, ``public`` or ``private``."""
    kept = settings.filter("keep").select("benchmark_id", "access")
    pools = F.array(F.lit("overall"), F.when(F.col("access").isin("public", "private"), F.col("access")))
    rows = points.filter("accepted").join(kept, "benchmark_id").withColumn("pool", F.explode(F.filter(pools, lambda p: p.isNotNull())))
    return rows.select("pool", "benchmark_id", "access", "threshold", "lead_model", "lead_date", "lag_model", "lag_date", "gap_days", "gap_months")


def pool_summary(pool: DataFrame) -> DataFrame:
    return pool.groupBy("pool").agg(F.median("gap_months").alias("median_gap_months"), F.count("*").alias("n_datapoints"), F.countDistinct("benchmark_id").alias("n_benchmarks"))


def pool_trends(pool: DataFrame, **smoothing) -> DataFrame:
    """The smoothed gap of each pool of two datapoints or more, with its interval, where it is known; ``smoothing``
    goes to ``kernel_smooth_bootstrap``."""
    rows = pool.withColumn("n", F.count("*").over(Window.partitionBy("pool"))).filter("n > 1")
    smooth = kernel_smooth_bootstrap(rows, ["pool"], date="lag_date", value="gap_months", **smoothing)
    return smooth.filter("mean is not null").select("pool", F.col("grid_date").alias("date"), "mean", "lo", "hi")


def level_grid(front: DataFrame, n: int = 100) -> DataFrame:
    """``benchmark_id``, ``i`` and ``level``: ``n`` equally spaced levels that the frontiers of both groups span."""
    ends = front.groupBy("benchmark_id", "is_laggard").agg(F.min("score").alias("a"), F.max("score").alias("z")).groupBy("benchmark_id").agg(F.max("a").alias("a"), F.min("z").alias("z"))
    level = lambda i: F.struct(i.alias("i"), (F.col("a") + i * ((F.col("z") - F.col("a")) / (n - 1))).alias("level"))
    return ends.select("benchmark_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), level)).alias("l")).select("benchmark_id", "l.i", "l.level")


def level_matches(front: DataFrame, n: int = 100) -> DataFrame:
    """For each level its first leader, and the earliest laggard at the level or not significantly below that leader.

    The test is two-sided.  A missing deviation leaves no significant difference; without any spread every
    difference is significant.  Of leaders of one day the best counts, then the least model.
    """
    grid = level_grid(front, n)
    leaders = grid.join(front.filter("not is_laggard"), "benchmark_id").filter("score >= level")
    first = F.min_by(F.struct("date", "score", "score_std"), F.struct("date", -F.col("score"), "model")).alias("lead")
    leaders = leaders.groupBy("benchmark_id", "i", "level").agg(first)
    laggards = front.filter("is_laggard").select("benchmark_id", "date", "score", "score_std")
    known = F.col("score_std").isNotNull() & F.col("lead.score_std").isNotNull()
    lower = known & differs_two_sided(F.col("score"), F.col("score_std"), F.col("lead.score"), F.col("lead.score_std"))
    pairs = leaders.join(laggards, "benchmark_id").filter((F.col("score") >= F.col("level")) | ~lower)
    return pairs.groupBy("benchmark_id", "i", "level").agg(F.first("lead.date").alias("lead_date"), F.min("date").alias("lag_date"))


def level_walk(front: DataFrame, n: int = 100) -> DataFrame:
    """The levels from the lowest up, with candidates that are dropped on the way: ``level_matches`` as one walk.

    At each level the laggards left are tried by date against the level's first leader.  One that reaches the level,
    or is not significantly below that leader, is the match.  One that is significantly below is out, with all
    that came no later, at this and every higher level, even if a later leader with a wider deviation would let it
    pass.  So a level's match is never earlier than without pruning, and levels may go without one.

    A benchmark's frontiers and its ``n`` levels are one row each; the walk is a fold that carries the last date
    that is out.
    """
    grid = level_grid(front, n)
    leaders = grid.join(front.filter("not is_laggard"), "benchmark_id").filter("score >= level")
    lead = F.min_by(F.struct("date", "score", "score_std"), F.struct("date", -F.col("score"), "model")).alias("lead")
    levels = leaders.groupBy("benchmark_id", "i", "level").agg(lead).groupBy("benchmark_id").agg(F.array_sort(F.collect_list(F.struct("i", "level", "lead"))).alias("levels"))
    ordered = F.array_sort(F.collect_list(F.struct("date", (-F.col("score")).alias("_s"), "model", "score", "score_std")))
    both = levels.join(front.filter("is_laggard").groupBy("benchmark_id").agg(ordered.alias("laggards")), "benchmark_id")

    def met(c: Column, level: Column) -> Column:
        known = c["score_std"].isNotNull() & level["lead"]["score_std"].isNotNull()
        lower = known & differs_two_sided(c["score"], c["score_std"], level["lead"]["score"], level["lead"]["score_std"])
        return (c["score"] >= level["level"]) | ~F.coalesce(lower, F.lit(False))

    def step(state: Column, level: Column) -> Column:
        left = F.filter("laggards", lambda c: state["out"].isNull() | (c["date"] > state["out"]))
        first = F.array_position(F.transform(left, lambda c: met(c, level)), F.lit(True)).cast("int")
        passed = F.when(first == 0, F.size(left)).otherwise(first - 1)  # those tried in vain
        out = F.when(passed > 0, F.try_element_at(left, passed)["date"]).otherwise(state["out"])
        match = F.struct(level["i"].alias("i"), level["level"].alias("level"), level["lead"]["date"].alias("lead_date"), F.when(first > 0, F.try_element_at(left, F.nullif(first, F.lit(0)))["date"]).alias("lag_date"))
        return F.struct(out.alias("out"), F.concat(state["found"], F.array(match)).alias("found"))

    none = F.from_json(F.lit("[]"), "array<struct<i:int,level:double,lead_date:date,lag_date:date>>")
    start = F.struct(F.lit(None).cast("date").alias("out"), none.alias("found"))
    walked = both.select("benchmark_id", F.explode(F.aggregate("levels", start, step)["found"]).alias("m"))
    return walked.select("benchmark_id", "m.i", "m.level", "m.lead_date", "m.lag_date").filter("lag_date is not null")
