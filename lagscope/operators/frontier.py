"""Frontiers: records that no earlier record of their group beats.

Within a group, records are ordered by date, then score downwards, then model.  Frontiers are
found from the best score of each day, so no window runs over the raw rows of a group.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = ("benchmark_id", "is_laggard")


def usable(df: DataFrame) -> DataFrame:
    """Rows with a date, a score and a group."""
    return df.filter("date is not null and score is not null and is_laggard is not null")


def _days(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The best score of each group and day, and the best of all days before."""
    best = df.groupBy(*by, "date").agg(F.max("score").alias("score"))
    return best.withColumn("before", F.max("score").over(Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)))


def frontier(df: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Rows of cumulative rank 1: no earlier row of the group has a greater score.  Ties stay."""
    df = usable(df)
    top = _days(df, by).filter("before is null or score >= before").select(*by, "date", "score")
    return df.join(top, [*by, "date", "score"]).select(*df.columns)


def strict_records(df: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Rows that raise their group's running maximum.  Of ties only the first stays."""
    df = usable(df)
    top = _days(df, by).filter("before is null or score > before").select(*by, "date", "score")
    row = F.struct(*df.columns)
    tied = df.join(top, [*by, "date", "score"]).groupBy(*by, "date").agg(F.min_by(row, "model").alias("row"))
    return tied.select("row.*")


def records_with_baseline(df: DataFrame, baseline: Column, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Strict records from ``baseline`` on; earlier rows raise the maximum but are not returned."""
    return strict_records(df, by).filter(F.col("date") >= baseline)


#: Blocks of scores in which a group's ranks are counted side by side.
BLOCKS = 64


def cumulative_rank(df: DataFrame, by: tuple[str, ...] = GROUP, top: int | None = None) -> DataFrame:
    """Adds ``rank``: 1 + the number of earlier rows of the group with a greater score.

    Earlier means before in (date, score down, model) order, null dates last: the greater scores up to a row's
    own date.  Rows without a score have no rank and count for none; ranks beyond ``top`` are null.

    Rows are first counted by date and score.  Greater scores of higher blocks come from a grid of dates and
    blocks; those of a row's own block bit by bit of its day: at each bit, days with a 1 count the greater scores
    of those with a 0 that agree in all higher bits.  No window runs over more than a block or a grid's line.
    """
    scored = df.filter("score is not null")
    first, last = scored.agg(F.min("date"), F.max("date")).first()
    days = (last - first).days + 1 if first is not None else 0
    day = F.coalesce(F.datediff("date", F.lit(first).cast("date")), F.lit(days)).alias("_day")
    same = lambda a, b: reduce(and_, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by))

    facts = scored.groupBy(*by, day, "score").agg(F.count("*").alias("_n"))
    edges = facts.groupBy(*by).agg(F.percentile_approx("score", [i / BLOCKS for i in range(1, BLOCKS)], 1000).alias("_edges"))
    facts = facts.alias("l").join(edges.alias("r"), same("l", "r")).select("l.*", F.size(F.filter("_edges", lambda e: e < F.col("score"))).alias("_block"))

    # greater scores in higher blocks, up to each day
    cells = facts.groupBy(*by, "_day", "_block").agg(F.sum("_n").alias("_n"))
    lines = cells.select(*by, "_day").distinct().withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).withColumn("_n", F.lit(0).cast("bigint"))
    grid = cells.unionByName(lines).groupBy(*by, "_day", "_block").agg(F.sum("_n").alias("_n"))
    grid = grid.withColumn("_n", F.sum("_n").over(Window.partitionBy(*by, "_block").orderBy("_day")))
    higher = Window.partitionBy(*by, "_day").orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("_higher", F.coalesce(F.sum("_n").over(higher), F.lit(0)))

    # greater scores in the same block: on the day itself, then on earlier ones
    def above(counted: Column, *alike: Column) -> Column:
        w = Window.partitionBy(*by, "_block", *alike).orderBy(F.col("score").desc(), "_day_desc").rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(counted).over(w), F.lit(0))

    # of equal scores, later days come first and count none; one shuffle serves the windows of all bits
    inner = facts.withColumn("_day_desc", -F.col("_day")).repartition(*by, "_block")
    inner = inner.withColumn("_own", above(F.col("_n"), F.col("_day")))
    for bit in range(days.bit_length()):
        one = F.shiftright("_day", bit).bitwiseAND(F.lit(1)) == 1
        inner = inner.withColumn("_own", F.col("_own") + F.when(one, above(F.when(~one, F.col("_n")), F.shiftright("_day", bit + 1))).otherwise(0))

    keyed = lambda a, b, *more: reduce(and_, (F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in more), same(a, b))
    ranks = inner.alias("l").join(grid.alias("r"), keyed("l", "r", "_day", "_block")).select("l.*", (1 + F.col("_own") + F.col("_higher")).alias("rank"))
    out = scored.withColumn("_day", day).alias("l").join(ranks.alias("r"), keyed("l", "r", "_day", "score")).select("l.*", "r.rank").drop("_day")
    out = out.unionByName(df.filter("score is null").withColumn("rank", F.lit(None).cast("bigint")))
    return out if top is None else out.withColumn("rank", F.when(F.col("rank") <= top, F.col("rank")))


def best_per_key(df: DataFrame, keys: list[str], score: str, tie: list[Column]) -> DataFrame:
    """The row of the greatest score of each key; of equal ones the first in order of ``tie`` (ascending columns)."""
    row = F.struct(*df.columns)
    return df.filter(F.col(score).isNotNull()).groupBy(*keys).agg(F.min_by(row, F.struct(-F.col(score), *tie)).alias("row")).select("row.*")
