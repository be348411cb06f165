"""Bootstrap draws as rows: which points each draw takes follows from integer arithmetic in columns.

Draws are the unit of work, whatever the number of groups, and any engine with 64-bit integers draws the same points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The generator: a prime modulus, the strides of draws and places, and the terms of its quadratic rounds.  A linear
#: generator would spread the places of one draw evenly, which random draws don't.
MODULUS = 2_147_483_647
DRAW_STRIDE, PLACE_STRIDE = 1_000_003, 7_919
ROUNDS = ((48_271, 12_345), (69_621, 67_891), (16_807, 13_579), (39_373, 24_683))


#: Points that are read once, into the plan, instead of computed anew for each use.
MOST_HELD = 10_000


def held(points: DataFrame, most: int = MOST_HELD) -> DataFrame:
    """The points as they are, or as rows of the plan itself where there are ``most`` at most.

    Frontiers and accepted thresholds are a few hundred rows behind a long plan, which a bootstrap uses several times.
    """
    found = points.limit(most + 1).collect()
    return points.sparkSession.createDataFrame(found, points.schema) if len(found) <= most else points


def with_drawn(places: DataFrame, name: str, draw: str, place: str, n: str, seed: int = 0) -> DataFrame:
    """Adds ``name``: which of ``n`` points, from 0, stands at a place of a draw.

    Each round is a column of its own, so that none is computed twice.
    """
    out = places.withColumn("_s", (F.col(draw) * DRAW_STRIDE + F.col(place) * PLACE_STRIDE + seed + 1) % MODULUS)
    for a, c in ROUNDS:
        out = out.withColumn("_s", (F.col("_s") * (F.col("_s") + a) + c) % MODULUS)
    return out.withColumn(name, F.call_function("div", F.col("_s") * F.col(n), F.lit(MODULUS).cast("bigint"))).drop("_s")


def resampled(points: DataFrame, by: list[str], order: list[Column], n_boot: int, seed: int = 0) -> DataFrame:
    """Points with ``draw`` and ``times``, how often the draw takes them; each draw takes as many points as a group has.

    ``order`` numbers the points of a group; a group's points are those of a frontier or of accepted thresholds.
    """
    every = Window.partitionBy(*by)
    numbered = points.withColumns({"_i": F.row_number().over(every.orderBy(*order)).cast("bigint") - 1, "_n": F.count("*").over(every)})
    groups = points.groupBy(*by).agg(F.count("*").alias("_n"))
    draws = groups.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_boot - 1).cast("bigint")))).repartition(*by, "draw")
    places = draws.withColumn("_place", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    taken = with_drawn(places, "_i", "draw", "_place", "_n", seed).groupBy(*by, "draw", "_i").agg(F.count("*").alias("times"))
    return taken.join(numbered.drop("_n"), [*by, "_i"]).drop("_i")
