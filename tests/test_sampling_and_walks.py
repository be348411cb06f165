"""Exact percentiles, resampling in columns, the level walk, lanes, pools and isolated publishing."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagscope.functions import numbers
from lagscope.operators import ingest, resample, smooth, spacing, thresholds
from lagscope.operators.selection import exact_percentile
from lagscope.plans import publish, queries

def as_of():
    return F.lit("2026-01-01").cast("date")


def test_percentiles_of_groups_of_every_size(spark):
    rng = random.Random(3)
    groups = {"one": [5.0], "two": [1.0, 2.0], "ties": [7.0] * 500, "few": [rng.random() for _ in range(11)], "outlier": [rng.random() for _ in range(200)] + [1e305, -1e305], "none": [None], None: [3.0, 4.0, 9.0]}
    groups["many"] = [round(rng.gauss(0, 1), 3) for _ in range(40_000)]  # more than a bin holds, with many ties
    groups["wide"] = [math.exp(rng.gauss(0, 40)) for _ in range(25_000)]
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, x double").repartition(6)
    for p in (0.0, 0.1, 0.25, 0.5, 0.937, 1.0):
        got = {r["g"]: r["v"] for r in exact_percentile(df, ["g"], "x", p, "v").collect()}
        want = {g: np.quantile(xs, p) for g, xs in groups.items() if xs != [None]}
        assert got.keys() == want.keys()
        assert all(got[g] == pytest.approx(want[g], rel=1e-12, abs=1e-12) for g in want)
    assert exact_percentile(df.limit(0), ["g"], "x", 0.5, "v").count() == 0


def test_percentile_plan_sorts_no_raw_rows(spark):
    df = spark.range(10).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("x"))
    plan = exact_percentile(df, ["g"], "x", 0.1, "v")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "percentile_approx" in plan and "percentile(" not in plan


def test_drawn_places_look_random(spark):
    n, draws = 50, 2000
    df = resample.with_drawn(spark.range(n * draws).select((F.col("id") / n).cast("bigint").alias("d"), (F.col("id") % n).alias("p"), F.lit(n).cast("bigint").alias("n")), "i", "d", "p", "n")
    counts = np.zeros((draws, n), int)
    for r in df.groupBy("d", "i").count().collect():
        counts[r["d"], r["i"]] = r["count"]
    assert counts.sum() == n * draws and (counts.sum(1) == n).all()
    share = counts.sum(0) / draws  # each point is drawn once a draw on average, with a variance of 1 - 1/n
    assert abs(share - 1).max() < 5 * math.sqrt(1 / draws)
    assert counts.var() == pytest.approx(1 - 1 / n, rel=0.03)
    assert (counts == 0).mean() == pytest.approx((1 - 1 / n) ** n, abs=0.01)
    assert abs(np.corrcoef(counts[:-1].ravel(), counts[1:].ravel())[0, 1]) < 0.02
    other = resample.with_drawn(spark.range(n).select(F.lit(0).cast("bigint").alias("d"), F.col("id").alias("p"), F.lit(n).cast("bigint").alias("n")), "i", "d", "p", "n", seed=1)
    assert sorted(r["i"] for r in other.collect()) != sorted(np.repeat(np.arange(n), counts[0]).tolist())


def test_smoother_interval_is_that_of_a_bootstrap(spark):
    """Against a bootstrap with another generator, and the mean inside."""
    rng = np.random.default_rng(5)
    days = np.sort(rng.integers(0, 300, 40))
    values = 5 + days / 100 + rng.normal(0, 1, 40)
    rows = [(dt.date(2023, 1, 1) + dt.timedelta(int(d)), float(v)) for d, v in zip(days, values)]
    out = smooth.kernel_smooth_bootstrap(spark.createDataFrame(rows, "date date, value double"), [], n_boot=2000).orderBy("grid_date").collect()
    grid = np.array([(r["grid_date"] - dt.date(2023, 1, 1)).days for r in out])
    w = np.exp(-0.5 * ((grid[:, None] - days) / 60.0) ** 2)
    c = np.stack([np.bincount(rng.integers(0, 40, 40), minlength=40) for _ in range(2000)], 1)
    lo, hi = np.quantile((w @ (c * values[:, None])) / (w @ c), [0.05, 0.95], axis=1)
    width = np.mean(hi - lo)
    assert np.abs(np.array([r["lo"] for r in out]) - lo).mean() < 0.1 * width and np.abs(np.array([r["hi"] for r in out]) - hi).mean() < 0.1 * width
    assert all(r["lo"] <= r["mean"] <= r["hi"] for r in out)


def test_smoother_of_many_points_takes_no_short_cut(spark, monkeypatch):
    """Beyond the checked sizes points stay a plan and kernel weights are joined by shuffle, with the same answer."""
    rows = [(g, dt.date(2023, 1, 1) + dt.timedelta(9 * i), float(i % 5)) for g in "ab" for i in range(12)]
    df = spark.createDataFrame(rows, "g string, date date, value double")
    run = lambda: [tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in r) for r in smooth.kernel_smooth_bootstrap(df, ["g"], n_boot=60).orderBy("g", "grid_date").collect()]
    short = run()
    monkeypatch.setattr(smooth, "MOST_BROADCAST", 0)
    monkeypatch.setattr(smooth, "held", lambda points: resample.held(points, 3))
    assert run() == short and len(short) > 20


FRONT = "benchmark_id string, model string, date date, score double, score_std double, is_laggard boolean"


def walk_by_hand(rows, n):
    """The walk as loops over levels and a shrinking list."""
    lead = [r for r in rows if not r[5]]
    left = sorted((r for r in rows if r[5]), key=lambda r: (r[2], -r[3], r[1]))
    a = max(min(r[3] for r in lead), min(r[3] for r in left))
    z = min(max(r[3] for r in lead), max(r[3] for r in left))
    out = []
    for i in range(n):
        level = a + i * ((z - a) / (n - 1))
        first = min((r for r in lead if r[3] >= level), key=lambda r: (r[2], -r[3], r[1]))
        for r in list(left):
            se = None if r[4] is None or first[4] is None else math.hypot(r[4], first[4])
            lower = se is not None and (r[3] != first[3] if se == 0 else abs(r[3] - first[3]) > 1.959963984540054 * se)
            if r[3] >= level or not lower:
                out.append((i, first[2], r[2]))
                break
            left = [x for x in left if x[2] > r[2]]
    return out


def test_level_walk_by_hand(spark):
    rng = random.Random(8)
    for _ in range(4):
        rows = [("b", f"m{i}", dt.date(2023, 1, 1) + dt.timedelta(rng.randrange(500)), rng.uniform(0, 100), rng.choice([None, 0.0, 1.0, 5.0, 20.0]), i % 2 == 0) for i in range(24)]
        got = thresholds.level_walk(spark.createDataFrame(rows, FRONT), 30).collect()
        assert sorted((r["i"], r["lead_date"], r["lag_date"]) for r in got) == walk_by_hand(rows, 30)


def test_lanes_never_overlap(spark):
    rng = random.Random(2)
    rows = [(g, i, a := rng.uniform(0, 100), a + rng.uniform(0, 20)) for g in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "g string, i int, a double, z double")
    for lanes in (1, 2, 60):
        got = spacing.packed(df, ["g"], "a", "z", ["a", "i"], lanes=lanes, gap=1.0).collect()
        assert len(got) == len(rows)
        taken = {}
        for r in sorted(got, key=lambda r: (r["g"], r["a"], r["i"])):
            ends = taken.setdefault(r["g"], [-math.inf] * lanes)
            free = next((k for k, e in enumerate(ends) if r["a"] >= e + 1.0), None)
            assert r["lane"] == free
            if free is not None:
                ends[free] = r["z"]
    assert all(r["lane"] is not None for r in got)


def test_rounding_of_large_and_odd_numbers(spark):
    values = [1e18, -1e18, 1e305, 9.3e16, 9e13 + 0.25, -9e13 - 0.25, math.inf, -math.inf, 2.0**53, 90071992547409.91, 123456789.125]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", numbers.round_exact(F.col("x")).alias("y")).collect():
        assert r["y"] == round(r["x"], 2) if math.isfinite(r["x"]) else r["y"] == r["x"]
    odd = spark.createDataFrame([(math.nan,), (None,)], "x double").select(numbers.round_exact(F.col("x")).alias("y")).collect()
    assert math.isnan(odd[0]["y"]) and odd[1]["y"] is None


def test_lookup_takes_the_first_row_even_without_a_label(spark):
    index = spark.createDataFrame([(1, " a", None), (2, "a", "Open weights"), (3, "b", "API access"), (4, "b", None)], "n int, k string, label string")
    got = ingest.lookup(spark.createDataFrame([("a",), ("b ",), ("c",)], "name string"), index, "name", "k", "label", [F.col("n")]).collect()
    assert {r["name"]: r["label"] for r in got} == {"a": None, "b ": "API access", "c": None}


def test_names_of_queries_are_taken_once():
    def gap_metrics(spark, sf):
        return None

    with pytest.raises(ValueError, match="gap_metrics"):
        queries.query(gap_metrics)


def benchmark_rows(spark, names="xyz"):
    start = dt.date(2022, 1, 1)
    data = [(b, f"{b}{i}", start + dt.timedelta(days=90 * i), 1.5**i * (1.0 if i % 2 == 0 else 0.9), None, i % 2 == 1) for b in names for i in range(12)]
    return spark.createDataFrame(data, FRONT)


def test_pools_keep_what_settings_keep(spark):
    points = thresholds.threshold_datapoints(benchmark_rows(spark), as_of())
    own = publish.full_settings(spark.createDataFrame([("x", True, "public"), ("y", True, "elsewhere"), ("z", None, "private")], "benchmark_id string, keep boolean, access string"))
    pool = thresholds.threshold_pool(points, own)
    accepted = points.filter("accepted").groupBy("benchmark_id").count().collect()
    n = {r["benchmark_id"]: r["count"] for r in accepted}
    got = {r["pool"]: (r["n_datapoints"], r["n_benchmarks"]) for r in thresholds.pool_summary(pool).collect()}
    assert got == {"overall": (n["x"] + n["y"], 2), "public": (n["x"], 1)}
    trends = thresholds.pool_trends(pool, n_boot=100).collect()
    assert trends and all(r["lo"] is None or r["lo"] <= r["hi"] for r in trends) and {r["pool"] for r in trends} <= {"overall", "public"}
    config = {r["benchmark_id"]: r for r in thresholds.threshold_config(points, own).collect()}
    assert config["x"]["keep"] and not config["z"]["keep"] and config["y"]["access"] == "elsewhere" and config["x"]["floor"] > 0


def test_documents_hold_summary_config_and_interval(spark):
    own = spark.createDataFrame([("x", True, [5.0])], "benchmark_id string, keep boolean, thresholds array<double>")
    (doc,) = publish.documents(publish.analyse(benchmark_rows(spark, "x"), as_of(), settings=own, n_boot=120)).collect()
    doc = json.loads(doc["document"])
    assert doc["threshold_summary"]["n_thresholds"] == 1 and doc["threshold_config"]["keep"] and doc["threshold_config"]["thresholds"] == [5.0]
    assert doc["trend_gap_interval"]["n_valid"] == 0  # six rows a side are too few for an interval


def test_a_failing_benchmark_leaves_the_others(spark, tmp_path):
    rows = benchmark_rows(spark)
    poisoned = rows.withColumn("score", F.when(F.col("benchmark_id") == "y", F.raise_error(F.lit("poison")).cast("double")).otherwise(F.col("score")))
    old = spark.createDataFrame([("y", "kept"), ("gone", "kept too"), ("x", "replaced")], "benchmark_id string, document string")
    every, errors = publish.publish_each(poisoned, as_of(), str(tmp_path / "run"), old=old)
    got = {r["benchmark_id"]: r["document"] for r in every.collect()}
    assert got["y"] == "kept" and got["gone"] == "kept too" and set(got) == {"x", "y", "z", "gone"}
    assert json.loads(got["x"])["gaps"] and json.loads(got["z"])["gaps"]
    (error,) = errors.collect()
    assert error["benchmark_id"] == "y" and "poison" in error["error"]


def test_framings_name_their_benchmarks(spark):
    rows = benchmark_rows(spark, "x").withColumn("region", F.when(F.col("model").endswith("1"), "a").when(F.col("model").endswith("2"), "b"))
    out = publish.framings(rows, {"ab": (F.col("region") == "a", F.col("region") == "b"), "ba": (F.col("region") == "b", F.col("region") == "a")})
    assert sorted((r["benchmark_id"], r["model"], r["is_laggard"]) for r in out.collect()) == [("ab/x", "x1", True), ("ab/x", "x11", True), ("ab/x", "x2", False), ("ba/x", "x1", False), ("ba/x", "x11", False), ("ba/x", "x2", True)]
