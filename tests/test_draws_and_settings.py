"""Paired draws beyond the first catch-up, settings by benchmark, and small source functions."""

import datetime
import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lagscope.functions import numbers
from lagscope.operators import match, spine
from lagscope.operators.frontier import frontier, strict_records
from lagscope.plans import publish
from lagscope.sources import scores

MONTH = 30.4375


def rows(spark, *data):
    """(model, date, score, draws, is_laggard) of one benchmark, with deviations of 2."""
    full = [("b", m, datetime.date.fromisoformat(d), s, 2.0, x, lag) for m, d, s, x, lag in data]
    return spark.createDataFrame(full, "benchmark_id string, model string, date date, score double, score_std double, draws array<double>, is_laggard boolean")


THREE = ("C_old", "2023-01-01", 100.0, [0.0] * 100, False), ("C_new", "2024-01-01", 120.0, [120.0] * 100, False), ("O1", "2024-06-01", 119.0, [999.0] * 10 + [0.0] * 90, True)


def test_daily_gap_takes_the_reference_that_draws_allow(spark):
    front = frontier(rows(spark, *THREE))
    m = spine.gap_metrics(spine.daily_gap(front, draws="draws")).first()
    assert m["avg_gap_months"] == pytest.approx(152 / MONTH)
    unlikely = [(m, d, s, [999.0] * 4 + [-1.0] * 96 if m == "O1" else x, lag) for m, d, s, x, lag in THREE]
    far = spine.gap_metrics(spine.daily_gap(frontier(rows(spark, *unlikely)), draws="draws")).first()
    assert far["avg_gap_months"] == pytest.approx((datetime.date(2024, 6, 1) - datetime.date(2023, 1, 1)).days / MONTH)


def test_history_with_draws(spark):
    names = [("ClosedA", "2023-01-01", 100.0, False), ("OpenB", "2023-06-01", 105.0, True), ("ClosedC", "2024-01-01", 120.0, False), ("OpenD", "2024-06-01", 125.0, True)]
    front = rows(spark, *((m, d, s, [10.0 * i] * 50, lag) for i, (m, d, s, lag) in enumerate(names)))
    got = spine.historical_gap(front, F.lit("2025-01-01").cast("date"), draws="draws").orderBy("day").collect()
    assert len(got) == 19 and all(r["gap_months"] >= 0 for r in got)
    assert got[-1]["matched"] and got[-1]["reference_model"] == "ClosedC" and got[-1]["laggard_model"] == "OpenD"
    assert not next(r for r in got if r["day"] == datetime.date(2024, 2, 1))["matched"]


def test_match_map_by_draws_and_by_score(spark):
    pair = lambda df, **k: [(r["lag_model"], r["lead_model"]) for r in match.frontier_match_map(strict_records(df), **k).collect()]
    draws = {"O1": [119.0] * 100, "C_old": [0.0] * 100, "C_new": [999.0] * 30 + [0.0] * 70}
    assert pair(rows(spark, *((m, d, s, draws[m], lag) for m, d, s, _, lag in THREE)), draws="draws") == [("O1", "C_new")]
    assert pair(rows(spark, *THREE).withColumn("score_std", F.lit(None).cast("double"))) == [("O1", "C_new")]
    first = dict(draws, C_old=[200.0] * 6 + [0.0] * 94)
    assert pair(rows(spark, *((m, d, s, first[m], lag) for m, d, s, _, lag in THREE)), draws="draws") == [("O1", "C_old")]


def near(x):
    """Without the last digits of doubles: sums depend on the order of rows."""
    if isinstance(x, dict):
        return {k: near(v) for k, v in x.items()}
    return [near(v) for v in x] if isinstance(x, list) else float(f"{x:.9g}") if isinstance(x, float) else x


def test_analysis_by_settings(spark):
    """One benchmark exactly, on a log scale and without survival analysis; the other by default."""
    start = datetime.date(2022, 1, 1)
    data = [(b, f"{b}{i}", start + datetime.timedelta(days=90 * i), 1.5**i * (1.0 if i % 2 == 0 else 0.9), None, i % 2 == 1) for b in "xy" for i in range(12)]
    df = spark.createDataFrame(data, "benchmark_id string, model string, date date, score double, score_std double, is_laggard boolean")
    own = spark.createDataFrame([("x", "log", 0.0, False, [5.0, 10.0])], "benchmark_id string, transform string, tolerance double, survival boolean, thresholds array<double>")
    as_of = F.lit("2026-01-01").cast("date")
    got = {r["benchmark_id"]: json.loads(r["document"]) for r in publish.documents(publish.analyse(df, as_of, settings=own)).collect()}
    plain = {r["benchmark_id"]: json.loads(r["document"]) for r in publish.documents(publish.analyse(df, as_of)).collect()}
    assert near({k: v for k, v in got["y"].items() if k != "threshold_config"}) == near(plain["y"]) and got["x"] != plain["x"]
    assert got["y"]["current_gap"]["method"] != "oldest_unmatched" and got["x"]["current_gap"]["method"] in ("oldest_unmatched", "no_unmatched")
    ages = [g["gap_months"] for g in got["x"]["gaps"] if not g["matched"]]
    assert got["x"]["current_gap"]["estimated_gap"] == max(ages, default=0.0)
    assert [p["threshold"] for p in got["x"]["thresholds"]] == [5.0, 10.0]
    assert got["x"]["trend_gap"] != plain["x"]["trend_gap"]
    exact = {g["lead_model"]: g.get("lag_model") for g in got["x"]["gaps"]}
    loose = {g["lead_model"]: g.get("lag_model") for g in plain["x"]["gaps"]}
    assert exact["x2"] == loose["x2"] == "x3" and {k for k in loose if loose[k] != exact[k]} <= set(loose)


def test_draws_come_back_from_the_cache(spark, tmp_path):
    draws = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.5, 0.25])], "model string, draws array<double>")
    assert scores.write_draws(draws, str(tmp_path / "d"), "h", 7, 2) and scores.write_draws(draws.limit(1), str(tmp_path / "d"), "other", 7, 2)
    cached = spark.read.parquet(str(tmp_path / "d"))
    assert sorted((r["model"], r["draws"]) for r in scores.latest_draws(cached, "h", 7, 2).collect()) == [("a", [1.0, 2.0]), ("b", [0.5, 0.25])]
    assert scores.latest_draws(cached, "h", 8, 2).count() == 0
    (tmp_path / "file").write_text("")
    assert not scores.write_draws(draws, str(tmp_path / "file" / "below"), "h", 7, 2)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e9, 1e9) | st.integers(-10**6, 10**6).map(lambda i: i / 8) | st.integers(-10**6, 10**6).map(lambda i: i / 1000), min_size=1, max_size=200))
def test_rounding_is_exact(spark, values):
    df = spark.createDataFrame([(float(v),) for v in [*values, 0.35, 1.25, 2.675, 0.125, -0.375]], "x double")
    for places in (1, 2):
        for r in df.select("x", numbers.round_exact(F.col("x"), places).alias("y")).collect():
            assert r["y"] == round(r["x"], places) or math.isclose(r["y"], round(r["x"], places), rel_tol=1e-15)
