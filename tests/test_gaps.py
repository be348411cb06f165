"""Cases with known answers, and brute-force checks on small random frames."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lagscope.operators import match, smooth, spine, survival, thresholds, trend
from lagscope.operators.frontier import cumulative_rank, frontier, records_with_baseline, strict_records
from lagscope.plans import queries

SCHEMA = "benchmark_id string, model string, date date, score double, score_std double, is_laggard boolean"


def frame(spark, *rows):
    """Rows (group, score, date[, std]), with L for laggards."""
    out = [("b", f"{g}{i}", dt.date.fromisoformat(d) if d else None, s, rest[0] if rest else None, g == "L") for i, (g, s, d, *rest) in enumerate(rows)]
    return spark.createDataFrame(out, SCHEMA)


def as_of(d="2026-01-01"):
    return F.lit(d).cast("date")


def first(df):
    return df.first().asDict()


def test_simple_match(spark):
    g = first(match.first_catchup(frame(spark, ("R", 100.0, "2024-01-01"), ("L", 101.0, "2024-04-01")), as_of()))
    assert g["matched"] and g["gap_days"] == 91 and g["match_type"] == "threshold"


@pytest.mark.parametrize(("score", "matched"), [(99.0, True), (98.99, False)])
def test_tolerance_edge(spark, score, matched):
    g = first(match.first_catchup(frame(spark, ("R", 100.0, "2024-01-01"), ("L", score, "2024-04-01")), as_of()))
    assert g["matched"] is matched


def test_earlier_laggard_does_not_match(spark):
    g = first(match.first_catchup(frame(spark, ("R", 100.0, "2024-06-01"), ("L", 105.0, "2024-01-01")), as_of()))
    assert not g["matched"] and g["lag_model"] is None and g["match_type"] is None


def test_two_leaders_one_laggard(spark):
    rows = match.first_catchup(frame(spark, ("R", 100.0, "2024-01-01"), ("R", 120.0, "2024-03-01"), ("L", 125.0, "2024-06-01")), as_of()).collect()
    assert [r["lag_model"] for r in rows] == ["L2", "L2"]


@pytest.mark.parametrize(("a", "sa", "b", "sb", "caught"), [(100.0, 2.0, 103.0, 2.0, True), (100.0, 1.0, 110.0, 1.0, False)])
def test_analytical_predicate(spark, a, sa, b, sb, caught):
    c = match.caught_up(*(F.lit(x) for x in (a, sa, b, sb)))
    assert spark.range(1).select(c.alias("c")).first()["c"] is caught


@pytest.mark.parametrize(("hits", "caught"), [(5, True), (4, False)])
def test_draw_predicate(spark, hits, caught):
    rows = spark.createDataFrame([([1.0] * hits + [-1.0] * (100 - hits), [0.0] * 100)], "x array<double>, y array<double>")
    p = match.prob_exceeds(F.col("x"), F.col("y"))
    none = F.lit(None).cast("double")
    assert rows.select(match.caught_up(F.lit(0.0), none, F.lit(99.0), none, probability=p).alias("c")).first()["c"] is caught


def test_probability_skips_non_finite_and_missing(spark):
    rows = spark.createDataFrame([([1.0, float("nan"), 3.0], [0.0, 0.0, 5.0, 9.0]), (None, [1.0])], "x array<double>, y array<double>")
    assert [r["p"] for r in rows.select(match.prob_exceeds(F.col("x"), F.col("y")).alias("p")).collect()] == [0.5, None]


def test_one_day_metrics(spark):
    m = first(spine.gap_metrics(spine.daily_gap(frame(spark, ("R", 100.0, "2024-01-01"), ("R", 120.0, "2024-07-01"), ("L", 121.0, "2025-01-01")))))
    assert m["n_days"] == 1 and round(m["avg_gap_months"] * 30.4375) == 184 and m["avg_vertical"] == 0 and m["gap_std"] == 0


def test_lenient_and_strict(spark):
    d = spine.daily_gap(frame(spark, ("R", 100.0, "2023-01-01", 2.0), ("R", 120.0, "2024-01-01", 2.0), ("L", 119.0, "2024-06-01", 2.0)))
    r = d.first()
    assert round(r["gap_months"] * 30.4375) == 152 and round(r["strict_months"] * 30.4375) == 517


def test_window_override(spark):
    d = spine.daily_gap(frame(spark, ("R", 100.0, "2023-01-01"), ("L", 99.5, "2024-01-01")), start=as_of("2024-02-01"), end=as_of("2024-02-10"))
    assert d.count() == 10


def test_bracket(spark):
    f = frame(spark, ("R", 100.0, "2025-01-01"), ("R", 110.0, "2025-07-01"), ("L", 105.0, "2025-08-01"))
    b = first(trend.lag_bracket(f, as_of=as_of()))
    assert (b["below_model"], b["above_model"]) == ("R0", "R1") and b["under_months"] <= b["central_months"] <= b["over_months"]
    assert b["central_months"] == pytest.approx((365 - 90.5) / 30.4375, abs=0.03)


def test_bracket_leads_and_censored(spark):
    leads = first(trend.lag_bracket(frame(spark, ("R", 100.0, "2025-01-01"), ("L", 120.0, "2025-02-01"))))
    assert leads["laggard_leads"] and leads["central_months"] == 0
    censored = first(trend.lag_bracket(frame(spark, ("R", 100.0, "2025-01-01"), ("L", 90.0, "2025-02-01"))))
    assert censored["censored"] and censored["over_months"] is None and censored["central_months"] is None


def test_trend_offset_and_velocity(spark):
    day = lambda i, off=0: (dt.date(2023, 1, 1) + dt.timedelta(30 * i + off)).isoformat()
    same = frame(spark, *[("R", 10.0 + i, day(i)) for i in range(13)], *[("L", 10.0 + i, day(i, 183)) for i in range(13)])
    t = first(trend.trend_gap(same))
    assert t["backward_months"] == pytest.approx(183 / 30.4375, abs=0.15) and t["change_months_per_year"] == pytest.approx(0, abs=1e-6)
    twice = frame(spark, *[("R", 10.0 + i, day(i)) for i in range(13)], *[("L", 10.0 + 2 * i, day(i)) for i in range(13)])
    assert first(trend.trend_gap(twice))["change_months_per_year"] == pytest.approx(-12)
    flat = frame(spark, *[("R", 10.0, day(i)) for i in range(5)], *[("L", 1.0 + i, day(i)) for i in range(5)])
    assert trend.trend_gap(flat).count() == 0


def test_trend_bootstrap_is_seeded_and_brackets_the_point(spark):
    rng = random.Random(1)
    day = lambda i, off=0: (dt.date(2023, 1, 1) + dt.timedelta(30 * i + off)).isoformat()
    f = frame(spark, *[("R", 10.0 + i + rng.random(), day(i)) for i in range(12)], *[("L", 10.0 + i + rng.random(), day(i, 90)) for i in range(12)])
    a, b = (first(trend.trend_gap_bootstrap(f, n_boot=300)) for _ in range(2))
    point = first(trend.trend_gap(f))
    assert a == b and a["backward_low"] <= point["backward_months"] <= a["backward_high"]
    small = first(trend.trend_gap_bootstrap(f.filter("model <> 'x'").limit(5), n_boot=10))
    assert small["backward_low"] is None


def test_thresholds(spark):
    rows = frame(spark, ("R", 55.0, "2023-01-01"), ("R", 90.0, "2023-06-01"), ("L", 60.0, "2024-01-01"))
    points = {round(r["threshold"]): r for r in thresholds.threshold_datapoints(rows, as_of("2023-07-01")).collect()}
    assert points[50]["gap_days"] == 365 and points[50]["lead_model"] == "R0"
    assert points[75]["still_open"] and not points[75]["valid"] and round(points[75]["gap_months_so_far"] * 30.4375) == 30
    # one accepted row a pair, at the highest threshold that the pair spans
    chosen = thresholds.threshold_datapoints(rows, as_of("2023-07-01"), accepted=[50.0]).filter("accepted").collect()
    assert [(round(r["threshold"]), r["valid"]) for r in chosen] == [(55, False)]


def test_grids(spark):
    for top, n, last in ((0.9, 19, 0.95), (92.0, 19, 95.0), (150.0, 19, 142.5)):
        grid = [r["threshold"] for r in thresholds.auto_grid(frame(spark, ("R", 0.0, "2023-01-01"), ("R", top, "2023-01-02"))).collect()]
        assert len(grid) == n and max(grid) == pytest.approx(last)


def test_smoother(spark):
    rows = [(dt.date(2023, 1, 1) + dt.timedelta(10 * i), 5.0) for i in range(10)] + [(dt.date(2026, 1, 1) + dt.timedelta(10 * i), 5.0) for i in range(10)]
    out = smooth.kernel_smooth(spark.createDataFrame(rows, "date date, value double"), []).orderBy("grid_date").collect()
    known = [r["mean"] for r in out if r["mean"] is not None]
    assert all(x == pytest.approx(5) for x in known) and any(r["mean"] is None for r in out)
    boot = smooth.kernel_smooth_bootstrap(spark.createDataFrame(rows, "date date, value double"), [], n_boot=50)
    assert all(r["lo"] == pytest.approx(5) and r["hi"] == pytest.approx(5) for r in boot.collect() if r["lo"] is not None)


def test_current_gap(spark):
    rows = [("b", f"m{i}", m, g) for i, (m, g) in enumerate([(False, 8.0), (False, 6.0), (True, 3.0), (True, 5.0)])]
    gaps = spark.createDataFrame(rows, "benchmark_id string, lead_model string, matched boolean, gap_months double")
    r = first(survival.current_gap(gaps, ["benchmark_id"]))
    assert r["min_gap"] == 8 and r["method"] == "insufficient_data_heuristic" and r["estimated_gap"] == 8
    more = gaps.union(spark.createDataFrame([("b", "m9", True, 4.0)], gaps.schema))
    r = first(survival.current_gap(more, ["benchmark_id"]))
    assert r["method"] == "survival_analysis_mle" and r["estimated_gap"] >= 8
    assert first(survival.current_gap(gaps.filter("matched"), ["benchmark_id"]))["method"] == "no_unmatched"


def test_normal_cdf(spark):
    import math

    z = [-6.0, -1.0, 0.0, 0.5, 3.0]
    out = [r["p"] for r in spark.createDataFrame([(x,) for x in z], "z double").select(survival.normal_cdf(F.col("z")).alias("p")).collect()]
    assert out == pytest.approx([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in z], abs=2e-7)


def random_rows(seed, n=60):
    rng = random.Random(seed)
    return [("b", f"m{i:03}", dt.date(2024, 1, 1) + dt.timedelta(rng.randint(0, 20)), float(rng.randint(0, 12)) if rng.random() > 0.1 else None, None, rng.random() < 0.5) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_frontiers_by_brute_force(spark, seed):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    rank, front, strict = {}, set(), set()
    for side in (True, False):
        seen = []
        for r in sorted((r for r in rows if r[5] == side and r[3] is not None), key=lambda r: (r[2], -r[3], r[1])):
            rank[r[1]] = 1 + sum(x > r[3] for x in seen)
            if rank[r[1]] == 1:
                front.add(r[1])
            if all(x < r[3] for x in seen):
                strict.add(r[1])
            seen.append(r[3])
    assert {r["model"]: r["rank"] for r in cumulative_rank(df).filter("rank is not null").collect()} == rank
    assert {r["model"] for r in frontier(df).collect()} == front
    assert {r["model"] for r in strict_records(df).collect()} == strict
    late = {m for m in strict if dict((r[1], r[2]) for r in rows)[m] >= dt.date(2024, 1, 5)}
    assert {r["model"] for r in records_with_baseline(df, F.lit("2024-01-05").cast("date")).collect()} == late


@pytest.mark.parametrize("seed", [3, 4])
def test_catchup_and_daily_by_brute_force(spark, seed):
    rows = random_rows(seed)
    front = frontier(spark.createDataFrame(rows, SCHEMA))
    kept = [tuple(r) for r in front.collect()]
    lag = sorted((r for r in kept if r[5]), key=lambda r: (r[2], -r[3], r[1]))
    want = {r[1]: next((x[1] for x in lag if x[2] > r[2] and x[3] >= r[3] - 1), None) for r in kept if not r[5]}
    assert {r["lead_model"]: r["lag_model"] for r in match.first_catchup(front, as_of()).collect()} == want
    lead = sorted((r for r in kept if not r[5]), key=lambda r: (r[2], -r[3], r[1]))
    records = [r for i, r in enumerate(lead) if all(x[3] < r[3] for x in lead[:i])]
    day, end = max(lag[0][2], lead[0][2]), max(r[2] for r in kept)
    want = {}
    while day <= end:
        best = max(r[3] for r in lag if r[2] <= day)
        ref = [r[2] for r in records if r[2] <= day and best >= r[3] - 1]
        want[day] = ((day - (max(ref) if ref else records[0][2])).days, max(best, max(r[3] for r in records if r[2] <= day)) - best)
        day += dt.timedelta(1)
    assert {r["day"]: (round(r["gap_months"] * 30.4375), r["vertical"]) for r in spine.daily_gap(front).collect()} == want


def test_empty_and_one_sided(spark):
    for df in (frame(spark, ("R", 1.0, "2024-01-01")).limit(0), frame(spark, ("R", 1.0, "2024-01-01")), frame(spark, ("L", None, "2024-01-01"), ("R", 1.0, None))):
        f = frontier(df)
        assert spine.daily_gap(f).count() == 0 and trend.trend_gap(f).count() == 0 and trend.lag_bracket(f).count() == 0
        assert thresholds.threshold_datapoints(df, as_of()).count() == 0
        assert spine.statistics(f, match.first_catchup(f, as_of()), spine.gap_metrics(spine.daily_gap(f))).filter("avg_gap_months <> 0").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_level_matches_by_brute_force(spark, seed):
    """As in the notebook, without its pruning: at the level, or not significantly below its first leader."""
    rng = random.Random(seed)
    rows = []
    for g, shift in (("R", 0), ("L", -4)):
        for day in range(12):
            rows.append((g, float(2 * day + shift + rng.randint(0, 3)), f"2024-{day + 1:02d}-{rng.randint(1, 28):02d}", rng.choice([None, 0.0, 0.0, 1.0, 2.0] if seed else [0.0, 1.0, 2.0])))
    front = frontier(frame(spark, *rows))
    f = sorted(((r["date"], -r["score"], r["model"], r["score"], r["score_std"], r["is_laggard"]) for r in front.collect()), key=lambda r: r[:3])
    lead, lag = [r for r in f if not r[5]], [r for r in f if r[5]]

    def lower(a, b):
        if a[4] is None or b[4] is None:
            return False
        se = (a[4] ** 2 + b[4] ** 2) ** 0.5
        return abs(a[3] - b[3]) > (1.959963984540054 * se if se else 0)

    low, high = max(min(r[3] for r in x) for x in (lead, lag)), min(max(r[3] for r in x) for x in (lead, lag))
    want, plain = {}, {}
    for i in range(100):
        level = low + i * ((high - low) / 99)
        top = next((r for r in lead if r[3] >= level), None)
        match_ = top and next((r for r in lag if r[3] >= level or not lower(r, top)), None)
        if match_:
            want[i] = (top[0], match_[0])
        at = top and next((r for r in lag if r[3] >= level), None)
        if at:
            plain[i] = (top[0], at[0])
    assert {r["i"]: (r["lead_date"], r["lag_date"]) for r in thresholds.level_matches(front).collect()} == want
    assert want != plain


def test_query_of_levels_uses_the_test(spark):
    """Gaps are never longer than by scores alone, and at some level shorter."""
    sf = "/root/testdata/sf0.01"
    front = queries.front(spark, sf)
    at = thresholds.level_grid(front).join(front, "benchmark_id").filter("score >= level").groupBy("benchmark_id", "i")
    at = at.agg(F.min(F.when(~F.col("is_laggard"), F.col("date"))).alias("lead"), F.min(F.when(F.col("is_laggard"), F.col("date"))).alias("lag"))
    plain = {(r["benchmark_id"], r["i"]): round((r["lag"] - r["lead"]).days / 30.5, 6) for r in at.filter("lag is not null").collect()}
    tested = {(r["benchmark_id"], r["i"]): r["gap_months"] for r in queries.queries()["notebook_horizontal_levels"](spark, sf).collect()}
    assert plain.keys() <= tested.keys() and all(tested[k] <= plain[k] for k in plain)
    assert any(tested[k] < plain[k] for k in plain)
