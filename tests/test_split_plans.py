"""Plans that split a group, against plain counting on ties, nulls and skewed values."""

import datetime as dt
import random

import numpy as np
import pytest

from lagscope.operators.frontier import cumulative_rank
from lagscope.operators.thresholds import validity_floor

SCHEMA = "benchmark_id string, model string, date date, score double, is_laggard boolean"


def rows_of(seed):
    rng = random.Random(seed)
    out = []
    for i in range(900):
        date = None if rng.random() < 0.1 else dt.date(2020, 1, 1) + dt.timedelta(days=rng.choice([0, 0, 1, 2, 3, 40, 700]))
        score = None if rng.random() < 0.05 else rng.choice([rng.random(), round(rng.random(), 1), -1.5])
        out.append((rng.choice(["a", "a", "a", None]), f"m{i}", date, score, rng.choice([True, False, None])))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_ranks_by_brute_force(spark, seed):
    rows = rows_of(seed)
    late = dt.date.max
    expected = {}
    for b, m, d, s, g in rows:
        earlier = [x for x in rows if (x[0], x[4]) == (b, g) and x[3] is not None and s is not None and x[3] > s and (x[2] or late) <= (d or late)]
        expected[m] = None if s is None else 1 + len(earlier)
    found = cumulative_rank(spark.createDataFrame(rows, SCHEMA))
    assert {r["model"]: r["rank"] for r in found.collect()} == expected
    assert found.columns[-1] == "rank" and len(expected) == len(rows)


def test_ranks_without_dates_or_rows(spark):
    df = spark.createDataFrame([("a", "x", None, 1.0, True), ("a", "y", None, 2.0, True)], SCHEMA)
    assert {r["model"]: r["rank"] for r in cumulative_rank(df).collect()} == {"x": 2, "y": 1}
    assert cumulative_rank(df.limit(0)).count() == 0


def test_floor_equals_percentile(spark):
    rng = np.random.default_rng(5)
    groups = {str(n): rng.random(n) for n in (1, 2, 3, 10, 11, 12, 101, 999)} | {"wide": rng.lognormal(0, 4, 30_001), "tied": rng.integers(0, 12, 5000) / 4, "same": np.full(50, 2.5)}
    rows = [(b, float(s)) for b, own in groups.items() for s in own] + [("none", None)]
    found = {r["benchmark_id"]: r["floor"] for r in validity_floor(spark.createDataFrame(rows, "benchmark_id string, score double")).collect()}
    assert found == pytest.approx({b: float(np.percentile(own, 10)) for b, own in groups.items()}, rel=1e-12)
