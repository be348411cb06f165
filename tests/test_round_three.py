"""What the reviews of the third round found."""

import math
import re

import duckdb

from lagscope.operators.spacing import spaced
from lagscope.plans import publish, queries
from lagscope.plans.bindings import as_of, orders
from lagscope.sources import linked

SF = "/root/testdata/sf0.001"


def greedy(values, least):
    taken = []
    for x in sorted(v for v in values if v is not None and v > 0):
        if not taken or math.log10(x) - math.log10(taken[-1]) >= least:
            taken.append(x)
    return taken


def test_labels_are_spaced_over_all_orders(spark):
    rows = duckdb.sql(f"SELECT o_orderstatus || '-' || (o_orderkey % 10), o_totalprice::DOUBLE FROM '{SF}/orders.parquet'").fetchall()
    groups = {k: greedy((x for g, x in rows if g == k), 0.2) for k in {g for g, _ in rows}}
    got = queries.queries()["spaced_labels"](spark, SF).collect()
    assert sorted((r["benchmark_id"], r["score"]) for r in got) == sorted((k, x) for k, xs in groups.items() for x in xs)


def test_spacing_of_odd_values(spark):
    many = spark.range(40_000).selectExpr("if(id % 2 = 0, 'a', 'b') AS g", "pow(10D, (id - 10000) / 10007D) AS x")
    odd = [("c", float("inf")), ("c", 5e-324), ("c", 1.0), ("c", -1.0), ("c", 0.0), ("c", None), (None, 2.0), (None, 2.0), (None, 200.0), ("d", None), ("e", 7.0), ("e", float("nan"))]
    rows = many.union(spark.createDataFrame(odd, "g string, x double"))
    labels, got = spaced(rows, "g", "x", 0.4), {}
    for g, x in labels.collect():
        got.setdefault(g, []).append(x)
    for k in ("a", "b"):
        assert sorted(got[k]) == greedy((r[0] for r in many.filter(f"g = '{k}'").select("x").collect()), 0.4)
    assert sorted(got["c"]) == [5e-324, 1.0, float("inf")] and sorted(got[None]) == [2.0, 200.0] and "d" not in got
    assert got["e"][0] == 7.0 and math.isnan(got["e"][1]) and len(got["e"]) == 2
    assert sorted(r[0] for r in spaced(rows.filter("g is null"), "g", "x", 0.0).select("x").collect()) == [2.0, 200.0]


def test_exploration_has_one_sketch_a_task(spark):
    tasks = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "task_id int, path string")
    runs = spark.createDataFrame([("r1", 1, 7), ("r2", 1, 7), ("r3", 1, 8), ("r4", 1, None), ("r5", 2, 7), ("r5", 2, 9), ("r6", None, 7), ("r7", 4, 7)], "run_id string, task_id int, model_id int")
    scores = spark.createDataFrame([("r1", 1.0), ("r1", 3.0), ("r4", 2.0), ("r5", 5.0), ("r8", 9.0), ("r6", 9.0)], "run_id string, mean double")
    out = linked.exploration(tasks, runs, scores, recommended=2)
    got = {r["task_id"]: tuple(r[c] for c in ("n_runs", "n_scores", "n_models", "about_models", "n_unscored", "low", "high", "recommended")) for r in out.collect()}
    assert got == {1: (4, 3, 2, 2, 2, 2.0, 3.0, True), 2: (2, 2, 2, 2, 0, 5.0, 5.0, True), 3: (0, 0, 0, 0, 0, None, None, False)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    sketched = [x for x in plan.splitlines() if "approx_count_distinct" in x and "Aggregate(" in x]
    assert sketched and all(re.search(r"keys=\[task_id#\d+\]", x) for x in sketched)  # not by task and model


def buffers(node, stages):
    """The operators with buffers of their own in a node's stage; those of each stage below go to ``stages``."""
    n = int(node.nodeName() in ("Sort", "SortMergeJoin", "HashAggregate", "ObjectHashAggregate", "SortAggregate", "Window"))
    children = node.children()
    for i in range(children.size()):
        below = buffers(children.apply(i), stages)
        if children.apply(i).nodeName() in ("Exchange", "BroadcastExchange"):
            stages.append(below)
        else:
            n += below
    return n


def test_sections_are_made_in_tasks_of_their_own(spark):
    plan = publish.analyse(orders(spark, SF), as_of())._jdf.queryExecution().executedPlan().initialPlan()
    stages = []
    stages.append(buffers(plan, stages))
    assert len(stages) > 11 and max(stages) <= 60, sorted(stages)[-12:]


def test_sections_stand_beside_their_names(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "benchmark_id string")
    one = spark.createDataFrame([("a", [1, 2]), ("c", [3]), (None, [4])], "benchmark_id string, one array<int>")
    two = spark.createDataFrame([("b", (5, None)), ("c", (None, 6)), ("d", (7, 7))], "benchmark_id string, two struct<x:int,y:int>")
    want = names.join(one, "benchmark_id", "left").join(two, "benchmark_id", "left")
    got = publish._beside(names, [one, two])
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
