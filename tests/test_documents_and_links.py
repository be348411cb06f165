"""Block YAML, versioned documents, and the linked tables with their pushed filters."""

import json

import pytest
from pyspark.sql import functions as F

from lagscope.sources import blocks, files, linked

YAML = """\
# horizons
benchmark: "a: b # c"
doubling_time_in_days:
  all_time: {point_estimate: 212.5, ci_low: 1.5e2, ci_high: ~}
  from_2023_on:
    point_estimate: 130
results:
  model_a_inspect:
    release_date: 2024-05-01   # a day
    metrics:
      p50_horizon_length:
        estimate: 12.5
        ci_low: 4
        ci_high: 30.25
      average_score: 0.5
      is_sota: true
    notes: |
      first line
        second: line
    tags:
    - x
    - 'it''s'
    - {k: [1, two, "three\\n"]}
    -
      deep: 1
      more: -2.5
    - - n1
      - n2
    empty: {}
  'model: b':
    release_date: "2023-01-15"
    metrics:
      p50_horizon_length: 3.5
      is_sota: no
    folded: >-
      one
      two
    long: this goes
      on here
  model_c:
  model_d: {release_date: 2022-02-02, metrics: {p50_horizon_length: {estimate: 1,
      ci_low: 0.5}}}
"""
TWIN = {
    "benchmark": "a: b # c",
    "doubling_time_in_days": {"all_time": {"point_estimate": 212.5, "ci_low": 150.0, "ci_high": None}, "from_2023_on": {"point_estimate": 130}},
    "results": {
        "model_a_inspect": {"release_date": "2024-05-01", "metrics": {"p50_horizon_length": {"estimate": 12.5, "ci_low": 4, "ci_high": 30.25}, "average_score": 0.5, "is_sota": True}, "notes": "first line\n  second: line\n", "tags": ["x", "it's", {"k": [1, "two", "three\n"]}, {"deep": 1, "more": -2.5}, ["n1", "n2"]], "empty": {}},
        "model: b": {"release_date": "2023-01-15", "metrics": {"p50_horizon_length": 3.5, "is_sota": "no"}, "folded": "one two", "long": "this goes on here"},
        "model_c": None,
        "model_d": {"release_date": "2022-02-02", "metrics": {"p50_horizon_length": {"estimate": 1, "ci_low": 0.5}}},
    },
}


def test_scanned_document_is_its_twin():
    assert blocks.nested(blocks.scan(YAML)) == TWIN
    assert blocks.nested(blocks.scan(json.dumps(TWIN))) == TWIN  # JSON is a flow value
    assert blocks.nested(blocks.scan("- 1\n- a: 2\n  b: [ ]\n-  - x\n")) == [1, {"a": 2, "b": []}, ["x"]]
    assert blocks.nested(blocks.scan("---\na:\n  - 1\n  -\nb: ~\n...\n")) == {"a": [1, None], "b": None}
    assert blocks.nested(blocks.scan("a: 1\na: 2\n")) == {"a": 2} and blocks.scan("") == [] and blocks.scan("# only\n") == []


@pytest.mark.parametrize("text", ["a: &x 1\n", "a: *x\n", "a: !t 1\n", "a: 1\n---\nb: 2\n", "\ta: 1\n", "a: 'open\n", "just words\n", "a: {b: 1\n", 'a: "x" y\n'])
def test_what_is_not_read_is_refused(text):
    with pytest.raises(blocks.Malformed):
        blocks.scan(text)


def test_nested_results_of_yaml_and_json_alike(spark, tmp_path):
    for name, text in (("y/a.yaml", YAML), ("j/a.json", json.dumps(TWIN, indent=1)), ("bad/b.yaml", "a: 'open\n"), ("bad/c.yaml", YAML)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    read = lambda d: sorted(map(tuple, files.read_nested_results(spark, str(tmp_path / d)).collect()), key=repr)
    assert read("y") == read("j") == read("bad") and len(read("y")) == 4
    rows = blocks.yaml_rows(blocks.read_documents(spark, str(tmp_path / "y"))).orderBy("at").collect()
    assert (rows[0]["path"], rows[0]["value"]) == (["benchmark"], "a: b # c")
    assert [r["value"] for r in rows if r["path"][-1:] == ["n2"] or r["path"][-2:] == ["4", "1"]] == ["n2"]


def test_versions_and_metadata(spark):
    new = {"results": {"b": {"release_date": "2024-01-01", "metrics": {"p50_horizon_length": 2.0}, "more": {"k": 1}}, "c": {"metrics": {}}}, "doubling_time_in_days": {"all_time_stitched": {"point_estimate": 9}, "from_2023": {"point_estimate": "n/a"}}, "title": "x \"y\""}
    old = {"results": {"a": {"metrics": {"p50_horizon_length": {"estimate": 1.0, "ci_low": 0.5}}}, "b": {"metrics": {"p50_horizon_length": 7.0}}}, "doubling_time_in_days": {"all_time": {"point_estimate": 1}}}
    docs = spark.createDataFrame([("1.0", "f", json.dumps(old)), ("1.1", "f", json.dumps(new)), ("1.2", "f", None)], "version string, file string, json string")
    got = {r["key"]: r for r in files.merged_versions(docs, F.upper("id")).withColumn("k", F.expr("variant_get(entry, '$.more.k', 'int')")).collect()}
    assert {k: (r["version"], r["in_versions"], r["score"], r["low"], r["k"]) for k, r in got.items()} == {"A": ("1.0", ["1.0"], 1.0, 0.5, None), "B": ("1.1", ["1.0", "1.1"], 2.0, None, 1), "C": ("1.1", ["1.1"], None, None, None)}
    (meta,) = files.document_metadata(docs).withColumns({"title": F.expr("variant_get(rest, '$.title', 'string')"), "note": F.expr("variant_get(rest, '$.doubling_time_in_days.from_2023.point_estimate', 'string')")}).collect()
    assert (meta["version"], meta["versions"], meta["doubling_days"], meta["recent_doubling_days"], meta["title"], meta["note"]) == ("1.1", ["1.0", "1.1"], 9.0, None, 'x "y"', "n/a")


@pytest.fixture(scope="module")
def export(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("export"))
    rows = {
        "tasks": ([("t1", "b/task", "B"), ("t2", "a/task", "A"), ("t3", "é/task", None)], "task_id string, path string, name string"),
        "runs": ([(f"r{i}", [f"t{1 + i % 2}"], [f"m{i % 5}"] if i % 7 else [], "success" if i % 3 else "failed") for i in range(40)], "run_id string, task_id array<string>, model_id array<string>, status string"),
        "scores": ([(f"s{i}", [f"r{i % 40}"], "match" if i % 2 else "model_graded", i / 100, 0.01) for i in range(80)], "score_id string, run_id array<string>, scorer string, mean double, stderr double"),
        "models": ([(f"m{i}", None if i == 4 else __import__("datetime").date(2024, 1, 1 + i), [f"g{i % 2}"]) for i in range(5)], "model_id string, release_date date, group_id array<string>"),
        "groups": ([("g0", "Open weights", ["o1"]), ("g1", "API access", [])], "group_id string, accessibility string, organizations array<string>"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{at}/{name}")
    return at


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_linked_tables_push_filters_into_the_reader(spark, export):
    t = linked.read_linked(spark, export)
    done = t["runs"].filter("status = 'success' and model_id is not null")
    assert sorted(r["run_id"] for r in done.collect()) == sorted(f"r{i}" for i in range(40) if i % 3 and i % 7)
    assert "isnotnull(model_id" in plan(done) and "(status#" not in plan(done)  # Spark filters by the link only
    graded = t["scores"].filter(F.col("scorer").isin("match", "other") & (F.col("mean") >= 0.3))
    assert graded.count() == sum(i % 2 == 1 and i / 100 >= 0.3 for i in range(80))
    assert "scorer#" not in plan(graded).split("Filter")[-1].split("BatchScan")[0] if "Filter" in plan(graded) else True
    reader = linked.LinkedReader("runs", export)
    from pyspark.sql.datasource import EqualTo, IsNotNull

    left = list(reader.pushFilters([EqualTo(("status",), "success"), IsNotNull(("model_id",))]))
    assert left == [IsNotNull(("model_id",))] and len(reader.partitions()) >= 1
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert rows == sum(i % 3 > 0 for i in range(40))


def test_reports_of_linked_tables(spark, export):
    t = linked.read_linked(spark, export)
    assert [(r["path"], r["position"]) for r in linked.task_paths(t["tasks"]).orderBy("position").collect()] == [("a/task", 1), ("b/task", 2), ("é/task", 3)]
    configured = spark.createDataFrame([("x", "a/task"), ("y", "é/task"), ("z", "none")], "benchmark_id string, path string")
    assert sorted((r["benchmark_id"], r["n_models"]) for r in linked.available_tasks(t["tasks"], t["runs"], configured).collect()) == [("x", 5), ("y", 0)]
    report = {r["task_id"]: r for r in linked.exploration(t["tasks"], t["runs"], t["scores"], recommended=5).collect()}
    assert [report[k]["n_runs"] for k in ("t1", "t2", "t3")] == [20, 20, 0] and report["t1"]["n_scores"] == 40 and report["t1"]["recommended"] and not report["t3"]["recommended"]
    assert report["t1"]["about_models"] == report["t1"]["n_models"] == 5 and report["t1"]["low"] <= report["t1"]["median"] <= report["t1"]["high"]
    assert {(r["kind"], r["n_groups"]) for r in linked.accessibility_report(t["groups"]).collect()} == {("open", 1), ("closed", 1)}


def test_positions_are_those_of_a_sort(spark):
    names = sorted({f"{'abcé'[i % 4] * (i % 3)}{i * 7919 % 1000}" for i in range(800)} | {"", "same/prefix/1", "same/prefix/2"}, key=str.encode)
    df = spark.createDataFrame([(n,) for n in reversed(names)], "path string")
    assert [r["path"] for r in linked.positions(df, "path").orderBy("position").collect()] == names
    assert linked.positions(df.limit(0), "path").count() == 0
