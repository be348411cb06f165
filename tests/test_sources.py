"""Adapters, string functions, publishing and the stream, on small files."""

import datetime as dt
import json
import zipfile

from pyspark.sql import functions as F

from lagscope.functions import dates, strings
from lagscope.operators import classify, ingest
from lagscope.plans import publish
from lagscope.plans.bindings import orders
from lagscope.sources import files, scores
from lagscope.streaming.records import daily_best, frontier_of_days


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scores_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Model,eci,eci_ci_low,eci_ci_high,date,Organization,Model accessibility\n"A, the\nfirst",10,8,12,2024-01-02,,Open weights\n"A, the\nfirst",12,,,2024-03-01,,Open weights\nB (Sep 2025),x,,,2024-01-01,O,API access\nC,7,6,8,bad,,\n')
    t = files.read_csv_strings(spark, str(tmp_path / "s.csv"))
    out = {r["model"]: r for r in scores.model_scores(t, "eci", overrides=spark.createDataFrame([("C", "API access")], "key string, value string")).collect()}
    assert set(out) == {"A, the\nfirst", "C"}
    assert out["A, the\nfirst"]["score"] == 12 and out["A, the\nfirst"]["is_laggard"] is True
    assert out["C"]["date"] is None and out["C"]["is_laggard"] is False and abs(out["C"]["score_std"] - 2 / 3.29) < 1e-12


def test_backfill_prefers_the_exact_name(spark):
    rows = spark.createDataFrame([("B (Sep 2025)", None), ("B", None), ("C", "own")], "Model string, org string")
    ref = spark.createDataFrame([("B", "plain"), ("B (Sep 2025)", "dated")], "Model string, o string")
    out = {r["Model"]: r["org"] for r in ingest.backfill_two_keys(rows, ref, "Model", {"org": "o"}, [F.col("o")]).collect()}
    assert out == {"B (Sep 2025)": "dated", "B": "plain", "C": "own"}


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.csv", 'name,score\n"p,\nq",0.5\nr,\n')
        z.writestr("y.csv", "name\ns\n")
    rows = files.read_zip_csv(spark, str(tmp_path / "a.zip"), "x.csv").select(files.cell("name").alias("n"), files.cell("score").alias("s")).collect()
    assert [tuple(r) for r in rows] == [("p,\nq", "0.5"), ("r", None)]
    assert files.read_zip_csv(spark, str(tmp_path / "a.zip"), "none.csv").count() == 0


def test_benchmark_scores(spark):
    t = spark.createDataFrame([("m", "0.5", "0.1", "2024-01-01"), ("n", None, None, "2024-01-01"), ("", "1.0", None, "2024-01-01"), ("k", "1.0", None, "2024-01-01")], "`Model version` string, mean_score string, stderr string, `Release date` string")
    out = [tuple(r)[1:5] for r in scores.benchmark_scores(t, "b", F.lit(True)).orderBy("model").collect()]
    assert out == [("k", dt.date(2024, 1, 1), 100.0, 0.0), ("m", dt.date(2024, 1, 1), 50.0, 10.0)]


def test_nested_results(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"results": {"a": {"release_date": "2024-05-01", "metrics": {"p50_horizon_length": {"estimate": 4.5, "ci_low": 1, "ci_high": 9}, "is_sota": True}}, "b": {"release_date": "2024/06/01", "metrics": {"p50_horizon_length": 2, "average_score": 0.3}}}}))
    out = {r["id"]: r for r in files.read_nested_results(spark, str(tmp_path)).collect()}
    assert (out["a"]["score"], out["a"]["low"], out["a"]["is_sota"]) == (4.5, 1.0, True)
    assert (out["b"]["score"], out["b"]["low"], out["b"]["average_score"], out["b"]["date"]) == (2.0, None, 0.3, dt.date(2024, 6, 1))


def test_tasks_and_runs(spark):
    tasks = spark.createDataFrame([(1, "x/gpqa_diamond"), (2, "alt/gpqa")], "task_id int, path string")
    assert scores.resolve_task(tasks, "no", ["alt/gpqa"], ["diamond"]).first()["task_id"] == 2
    assert scores.resolve_task(tasks, "no", [], ["DIAMOND"]).first()["task_id"] == 1
    runs = spark.createDataFrame([(1, 2, "m", "success"), (2, 2, "m", "success"), (3, 2, "m", "error")], "run_id int, task_id int, model_id string, status string")
    marks = spark.createDataFrame([(1, "acc", 0.4, 0.1), (2, "acc", 0.6, 0.1), (3, "acc", 0.9, 0.1), (2, "other", 0.99, 0.1)], "run_id int, scorer string, mean double, stderr double")
    models = spark.createDataFrame([("m", dt.date(2024, 1, 1), 7)], "model_id string, release_date date, group_id int")
    groups = spark.createDataFrame([(7, "Open weights", ["Org"])], "group_id int, accessibility string, organizations array<string>")
    out = scores.run_scores(tasks.filter("task_id = 2"), runs, marks, models, groups, "g", classify.classify_accessible(F.col("accessibility"), F.col("organizations"), ["Open weights"], []), scorers=["acc"]).collect()
    assert [(r["model"], r["score"], r["is_laggard"]) for r in out] == [("m", 60.0, True)]


def test_classification_chain(spark):
    def kind(own=None, index=None, over=None, name="n", org="o"):
        return one(spark, classify.classify_chain(*(F.lit(x).cast("string") for x in (own, index, over, name, org)), open_names=["llama"], closed_orgs=["closed"], open_orgs=["open"]))

    assert kind(own="Open weights", index="API access") is True and kind(index="API access", over="Open weights") is False
    assert kind(over="Hosted access (no API)") is False and kind(name="Llama 2") is True and kind(org="Closed Inc") is False
    assert kind(org="open lab") is True and kind(own="Unreleased") is None


def test_strings_and_dates(spark):
    assert one(spark, strings.strip_dated_suffix(F.lit("Gemini 2.5 (Sep 2025) "))) == "Gemini 2.5"
    assert one(spark, strings.strip_dated_suffix(F.lit("A (beta)"))) == "A (beta)"
    assert one(spark, strings.title_case(F.lit("4o mini-x"))) == "4O Mini-X"
    assert one(spark, dates.floor_days(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-02 12:00:00").cast("timestamp_ntz"))) == -2
    assert one(spark, dates.parse_date(F.lit("2024/03/05"))) == dt.date(2024, 3, 5) and one(spark, dates.parse_date(F.lit("soon"))) is None


def test_publish(spark, tmp_path):
    sections = publish.analyse(orders(spark, "/root/testdata/sf0.001"), F.lit("2001-01-01").cast("date"))
    docs = {r["benchmark_id"]: json.loads(r["document"]) for r in publish.documents(sections).collect()}
    assert set(docs) == {"F", "O", "P"} and all("NaN" not in json.dumps(d) for d in docs.values())
    assert docs["F"]["gaps"] and docs["F"]["statistics"]["n_days"] > 0
    new = publish.documents(sections).filter("benchmark_id = 'F'")
    publish.publish(new, publish.documents(sections), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    from lagscope.operators.frontier import strict_records

    rows = [("b", i % 2 == 0, dt.datetime(2024, 1, 1 + i // 3, i % 3), float((i * 7) % 11)) for i in range(30)]
    schema = "benchmark_id string, is_laggard boolean, ts timestamp, score double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = daily_best(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.foreachBatch(lambda d, i: d.write.mode("overwrite").parquet(str(tmp_path / "days"))).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["is_laggard"], r["date"], r["score"]) for r in frontier_of_days(spark.read.parquet(str(tmp_path / "days"))).collect()}
    batch = spark.createDataFrame(rows, schema).withColumns({"date": F.to_date("ts"), "model": F.col("ts")})
    assert got == {(r["is_laggard"], r["date"], r["score"]) for r in strict_records(batch).collect()}
