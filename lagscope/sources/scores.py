"""Adapters: source tables to the canonical frame."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.classify import classify_label
from ..operators.frontier import best_per_key
from ..operators.ingest import backfill_two_keys, day, number, override_blank, rename_if_absent, require_columns, scaled, std_from_interval
from ..schema import to_canonical

log = logging.getLogger(__name__)


def model_scores(table: DataFrame, benchmark_id: str, *, reference: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """A score table of strings (Model, eci, interval, date, Model accessibility): the best variant of each
    model, backfilled, with deviations from intervals.  Rows without a known group stay, with a null flag."""
    t = rename_if_absent(require_columns(table, ["Model", "eci"]), "Version release date", "date")
    for c in ("eci", "eci_ci_low", "eci_ci_high"):
        t = t.withColumn(c, number(F.col(c)) if c in t.columns else F.lit(None).cast("double"))
    for c in ("date", "Organization", "Model accessibility"):
        t = t if c in t.columns else t.withColumn(c, F.lit(None).cast("string"))
    t = best_per_key(t.filter("eci is not null"), ["Model"], "eci", [F.coalesce("date", F.lit("")), F.coalesce("eci_ci_low", F.lit(0.0))])
    if reference is not None:
        needed = ["Model", "Organization", "Publication date"]
        t = backfill_two_keys(t, require_columns(reference, needed).select(needed), "Model", {"Organization": "Organization", "date": "Publication date"}, [F.coalesce("Publication date", F.lit(""))])
    if overrides is not None:
        t = override_blank(t, overrides, "Model", "Model accessibility")
    return to_canonical(t, {"benchmark_id": F.lit(benchmark_id), "model": "Model", "date": day(F.col("date")), "score": "eci", "score_std": std_from_interval(F.col("eci_ci_low"), F.col("eci_ci_high")), "is_laggard": classify_label(F.col("Model accessibility"))})


def benchmark_scores(table: DataFrame, benchmark_id: str, is_laggard: Column, *, scale: float = 100.0, scores: tuple[str, ...] = ("mean_score", "Best score (across scorers)", "ECI Score"), name: str = "Model version", date: str = "Release date", std: str = "stderr") -> DataFrame:
    """A per-benchmark table: the first known score, scaled row by row; rows without a score, date, name or
    group are rejected, and a missing deviation is 0."""
    value = F.coalesce(*(number(F.col(f"`{c}`")) for c in scores if c in table.columns))
    rows = to_canonical(table, {"benchmark_id": F.lit(benchmark_id), "model": F.when(F.trim(f"`{name}`") != "", F.trim(f"`{name}`")), "date": day(F.col(f"`{date}`")), "score": scaled(value, scale), "score_std": F.coalesce(scaled(number(F.col(f"`{std}`")), scale), F.lit(0.0)) if std in table.columns else F.lit(0.0), "is_laggard": is_laggard})
    return rows.filter("score is not null and date is not null and model is not null and is_laggard is not null")


def resolve_task(tasks: DataFrame, path: str, alternates: list[str], keywords: list[str]) -> DataFrame:
    """The one task of a benchmark: by its path, else by an alternate, else by a keyword in its path."""
    exact = F.when(F.col("path") == path, F.lit(0))
    others = [F.when(F.col("path") == a, F.lit(1 + i)) for i, a in enumerate(alternates)]
    words = [F.when(F.lower("path").contains(k.lower()), F.lit(1000 + i)) for i, k in enumerate(keywords)]
    ranked = tasks.withColumn("tier", F.coalesce(exact, *others, *words)).filter("tier is not null")
    return ranked.orderBy("tier", "path").limit(1).drop("tier")


def run_scores(task: DataFrame, runs: DataFrame, scores: DataFrame, models: DataFrame, groups: DataFrame, benchmark_id: str, is_laggard: Column, *, scorers: list[str], scale: float = 100.0) -> DataFrame:
    """Best score of each model over the successful runs of a task, by allowed scorers.

    tasks(task_id, path), runs(run_id, task_id, model_id, status), scores(run_id, scorer, mean, stderr),
    models(model_id, release_date, group_id), groups(group_id, accessibility, organizations array<string>).
    """
    done = runs.filter(F.col("status") == "success").join(task.select("task_id"), "task_id").join(scores.filter(F.col("scorer").isin(scorers)), "run_id")
    best = best_per_key(done.select("model_id", "mean", "stderr", "run_id"), ["model_id"], "mean", [F.col("run_id")])
    full = best.join(models, "model_id").join(groups, "group_id")
    return to_canonical(full, {"benchmark_id": F.lit(benchmark_id), "model": "model_id", "date": "release_date", "score": scaled(F.col("mean"), scale), "score_std": scaled(F.col("stderr"), scale), "is_laggard": is_laggard})


def latest_draws(draws: DataFrame, source_hash: str, seed: int, n: int) -> DataFrame:
    """Cached draws (model, draws) of one source, seed and number; none if any differs."""
    return draws.filter((F.col("source_hash") == source_hash) & (F.col("seed") == seed) & (F.col("n_samples") == n)).select("model", "draws")


def write_draws(draws: DataFrame, path: str, source_hash: str, seed: int, n: int) -> bool:
    """Add draws (model, draws) to a cache that ``latest_draws`` reads; a cache that can't be written is no error,
    and the answer is whether it was."""
    marked = draws.select("model", "draws", F.lit(source_hash).alias("source_hash"), F.lit(seed).alias("seed"), F.lit(n).alias("n_samples"))
    try:
        marked.write.mode("append").partitionBy("source_hash", "seed", "n_samples").parquet(path)
    except Exception as error:  # whatever the file system says
        log.warning("draws not cached: %s", error)
        return False
    return True


def available_benchmarks(rows: DataFrame) -> DataFrame:
    """Non-empty benchmarks with their numbers of rows and models, in order."""
    counts = rows.groupBy("benchmark_id").agg(F.count("*").alias("n_rows"), F.countDistinct("model").alias("n_models"))
    return counts.withColumn("position", F.row_number().over(Window.orderBy("benchmark_id")))
