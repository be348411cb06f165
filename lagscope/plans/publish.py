"""Sections of a benchmark as one nested JSON document per benchmark."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import match, spine, survival, thresholds, trend
from ..operators.frontier import frontier, strict_records
from ..schema import MATCH_TOLERANCE

log = logging.getLogger(__name__)


def _rows(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """All rows of a benchmark as a sorted array: sections are frontier-sized."""
    key = [c for c in df.columns if c != "benchmark_id"]
    key = [c for c in order if c in key] + [c for c in key if c not in order]
    return df.groupBy("benchmark_id").agg(F.array_sort(F.collect_list(F.struct(*key))).alias(name))


def _row(df: DataFrame, name: str) -> DataFrame:
    return df.select("benchmark_id", F.struct(*(c for c in df.columns if c != "benchmark_id")).alias(name))


def _beside(names: DataFrame, sections: list[DataFrame]) -> DataFrame:
    """One row for each of ``names``, with the section (two columns: ``benchmark_id`` and its name) of each table.

    Each section is shuffled once it is made, by its name, too, and all meet in one grouped aggregate.  Else they would
    be made in one task, as all have the same partitions, with the buffers of all their sorts and joins.
    """
    columns = [s.columns[1] for s in sections]
    out = names.withColumn("_named", F.lit(True))
    for s in sections:
        out = out.unionByName(s.filter("benchmark_id is not null").repartition("benchmark_id", F.lit(s.columns[1])), allowMissingColumns=True)
    out = out.groupBy("benchmark_id").agg(F.max("_named").alias("_named"), *(F.first(c, ignorenulls=True).alias(c) for c in columns))
    return out.filter("_named").drop("_named")


#: Columns of a settings table beside ``benchmark_id``; null means the default.
SETTINGS = {"transform": "string", "tolerance": "double", "survival": "boolean", "accepted": "array<double>", "thresholds": "array<double>", "floor": "double", "keep": "boolean", "access": "string"}


def with_settings(rows: DataFrame, settings: DataFrame | None, transform: str = "linear") -> DataFrame:
    """Rows with the ``tolerance``, ``transform`` and ``survival`` of their benchmark; a setting that is missing or
    null has its default."""
    defaults = {"tolerance": F.lit(MATCH_TOLERANCE), "transform": F.lit(transform), "survival": F.lit(True)}
    if settings is None:
        return rows.withColumns(defaults)
    own = settings.select("benchmark_id", *(F.col(c) if c in settings.columns else F.lit(None).cast(SETTINGS[c]).alias(c) for c in defaults))
    return rows.join(own, "benchmark_id", "left").withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def _by_transform(front: DataFrame, section) -> DataFrame:
    """A section of all benchmarks, each with its own transform."""
    plain = front.drop("transform", "tolerance", "survival")
    parts = [section(plain.filter(front["transform"] == t), t) for t in ("linear", "log", "logit")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def full_settings(settings: DataFrame) -> DataFrame:
    """Settings with all their columns; those that are missing are null."""
    return settings.select("benchmark_id", *(F.col(c).cast(t).alias(c) if c in settings.columns else F.lit(None).cast(t).alias(c) for c, t in SETTINGS.items()))


def analyse(rows: DataFrame, as_of: Column, *, transform: str = "linear", settings: DataFrame | None = None, draws: str | None = None, n_boot: int = 0) -> DataFrame:
    """All sections of each benchmark: models, gaps, statistics, the current gap, trends, trend gap, bracket,
    history, matches, thresholds and their summary.  A section that has nothing to say is null.

    With ``settings`` there is ``threshold_config``, too, and with ``n_boot`` draws the ``trend_gap_interval``.

    ``settings``: a row a benchmark at most, of ``SETTINGS``: the transform of trends and brackets, the score by
    which a laggard may trail and have caught up, whether survival analysis estimates the current gap (else it is the oldest unmatched age), and the
    thresholds that count.  ``draws``: an array column of paired draws.
    """
    rows = with_settings(rows, settings, transform)
    front = frontier(rows)
    gaps = match.first_catchup(front, as_of, threshold=F.col("lead_tolerance"), draws=draws)
    metrics = spine.gap_metrics(spine.daily_gap(front, threshold=F.col("lead_tolerance"), draws=draws))
    by_survival = rows.select("benchmark_id", "survival").distinct()
    estimated = lambda survive: survival.current_gap(gaps.join(by_survival.filter(F.col("survival") == survive), "benchmark_id", "left_semi"), ["benchmark_id"], survival=survive)
    review = full_settings(settings) if settings is not None else None
    points = thresholds.threshold_datapoints(rows, as_of, settings=review)
    sections = [
        _rows(front.select("benchmark_id", "date", "model", "score", "score_std", "is_laggard"), "models", ["date", "model"]),
        _rows(gaps, "gaps", ["lead_date", "lead_model"]),
        _row(spine.statistics(front, gaps, metrics), "statistics"),
        _row(estimated(True).unionByName(estimated(False)), "current_gap"),
        _rows(trend.trends(trend.with_periods(rows, ["benchmark_id"]), ["benchmark_id", "period"]), "trends", ["period"]),
        _row(_by_transform(front, trend.trend_gap), "trend_gap"),
        _row(_by_transform(front, trend.lag_bracket), "lag_bracket"),
        _rows(spine.historical_gap(front, as_of, threshold=F.col("lag_tolerance"), draws=draws), "history", ["day"]),
        _rows(match.frontier_match_map(strict_records(rows), threshold=F.col("lead_tolerance"), draws=draws), "matches", ["lag_model"]),
        _rows(points, "thresholds", ["threshold"]),
        _row(thresholds.threshold_summary(points), "threshold_summary"),
    ]
    if review is not None:
        sections.append(_row(thresholds.threshold_config(points, review), "threshold_config"))
    if n_boot:
        sections.append(_row(_by_transform(front, lambda f, t: trend.trend_gap_bootstrap(f, t, n_boot=n_boot)), "trend_gap_interval"))
    return _beside(rows.select("benchmark_id").distinct(), sections)


def documents(analysed: DataFrame) -> DataFrame:
    """One JSON text per benchmark; nulls are left out, so no NaN or empty section appears."""
    return analysed.select("benchmark_id", F.to_json(F.struct(*analysed.columns)).alias("document"))


def view(analysed: DataFrame, framed: DataFrame, section: str) -> DataFrame:
    """A section as another framing has it; where that has none, null."""
    return analysed.select("benchmark_id").join(framed.select("benchmark_id", section), "benchmark_id", "left")


def framing(rows: DataFrame, laggard: Column, leader: Column) -> DataFrame:
    """Rows of either of two groups, the first as laggards (also where both hold)."""
    return rows.filter(laggard | leader).withColumn("is_laggard", laggard)


def framings(rows: DataFrame, frames: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Rows as several framings have them, each with its own laggards and leaders, for one run over all of them.

    A framing's benchmarks are named after it: ``framing/benchmark``.
    """
    sides = [F.when(F.coalesce(lag, F.lit(False)) | F.coalesce(lead, F.lit(False)), F.struct(F.lit(name).alias("name"), F.coalesce(lag, F.lit(False)).alias("lag"))) for name, (lag, lead) in frames.items()]
    framed = rows.withColumn("_frame", F.explode(F.filter(F.array(*sides), lambda x: x.isNotNull())))
    return framed.withColumns({"benchmark_id": F.concat_ws("/", "_frame.name", "benchmark_id"), "is_laggard": F.col("_frame.lag")}).drop("_frame")


def model_list(rows: DataFrame) -> DataFrame:
    """All scored and dated rows, not only those on a frontier, and which are.  One row each: a benchmark has any
    number of them, so they are a table beside the documents."""
    front = frontier(rows).select("benchmark_id", "is_laggard", "model", "date", "score").distinct().withColumn("on_frontier", F.lit(True))
    known = rows.filter("date is not null and score is not null")
    joined = known.join(front, ["benchmark_id", "is_laggard", "model", "date", "score"], "left")
    return joined.select("benchmark_id", "model", "date", "score", "score_std", "is_laggard", F.coalesce("on_frontier", F.lit(False)).alias("on_frontier"))


def publish(new: DataFrame, old: DataFrame | None, path: str) -> None:
    """Write documents, keeping old ones of benchmarks that the new run lacks."""
    every = new if old is None else match.preserve_missing(old, new, "benchmark_id")
    every.write.mode("overwrite").json(path)


def publish_each(rows: DataFrame, as_of: Column, path: str, *, old: DataFrame | None = None, at_once: int = 4, **options) -> tuple[DataFrame, DataFrame]:
    """Write each benchmark's document by a job of its own under ``path``, so that one that fails leaves the rest.

    Returns the documents, and a table of errors (``benchmark_id``, ``error``), which is written, too.  Where a
    benchmark failed, or the run lacks it, the document of ``old`` stays.  ``options`` go to ``analyse``.
    """
    spark = rows.sparkSession
    names = sorted((r[0] for r in rows.select("benchmark_id").distinct().collect()), key=lambda n: (n is None, n))

    def one(numbered: tuple[int, str | None]) -> str | None:
        i, name = numbered
        try:
            own = rows.filter(F.col("benchmark_id").eqNullSafe(F.lit(name)))
            documents(analyse(own, as_of, **options)).write.mode("overwrite").parquet(f"{path}/documents/{i}")
        except Exception as error:  # whatever it is, the other benchmarks are not to miss out
            log.warning("benchmark %s failed: %s", name, error)
            return str(error)[:2000]
        return None

    with ThreadPoolExecutor(at_once) as pool:
        errors = list(pool.map(one, enumerate(names)))
    failed = spark.createDataFrame([(n, e) for n, e in zip(names, errors, strict=True) if e], "benchmark_id string, error string")
    failed.write.mode("overwrite").parquet(f"{path}/errors")
    written = [f"{path}/documents/{i}" for i, e in enumerate(errors) if not e]
    schema = "benchmark_id string, document string"
    new = spark.read.schema(schema).parquet(*written) if written else spark.createDataFrame([], schema)
    every = new if old is None else match.preserve_missing(old.select("benchmark_id", "document"), new, "benchmark_id")
    return every, spark.read.schema("benchmark_id string, error string").parquet(f"{path}/errors")
