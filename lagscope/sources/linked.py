"""Linked tables of an evaluation database as a Spark data source, and what their links say.

An export has a folder of Parquet files for each of ``tasks``, ``runs``, ``scores``, ``models`` and ``groups``.  Links
are lists of record ids, as databases with linked fields export them; the source takes a link's first id.

    spark.dataSource.register(LinkedTables)
    spark.read.format("linked_tables").option("table", "runs").load(folder)

Each file is a partition.  Filters that compare a column with constants are pushed into the reader, which skips row
groups and rows by them (``spark.sql.python.filterPushdown.enabled`` has to be on).
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

#: Columns of the tables; those whose names end in ``_id`` but for the first are links.
TABLES = {
    "tasks": "task_id string, path string, name string",
    "runs": "run_id string, task_id string, model_id string, status string",
    "scores": "score_id string, run_id string, scorer string, mean double, stderr double",
    "models": "model_id string, release_date date, group_id string",
    "groups": "group_id string, accessibility string, organizations array<string>",
}
_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


@dataclass
class _File(InputPartition):
    path: str


def _names(table: str) -> list[str]:
    return [c.split()[0] for c in TABLES[table].split(", ")]


def _links(table: str) -> list[str]:
    return [c for c in _names(table)[1:] if c.endswith("_id")]


class LinkedReader(DataSourceReader):
    def __init__(self, table: str, path: str) -> None:
        self.table, self.path, self.pushed = table, path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of plain columns with constants; links and what is left are Spark's to filter."""
        for f in filters:
            simple = len(f.attribute) == 1 and f.attribute[0] not in _links(self.table) and f.attribute[0] != "organizations"
            if simple and isinstance(f, (*_COMPARE, In, IsNotNull, IsNull)):
                self.pushed.append(f)
            else:
                yield f

    def expression(self):
        import pyarrow.compute as pc

        def one(f: Filter):
            field = pc.field(f.attribute[0])
            if isinstance(f, In):
                return field.isin(list(f.value))
            if isinstance(f, IsNotNull):
                return field.is_valid()
            if isinstance(f, IsNull):
                return field.is_null()
            return _COMPARE[type(f)](field, pa.scalar(f.value))

        return reduce(operator.and_, map(one, self.pushed)) if self.pushed else None

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = system.get_file_info(fs.FileSelector(f"{root.rstrip('/')}/{self.table}", recursive=True))
        scheme = f"{self.path.split('://')[0]}://" if "://" in self.path else ""
        return [_File(scheme + f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(".parquet")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(partition.path) if "://" in partition.path else (fs.LocalFileSystem(), partition.path)
        names, links = _names(self.table), _links(self.table)
        for batch in ds.dataset(path, filesystem=system, format="parquet").to_batches(columns=names, filter=self.expression()):
            columns = [_first(batch.column(c)) if c in links else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _first(links: pa.Array) -> pa.Array:
    """The first id of each list; null of an empty one."""
    if not pa.types.is_list(links.type):
        return links
    return pa.array([x[0] if x else None for x in links.to_pylist()], pa.string())


class LinkedTables(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "linked_tables"

    def schema(self) -> str:
        return TABLES[self.options["table"]]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return LinkedReader(self.options["table"], self.options["path"])


def read_linked(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The five tables of an export, by name."""
    spark.dataSource.register(LinkedTables)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return {t: spark.read.format("linked_tables").option("table", t).load(path) for t in TABLES}


def task_paths(tasks: DataFrame) -> DataFrame:
    """All paths there are, in order, each with its ``position`` from 1."""
    return positions(tasks.filter("path is not null").select("path").distinct(), "path")


def positions(rows: DataFrame, order: str) -> DataFrame:
    """Adds ``position`` (from 1) by an ``order`` of strings, without one task that sorts all rows.

    Rows are cut at quantiles of their first bytes, as a sketch has them, sorted in their cut, and moved on by the rows
    of the cuts before.  The cuts decide how evenly tasks share the rows, and not the positions.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.substring(F.rpad(F.hex(F.encode(F.col(order), "UTF-8")), 14, "0"), 1, 14)
    coded = rows.withColumn("_c", F.conv(first, 16, 10).cast("bigint"))
    cuts = coded.agg(F.percentile_approx("_c", [i / width for i in range(1, width)] or [0.5], 10_000)).first()[0] or []
    dealt = coded.withColumn("_part", reduce(operator.add, (F.when(F.col("_c") > c, 1).otherwise(0) for c in cuts), F.lit(0))).drop("_c")
    totals = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = totals.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = dealt.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    return inside.join(F.broadcast(before), "_part").withColumn("position", F.col("_before") + F.col("_i")).drop("_part", "_before", "_i")  # a row for each cut


def available_tasks(tasks: DataFrame, runs: DataFrame, configured: DataFrame) -> DataFrame:
    """Configured benchmarks (``benchmark_id``, ``path``) whose task exists, with the models that have run it."""
    found = configured.join(tasks.select("task_id", "path"), "path")
    counts = runs.filter("model_id is not null").groupBy("task_id").agg(F.countDistinct("model_id").alias("n_models"))
    return found.join(counts, "task_id", "left").select("benchmark_id", "path", F.coalesce("n_models", F.lit(0).cast("bigint")).alias("n_models"))


#: Relative standard error of the distinct sketch, and accuracy of the quantile sketch of a report.
DISTINCT_ERROR, QUANTILE_ACCURACY = 0.02, 1_000


def exploration(tasks: DataFrame, runs: DataFrame, scores: DataFrame, *, recommended: int = 20) -> DataFrame:
    """What an export holds, by task: runs, models and scores, and whether enough models have run it.

    ``n_models`` is exact; ``about_models`` is a mergeable sketch of the same with a relative standard error of
    ``DISTINCT_ERROR``, and ``low``, ``median`` and ``high`` are quantiles of the mean scores, each at most
    1/``QUANTILE_ACCURACY`` of the rows off.  The sketches of all tasks come from one pass over joined runs.  Models
    are counted in another: beside a distinct count, each model of a task would have sketches of its own.
    """
    per_run = scores.groupBy("run_id").agg(F.count("*").alias("n"), F.sum("mean").alias("total"), F.max("mean").alias("best"))
    both = runs.join(per_run, "run_id", "left")
    sketch = F.percentile_approx("best", [0.1, 0.5, 0.9], QUANTILE_ACCURACY)
    facts = both.groupBy("task_id").agg(
        F.count("*").alias("n_runs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_scores"), F.approx_count_distinct("model_id", DISTINCT_ERROR).alias("about_models"),
        sketch.alias("q"), F.count_if(F.col("n").isNull()).alias("n_unscored"),
    )
    models = runs.groupBy("task_id").agg(F.countDistinct("model_id").alias("n_models"))
    out = tasks.select("task_id", "path").join(facts, "task_id", "left").join(models, "task_id", "left")
    none = F.lit(0).cast("bigint")
    counts = [F.coalesce(c, none).alias(c) for c in ("n_runs", "n_scores", "n_models", "about_models", "n_unscored")]
    return out.select("task_id", "path", *counts, *(F.col("q")[i].alias(c) for i, c in enumerate(("low", "median", "high"))), (F.coalesce("n_models", none) >= recommended).alias("recommended"))


def accessibility_report(groups: DataFrame) -> DataFrame:
    """How many groups are open, closed or unknown by their label, and the labels of each kind."""
    label = F.lower("accessibility")
    kind: Column = F.when(label.contains("open"), "open").when(label.contains("closed") | label.contains("api"), "closed").otherwise("unknown")
    labels = groups.select(kind.alias("kind"), "accessibility").groupBy("kind", "accessibility").agg(F.count("*").alias("n"))
    return labels.groupBy("kind").agg(F.sum("n").alias("n_groups"), F.array_join(F.array_sort(F.collect_set("accessibility")), "|").alias("labels"))
