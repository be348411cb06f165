"""File sources: CSV, CSV members of ZIP archives and nested documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from .blocks import json_documents, read_documents


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with all columns as strings; quoted cells may span lines."""
    return spark.read.options(header=True, inferSchema=False, multiLine=True, quote='"', escape='"').csv(path)


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(header=True, inferSchema=True, multiLine=True, quote='"', escape='"').csv(path)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import csv
    import io
    import zipfile

    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for member in archive.namelist():
                    if not member.endswith(".csv"):
                        continue
                    with archive.open(member) as raw:
                        rows = []
                        for i, row in enumerate(csv.DictReader(io.TextIOWrapper(raw, "utf-8", newline=""))):
                            rows.append((path, member, i, [(k, v) for k, v in row.items() if k is not None and isinstance(v, str)]))
                            if len(rows) == 1000:
                                yield _member_batch(rows)
                                rows = []
                        if rows:
                            yield _member_batch(rows)


def _member_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["archive", "member", "row", "cells"])


def read_zip_csv(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """Rows of the CSV members of ZIP archives: archive, member, row number and a map of cells.

    Archives are spread over tasks; ``member`` keeps one file of each, and one that is missing gives no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(_members, "archive string, member string, row bigint, cells map<string,string>")
    return rows if member is None else rows.filter(F.col("member").endswith(member))


def cell(name: str) -> Column:
    """A cell of ``read_zip_csv``; blank is null."""
    return F.when(F.trim(F.col("cells")[name]) != "", F.col("cells")[name])


def metric(entry: Column, path: str) -> tuple[Column, Column, Column]:
    """Estimate, low and high of a nested metric that is a number or a struct of them."""
    get = lambda p: F.get_json_object(entry, p).try_cast("double")
    return F.coalesce(get(f"$.{path}.estimate"), get(f"$.{path}")), get(f"$.{path}.ci_low"), get(f"$.{path}.ci_high")


def nested_results(documents: DataFrame) -> DataFrame:
    """Entries of documents (``file``, ``json``) ``{"results": {id: {release_date, metrics: {...}}}}``, one row each."""
    entries = documents.select("file", F.explode(F.from_json(F.get_json_object("json", "$.results"), "map<string,string>")).alias("id", "entry"))
    score, low, high = metric(F.col("entry"), "metrics.p50_horizon_length")
    return entries.select(
        "file", "id", parse_date(F.get_json_object("entry", "$.release_date")).alias("date"), score.alias("score"), low.alias("low"), high.alias("high"),
        metric(F.col("entry"), "metrics.average_score")[0].alias("average_score"), F.coalesce(F.get_json_object("entry", "$.metrics.is_sota").try_cast("boolean"), F.lit(False)).alias("is_sota"), "entry",
    )


def read_nested_results(spark: SparkSession, path: str) -> DataFrame:
    """``nested_results`` of whole files, JSON or block YAML; a file that can't be read gives no rows."""
    return nested_results(json_documents(read_documents(spark, path))).drop("file", "entry")


#: The figures of a document beside its entries: name, and the JSON paths that may hold it, first come first.
FIGURES = {
    "doubling_days": ("doubling_time_in_days.all_time.point_estimate", "doubling_time_in_days.all_time_stitched.point_estimate"),
    "doubling_low": ("doubling_time_in_days.all_time.ci_low", "doubling_time_in_days.all_time_stitched.ci_low"),
    "doubling_high": ("doubling_time_in_days.all_time.ci_high", "doubling_time_in_days.all_time_stitched.ci_high"),
    "recent_doubling_days": ("doubling_time_in_days.from_2023_on.point_estimate", "doubling_time_in_days.from_2023.point_estimate"),
}


def merged_versions(documents: DataFrame, key: Column) -> DataFrame:
    """Of versioned documents (``version``, ``file``, ``json``) each entry as the latest version has it.

    ``key`` names an entry across versions, from its ``id``.  Beside the typed columns, ``entry`` keeps all of the
    entry as a variant, and ``in_versions`` lists the versions that have it.
    """
    rows = nested_results(documents.select(F.struct("version", "file").alias("file"), "json")).withColumns({"version": F.col("file.version"), "key": key})
    latest = F.max_by(F.struct("id", "date", "score", "low", "high", "average_score", "is_sota", "entry"), F.struct("version", F.col("file.file"), "id"))
    out = rows.groupBy("key").agg(latest.alias("r"), F.max("version").alias("version"), F.array_sort(F.collect_set("version")).alias("in_versions"))
    return out.select("key", "version", "in_versions", "r.*").withColumn("entry", F.try_parse_json("entry"))


def document_metadata(documents: DataFrame) -> DataFrame:
    """One row: the figures of the latest version's document (``version``, ``json``), typed, all that stands beside its
    entries as a variant ``rest``, and the versions there are.  A figure that is missing or no number is null."""
    top = documents.filter("json is not null").agg(F.max_by("json", "version").alias("json"), F.max("version").alias("version"), F.array_sort(F.collect_set("version")).alias("versions"))
    whole = F.from_json("json", "map<string,string>")
    rest = F.map_filter(whole, lambda k, v: k != "results")
    joined = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(rest), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), F.when(F.try_parse_json(e["value"]).isNotNull(), e["value"]).otherwise(F.to_json(F.array(e["value"])).substr(F.lit(2), F.length(F.to_json(F.array(e["value"]))) - 2)))), ","), F.lit("}"))
    figures = [F.coalesce(*(F.get_json_object("json", f"$.{p}").try_cast("double") for p in paths)).alias(name) for name, paths in FIGURES.items()]
    return top.select("version", "versions", *figures, F.try_parse_json(joined).alias("rest"))
