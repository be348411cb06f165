"""Cleaning and merging of source tables on the way to the canonical frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import strip_dated_suffix
from ..schema import CI_TO_STD


def number(x: Column) -> Column:
    """A number, or null where the text is none."""
    return x.try_cast("double")


def day(x: Column) -> Column:
    return x.try_cast("date")


def std_from_interval(low: Column, high: Column) -> Column:
    """The deviation behind a 90 % interval."""
    return (high - low) / F.lit(CI_TO_STD)


def scaled(value: Column, scale: float) -> Column:
    """A share on the scale of its benchmark: values up to 1 are multiplied unless the scale is 1."""
    return value if scale == 1 else F.when(value <= 1, value * scale).otherwise(value)


def default_strings(df: DataFrame, columns: list[str], value: str = "Unknown") -> DataFrame:
    return df.fillna(value, subset=columns)


def with_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Each column's own default where it is null or blank."""
    return df.withColumns({c: F.when(F.trim(F.col(c)) != "", F.col(c)).otherwise(F.lit(x)) for c, x in defaults.items()})


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns by the field names that readers of a result expect; names that ``df`` lacks are left out."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def lookup(df: DataFrame, index: DataFrame, key: str, index_key: str, value: str, order: list[Column]) -> DataFrame:
    """Adds ``value`` from the first row of an index with the same trimmed key: null where that row has none, whatever
    later rows have."""
    first = index.select(F.trim(index_key).alias("_key"), *(c.alias(f"_o{i}") for i, c in enumerate(order)), value)
    first = first.groupBy("_key").agg(F.min_by(value, F.struct(*(f"_o{i}" for i in range(len(order))))).alias(value))
    return df.join(first, F.trim(key) == F.col("_key"), "left").drop("_key")


def rename_if_absent(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new) if old in df.columns and new not in df.columns else df


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    lacking = sorted(set(needed) - set(df.columns))
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def first_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in a given order."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def backfill_two_keys(df: DataFrame, reference: DataFrame, key: str, columns: dict[str, str], order: list[Column], *, blank_as_null: bool = False) -> DataFrame:
    """Fill nulls of ``df`` from the reference row of the same key, else of the key without its dated suffix.

    ``columns``: column of ``df`` to column of the reference; those that ``df`` lacks are added.
    """
    reference = reference.withColumn("_k", F.trim(key)).withColumn("_s", strip_dated_suffix(F.col("_k")))
    side = lambda k, p: first_per_key(reference, k, order).select(F.col(k).alias(f"{p}{k}"), *(F.col(c).alias(f"{p}{c}") for c in columns.values()))
    exact, stripped = side("_k", "e"), side("_s", "s")
    out = df.withColumn(key, F.trim(key))
    out = out.join(exact, F.col(key) == F.col("e_k"), "left").join(stripped, strip_dated_suffix(F.col(key)) == F.col("s_s"), "left")
    for own, ref in columns.items():
        value = F.col(own) if own in df.columns else F.lit(None)
        if blank_as_null and own in df.columns:
            value = F.when(F.trim(own) != "", F.col(own))
        out = out.withColumn(own, F.coalesce(value, f"e{ref}", f"s{ref}"))
    return out.drop("e_k", "s_s", *(f"{p}{c}" for p in "es" for c in columns.values()))


def override_blank(df: DataFrame, overrides: DataFrame, key: str, column: str) -> DataFrame:
    """Replace blank or null values for which an override (key, value) exists."""
    o = overrides.select(F.col("key").alias("_o"), F.col("value").alias("_v"))
    blank = F.coalesce(F.trim(column), F.lit("")) == ""
    return df.join(o, F.col(key) == F.col("_o"), "left").withColumn(column, F.when(blank & F.col("_v").isNotNull(), F.col("_v")).otherwise(F.col(column))).drop("_o", "_v")


def precedence_merge(tables: list[DataFrame], key: str) -> DataFrame:
    """One row per key, from the last table that has it; the column ``version`` counts tables from 0."""
    every = None
    for i, t in enumerate(tables):
        t = t.withColumn("version", F.lit(i))
        every = t if every is None else every.unionByName(t, allowMissingColumns=True)
    latest = Window.partitionBy(key).orderBy(F.col("version").desc())
    return every.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """All keys of two tables, with whether they are "only_a", "only_b" or in "both"."""
    both = a.select(key).distinct().withColumn("a", F.lit(True)).join(b.select(key).distinct().withColumn("b", F.lit(True)), key, "full")
    return both.select(key, F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").otherwise("both").alias("side"))
