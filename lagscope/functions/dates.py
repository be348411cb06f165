"""Date functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(x: Column, formats: Sequence[str] = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "yyyy-MM", "yyyy")) -> Column:
    """The date by the first format that fits, else null."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(x, F.lit(f))) for f in formats))


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days between two timestamps, rounded down."""
    return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000)).cast("bigint")


def add_fractional_months(date: Column, n: Column) -> Column:
    """Whole months, then the rest in days of a mean month, rounded down."""
    whole = F.floor(n).cast("int")
    return F.date_add(F.add_months(date, whole), F.floor((n - whole) * 30.4375).cast("int"))


def fractional_days(later: Column, earlier: Column) -> Column:
    """Days between two timestamps, with the part of a day."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000)


def quarter_ticks(first: Column, last: Column) -> Column:
    """The first days of all quarters from that of ``first`` up to ``last``."""
    return F.sequence(F.trunc(first, "quarter"), last, F.expr("interval 3 months"))


def month_label(date: Column) -> Column:
    return F.date_format(date, "MMM yyyy")


def quarter_label(date: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(date), F.lit(" "), F.year(date))
