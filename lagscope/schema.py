"""The canonical frame that adapters produce and operators take.

``benchmark_id``, ``model``, ``date`` (DATE), ``score`` and ``score_std`` (DOUBLE, null rather
than NaN) and ``is_laggard`` (true for the group that trails, null if unclassified).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the analysis.
DAYS_PER_MONTH = 30.4375
MATCH_TOLERANCE = 1.0
Z_ONE_SIDED_05 = 1.6448536269514722
CI_TO_STD = 2 * 1.645
CAUGHT_UP_PROBABILITY = 0.05

CANONICAL = {"benchmark_id": "string", "model": None, "date": "date", "score": "double", "score_std": "double", "is_laggard": "boolean"}


def to_canonical(df: DataFrame, columns: Mapping[str, Column | str]) -> DataFrame:
    """Project ``df`` to the canonical frame; what ``columns`` leaves out is null, and NaN becomes null."""
    out = []
    for name, kind in CANONICAL.items():
        given = columns.get(name)
        value = F.lit(None).cast(kind or "string") if given is None else (F.col(given) if isinstance(given, str) else given)
        if kind:
            value = value.cast(kind)
        if kind == "double":
            value = F.when(~F.isnan(value), value)
        out.append(value.alias(name))
    return df.select(*out)


def months(days: Column) -> Column:
    return days / F.lit(DAYS_PER_MONTH)
