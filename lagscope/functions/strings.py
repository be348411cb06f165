"""String functions on names and ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The suffixes that names lose, and the entities that HTML text gets.
DATED_SUFFIX, ANY_SUFFIX = r"\s*\([^)]*\d{4}\)\s*$", r"\s*\([^)]*\)\s*$"
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def strip_dated_suffix(name: Column) -> Column:
    """Drop a last parenthesis that ends with a year."""
    return F.trim(F.regexp_replace(name, DATED_SUFFIX, ""))


def short_name(name: Column) -> Column:
    """Drop a last parenthesis."""
    return F.trim(F.regexp_replace(name, ANY_SUFFIX, ""))


def normalize_id(x: Column, *, suffix: str = "_inspect", dated: Sequence[str] = (), same: Sequence[tuple[str, str]] = ()) -> Column:
    """Drop the suffix, cut dates after the stems in ``dated``, and replace whole ids by their equivalents."""
    out = F.regexp_replace(F.trim(x), f"{suffix}$", "")
    for stem in dated:
        out = F.regexp_replace(out, rf"{stem}_\d{{4}}_\d{{2}}_\d{{2}}", stem)
    value = out
    for old, new in reversed(list(same)):
        value = F.when(out == old, F.lit(new)).otherwise(value)
    return value


def title_case(x: Column) -> Column:
    """Upper case for each letter that no letter precedes, lower case for the others."""
    letters = F.split(F.lower(x), "")
    return F.array_join(F.transform(letters, lambda c, i: F.when((i == 0) | ~F.coalesce(F.get(letters, i - 1), F.lit("")).rlike("[a-z]"), F.upper(c)).otherwise(c)), "")


def display_name(x: Column, replacements: Sequence[tuple[str, str]] = (), suffix: str = "_inspect") -> Column:
    """A readable name: no suffix, words in title case, then replacements in order."""
    out = title_case(F.translate(F.regexp_replace(x, f"{suffix}$", ""), "_-", "  "))
    for old, new in replacements:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(out)


def by_prefix(x: Column, prefixes: Sequence[tuple[str, str]], default: str = "Unknown") -> Column:
    """The value of the first prefix of the lower-cased id, dashes read as underscores."""
    low = F.translate(F.lower(x), "-", "_")
    out = F.lit(default)
    for prefix, value in reversed(list(prefixes)):
        out = F.when(low.startswith(prefix), F.lit(value)).otherwise(out)
    return out


def escape_html(x: Column) -> Column:
    for old, new in ENTITIES:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x
