"""Group classification of rows, and flags by region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.strings import normalize_id


def classify_label(label: Column, open_mark: str = "Open", closed: Sequence[str] = ("API access", "Hosted access (no API)")) -> Column:
    """True if the label contains ``open_mark``, false if it is one of ``closed``, else null."""
    text = F.trim(label)
    return F.when(text.contains(open_mark), F.lit(True)).when(text.isin(list(closed)), F.lit(False))


def contains_mark(label: Column, open_mark: str = "Open", missing: bool | None = False) -> Column:
    """The older two-valued rule: whether the label contains ``open_mark``; ``missing`` for null."""
    found = label.contains(open_mark)
    return found if missing is None else F.coalesce(found, F.lit(missing))


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    """Whether the lower-cased text contains any of the needles; false for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for x in needles:
        found = found | low.contains(x)
    return found


def classify_chain(own: Column, index: Column, override: Column, name: Column, organization: Column, *, open_names: Sequence[str], closed_orgs: Sequence[str], open_orgs: Sequence[str], **labels) -> Column:
    """The first that decides: own label, index, override, open name patterns, closed organisations, open ones."""
    by_label = [classify_label(x, **labels) for x in (own, index, override)]
    by_name = F.when(contains_any(name, open_names), F.lit(True)).when(contains_any(organization, closed_orgs), F.lit(False)).when(contains_any(organization, open_orgs), F.lit(True))
    return F.coalesce(*by_label, by_name)


def region_flags(country: Column, regions: dict[str, Sequence[str]]) -> list[Column]:
    """A flag for each region: whether the country is exactly one of its names; false for null."""
    return [F.coalesce(country.isin(list(names)), F.lit(False)).alias(name) for name, names in regions.items()]


def open_by_id(x: Column, patterns: Sequence[str], **normal) -> Column:
    """Whether the normalised id matches any of the patterns; false for null."""
    return F.coalesce(F.lower(normalize_id(x, **normal)).rlike("|".join(patterns)), F.lit(False))


def classify_accessible(access: Column, organizations: Column, open_access: Sequence[str], open_orgs: Sequence[str]) -> Column:
    """By an exact label if there is one, else by whether an organisation's name contains an open one."""
    fallback = F.coalesce(F.exists(organizations, lambda o: contains_any(o, open_orgs)), F.lit(False))
    return F.when(access.isNotNull(), access.isin(list(open_access))).otherwise(fallback)


def differs_two_sided(a: Column, a_std: Column, b: Column, b_std: Column, *, z: float = 1.959963984540054, missing_differs: bool = True) -> Column:
    """Whether two scores differ significantly; without deviations, whether they differ at all, or never."""
    plain = (a != b) if missing_differs else F.lit(False)
    se = F.sqrt(a_std * a_std + b_std * b_std)
    return F.when(a_std.isNull() | b_std.isNull() | (se == 0), plain).otherwise(F.abs(a - b) > z * se)
