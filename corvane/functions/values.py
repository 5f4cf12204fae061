"""Lenient conversions at the edge: a bad value becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\d{4}-\d{2}-\d{2}"


def present(value: Column) -> Column:
    """Null for an empty string; blanks are a value."""
    return F.nullif(value, F.lit(""))


def first_present(payload: Column, paths: list[str]) -> Column:
    """The first scalar at one of the JSON paths that isn't empty."""
    found = [present(F.get_json_object(payload, p)) for p in paths]
    return F.coalesce(*[F.when(~F.startswith(F.ltrim(v), F.lit("{")) & ~F.startswith(F.ltrim(v), F.lit("[")), v) for v in found])


def to_date(value: Column) -> Column:
    return F.when(F.rlike(value, F.lit(_ISO)), F.substring(value, 1, 10).try_cast("date"))


def to_timestamp(value: Column) -> Column:
    """ISO text; a bare date is midnight UTC."""
    return F.when(F.rlike(value, F.lit(_ISO)), value.try_cast("timestamp"))


def to_time(value: Column) -> Column:
    """The leading H:MM or H:MM:SS, as text."""
    return present(F.regexp_extract(value, r"^\s*(\d{1,2}:\d{2}(?::\d{2})?)", 1))


def to_int(value: Column) -> Column:
    """Truncated towards zero; infinities and non-numbers are null."""
    return value.try_cast("double").try_cast("int")


def total_injuries(total: Column, serious: Column, minor: Column) -> Column:
    """The given total, else serious and minor ones; a sum of zero is unknown."""
    return F.coalesce(total, F.nullif(F.coalesce(serious, F.lit(0)) + F.coalesce(minor, F.lit(0)), F.lit(0)))


def years_before(day: Column, years: int) -> Column:
    """The same day years earlier; 29 February becomes the 28th."""
    return F.add_months(day, -12 * years)


def kept_keys(document: Column, allowed: list[str]) -> Column:
    """The allowed top-level keys of a JSON object as a map of their values; empty for anything else."""
    parsed = F.coalesce(F.from_json(document, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    return F.map_filter(parsed, lambda k, _: k.isin(allowed))
