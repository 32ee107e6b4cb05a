"""Boolean column expressions used by the checks, filters and controls."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def not_in_domain(col: Column, values: Iterable[str]) -> Column:
    """True for NULL as well as for values outside the domain."""
    return col.isNull() | ~col.isin(*values)


def is_filled(col: Column) -> Column:
    """Not NULL and not blank; never NULL itself."""
    return F.coalesce(F.trim(col) != F.lit(""), F.lit(False))


def outside(left: Column, right: Column, tolerance: float | str) -> Column:
    """abs(left - right) > tolerance, with the tolerance kept decimal."""
    return F.abs(left - right) > F.lit(str(tolerance)).cast("decimal(38,2)")


def mentions(col: Column, text: str) -> Column:
    """Case-insensitive LIKE '%text%'."""
    return col.ilike(f"%{text}%")


def nested_mentions(col: Column, text: str) -> Column:
    """The same test on the JSON text of a nested column."""
    return F.to_json(col).ilike(f"%{text}%")


def whole(pattern: str) -> str:
    """Anchor a pattern: Spark's ``rlike`` looks for a substring."""
    return f"^(?:{pattern})$"


def format_ok(col: Column, by: Column, patterns: Mapping[str, str]) -> Column:
    """True where ``col`` matches the pattern that ``by`` selects, whole string."""
    ok = F.lit(False)
    for value, pattern in patterns.items():
        ok = F.when(by == F.lit(value), col.rlike(whole(pattern))).otherwise(ok)
    return F.coalesce(ok, F.lit(False))


def within_hours(ts: Column, end: datetime | Column, hours: int) -> Column:
    """ts >= end - hours (no upper bound, as for an evidence window)."""
    end = end if isinstance(end, Column) else F.lit(end)
    return ts >= end - F.make_interval(hours=F.lit(hours))


def between_hours(ts: Column, end: datetime | Column, hours: int) -> Column:
    """end - hours <= ts <= end."""
    end = end if isinstance(end, Column) else F.lit(end)
    return within_hours(ts, end, hours) & (ts <= end)


def label(condition: Column, yes: str, no: str) -> Column:
    return F.when(condition, F.lit(yes)).otherwise(F.lit(no))
