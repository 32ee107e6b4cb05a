"""Scalar expressions: ratios, ids, time text, names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Timestamp text formats of the certification tag and the harvest id.
STAMP_WITH_ZONE = "yyyy-MM-dd HH:mm:ss xxx"
STAMP_COMPACT = "yyyy_MM_dd_HH_mm_ss"


def ratio(part: Column, total: Column, digits: int, scale: float = 1.0) -> Column:
    """round(scale * part / total, digits); NULL when total is 0 (ANSI division would fail)."""
    return F.round(F.lit(float(scale)) * part.cast("double") / F.nullif(total, F.lit(0)).cast("double"), digits)


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First value that is neither NULL nor the empty string."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def key_id(*parts: Column) -> Column:
    """md5 of the parts joined by ':'; reruns give the same id."""
    return F.md5(F.concat_ws(":", *parts))


def stamp(ts: Column, fmt: str = STAMP_WITH_ZONE) -> Column:
    return F.date_format(ts, fmt)


def name_part(qualified: Column, position: int) -> Column:
    return F.split_part(qualified, F.lit("."), F.lit(position))


def dotted(*parts: Column) -> Column:
    """a.b.c, leaving out NULL parts."""
    return F.concat_ws(".", *parts)


def rank_of(col: Column, names: Sequence[str], other: int = 99) -> Column:
    """1, 2, 3... in the order of ``names``; ``other`` for anything else."""
    out = F.lit(other)
    for i, name in reversed(list(enumerate(names, start=1))):
        out = F.when(col == name, F.lit(i)).otherwise(out)
    return out


def mapped(col: Column, table: Mapping[str, str]) -> Column:
    """Look a value up in a small constant table; NULL when absent."""
    out = F.lit(None).cast("string")
    for key, value in table.items():
        out = F.when(col == key, F.lit(value)).otherwise(out)
    return out


def variant_field(json_text: Column, *names: str) -> Column:
    """The first of several spellings of a field of a JSON text, as string."""
    doc = F.try_parse_json(json_text)
    return F.coalesce(*[F.try_variant_get(doc, f"$.{n}", "string") for n in names])
