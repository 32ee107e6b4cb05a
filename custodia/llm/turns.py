"""Turns of conversations in order: positions, and running totals along a conversation, without one task per conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What parts words: everything but ASCII white space is a word.
WORD = r"[^\x20\x09-\x0D]+"
#: log2 of the turns of a conversation that are numbered by one window, and the place of turns without a number: before all others.
SPAN, FIRST = 12, -(1 << 62)


def before(frame: DataFrame, key: str, at: Column, totals: dict[str, Column], none: Column, backwards: bool = False) -> DataFrame:
    """frame with, per row, totals over the rows of the same key that lie before it (after it, if backwards).

    totals: new column name to an aggregate, which must combine by itself: `bit_xor` or `sum` of one column. `at` is the place of a row, one
    row a place. Rows are dealt by (key, 4,096 places), so a key with a third of all rows is spread over tasks; only one row for each such
    span meets the others of its key.
    """
    frame = frame.withColumns({"__at": at, "__span": F.shiftright(at, SPAN)})
    way = (lambda c: F.col(c).desc()) if backwards else F.col
    inside = Window.partitionBy(key, "__span").orderBy(way("__at")).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(key).orderBy(way("__span")).rowsBetween(Window.unboundedPreceding, -1)
    names = list(totals)
    spans = frame.groupBy(key, "__span").agg(*[totals[n].alias(f"__{n}") for n in names])
    combine = {n: (F.bit_xor if "bit_xor" in str(totals[n]) else F.sum)(f"__{n}").over(along) for n in names}
    spans = spans.select(key, "__span", *[combine[n].alias(f"__{n}_ahead") for n in names])
    out = frame.withColumns({f"__{n}_here": totals[n].over(inside) for n in names}).join(spans, [key, "__span"])

    def both(n: str) -> Column:
        here, ahead = F.coalesce(f"__{n}_here", none), F.coalesce(f"__{n}_ahead", none)
        return here.bitwiseXOR(ahead) if "bit_xor" in str(totals[n]) else here + ahead

    return out.withColumns({n: both(n) for n in names}).drop("__at", "__span", *[f"__{n}_{x}" for n in names for x in ("here", "ahead")])


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text) of columns conv_id, turn, role, text: position from 1 by turn, null turns first, ties by role and text.

    Rows are numbered inside spans of 4,096 turn numbers and the spans are counted, so a conversation with very many turns is spread over
    tasks (one whose turns are all null, or all the same, is not: its sort spills to disk). Null roles and texts are empty. Rows with a null
    conv_id belong to no conversation and go.
    """
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.shiftright(F.col("turn").cast("long"), SPAN), F.lit(FIRST)).alias("span"),
    )
    sizes = rows.groupBy("conv_id", "span").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "span", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("ahead"))
    here = Window.partitionBy("conv_id", "span").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = rows.withColumn("place", F.row_number().over(here)).join(sizes, ["conv_id", "span"])
    return numbered.select("conv_id", (F.col("place") + F.col("ahead")).cast("long").alias("pos"), "role", "text")
