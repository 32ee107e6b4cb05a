"""Comparing two large relations by digests of their parts, and by rows only where the digests differ.

A digest is the number of rows and six sums over hashes of the rows (120 bits), so it does
not depend on their order and counts duplicates. Equal parts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.operators import relational as R
from custodia.session import cut

PARTS = 4096

# Each of the six sums adds numbers of 20 bits: a bigint holds more than 8 * 10^12 of them.
_BITS = 20
_SUMS = [f"digest_{k}" for k in range(6)]


def row_hash(columns: Sequence[str], seed: int) -> Column:
    """A hash of a row's values. Spark passes over NULLs when it hashes, so which columns are NULL is hashed as well."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`").isNull() for c in columns], *[F.col(f"`{c}`") for c in columns])


def part_of(columns: Sequence[str], parts: int) -> Column:
    return F.pmod(row_hash(columns, 0), F.lit(parts)).cast("int")


def _measures(columns: Sequence[str]) -> list[Column]:
    pieces = [F.shiftrightunsigned(row_hash(columns, seed), k * _BITS).bitwiseAND(2**_BITS - 1) for seed in (1, 2) for k in range(3)]
    return [F.count(F.lit(1)).alias("row_count"), *[F.coalesce(F.sum(p), F.lit(0)).alias(n) for p, n in zip(pieces, _SUMS, strict=True)]]


def part_digests(df: DataFrame, columns: Sequence[str] | None = None, parts: int = PARTS) -> DataFrame:
    """One row per part that has rows: (part, row_count, digest_0 .. digest_5). Map columns cannot be hashed."""
    columns = list(columns or df.columns)
    return df.groupBy(part_of(columns, parts).alias("part")).agg(*_measures(columns))


def table_digests(frames: Mapping[str, DataFrame]) -> DataFrame:
    """One row per named relation, empty ones included; columns count in the order of their names."""
    return R.union_all(
        [df.agg(*_measures(sorted(df.columns))).select(F.lit(name).alias("object_name"), "row_count", *_SUMS) for name, df in frames.items()]
    )


def reconcile(expected: Mapping[str, DataFrame], loaded: Mapping[str, DataFrame]) -> DataFrame:
    """Relations whose loaded content is not the expected one: also where the row counts agree.

    A relation on one side only is listed with a NULL count on the other. Each relation is read
    once and becomes one row.
    """
    e, a = table_digests(expected), table_digests(loaded)
    same = F.col("e.row_count").eqNullSafe(F.col("a.row_count"))
    for n in _SUMS:
        same = same & F.col(f"e.{n}").eqNullSafe(F.col(f"a.{n}"))
    met = e.alias("e").join(a.alias("a"), F.col("e.object_name") == F.col("a.object_name"), "full").filter(~same)
    return met.select(
        F.coalesce("e.object_name", "a.object_name").alias("object_name"),
        F.col("e.row_count").alias("expected_rows"), F.col("a.row_count").alias("loaded_rows"),
    )


def differing_parts(left: DataFrame, right: DataFrame, columns: Sequence[str], parts: int = PARTS) -> DataFrame:
    """The parts whose rows are not the same multiset on both sides: at most ``parts`` numbers."""
    sides = R.union_all([part_digests(df, columns, parts).withColumn("side", F.lit(k)) for k, df in ((1, left), (-1, right))])
    balance = [F.sum(F.col("side") * F.col(n)).alias(n) for n in ("row_count", *_SUMS)]
    off = F.lit(False)
    for n in ("row_count", *_SUMS):
        off = off | (F.col(n) != 0)
    return sides.groupBy("part").agg(*balance).filter(off).select("part")


def difference(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None, parts: int = PARTS) -> DataFrame:
    """Rows that do not occur equally often on both sides, with their counts (0 where a side lacks them).

    NULLs equal each other and duplicates count. The right side's columns are cast to the left's
    types. The first pass moves one row per part and task; the second reads the rows of differing
    parts only, counts them per row before they move, and stacks both sides instead of joining them.
    The parts are chosen by a list of at most ``parts`` numbers, which Spark broadcasts by its size.
    """
    columns = list(columns or left.columns)
    left = left.select(*[F.col(f"`{c}`") for c in columns])
    right = right.select(*[F.col(f"`{c}`").cast(left.schema[c].dataType).alias(c) for c in columns])
    off = cut(differing_parts(left, right, columns, parts))
    sides = [
        df.withColumn("__part", part_of(columns, parts))
        .join(off.withColumnRenamed("part", "__part"), "__part", "left_semi")
        .select(*columns, F.lit(l).cast("bigint").alias("left_rows"), F.lit(r).cast("bigint").alias("right_rows"))
        for df, l, r in ((left, 1, 0), (right, 0, 1))
    ]
    counts = sides[0].unionByName(sides[1]).groupBy(*columns)
    return counts.agg(F.sum("left_rows").alias("left_rows"), F.sum("right_rows").alias("right_rows")).filter("left_rows <> right_rows")
