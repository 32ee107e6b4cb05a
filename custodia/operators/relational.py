"""Joins, aggregates and sorts that the governance operators share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.functions import scalars as S


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows whose key has no parent; a NULL key has none.

    Written as an anti join: the outer-join-and-filter form would keep the parent's rows.
    """
    parent_key = parent_key or key
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti").select(*child.columns)


def join_ignoring_case(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on upper-cased keys; the left side keeps its own spelling of them."""
    r = right.select(
        *[F.upper(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    on = [F.upper(left[k]) == r[f"__r_{k}"] for k in keys]
    return left.join(r, on, how).drop(*[f"__r_{k}" for k in keys])


def strip_prefix(col: Column, prefix: str) -> Column:
    return F.regexp_replace(col, f"^{prefix}", "")


def compare_keys(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are not exactly once on both sides.

    Both sides are counted per key first, so the full join meets one row per key.
    """
    e = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("source_rows"))
    m = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("mart_rows"))
    e = e.select(*[F.col(k).alias(f"source_{k}") for k in keys], "source_rows")
    m = m.select(*[F.col(k).alias(f"mart_{k}") for k in keys], "mart_rows")
    on = [e[f"source_{k}"] == m[f"mart_{k}"] for k in keys]
    wrong = (
        F.col("source_rows").isNull()
        | F.col("mart_rows").isNull()
        | (F.col("source_rows") != 1)
        | (F.col("mart_rows") != 1)
    )
    return e.join(m, on, "full").filter(wrong)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Concatenate by column name; duplicates stay."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def labelled_counts(frames: Mapping[str, DataFrame], label: str = "object_name") -> DataFrame:
    """One row per named relation with its row count."""
    return union_all(
        [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias(label), "row_count") for n, df in frames.items()]
    )


def count_by(df: DataFrame, *dims: str, count: str = "row_count", latest: str | None = None, latest_as: str = "latest") -> DataFrame:
    """Rows per combination of dimensions, optionally with the latest clock."""
    extra = [F.max(latest).alias(latest_as)] if latest else []
    return df.groupBy(*dims).agg(F.count(F.lit(1)).alias(count), *extra)


def with_total(df: DataFrame, dim: str, total: str = "TOTAL", count: str = "object_count") -> DataFrame:
    """Counts per value of one dimension and the grand total, in one pass."""
    return (
        df.rollup(dim)
        .agg(F.count(F.lit(1)).alias(count), F.grouping(dim).alias("is_total"))
        .select(F.when(F.col("is_total") == 1, F.lit(total)).otherwise(F.col(dim)).alias(dim), count)
    )


def pivot_values(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Key/value rows to one row per key with a column per listed name (largest value wins).

    One conditional maximum per name is a plain aggregate: it combines before the
    shuffle and needs a single one, where ``pivot`` would group twice.
    """
    return df.groupBy(*keys).agg(
        *[F.max(F.when(F.upper(name) == n.upper(), F.col(value))).alias(n.lower()) for n in names]
    )


def list_distinct(df: DataFrame, keys: Sequence[str], item: Column, alias: str, separator: str = ", ") -> DataFrame:
    """Distinct values of a group as one ordered text (empty for a group of NULLs).

    The text itself is the result, so a group's items do meet in one cell; duplicates
    are dropped before they are shuffled together.
    """
    items = df.select(*keys, item.alias("item")).distinct()
    return items.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("item")), separator).alias(alias))


def latest_by(df: DataFrame, group: Sequence[str], item: str, clock: str) -> DataFrame:
    """Per group the item with the newest clock (ties: the larger item).

    The maximum of (clock, item) combines before the shuffle, so a group with a very
    long history costs no more than any other; a window would sort it in one task.
    """
    newest = F.max(F.struct(F.col(clock).alias("c"), F.col(item).alias("i")))
    return (
        df.filter(F.col(item).isNotNull())
        .groupBy(*group)
        .agg(newest.alias("n"))
        .select(*group, F.col("n.i").alias(item), F.col("n.c").alias(f"latest_{clock}"))
    )


def latest_rows(df: DataFrame, group: Sequence[str], item: str, clock: str) -> DataFrame:
    """All rows that belong to the newest item of their group."""
    newest = latest_by(df, group, item, clock).select(*group, item)
    return df.join(newest, [*group, item], "left_semi")


def latest_run(df: DataFrame, item: str, clock: str) -> DataFrame:
    """The newest item over the whole relation, as one row."""
    return (
        df.filter(F.col(item).isNotNull())
        .groupBy(item)
        .agg(F.max(clock).alias("latest"))
        .orderBy(F.col("latest").desc(), F.col(item).desc())
        .limit(1)
        .select(item)
    )


def of_latest_run(df: DataFrame, item: str, clock: str) -> DataFrame:
    """Rows of the newest item; the id reaches the scan as a scalar subquery."""
    return df.filter(F.col(item) == latest_run(df, item, clock).scalar())


def order_by_rank(df: DataFrame, col: str, names: Sequence[str], *then: str) -> DataFrame:
    """Sort by a given order of names; unknown names come last."""
    return df.orderBy(S.rank_of(F.col(col), names), *then)


def newest(df: DataFrame, clock: str, k: int, *tie: str) -> DataFrame:
    """The k newest rows."""
    return df.orderBy(F.col(clock).desc(), *tie).limit(k)


def sample_filled(df: DataFrame, columns: Sequence[str], k: int, order: Sequence[str]) -> DataFrame:
    """First k rows in which at least one of the columns is filled; ordered, so reruns agree."""
    some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])
    return df.filter(some).orderBy(*order).limit(k)


def count_distinct_key(df: DataFrame, keys: Sequence[str], alias: str) -> DataFrame:
    """Distinct combinations; NULL parts count as a value of their own."""
    return df.agg(F.count_distinct(F.struct(*keys)).alias(alias))
