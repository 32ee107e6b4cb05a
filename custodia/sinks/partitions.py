"""Tables whose partitions are replaced one at a time, so a change writes only what it touches.

A table is partitioned by its scope columns (``create``) or by a hash of its keys
(``create_keyed``). Spark's dynamic partition overwrite swaps the partitions that the new
rows belong to; files of all others keep their names and times.

The next content is written to the shared folder before the swap, because Spark deletes
a partition's old files when it commits. Should the driver be lost in that moment, the rows
are still there; an executor lost at any time costs only its tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia.session import cut
from custodia.sinks import store

PART = "key_part"
_MODE = "spark.sql.sources.partitionOverwriteMode"
_KEYS, _PARTS = "custodia.keys", "custodia.parts"


def create(df: DataFrame, name: str, by: Sequence[str], path: str | None = None) -> DataFrame:
    """Write ``df`` as the table ``name`` with a partition for each combination of ``by``.

    NULL is a scope of its own. An empty text cannot be told from it in a folder's name, so it fails the job.
    """
    writer = _laid_out(_named(df, by), by).write.mode("overwrite").format("parquet").partitionBy(*by)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def create_keyed(df: DataFrame, name: str, keys: Sequence[str], parts: int, path: str | None = None) -> DataFrame:
    """The same with ``parts`` partitions by a hash of the keys, which the table remembers."""
    create(df.withColumn(PART, part_of(keys, parts)), name, [PART], path)
    df.sparkSession.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{_KEYS}' = '{','.join(keys)}', '{_PARTS}' = '{parts}')")
    return df.sparkSession.table(name)


def part_of(keys: Sequence[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(parts)).cast("int")


def partition_columns(spark: SparkSession, name: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(name) if c.isPartition]


def overwrite(df: DataFrame, name: str) -> DataFrame:
    """Replace the partitions that ``df`` has rows of; the others are not touched. ``df`` may read the table."""
    spark = df.sparkSession
    by = partition_columns(spark, name)
    staged = cut(_named(df.select(*spark.table(name).columns), by))
    with _dynamic(spark):
        _laid_out(staged, by).write.insertInto(name, overwrite=True)
    return spark.table(name)


def replace_scope(name: str, fresh: DataFrame, scope: Mapping[str, str]) -> DataFrame:
    """Put ``fresh`` in the place of one scope (a value for every partition column); without rows it ends up empty.

    A row of ``fresh`` from outside the scope fails the job before anything is replaced.
    """
    spark = fresh.sparkSession
    by = partition_columns(spark, name)
    if set(by) != set(scope):
        raise ValueError(f"{name} is partitioned by {', '.join(by)}; the scope names {', '.join(scope)}")
    inside = F.lit(True)
    for column, value in scope.items():
        inside = inside & F.col(column).eqNullSafe(F.lit(value))
    own = [c for c in spark.table(name).columns if c not in by]
    staged = cut(fresh.filter(F.assert_true(inside, F.lit(f"row outside the scope of {name}")).isNull()).select(*own))
    values = ", ".join(f"`{c}` = {_literal(scope[c])}" for c in by)
    spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION ({values}) SELECT * FROM {{rows}}", rows=staged)
    return spark.table(name)


def upsert(
    name: str,
    source: DataFrame,
    update: Sequence[str] | None = None,
    when: Column | None = None,
    insert_values: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``store.upsert`` into a table of ``create_keyed``: only the partitions of the source's keys are read and written.

    The driver learns which partitions those are: at most as many numbers as the table has partitions.
    """
    spark = source.sparkSession
    settings = store.properties(spark, name)
    keys, parts = settings[_KEYS].split(","), int(settings[_PARTS])
    marked = source.withColumn(PART, part_of(keys, parts))
    touched = [r[PART] for r in marked.select(PART).distinct().collect()]
    stored = spark.table(name).filter(F.col(PART).isin(touched))
    return overwrite(store.upsert(stored, marked, keys, update, when, insert_values), name)


@contextmanager
def _dynamic(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_MODE)
    spark.conf.set(_MODE, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(_MODE, before)


def _laid_out(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of a partition together, so it gets few files; adaptive execution splits a large partition among tasks."""
    return df.hint("rebalance", *[F.col(c) for c in by])


def _named(df: DataFrame, by: Sequence[str]) -> DataFrame:
    blank = F.lit(False)
    for c in by:
        blank = blank | (F.col(c).cast("string") == "")
    return df.filter(F.assert_true(~F.coalesce(blank, F.lit(False)), F.lit("empty text in a partition column")).isNull())


def _literal(value: str | None) -> str:
    return "NULL" if value is None else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
