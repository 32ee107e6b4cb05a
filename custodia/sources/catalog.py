"""The Spark catalog as relations: tables, columns, and relations by name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia.sources.values import values_df

TABLE_ROWS = (
    "database_name string, schema_name string, table_name string, object_type string, "
    "table_comment string, row_count bigint, created_on timestamp_ntz, last_altered timestamp_ntz"
)
COLUMN_ROWS = (
    "database_name string, schema_name string, table_name string, ordinal_position int, "
    "column_name string, column_type string, column_comment string, is_nullable string"
)


def relation(spark: SparkSession, name: str) -> DataFrame:
    """Any relation by its name at run time."""
    return spark.table(name)


def scan_tables(
    spark: SparkSession, databases: Sequence[str], catalog: str = "spark_catalog", pattern: str | None = None
) -> DataFrame:
    """One row per table or view of the listed databases. Metadata only: no table is read.

    The catalog itself is asked for those databases and for names like ``pattern`` (``*`` and ``|`` as in SHOW TABLES) only.
    """
    rows = []
    for database in databases:
        for t in spark.catalog.listTables(database, pattern):
            if t.isTemporary:
                continue
            kind = "VIEW" if t.tableType == "VIEW" else "BASE TABLE"
            rows.append((catalog, database, t.name, kind, t.description, None, None, None))
    return values_df(spark, rows, TABLE_ROWS)


def scan_columns(
    spark: SparkSession, databases: Sequence[str], catalog: str = "spark_catalog", pattern: str | None = None
) -> DataFrame:
    """One row per column of those tables, in order, with type, comment and nullability."""
    rows = []
    for database in databases:
        for t in spark.catalog.listTables(database, pattern):
            if not t.isTemporary:
                name = f"`{database}`.`{t.name}`"
                rows.extend(_column_rows(spark.table(name), catalog, database, t.name))
    return values_df(spark, rows, COLUMN_ROWS)


def columns_of(spark: SparkSession, relations: Mapping[tuple[str, str, str], DataFrame]) -> DataFrame:
    """The same rows for DataFrames under given (database, schema, table) names."""
    rows = []
    for (database, schema, table), df in relations.items():
        rows.extend(_column_rows(df, database, schema, table))
    return values_df(spark, rows, COLUMN_ROWS)


def _column_rows(df: DataFrame, database: str, schema: str, table: str) -> list[tuple]:
    return [
        (
            database,
            schema,
            table,
            i,
            f.name,
            f.dataType.simpleString().upper(),
            f.metadata.get("comment"),
            "YES" if f.nullable else "NO",
        )
        for i, f in enumerate(df.schema.fields, start=1)
    ]


def tables_of(spark: SparkSession, relations: Mapping[tuple[str, str, str], DataFrame]) -> DataFrame:
    """Table rows for DataFrames under given names, with real row counts (one aggregate each)."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(database).alias("database_name"), F.lit(schema).alias("schema_name"), F.lit(table).alias("table_name"),
            F.lit("BASE TABLE").alias("object_type"), "row_count",
        )
        for (database, schema, table), df in relations.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def filled_counts(spark: SparkSession, relations: Mapping[tuple[str, str, str], DataFrame]) -> DataFrame:
    """Column rows with the number of filled values: one aggregate per table, whatever its width."""
    parts = []
    for (database, schema, table), df in relations.items():
        fields = list(enumerate(df.schema.fields, start=1))
        pairs = [
            F.struct(F.lit(i).alias("ordinal_position"), F.lit(f.name).alias("column_name"), F.col(f"n_{i}").alias("filled"))
            for i, f in fields
        ]
        row = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"n_{i}") for i, f in fields])
        parts.append(
            row.select(F.explode(F.array(*pairs)).alias("c")).select(
                F.lit(database).alias("database_name"), F.lit(schema).alias("schema_name"), F.lit(table).alias("table_name"), "c.*"
            )
        )
    return reduce(DataFrame.unionByName, parts)
