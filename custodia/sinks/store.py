"""Table maintenance without row-level updates.

Parquet tables accept neither MERGE nor DELETE, so every change is a DataFrame of
the table's next content (``upsert``, ``replace_scope``, ``transition`` ...) and
``publish`` writes it as a new version, then moves the view that readers use.
A job that fails half way leaves the old version in place.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# ---- next content as a DataFrame -------------------------------------------------


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update: Sequence[str] | None = None,
    when: Column | None = None,
    insert_values: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Rows of ``target`` with the matched ones updated and the new ones of ``source`` added.

    ``update`` lists the columns a match refreshes (default: all of source's that are
    not keys); ``when`` is a predicate on the target's columns that a match must meet;
    ``insert_values`` gives columns of new rows that source lacks. Two source rows with one
    key fail the job that reads the result, as MERGE does; rows with a NULL key match nothing.

    The target is the left side of a left join and is never the side that is built, so a
    small source is broadcast by its measured size and the target is not moved; a large
    source meets it in a sort-merge join that adaptive execution may split. (A full join
    would shuffle and sort the whole target every time.) NULL keys never match, as in SQL.
    """
    keys = list(keys)
    single, loose = one_per_key(source, keys)
    update = [c for c in source.columns if c not in keys and c in target.columns] if update is None else list(update)
    s = single.select(*[F.col(c).alias(f"s__{c}") for c in source.columns], F.lit(True).alias("s__hit"))
    joined = target.join(s, [target[k] == s[f"s__{k}"] for k in keys], "left")
    hit = F.coalesce("s__hit", F.lit(False))
    if when is not None:
        hit = hit & F.coalesce(when, F.lit(False))
    kept = joined.select(
        *[
            F.when(hit, F.col(f"s__{f.name}")).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name)
            if f.name in update
            else F.col(f.name)
            for f in target.schema.fields
        ]
    )
    given = dict(insert_values or {})
    added = absent(single, target, keys).unionByName(loose).select(
        *[
            (F.col(f.name) if f.name in source.columns else given.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
            for f in target.schema.fields
        ]
    )
    return kept.unionByName(added)


def one_per_key(source: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The source rows whose keys hold no NULL, with an error raised while they are read if a key occurs twice, and all others."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    rest = [c for c in source.columns if c not in keys]
    grouped = source.filter(whole).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(F.lit(1).alias("__one"), *rest)).alias("__row"))
    checked = grouped.filter(F.assert_true(F.col("__n") == 1, F.lit(f"duplicate keys: {', '.join(keys)}")).isNull())
    single = checked.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in source.columns])
    return single, source.filter(~whole)


def absent(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows whose keys the target lacks.

    The target's keys are first reduced to those the source has, again with the target
    as the streamed side; what is left is no larger than the source.
    """
    known = target.select(*keys).join(source.select(*keys), list(keys), "left_semi").distinct()
    return source.join(known, list(keys), "left_anti").select(*source.columns)


def insert_missing(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target plus the source rows whose keys it lacks; matched rows stay untouched."""
    return target.unionByName(absent(source, target, keys), allowMissingColumns=True)


def replace_scope(target: DataFrame, fresh: DataFrame, scope: Mapping[str, str]) -> DataFrame:
    """Drop the rows of one scope (column = value ...) and put ``fresh`` in their place."""
    inside = F.lit(True)
    for column, value in scope.items():
        inside = inside & F.col(column).eqNullSafe(F.lit(value))
    return target.filter(~inside).unionByName(fresh, allowMissingColumns=True)


def replace_scopes(target: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for many scopes at once: every scope that ``fresh`` holds is replaced."""
    kept = target.join(fresh.select(*keys).distinct(), list(keys), "left_anti").select(*target.columns)
    return kept.unionByName(fresh, allowMissingColumns=True)


def append(target: DataFrame, rows: DataFrame) -> DataFrame:
    return target.unionByName(rows, allowMissingColumns=True)


def transition(
    target: DataFrame, ids: DataFrame | str, id_column: str, state_column: str, from_state: str, values: Mapping[str, Column]
) -> DataFrame:
    """Set columns of the rows that are in ``from_state`` and whose id is asked for.

    Check and change are one expression, so two callers cannot both pass the check.
    ``ids`` is a single id or a relation with the column ``id_column``; in the second
    case ``values`` may refer to its other columns as ``r.<name>``.
    """
    if isinstance(ids, str):
        hit = (F.col(id_column) == ids) & (F.col(state_column) == from_state)
        return target.select(
            *[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns]
        )
    t, r = target.alias("t"), ids.alias("r")
    hit = F.col(f"r.{id_column}").isNotNull() & (F.col(f"t.{state_column}") == from_state)
    joined = t.join(r, F.col(f"t.{id_column}") == F.col(f"r.{id_column}"), "left")
    return joined.select(
        *[
            (F.when(hit, values[c]).otherwise(F.col(f"t.{c}")) if c in values else F.col(f"t.{c}")).alias(c)
            for c in target.columns
        ]
    )


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the schema's missing columns as NULL; existing columns and rows stay."""
    have = set(df.columns)
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in have])


def duplicated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrence_count")).filter("occurrence_count > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The declared primary key, enforced before a write."""
    if not duplicated_keys(df, keys).isEmpty():
        raise ValueError(f"duplicate keys: {', '.join(keys)}")
    return df


def require_non_empty(frames: Mapping[str, DataFrame]) -> None:
    """Refuse a snapshot with an empty input before any table is touched."""
    empty = [name for name, df in frames.items() if df.isEmpty()]
    if empty:
        raise ValueError(f"empty snapshot input: {', '.join(empty)}")


def reconcile_counts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Tables whose loaded row count is not the expected one; input (object_name, row_count)."""
    e = expected.withColumnRenamed("row_count", "expected_rows")
    a = actual.withColumnRenamed("row_count", "loaded_rows")
    return e.join(a, "object_name", "full").filter(~F.col("expected_rows").eqNullSafe(F.col("loaded_rows")))


# ---- writing ---------------------------------------------------------------------


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Full refresh of a model's table."""
    writer = df.write.mode("overwrite").format("parquet")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def reload(df: DataFrame, name: str) -> DataFrame:
    """Replace the rows but keep the table object, so what is attached to it stays."""
    spark = df.sparkSession
    df.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)
    return spark.table(name)


def properties(spark: SparkSession, name: str) -> dict[str, str]:
    """Properties of a table object."""
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}


def append_to(df: DataFrame, path: str) -> DataFrame:
    """Add rows to a history kept as Parquet files; readers merge older schemas."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.option("mergeSchema", True).parquet(path)


def write_all(df: DataFrame, path: str) -> DataFrame:
    """Replace a path by ``df``, which must not read that path."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def publish(df: DataFrame, name: str, location: str | None = None) -> DataFrame:
    """Write ``df`` as a new version of ``name`` and point the view ``name`` at it.

    ``df`` may read the current version: it is not touched. ``location`` is the folder
    that holds the versions; leave it out to use the warehouse.
    """
    spark = df.sparkSession
    version = f"{name}__{uuid.uuid4().hex}"
    materialize(df, version, None if location is None else f"{location.rstrip('/')}/{version.split('.')[-1]}")
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {version}")
    return spark.table(name)


def store_failures(df: DataFrame, check: str, folder: str) -> DataFrame:
    """Keep a check's failing rows for drill-down; the next run replaces them."""
    return write_all(df, f"{folder.rstrip('/')}/{check}")


def as_view(df: DataFrame, name: str) -> DataFrame:
    """A named derived relation."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)

