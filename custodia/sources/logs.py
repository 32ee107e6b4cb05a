"""Governance logs: tag references, query history, dependencies, access history, policies."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.functions import predicates as P
from custodia.functions import scalars as S


def tag_references(
    tags: DataFrame,
    tag_names: list[str] | None = None,
    obj: tuple[str, str, str] | None = None,
    domains: list[str] | None = None,
) -> DataFrame:
    """Tag rows in one of four scopes: an object, its columns, everything, everything with propagation.

    Propagated rows are ordinary rows of ``tags`` (apply_method PROPAGATED) once
    ``operators.protect.propagate_tags`` has added them.
    """
    out = tags
    if tag_names is not None:
        out = out.filter(F.upper("tag_name").isin(*[t.upper() for t in tag_names]))
    if obj is not None:
        database, schema, table = obj
        out = out.filter(
            (F.col("database_name") == database) & (F.col("schema_name") == schema) & (F.col("table_name") == table)
        )
    if domains is not None:
        out = out.filter(F.col("domain").isin(*domains))
    return out


def query_history(history: DataFrame, end: datetime, hours: int, limit: int | None = None) -> DataFrame:
    """Successful queries of the window, newest first when capped.

    The cap is a parameter of the scan; leave it out and no evidence is lost.
    """
    out = history.filter(
        P.between_hours(F.col("start_time"), end, hours) & (F.col("execution_status") == "SUCCESS")
    )
    if limit is not None:
        out = out.orderBy(F.col("start_time").desc(), F.col("query_id")).limit(limit)
    return out


def object_dependencies(deps: DataFrame, obj: tuple[str, str, str]) -> DataFrame:
    """Dependencies that touch the object as referrer or as referee."""
    database, schema, name = obj

    def is_object(side: str):
        return (
            (F.col(f"{side}_database") == database)
            & (F.col(f"{side}_schema") == schema)
            & (F.col(f"{side}_object_name") == name)
        )

    return deps.filter(is_object("referencing") | is_object("referenced"))


def access_edges(access: DataFrame, target: str | None = None) -> DataFrame:
    """Object pairs read -> written by each query, from nested access records.

    A record holds the arrays of one query, so the two explodes stay within a row.
    The written side is filtered inside the array before anything is exploded.
    """
    written = F.col("objects_modified")
    if target is not None:
        written = F.filter(written, lambda o: o["objectName"] == F.lit(target))
    pairs = (
        access.withColumn("written", written)
        .filter(F.size("written") > 0)
        .select("query_id", "query_start_time", "direct_objects_accessed", F.explode("written").alias("t"))
        .select("query_id", "query_start_time", "t", F.explode("direct_objects_accessed").alias("s"))
    )
    return pairs.select(
        S.name_part(F.col("s.objectName"), 1).alias("source_database"),
        S.name_part(F.col("s.objectName"), 2).alias("source_schema"),
        S.name_part(F.col("s.objectName"), 3).alias("source_object"),
        F.col("s.objectDomain").alias("source_object_domain"),
        S.name_part(F.col("t.objectName"), 1).alias("target_database"),
        S.name_part(F.col("t.objectName"), 2).alias("target_schema"),
        S.name_part(F.col("t.objectName"), 3).alias("target_object"),
        F.col("t.objectDomain").alias("target_object_domain"),
        F.col("query_id"),
        F.col("query_start_time"),
        F.to_json(F.struct(F.col("s.columns").alias("source_columns"), F.col("t.columns").alias("target_columns"))).alias(
            "process_details"
        ),
    ).distinct()


def access_column_edges(access: DataFrame) -> DataFrame:
    """Column pairs read -> written, for tag propagation along data movement.

    A written column lists the columns it came from, so no pair is invented.
    """
    out = (
        access.select("query_id", F.explode("objects_modified").alias("t"))
        .select("query_id", "t.objectName", F.explode("t.columns").alias("c"))
        .select(
            "objectName",
            F.col("c.columnName").alias("target_column"),
            F.explode("c.directSources").alias("s"),
        )
    )
    return out.select(
        S.name_part(F.col("s.objectName"), 1).alias("source_database"),
        S.name_part(F.col("s.objectName"), 2).alias("source_schema"),
        S.name_part(F.col("s.objectName"), 3).alias("source_object"),
        F.col("s.columnName").alias("source_column"),
        S.name_part(F.col("objectName"), 1).alias("target_database"),
        S.name_part(F.col("objectName"), 2).alias("target_schema"),
        S.name_part(F.col("objectName"), 3).alias("target_object"),
        F.col("target_column"),
    ).distinct()


def policy_references(bindings: DataFrame, kind: str, status: str | None = None) -> DataFrame:
    out = bindings.filter(F.col("policy_kind") == kind)
    return out if status is None else out.filter(F.col("policy_status") == status)
