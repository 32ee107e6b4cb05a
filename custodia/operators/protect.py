"""Protection: roles, masked projections, row filters, tag propagation, policy gaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custodia.functions import masks
from custodia.operators import graph, lineage
from custodia.operators import relational as R
from custodia.operators.classify import KEY
from custodia.sinks import store
from custodia.sources.values import values_df

# Who may see which branch ('*' is every branch), and the role grants.
ENTITLEMENTS = (
    ("DATA_OWNER", "*"),
    ("DATA_STEWARD", "*"),
    ("DEPOSITS_ANALYST", "*"),
    ("BRANCH_HUDSON", "BR_01"),
)
ROLE_GRANTS = (
    ("DATA_OWNER", "DATA_STEWARD"),
    ("DATA_OWNER", "DEPOSITS_ANALYST"),
    ("DATA_OWNER", "BRANCH_HUDSON"),
    ("DATA_OWNER", "SVC_PIPELINE"),
)
ALL_BRANCHES = "*"

# Classes from the least to the most protected: of several tags on a column the last counts.
STRICTNESS = ("PUBLIC", "INTERNAL", "POTENTIALLY_SENSITIVE", "SENSITIVE", "ACCOUNT_DETAILS", "PII")


def entitlements_df(spark: SparkSession) -> DataFrame:
    return values_df(spark, ENTITLEMENTS, "role_name string, branch_code string")


def role_grants_df(spark: SparkSession) -> DataFrame:
    return values_df(spark, ROLE_GRANTS, "role string, granted_role string")


def session_roles(grants: DataFrame, roles: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Roles held by a session: the given ones and all they are granted, at any depth.

    ``roles`` has a column ``role``; with ``carry`` many users are resolved at once.
    """
    found = graph.distances(
        grants, roles.select(*carry, F.col("role").alias("node_role")), ["role"], ["granted_role"], ["node_role"], carry
    )
    return found.select(*carry, F.col("node_role").alias("role_name")).distinct()


def held_roles(grants: DataFrame, role: str) -> list[str]:
    """The same for one role as a list, for building masks: the names of one session's roles."""
    start = values_df(grants.sparkSession, [(role,)], "role string")
    return sorted(r["role_name"] for r in session_roles(grants, start).collect())


def masked(df: DataFrame, tags: Mapping[str, str], roles: Sequence[str]) -> DataFrame:
    """The table as the roles may see it: a projection, so filters and pruning pass through.

    ``tags`` gives the classification of tagged columns (any spelling); columns without
    a tag are left alone.
    """
    return df.select(*[shown(f, tags, roles) for f in df.schema.fields])


def shown(field: T.StructField, tags: Mapping[str, str], roles: Sequence[str]) -> Column:
    """One column as the roles may see it."""
    tag = {k.upper(): v for k, v in tags.items()}.get(field.name.upper())
    return F.col(f"`{field.name}`") if tag is None else masks.mask_for(field, tag, roles)


def column_tags(tags: DataFrame, obj: tuple[str, str, str]) -> dict[str, str]:
    """Classification tags of one table's columns: one row per column, the strictest of its tags; an unlisted class counts as strictest."""
    database, schema, table = obj
    rows = tags.filter(
        (F.col("tag_name") == "CLASSIFICATION")
        & (F.col("database_name") == database)
        & (F.col("schema_name") == schema)
        & (F.col("table_name") == table)
        & F.col("column_name").isNotNull()
    ).groupBy("column_name").agg(F.max_by("tag_value", F.struct(strictness(F.col("tag_value")), "tag_value")).alias("tag_value"))
    return {r["column_name"]: r["tag_value"] for r in rows.collect()}


def strictness(tag_value: Column) -> Column:
    """The rank of a class; unlisted classes rank above all listed ones."""
    rank = F.array_position(F.array(*map(F.lit, STRICTNESS)), tag_value)
    return F.when(rank > 0, rank).otherwise(len(STRICTNESS) + 1)


def row_filter(
    df: DataFrame, column: str, entitlements: DataFrame, roles: Sequence[str]
) -> DataFrame:
    """Rows whose value is entitled to any of the roles; '*' entitles to all, nothing to none.

    Entitlements are looked up when the view is read, not when it is made: the values by an
    equi-join with the distinct ones, the wildcard by a one-row subquery. Nothing runs here,
    and the plan is the same for any number of values.
    """
    granted = entitlements.filter(F.col("role_name").isin(*roles)).select(F.col("branch_code").alias("__entitled")).distinct()
    every = granted.agg(F.coalesce(F.max(F.col("__entitled") == ALL_BRANCHES), F.lit(False))).scalar()
    joined = df.join(granted, df[column] == F.col("__entitled"), "left")
    return joined.filter(F.col("__entitled").isNotNull() | every).select(*[df[c] for c in df.columns])


def protect(
    df: DataFrame,
    tags: Mapping[str, str],
    roles: Sequence[str],
    entitlements: DataFrame | None = None,
    column: str | None = None,
) -> DataFrame:
    """Row filter, then masks: the filter sees the real value, the reader does not."""
    if entitlements is not None and column is not None:
        df = row_filter(df, column, entitlements, roles)
    return masked(df, tags, roles)


def grant_branch(entitlements: DataFrame, rows: DataFrame) -> DataFrame:
    """Add entitlements that are not there yet."""
    return store.insert_missing(entitlements, rows, ["role_name", "branch_code"])


def attach_row_filter(
    attached: Mapping[str, str], targets: Mapping[str, DataFrame], policy: str, column: str
) -> dict[str, str]:
    """Which policy filters which table, after attaching ``policy`` to the targets.

    Refused when a target lacks the column or has another filter; skipped when it has
    this one. Only schemas are looked at.
    """
    out = dict(attached)
    for name, df in targets.items():
        if column.upper() not in {c.upper() for c in df.columns}:
            raise ValueError(f"required column {column} is absent from {name}")
        current = out.get(name)
        if current is not None and current.upper() != policy.upper():
            raise ValueError(f"a different row filter is already attached to {name}: {current}")
        out[name] = policy
    return out


def propagate_tags(tags: DataFrame, edges: DataFrame, tag_name: str = "CLASSIFICATION") -> DataFrame:
    """Tags carried along column edges to every column derived from a tagged one.

    The closure is kept per tag value, not per tagged column, so it holds at most one
    row per column and value. Columns with a tag of their own keep it.
    """
    own = tags.filter((F.col("tag_name") == tag_name) & F.col("column_name").isNotNull())
    seeds = own.select(
        F.col("database_name").alias("node_database"), F.col("schema_name").alias("node_schema"),
        F.col("table_name").alias("node_object"), F.col("column_name").alias("node_column"), "tag_value",
    )
    by_column = edges.filter(F.col("source_column").isNotNull() & F.col("target_column").isNotNull())
    found = graph.distances(by_column, seeds, lineage.SOURCE, lineage.TARGET, lineage.NODE, ["tag_value"])
    carried = found.filter("distance > 0").select(
        F.col("node_database").alias("database_name"), F.col("node_schema").alias("schema_name"),
        F.col("node_object").alias("table_name"), F.col("node_column").alias("column_name"),
        F.lit("COLUMN").alias("domain"), F.lit(tag_name).alias("tag_name"), "tag_value",
        F.lit("PROPAGATED").alias("apply_method"),
    )
    fresh = carried.join(own.select(*KEY).distinct(), KEY, "left_anti")
    return tags.unionByName(fresh, allowMissingColumns=True)


def policy_gaps(tags: DataFrame, columns: DataFrame, bindings: DataFrame, queue: DataFrame) -> DataFrame:
    """Sensitive columns that no active policy covers, with who approved the tag.

    ``bindings`` lists policies and their status. The policy names a type can need are
    three, so which of them are active is decided by one flag per name.
    """
    live = tags.filter(
        (F.col("tag_name") == "CLASSIFICATION")
        & (F.col("domain") == "COLUMN")
        & F.col("tag_value").isin(*masks.PROTECTED_TAGS)
    ).select(*KEY, F.col("tag_value").alias("classification_tag_value"), "apply_method")
    current = columns.select(*KEY, F.col("column_type").alias("data_type"))
    needed = live.join(current, KEY, "left").withColumn("required_policy", masks.policy_for_type(F.col("data_type")))
    active = (
        bindings.filter((F.col("policy_kind") == "MASKING_POLICY") & (F.col("policy_status") == "ACTIVE"))
        .select(F.upper("policy_name").alias("required_policy"))
        .distinct()
        .withColumn("is_active", F.lit(True))
    )
    reason = (
        F.when(F.col("data_type").isNull(), "COLUMN_NOT_FOUND")
        .when(F.col("required_policy").isNull(), "UNSUPPORTED_MASKING_DATA_TYPE")
        .when(F.col("is_active").isNull(), "TAG_MASKING_POLICY_NOT_ACTIVE")
    )
    approval = queue.filter("review_status = 'APPROVED'").select(*KEY, "review_id", "reviewed_by", "reviewed_at")
    gaps = (
        needed.join(active, "required_policy", "left")
        .withColumn("gap_reason", reason)
        .filter(F.col("gap_reason").isNotNull())
    )
    return gaps.join(approval, KEY, "left").select(
        *KEY, "classification_tag_value", "apply_method", "data_type", "required_policy",
        "review_id", "reviewed_by", "reviewed_at", "gap_reason",
    )


def masking_by_role(
    df: DataFrame, tags: Mapping[str, str], roles: Mapping[str, Sequence[str]], columns: Sequence[str]
) -> DataFrame:
    """The same columns as each role sees them, labelled by role.

    The table is scanned once: each row is unfolded into one per role.
    """
    fields = [df.schema[c] for c in columns]
    views = [F.struct(F.lit(role).alias("role_name"), *[shown(f, tags, held).alias(f.name) for f in fields]) for role, held in roles.items()]
    return df.select(F.inline(F.array(*views)))


def branch_distribution(
    tables: Mapping[str, DataFrame], column: str, entitlements: DataFrame, roles: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Rows per branch that each role gets to see of each table.

    Every table is counted by branch once, whatever the number of roles. Branches then meet the
    list of roles entitled to them; the roles entitled to all are a one-row subquery. Both
    lists hold names out of ``roles`` and no others.
    """
    spark = entitlements.sparkSession
    held = values_df(spark, [(role, h) for role, names in roles.items() for h in names], "viewer string, role_name string")
    granted = entitlements.join(held, "role_name").select("viewer", F.col("branch_code").alias("__entitled")).distinct()
    every = granted.agg(F.collect_set(F.when(F.col("__entitled") == ALL_BRANCHES, F.col("viewer")))).scalar()
    viewers = granted.groupBy("__entitled").agg(F.collect_set("viewer").alias("__viewers"))
    counts = R.union_all(
        [R.count_by(df, column).select(F.lit(name).alias("object_name"), column, "row_count") for name, df in tables.items()]
    )
    met = counts.join(viewers, counts[column] == viewers["__entitled"], "left")
    seen_by = F.array_union(F.coalesce("__viewers", F.array().cast("array<string>")), every)
    return met.select(F.explode(seen_by).alias("role_name"), "object_name", counts[column], "row_count")
