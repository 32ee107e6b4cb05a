"""Masking expressions. ``roles`` is the set of roles held by the session."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Who sees what, and which classification tags are protected.
CLEAR_ROLES = ("DATA_OWNER", "SVC_PIPELINE")
PARTIAL_ROLES = ("DATA_STEWARD",)
PROTECTED_TAGS = ("PII", "ACCOUNT_DETAILS", "SENSITIVE")
FULL_MASK = "***MASKED***"
SHORT_MASK = "****"
NUMBER_STEP = 10000

# Policy that covers a data type, by the type's catalog name.
STRING_POLICY = "CLASSIFICATION_MASK_VARCHAR"
DATE_POLICY = "CLASSIFICATION_MASK_DATE"
NUMBER_POLICY = "CLASSIFICATION_MASK_NUMBER"
POLICY_BY_TYPE = {
    "TEXT": STRING_POLICY,
    "VARCHAR": STRING_POLICY,
    "CHAR": STRING_POLICY,
    "CHARACTER": STRING_POLICY,
    "DATE": DATE_POLICY,
    "NUMBER": NUMBER_POLICY,
    "DECIMAL": NUMBER_POLICY,
    "NUMERIC": NUMBER_POLICY,
    "INT": NUMBER_POLICY,
    "INTEGER": NUMBER_POLICY,
    "BIGINT": NUMBER_POLICY,
    "SMALLINT": NUMBER_POLICY,
}


def level(tag: str | None, roles: Iterable[str], protected: Iterable[str] = PROTECTED_TAGS) -> str:
    """CLEAR, PARTIAL or FULL. Clear is tested first: an owner also holds the steward role."""
    held = set(roles)
    if tag is not None and tag not in set(protected):
        return "CLEAR"
    if held & set(CLEAR_ROLES):
        return "CLEAR"
    return "PARTIAL" if held & set(PARTIAL_ROLES) else "FULL"


def partial_string(col: Column) -> Column:
    """First two and last two characters; four or fewer are hidden altogether."""
    n = F.length(col)
    hidden = F.concat(F.left(col, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(col, F.lit(2)))
    return F.when(col.isNull(), F.lit(None)).when(n <= 4, F.lit(SHORT_MASK)).otherwise(hidden)


def partial_date(col: Column) -> Column:
    return F.make_date(F.year(col), F.lit(1), F.lit(1))


def partial_number(col: Column) -> Column:
    return col - F.pmod(col, F.lit(NUMBER_STEP))


def mask_string(col: Column, tag: str | None, roles: Iterable[str]) -> Column:
    return {"CLEAR": col, "PARTIAL": partial_string(col), "FULL": F.lit(FULL_MASK)}[level(tag, roles)]


def mask_date(col: Column, tag: str | None, roles: Iterable[str]) -> Column:
    return {"CLEAR": col, "PARTIAL": partial_date(col), "FULL": F.lit(None).cast("date")}[level(tag, roles)]


def mask_number(col: Column, tag: str | None, roles: Iterable[str], dtype: str = "decimal(38,2)") -> Column:
    return {
        "CLEAR": col,
        "PARTIAL": partial_number(col).cast(dtype),
        "FULL": F.lit(None).cast(dtype),
    }[level(tag, roles)]


def mask_for(field: T.StructField, tag: str, roles: Iterable[str]) -> Column:
    """The mask that fits the column's type; other types have no policy and stay as they are."""
    col = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        out = mask_string(col, tag, roles)
    elif isinstance(kind, T.DateType):
        out = mask_date(col, tag, roles)
    elif isinstance(kind, (T.DecimalType, T.IntegralType)):
        out = mask_number(col, tag, roles, kind.simpleString())
    else:
        out = col
    return out.alias(field.name)


def policy_for_type(type_name: Column) -> Column:
    """Name of the masking policy that a catalog data type needs; NULL when unsupported."""
    out = F.lit(None).cast("string")
    for policy in (STRING_POLICY, DATE_POLICY, NUMBER_POLICY):
        names = [t for t, p in POLICY_BY_TYPE.items() if p == policy]
        out = F.when(type_name.isin(*names), F.lit(policy)).otherwise(out)
    return out
