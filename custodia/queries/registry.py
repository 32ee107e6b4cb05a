"""Registration of queries and of the SQL they are checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custodia.queries.inputs import BASE, SQL, Inputs, needed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Relations that Spark derives with the library and the oracle states in SQL of its own.
VIEWS: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Types that every client prints alike: no decimals, dates or zoned timestamps."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, fn: Callable[[Inputs], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query registered twice: {name}")
    QUERIES[name] = lambda spark, folder: plain(fn(Inputs(spark, folder)))
    if sql is not None:
        ORACLE[name] = sql


def oracle() -> dict[str, str]:
    """The registered SQL with the relations it names; composed late, so modules may refer to each other's."""
    return {name: with_inputs(sql) for name, sql in ORACLE.items()}


def with_inputs(sql: str) -> str:
    """Put the relations that ``sql`` names in front of it as common table expressions."""
    ctes: dict[str, str] = {}

    def add(text: str) -> None:
        for name in needed(text):
            if name in BASE or name in ctes:
                continue
            body = SQL.get(name) or VIEWS[name]
            add(body)
            ctes[name] = body
    add(sql)
    body = sql.strip()
    parts = [f"{n} as ({_named(b)})" for n, b in ctes.items()]
    own = re.match(r"(?is)^with\s+(recursive\s+)?", body)
    if own:
        return "with recursive " + ",\n".join([*parts, _named(body[own.end():])])
    head = "with recursive " + ",\n".join(parts) + "\n" if parts else ""
    return head + _named(body)


def _named(text: str) -> str:
    return re.sub(r"\{([a-z_]\w*)\}", r"\1", text)
