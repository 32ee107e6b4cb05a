"""The queries that SQL can express against their SQL: same columns and rows."""

import math
from pathlib import Path

import duckdb
import pytest

from custodia.llm import queries

DATA = Path("/root/testdata/sf0.001")


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    got, want = queries.QUERIES[name](spark, str(DATA)), con.sql(queries.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda found: sorted(tuple(map(value, r)) for r in found)
    assert rows(got.select(columns).collect()) == rows(want.project(", ".join(columns)).fetchall())
