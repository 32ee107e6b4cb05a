"""Every query of the library against its SQL on the smallest data set: same columns, types and rows."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from custodia.queries import QUERIES, oracle  # noqa: E402
from custodia.queries.inputs import BASE  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
ORACLE = oracle()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    yield con
    con.close()


def kind(arrow_type):
    name = str(arrow_type).replace("large_string", "string").replace("string_view", "string")
    return "timestamp" if name.startswith("timestamp") else name


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(v)


def table_rows(table, columns):
    return sorted(tuple(value(r[c]) for c in columns) for r in table.to_pylist())


def test_every_query_has_its_sql():
    assert set(ORACLE) == set(QUERIES)


def test_entry_has_all_queries():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 414


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    got = QUERIES[name](spark, str(DATA)).toArrow()
    want = duck.execute(ORACLE[name]).to_arrow_table()
    assert {f.name: kind(f.type) for f in got.schema} == {f.name: kind(f.type) for f in want.schema}
    columns = sorted(got.column_names)
    assert table_rows(got, columns) == table_rows(want, columns)
