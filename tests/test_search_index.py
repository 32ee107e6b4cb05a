"""Search by grams against the plain search, tables that keep their properties, and refused records."""

import pytest
from pyspark.sql import functions as F

from custodia.operators import search as X
from custodia.sinks import store
from custodia.sources import files

SCHEMA = "database_name string, schema_name string, table_name string, column_name string, description string, cde_flag string"


@pytest.fixture(scope="module")
def master(spark):
    rows = [
        ("D", "S", "ACCOUNT", "BRANCH_CODE", "Branch of the account", "YES"), ("D", "S", "ACCOUNT", "ID", None, "NO"), ("D", "T", "BR", "AB", "aaaa é ü", "YES"),
        ("E", "S", "ANCH", "x", "", "NO"), ("E", "S", None, None, None, None), ("E", "S", "ACCOUNT", "BRANCH_CODE", "again, and again", "NO"), ("E", "S", "AC", "COUNT", "ab", "NO"),
        ("D", "S", "ACCOUNT", "ID", None, "NO"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def index(master):
    return X.build_index(master)


@pytest.mark.parametrize("text", ["branch", "BRANCH", "aaa", "aaaa", "aaaaa", "é ü", "account", "accountbranch", "count", "ab", "a", "", "again, and again", "zzz", "_co", "%", "___"])
def test_index_finds_what_the_scan_finds(master, index, text):
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(X.search_index(index, text)) == rows(X.search(master, text))
    assert rows(X.search_index(index, text, database="D", cde_only=True)) == rows(X.search(master, text, database="D", cde_only=True))


def test_only_the_postings_asked_for_are_read(index, capsys):
    capsys.readouterr()
    X.candidates(index, "branch").explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [In(gram, [anc,bra,nch,ran])]" in plan and "ReadSchema: struct<row_id:bigint,gram:string>" in plan


def test_empty_catalog(spark):
    assert X.search_index(X.build_index(spark.createDataFrame([], SCHEMA)), "abc").count() == 0


def test_reload_keeps_the_table_object(spark, tmp_path):
    first = spark.range(10).selectExpr("id", "id * 2 as twice")
    store.materialize(first, "kept_table", str(tmp_path / "kept"))
    spark.sql("ALTER TABLE kept_table SET TBLPROPERTIES ('data_owner' = 'Ann')")
    spark.sql("COMMENT ON TABLE kept_table IS 'rows that matter'")
    out = store.reload(spark.range(3).selectExpr("id * 5 as twice", "id"), "kept_table")
    assert sorted(map(tuple, out.collect())) == [(0, 0), (1, 5), (2, 10)] and spark.table("kept_table").count() == 3
    assert store.properties(spark, "kept_table")["data_owner"] == "Ann"
    assert spark.catalog.getTable("kept_table").description == "rows that matter"


LOAD = "id bigint, name string, amount decimal(12,2), day date"


def test_rejects_name_file_and_reason(spark, tmp_path):
    (tmp_path / "good.csv").write_text("id,name,amount,day\n1,a,2.50,2024-01-01\n2,NULL,null,\n")
    (tmp_path / "bad.csv").write_text('id,name,amount,day\nx,b,1.00,2024-01-01\n4,c,many,2024-01-01\n5,d,1.00,2024-13-01\n6,e,1.00\n7,"f,g",1.00,2024-01-02\n8,h,1.00,2024-01-01,9\n')
    got = {(r.file_path.rsplit("/", 1)[1], r.record.split(",")[0], r.reason) for r in files.rejects(spark, str(tmp_path), LOAD).collect()}
    assert got == {("bad.csv", "x", "id: not bigint"), ("bad.csv", "4", "amount: not decimal(12,2)"), ("bad.csv", "5", "day: not date"), ("bad.csv", "6", "number of fields"), ("bad.csv", "8", "number of fields")}
    good = files.load_or_refuse(spark, str(tmp_path / "good.csv"), LOAD)
    assert [(r.id, r.name, None if r.amount is None else float(r.amount)) for r in good.orderBy("id").collect()] == [(1, "a", 2.5), (2, None, None)]
    with pytest.raises(Exception, match=r"bad\.csv: "):
        files.load_or_refuse(spark, str(tmp_path), LOAD).agg(F.count(F.lit(1)), F.max("day")).collect()
