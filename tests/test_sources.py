import json
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from custodia.sources import catalog, files, logs, schemas


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_null_tokens_quotes_and_types(spark, tmp_path):
    path = write(
        tmp_path / "account.csv",
        "ACCOUNT_ID,CUSTOMER_ID,ACCOUNT_TYPE,ACCOUNT_NUMBER,BRANCH_CODE,BALANCE,STATUS,OPENED_DATE,CREATED_AT\n"
        'A1,C1,CHECKING,"1,234",NULL,10.50,ACTIVE,2020-01-02,2020-01-02 03:04:05\n'
        'A2,C2,"say ""hi""",null,,NULL,,,\n',
    )
    a, b = files.read_csv(spark, path, schemas.ACCOUNT).orderBy("account_id").collect()
    assert (a.account_number, a.branch_code, a.balance, a.opened_date) == ("1,234", None, Decimal("10.50"), date(2020, 1, 2))
    assert b.account_type == 'say "hi"'
    assert (b.account_number, b.branch_code, b.balance, b.status, b.created_at) == (None, None, None, None, None)


@pytest.mark.parametrize("line", ["B1,name,boss", "B1,name,boss,EAST,extra"])
def test_csv_stops_at_a_record_of_the_wrong_width(spark, tmp_path, line):
    path = write(tmp_path / "branch.csv", f"BRANCH_CODE,BRANCH_NAME,BRANCH_MANAGER,REGION\n{line}\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        files.read_csv(spark, path, schemas.BRANCH).collect()


def test_csv_stops_at_a_value_of_the_wrong_type(spark, tmp_path):
    path = write(tmp_path / "gl.csv", "GL_CODE,ACCOUNT_TYPE,CONTROL_TOTAL,RECORD_COUNT,AS_OF_DATE\nG,CHECKING,ten,1,2020-01-01\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        files.read_csv(spark, path, schemas.GL_CONTROL).collect()


def test_load_adds_the_clock(spark, as_of):
    df = files.load_table(spark.range(2).withColumn("x", F.lit(1)), ["id"], as_of)
    assert df.columns == ["id", "_load_timestamp"]
    assert str(df.first()["_load_timestamp"]) == "2024-01-31 00:00:00"


def test_dictionary_flag(spark, tmp_path):
    path = write(
        tmp_path / "dictionary.csv",
        "table_name,column_name,column_description,data_type,sensitivity_classification,is_cde,notes\n"
        "CUSTOMER,TAX_ID,Tax ID,VARCHAR,PII,YES,x\nCUSTOMER,EMAIL,Mail,VARCHAR,PII,NO,NULL\n",
    )
    got = {r.column_name: (r.is_cde, r.notes) for r in files.read_dictionary(spark, path).collect()}
    assert got == {"TAX_ID": (True, "x"), "EMAIL": (False, None)}


def test_sealed_document_becomes_one_relation(spark, tmp_path, rows):
    doc = {
        "comment": "sealed",
        "confirmed_sensitive_columns": [{"table": "CUSTOMER", "column": "EMAIL", "classification": "PII", "reason": "contact", "masking_rule": "x"}],
        "deliberately_mislabeled": [{"table": "LOAN", "column": "LOAN_MEMO", "surface_classification": "PUBLIC", "actual_classification": "POTENTIALLY_SENSITIVE", "why_mislabeled": "text"}],
    }
    path = write(tmp_path / "sealed.json", json.dumps(doc, indent=2))
    assert rows(files.read_sealed(spark, path)) == [
        ("CUSTOMER", "EMAIL", "PII", "CONFIRMED", "contact"),
        ("LOAN", "LOAN_MEMO", "POTENTIALLY_SENSITIVE", "MISLABELED", "text"),
    ]


def test_sealed_document_may_lack_a_section(spark, tmp_path):
    path = write(tmp_path / "one.json", json.dumps({"confirmed_sensitive_columns": []}))
    assert files.read_sealed(spark, path).count() == 0


def test_catalog_scans(spark, rows):
    spark.sql("create database if not exists scan_db")
    spark.sql("create or replace temp view not_listed as select 1 as x")
    spark.sql("drop table if exists scan_db.t1")
    spark.sql("create table scan_db.t1 (id bigint not null comment 'the key', name string) using parquet")
    spark.sql("create or replace view scan_db.v1 as select id from scan_db.t1")
    assert rows(catalog.scan_tables(spark, ["scan_db"]).select("schema_name", "table_name", "object_type")) == [
        ("scan_db", "t1", "BASE TABLE"),
        ("scan_db", "v1", "VIEW"),
    ]
    cols = catalog.scan_columns(spark, ["scan_db"]).filter("table_name = 't1'")
    assert rows(cols.select("ordinal_position", "column_name", "column_type", "column_comment")) == [
        (1, "id", "BIGINT", "the key"),
        (2, "name", "STRING", None),
    ]


def test_history_window_is_inclusive_and_successful_only(spark, as_of, rows):
    df = spark.sql(
        """select * from values
        (1, timestamp '2024-01-31 00:00:00', 'SUCCESS'), (2, timestamp '2024-01-24 01:00:00', 'SUCCESS'),
        (3, timestamp '2024-01-24 00:59:59', 'SUCCESS'), (4, timestamp '2024-01-30 00:00:00', 'FAILED'),
        (5, timestamp '2024-01-31 00:00:01', 'SUCCESS') as t(query_id, start_time, execution_status)"""
    )
    assert rows(logs.query_history(df, as_of, 167).select("query_id")) == [(1,), (2,)]
    assert rows(logs.query_history(df, as_of, 167, limit=1).select("query_id")) == [(1,)]


def test_access_edges_pair_reads_with_writes(spark, rows):
    obj = "struct<objectName:string,objectDomain:string,columns:array<struct<columnName:string>>>"
    df = spark.createDataFrame(
        [(1, None, [("R.P.A", "TABLE", [("x",)]), ("R.P.B", "TABLE", [])], [("A.M.D", "TABLE", []), ("A.M.E", "VIEW", [])]), (2, None, [("R.P.A", "TABLE", [])], [])],
        f"query_id int, query_start_time timestamp, direct_objects_accessed array<{obj}>, objects_modified array<{obj}>",
    )
    got = logs.access_edges(df, "A.M.D")
    assert rows(got.select("source_object", "target_object", "query_id")) == [("A", "D", 1), ("B", "D", 1)]
    assert logs.access_edges(df).count() == 4
    assert '"source_columns":[{"columnName":"x"}]' in got.filter("source_object = 'A'").first()["process_details"]
