from pyspark.sql import functions as F

from custodia.operators import catalog as D
from custodia.operators import search as X
from custodia.operators.checks import DIMENSIONS

COLUMNS = "database_name string, schema_name string, table_name string, column_name string, ordinal_position int, column_type string, column_comment string, is_nullable string, harvested_at int"
DICT = "table_name string, column_name string, column_description string"
CDE = "cde_id int, database_name string, schema_name string, table_name string, column_name string, criticality_level string, business_owner string"


def tag(obj, name, value, column=None):
    return (*obj, column, "TABLE" if column is None else "COLUMN", name, value, "MANUAL")


A, B = ("RAW", "PUBLIC", "ACCOUNT"), ("RAW", "PUBLIC", "LOAN")


def master(spark, **kw):
    columns = spark.createDataFrame(
        [(*A, "ID", 1, "NUMBER", "the key", "NO", 1), (*A, "MEMO", 2, "TEXT", "", "YES", 1), (*B, "ID", 1, "NUMBER", None, "NO", 1)], COLUMNS)
    words = spark.createDataFrame([("account", "memo", "free text"), ("ACCOUNT", "ID", "not used"), ("LOAN", "ID", "")], DICT)
    cdes = spark.createDataFrame([(1, "raw", "public", "account", "id", "CRITICAL", "Deposits")], CDE)
    tags = spark.createDataFrame([tag(A, "DATA_STEWARD", "Ann"), tag(B, "DATA_OWNER", "Lending"), tag(B, "CERTIFICATION", "IN_PROGRESS"), tag(A, "CLASSIFICATION", "PII", "MEMO")], D.TAG_SCHEMA)
    results = kw.get("results") or [("r1", *A, d, "PASS", 2) for d in DIMENSIONS] + [("r2", *B, d, "PASS", 9) for d in DIMENSIONS[:5]] + [("r2", *B, "ACCURACY", None, 9)]
    dq = spark.createDataFrame(results, "invocation_id string, target_database string, target_schema string, target_table string, check_dimension string, check_result string, executed_at int")
    return D.catalog_master(columns, words, cdes, tags, dq)


def test_master_view(spark):
    got = {(r.table_name, r.column_name): r for r in master(spark).collect()}
    a, m, b = got[("ACCOUNT", "ID")], got[("ACCOUNT", "MEMO")], got[("LOAN", "ID")]
    assert (a.description, m.description, b.description) == ("the key", "free text", None)
    assert (a.cde_flag, a.criticality_level, m.cde_flag) == ("YES", "CRITICAL", "NO")
    assert (a.data_owner, a.data_steward, b.data_owner, b.certification) == ("Deposits", "Ann", "Lending", "IN_PROGRESS")
    assert (m.classification, a.classification) == ("PII", None)
    assert (a.latest_dq_status, b.latest_dq_status) == ("PASS", "FAIL")


def test_search_is_literal_and_case_blind(spark):
    m = master(spark)
    assert X.search(m, "FREE T").count() == 1
    assert X.search(m, "account").count() == 2
    assert X.search(m, "f.ee").count() == 0
    assert X.search(m, "", cde_only=True).count() == 1
    assert X.search(m, "", database="ANALYTICS").count() == 0


def test_metrics_and_assets(spark):
    m = master(spark)
    assert tuple(X.catalog_metrics(m).first()) == (2, 3, 1, 2)
    got = {r.object_name: r for r in X.assets(m).collect()}
    a, b = got["RAW.PUBLIC.ACCOUNT"], got["RAW.PUBLIC.LOAN"]
    assert (a.data_owner, a.data_steward, a.certification, a.latest_dq_status) == ("Deposits", "Ann", "Not certified", "PASS")
    assert (b.data_steward, b.certification) == ("Not assigned", "IN_PROGRESS")


def test_certification_shown_prefers_the_latest_run(spark):
    runs = spark.createDataFrame([("1", *B, "IN_PROGRESS", 1), ("2", *B, "CERTIFIED", 2)], "certification_run_id string, database_name string, schema_name string, object_name string, final_status string, completed_at int")
    got = {r.table_name: r.certification for r in X.certification_status(master(spark), runs).collect()}
    assert got == {"ACCOUNT": "Not certified", "LOAN": "CERTIFIED"}


def test_tags_are_set_once_per_object_and_column(spark):
    stored = spark.createDataFrame([tag(A, "DATA_OWNER", "old"), tag(A, "CDE", "YES", "ID")], D.TAG_SCHEMA)
    rows = spark.createDataFrame([tag(A, "DATA_OWNER", "new"), tag(A, "CDE", "NO", "ID"), tag(B, "DATA_OWNER", "x")], D.TAG_SCHEMA)
    once = D.apply_tags(stored, rows)
    got = sorted((r.table_name, r.column_name or "", r.tag_value) for r in once.collect())
    assert got == [("ACCOUNT", "", "new"), ("ACCOUNT", "ID", "NO"), ("LOAN", "", "x")]
    assert D.apply_tags(once, rows).count() == 3


def test_harvest_refreshes_part_of_a_row(spark, as_of):
    spark.sql("create database if not exists harvest_db")
    spark.sql("drop table if exists harvest_db.t")
    spark.sql("create table harvest_db.t (id bigint comment 'key') using parquet")
    none_t = spark.createDataFrame([], "database_name string, schema_name string, table_name string, object_type string, table_comment string, row_count bigint, created_on timestamp_ntz, last_altered timestamp_ntz, harvested_at timestamp")
    none_c = spark.createDataFrame([], "database_name string, schema_name string, table_name string, ordinal_position int, column_name string, column_type string, column_comment string, is_nullable string, harvested_at timestamp")
    log = spark.createDataFrame([], "tag_name string, object_type string, object_identifier string, tag_value string, assigned_by string, assigned_at timestamp, harvest_id string")
    tables, columns, history = D.harvest(spark, none_t, none_c, log, ["harvest_db"], as_of)
    assert [(r.table_name, r.row_count) for r in tables.collect()] == [("t", 0)]
    changed = columns.withColumn("column_type", F.lit("OLD")).withColumn("ordinal_position", F.lit(7))
    _, columns2, history2 = D.harvest(spark, tables, changed, history, ["harvest_db"], as_of)
    assert [(r.column_name, r.column_type, r.ordinal_position) for r in columns2.collect()] == [("id", "BIGINT", 7)]
    assert [r.harvest_id for r in history2.collect()] == ["2024_01_31_00_00_00"] * 2


def test_glossary_keeps_terms_without_columns(spark):
    terms = spark.createDataFrame([(1, "Balance", "d"), (2, "Collateral", "d")], "term_id int, term_name string, definition string")
    maps = spark.createDataFrame([("RAW", "PUBLIC", "B", "X", 1), ("RAW", "PUBLIC", "A", "X", 1), ("ANALYTICS", "M", "A", "X", 1)], "database_name string, schema_name string, table_name string, column_name string, term_id int")
    got = {r.term_name: (r.column_count, r.mapped_columns) for r in D.glossary_coverage(terms, maps).collect()}
    assert got == {"Balance": (3, "A.X, B.X"), "Collateral": (0, "")}


def test_documentation_coverage_counts_against_the_harvest(spark):
    columns = spark.createDataFrame([("T", "A"), ("T", "B"), ("T", "C"), ("U", "A")], "table_name string, column_name string")
    words = spark.createDataFrame([("t", "a", "x"), ("T", "B", " "), ("T", "Z", "gone")], DICT)
    got = {r.table_name: (r.total_columns, r.documented_columns, r.documentation_percentage) for r in D.documentation_coverage(columns, words).collect()}
    assert got == {"T": (3, 1, 33.33), "U": (1, 0, 0.0)}


def test_taxonomy(spark):
    assert D.tag_taxonomy(spark).count() == 11
    tags = spark.createDataFrame([tag(A, "DATA_OWNER", "x"), tag(A, "NOPE", "y")], D.TAG_SCHEMA)
    assert [r.tag_name for r in D.undefined_tags(tags).collect()] == ["NOPE"]


def test_layer_counts(spark):
    tables = spark.createDataFrame([("RAW", "PUBLIC", "A", "T"), ("RAW", "PUBLIC", "B", "T"), ("ANALYTICS", "MARTS", "M", "T"), ("GOVERNANCE", "CATALOG", "X", "T")], "database_name string, schema_name string, table_name string, object_type string")
    assert {(r.layer, r.object_count) for r in D.layer_counts(tables).collect()} == {("RAW", 2), ("MARTS", 1), ("TOTAL", 3)}
