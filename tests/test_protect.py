import pytest
from pyspark.sql import functions as F

from custodia.operators import protect as P

TAG = "database_name string, schema_name string, table_name string, column_name string, domain string, tag_name string, tag_value string, apply_method string"
COLUMN = "database_name string, schema_name string, table_name string, column_name string, column_type string"
QUEUE = "database_name string, schema_name string, table_name string, column_name string, review_id string, review_status string, reviewed_by string, reviewed_at timestamp"


def test_owner_holds_every_role(spark):
    grants = P.role_grants_df(spark)
    assert P.held_roles(grants, "DATA_OWNER") == ["BRANCH_HUDSON", "DATA_OWNER", "DATA_STEWARD", "DEPOSITS_ANALYST", "SVC_PIPELINE"]
    assert P.held_roles(grants, "DATA_STEWARD") == ["DATA_STEWARD"]


def test_roles_are_transitive_and_cycles_end(spark):
    grants = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "role string, granted_role string")
    assert P.held_roles(grants, "a") == ["a", "b", "c", "d"]
    assert P.held_roles(grants, "d") == ["d"]


@pytest.fixture
def accounts(spark):
    return spark.createDataFrame([(1, "BR_01"), (2, "BR_02"), (3, None), (4, "BR_01")], "id int, branch_code string")


@pytest.mark.parametrize(
    ("roles", "ids"),
    [(["BRANCH_HUDSON"], [1, 4]), (["DATA_STEWARD"], [1, 2, 3, 4]), (["BRANCH_HUDSON", "DATA_OWNER"], [1, 2, 3, 4]), (["SVC_PIPELINE"], []), (["NOBODY"], [])],
)
def test_row_filter(spark, accounts, roles, ids):
    out = P.row_filter(accounts, "branch_code", P.entitlements_df(spark), roles)
    assert out.columns == accounts.columns
    assert sorted(r.id for r in out.collect()) == ids


def test_row_filter_is_resolved_when_read(spark, accounts, capsys):
    entitlements = spark.createDataFrame([("R", f"BR_SECRET_{k}") for k in range(2000)], "role_name string, branch_code string")
    P.row_filter(accounts, "branch_code", entitlements, ["R"]).explain(True)
    text = capsys.readouterr().out
    assert "BR_SECRET" not in text.split("== Optimized Logical Plan ==")[0] and "In(branch_code" not in text
    assert P.row_filter(accounts, "branch_code", entitlements, ["none"]).count() == 0


def test_strictest_tag_wins(spark):
    key = ("D", "S", "T", "C", "COLUMN", "CLASSIFICATION")
    schema = "database_name string, schema_name string, table_name string, column_name string, domain string, tag_name string, tag_value string"
    for values in (("PUBLIC", "PII"), ("PII", "PUBLIC"), ("PUBLIC", "UNHEARD_OF", "PII")):
        got = P.column_tags(spark.createDataFrame([(*key, v) for v in values], schema), ("D", "S", "T"))
        assert got == {"C": "UNHEARD_OF" if len(values) == 3 else "PII"}


def test_grants_are_added_once(spark):
    rows = spark.createDataFrame([("BRANCH_HUDSON", "BR_01"), ("BRANCH_SALEM", "BR_02")], "role_name string, branch_code string")
    once = P.grant_branch(P.entitlements_df(spark), rows)
    assert once.count() == 5
    assert P.grant_branch(once, rows).count() == 5


def test_filter_sees_the_value_the_reader_does_not(spark, accounts, rows):
    out = P.protect(accounts, {"BRANCH_CODE": "PII"}, ["BRANCH_HUDSON"], P.entitlements_df(spark), "branch_code")
    assert rows(out) == [(1, "***MASKED***"), (4, "***MASKED***")]


def test_attach(accounts, spark):
    policy = "GOVERNANCE.CATALOG.BRANCH_ENTITLEMENT_POLICY"
    assert P.attach_row_filter({}, {"A": accounts}, policy, "BRANCH_CODE") == {"A": policy}
    assert P.attach_row_filter({"A": policy.lower()}, {"A": accounts}, policy, "branch_code") == {"A": policy}
    with pytest.raises(ValueError, match="absent from B"):
        P.attach_row_filter({}, {"A": accounts, "B": spark.range(1)}, policy, "branch_code")
    with pytest.raises(ValueError, match="different row filter"):
        P.attach_row_filter({"A": "OTHER"}, {"A": accounts}, policy, "branch_code")


def test_policy_gaps(spark):
    def tag(column, value="PII"):
        return ("D", "S", "T", column, "COLUMN", "CLASSIFICATION", value, "MANUAL")

    tags = spark.createDataFrame([tag("NAME"), tag("GONE"), tag("TS"), tag("RATE"), tag("AMOUNT"), tag("BORN"), tag("CITY", "QUASI_IDENTIFIER")], TAG)
    columns = spark.createDataFrame(
        [("D", "S", "T", c, t) for c, t in (("NAME", "VARCHAR"), ("TS", "TIMESTAMP_NTZ"), ("RATE", "FLOAT"), ("AMOUNT", "NUMBER"), ("BORN", "DATE"), ("CITY", "FLOAT"))], COLUMN)
    bindings = spark.createDataFrame(
        [("classification_mask_varchar", "MASKING_POLICY", "ACTIVE"), ("CLASSIFICATION_MASK_DATE", "ROW_ACCESS_POLICY", "ACTIVE"), ("CLASSIFICATION_MASK_NUMBER", "MASKING_POLICY", "SUSPENDED")],
        "policy_name string, policy_kind string, policy_status string")
    queue = spark.createDataFrame([("D", "S", "T", "RATE", "r1", "APPROVED", "steward", None), ("D", "S", "T", "TS", "r2", "PENDING", None, None)], QUEUE)
    got = {r.column_name: r for r in P.policy_gaps(tags, columns, bindings, queue).collect()}
    assert {c: r.gap_reason for c, r in got.items()} == {
        "GONE": "COLUMN_NOT_FOUND", "TS": "UNSUPPORTED_MASKING_DATA_TYPE", "RATE": "UNSUPPORTED_MASKING_DATA_TYPE",
        "AMOUNT": "TAG_MASKING_POLICY_NOT_ACTIVE", "BORN": "TAG_MASKING_POLICY_NOT_ACTIVE"}
    assert (got["RATE"].review_id, got["TS"].review_id) == ("r1", None)


def test_tags_follow_column_edges(spark):
    def tag(obj, column, value):
        return ("D", "S", obj, column, "COLUMN", "CLASSIFICATION", value, "MANUAL")

    tags = spark.createDataFrame([tag("raw", "ssn", "PII"), tag("mart", "own", "SENSITIVE")], TAG)
    edges = spark.createDataFrame(
        [("D", "S", a, x, "D", "S", b, y) for a, x, b, y in (
            ("raw", "ssn", "stg", "tax_id"), ("stg", "tax_id", "mart", "tax_id"), ("stg", "tax_id", "mart", "own"), ("mart", "tax_id", "raw", "ssn"), ("raw", "city", "stg", "city"), ("raw", None, "stg", None))],
        "source_database string, source_schema string, source_object string, source_column string, target_database string, target_schema string, target_object string, target_column string")
    got = {(r.table_name, r.column_name): (r.tag_value, r.apply_method) for r in P.propagate_tags(tags, edges).collect()}
    assert got == {("raw", "ssn"): ("PII", "MANUAL"), ("mart", "own"): ("SENSITIVE", "MANUAL"), ("stg", "tax_id"): ("PII", "PROPAGATED"), ("mart", "tax_id"): ("PII", "PROPAGATED")}


def test_views_per_role(spark, accounts):
    out = P.branch_distribution({"ACCOUNT": accounts}, "branch_code", P.entitlements_df(spark), {"O": ["DATA_OWNER"], "H": ["BRANCH_HUDSON"]})
    assert {(r.role_name, r.branch_code, r.row_count) for r in out.collect()} == {("O", "BR_01", 2), ("O", "BR_02", 1), ("O", None, 1), ("H", "BR_01", 2)}
    seen = P.masking_by_role(accounts, {"branch_code": "PII"}, {"O": ["DATA_OWNER"], "A": ["X"]}, ["id", "branch_code"])
    assert seen.filter(F.col("role_name") == "A").select("branch_code").distinct().collect()[0][0] == "***MASKED***"
