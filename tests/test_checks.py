from datetime import date
from decimal import Decimal

import pytest

from custodia.operators import checks as Q
from custodia.operators import relational as R

D1, D2 = date(2024, 1, 31), date(2024, 2, 1)


# ---- the status machine ----------------------------------------------------------

STATUS = [
    ("not_executed", None, "pass", 0, "NOT_EXECUTED"),
    ("skipped", None, "pass", 0, "NOT_EXECUTED"),
    ("skipped", 3, "pass", 0, "NOT_EXECUTED"),
    ("error", None, "pass", 0, "ERROR"),
    ("warn", 0, "pass", 0, "ERROR"),
    (None, 0, "pass", 0, "ERROR"),
    ("pass", None, "pass", 0, "ERROR"),
    ("fail", -1, "pass", 0, "ERROR"),
    ("fail", 4, "pass", 0, "FAIL"),
    ("pass", 4, "pass", 0, "FAIL"),
    ("fail", 0, "pass", 0, "ERROR"),
    ("pass", 0, "fail", 1, "BLOCKED"),
    ("pass", 0, "pass", 1, "BLOCKED"),
    ("pass", 0, "not_executed", None, "BLOCKED"),
    ("pass", 0, "pass", 0, "PASS"),
    ("fail", 4, "fail", 1, "FAIL"),
]


@pytest.mark.parametrize(("status", "failed", "pre", "pre_failed", "result"), STATUS)
def test_status_machine(spark, status, failed, pre, pre_failed, result):
    df = spark.createDataFrame(
        [(status, failed, pre, pre_failed)],
        "dbt_status string, failed_rows bigint, prerequisite_status string, prerequisite_failures bigint",
    )
    assert Q.resolve_status(df).first()["check_result"] == result


# ---- reconciliation --------------------------------------------------------------

MART = "account_type string, current_balance decimal(15,2)"
GL = "gl_code string, account_type string, control_total decimal(15,2), record_count int, as_of_date date"


def mart(spark, *data):
    return spark.createDataFrame([(t, None if b is None else Decimal(b)) for t, b in data], MART)


def gl(spark, *data):
    return spark.createDataFrame([(c, t, None if v is None else Decimal(v), n, d) for c, t, v, n, d in data], GL)


def failures(m, g, expected=("CHECKING", "SAVINGS")):
    e = m.sparkSession.createDataFrame([(t,) for t in expected], "account_type string")
    return sorted((r.failure_reason, r.account_type) for r in Q.accuracy(m, g, e).collect())


GOOD_MART = (("CHECKING", "60.00"), ("CHECKING", "40.00"), ("SAVINGS", "10.00"))
CHECKING, SAVINGS = ("G1", "CHECKING", "100.00", 2, D1), ("G2", "SAVINGS", "10.00", 1, D1)
RECON = "ACCOUNT_TYPE_RECONCILIATION"


def test_accuracy_passes(spark):
    assert failures(mart(spark, *GOOD_MART), gl(spark, CHECKING, SAVINGS)) == []


@pytest.mark.parametrize(("total", "bad"), [("101.00", False), ("99.00", False), ("101.01", True), ("98.99", True)])
def test_accuracy_tolerance(spark, total, bad):
    got = failures(mart(spark, *GOOD_MART), gl(spark, ("G1", "CHECKING", total, 2, D1), SAVINGS))
    assert got == ([(RECON, "CHECKING")] if bad else [])


@pytest.mark.parametrize(
    ("controls", "expected"),
    [
        ((CHECKING,), [(RECON, "SAVINGS")]),
        ((CHECKING, CHECKING, SAVINGS), [(RECON, "CHECKING")]),
        ((CHECKING, SAVINGS, ("G3", "MONEY_MARKET", "1.00", 1, D1)), [(RECON, "MONEY_MARKET")]),
        ((CHECKING, ("G2", "SAVINGS", "10.00", 1, D2)), [(RECON, "SAVINGS"), ("INVALID_GL_SNAPSHOT", None)]),
        ((("G1", "CHECKING", None, 2, D1), SAVINGS), [(RECON, "CHECKING")]),
        (((None, "CHECKING", "100.00", 2, D1), SAVINGS), [(RECON, "CHECKING")]),
        ((("G1", "CHECKING", "100.00", 3, D1), SAVINGS), [(RECON, "CHECKING")]),
        ((("G1", "CHECKING", "100.00", None, D1), SAVINGS), [(RECON, "CHECKING")]),
        ((("G1", "CHECKING", "100.00", 2, None), SAVINGS), [(RECON, "CHECKING"), ("INVALID_GL_SNAPSHOT", None)]),
        ((CHECKING, SAVINGS, ("G4", None, "1.00", 1, D1)), [(RECON, None)]),
        ((), [(RECON, "CHECKING"), (RECON, "SAVINGS"), ("INVALID_GL_SNAPSHOT", None)]),
    ],
)
def test_accuracy_control_problems(spark, controls, expected):
    got = failures(mart(spark, *GOOD_MART), gl(spark, *controls))
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_accuracy_mart_problems(spark):
    g = gl(spark, CHECKING, SAVINGS)
    assert failures(mart(spark, ("CHECKING", "60.00"), ("CHECKING", "40.00")), g) == [(RECON, "SAVINGS")]
    assert failures(mart(spark, ("CHECKING", "100.00"), ("CHECKING", None), ("SAVINGS", "10.00")), g) == [(RECON, "CHECKING")]
    assert failures(mart(spark, *GOOD_MART, ("MONEY_MARKET", "1.00")), g) == [(RECON, "MONEY_MARKET")]


def test_single_snapshot_date(spark):
    one = lambda *c: Q.single_snapshot_date(gl(spark, *c)).first()[0]
    assert one(CHECKING, SAVINGS) == D1
    assert one(CHECKING, ("G2", "SAVINGS", "10.00", 1, D2)) is None
    assert one(CHECKING, ("G2", "SAVINGS", "10.00", 1, None)) is None
    assert one() is None


# ---- other dimensions ------------------------------------------------------------


@pytest.mark.parametrize(
    ("mart_days", "source_days", "fails"),
    [((D1, D2), (D1, D2), False), ((D1,), (D2,), True), ((), (D1,), True), ((None,), (D1,), True), ((D1,), (), True), ((D1,), (None,), True), ((None, D1), (D1,), False)],
)
def test_timeliness(spark, mart_days, source_days, fails):
    m = spark.createDataFrame([(d,) for d in mart_days], "latest date")
    s = spark.createDataFrame([(d,) for d in source_days], "day date")
    assert (Q.timeliness(m, "latest", s, "day").count() == 1) is fails


def test_validity_reasons(spark, rows):
    df = spark.createDataFrame(
        [(1, "PERSON", "123-45-6789"), (2, "PERSON", "12-3456789"), (3, "BUSINESS", "12-3456789"), (4, "BUSINESS", None), (5, None, "x"), (6, "TRUST", "x"), (7, "PERSON", "123-45-67890")],
        "account_id int, customer_type string, tax_id string",
    )
    out = Q.validity(df, "tax_id", "customer_type", Q.TAX_ID_FORMATS, ["account_id"])
    assert "tax_id" not in out.columns
    assert rows(out) == [
        (2, "INVALID_TAX_ID_FORMAT"), (4, "NULL_TAX_ID"), (5, "NULL_CUSTOMER_TYPE"), (6, "UNSUPPORTED_CUSTOMER_TYPE"), (7, "INVALID_TAX_ID_FORMAT")]


def test_null_handling_of_the_key_checks(spark, rows):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "k int")
    parent = spark.createDataFrame([(1,)], "k int")
    assert rows(Q.uniqueness(df, ["k"])) == [(1, 2), (None, 2)]
    assert rows(Q.unique(df, "k")) == [(1, 2)]
    assert rows(Q.key_not_unique(df, ["k"])) == [(1, 2), (None, 2)]
    assert rows(Q.consistency(df, parent, "k", ["k"])) == [(2,), (None,), (None,)]
    assert rows(Q.relationships(df, parent, "k")) == [(2,)]
    assert Q.not_null(df, "k").count() == 2
    assert Q.completeness(df, "k", ["k"]).count() == 2


def test_accepted_values_pass_null(spark, rows):
    df = spark.createDataFrame([("A",), ("B",), ("B",), (None,)], "v string")
    assert rows(Q.accepted_values(df, "v", ["A"])) == [("B", 2)]


def test_not_empty(spark):
    assert Q.not_empty(spark.range(1)).count() == 0
    assert Q.not_empty(spark.range(0)).first()[0] == 0


# ---- history ---------------------------------------------------------------------

RESULT = "invocation_id string, mart_name string, target_table string, check_dimension string, check_result string, executed_at timestamp_ntz"


def history(spark, run, results, day):
    return spark.sql(
        "select * from values " + ", ".join(
            f"({'null' if run is None else repr(run)}, 'M', 'M', '{d}', {'cast(null as string)' if r is None else repr(r)}, timestamp_ntz '2024-01-{day:02d} 00:00:00')" for d, r in results)
        + " as t(invocation_id, mart_name, target_table, check_dimension, check_result, executed_at)"
    )


ALL_PASS = [(d, "PASS") for d in Q.DIMENSIONS]


@pytest.mark.parametrize(
    ("results", "outcome"),
    [
        (ALL_PASS, "PASS"),
        (ALL_PASS[:5], "INCOMPLETE"),
        ([*ALL_PASS[:5], ("UNIQUENESS", "PASS")], "INCOMPLETE"),
        ([*ALL_PASS[:5], ("ACCURACY", "FAIL")], "NOT_PASSED"),
        ([*ALL_PASS[:5], ("ACCURACY", None)], "NOT_PASSED"),
    ],
)
def test_summary(spark, results, outcome):
    r = Q.dq_summary(history(spark, "r1", results, 1)).first()
    assert r.assessment_result == outcome
    assert r.unresolved == sum(1 for _, x in results if x is None)


def test_latest_rows_ignore_runs_without_an_id(spark):
    old = history(spark, "r1", ALL_PASS, 1)
    new = history(spark, "r2", [("ACCURACY", "FAIL")], 2)
    legacy = history(spark, None, [("ACCURACY", "PASS")], 3)
    out = R.latest_rows(R.union_all([old, new, legacy]), ["target_table"], "invocation_id", "executed_at")
    assert [r.invocation_id for r in out.collect()] == ["r2"]
    assert R.of_latest_run(R.union_all([old, new, legacy]), "invocation_id", "executed_at").count() == 1


def test_compare_keys_sees_duplicates(spark, rows):
    a = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int")
    b = spark.createDataFrame([(1,), (2,), (4,)], "k int")
    assert rows(R.compare_keys(a, b, ["k"])) == [(2, 2, 2, 1), (3, 1, None, None), (None, None, 4, 1)]
