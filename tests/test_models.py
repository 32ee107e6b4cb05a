from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from custodia.operators import checks
from custodia.plans import build, marts, staging

ACCOUNT = "account_id int, customer_id int, account_type string, account_number string, branch_code string, balance decimal(15,2), status string, opened_date date, created_at timestamp_ntz"
CUSTOMER = "customer_id int, first_name string, last_name string, customer_type string, tax_id string, date_of_birth date, email string, phone string, address string"
TXN = "transaction_id int, account_id int, transaction_type string, amount decimal(12,2), business_date date, memo string"
LOAN = "loan_id int, customer_id int, account_id int, loan_type string, principal decimal(15,2), interest_rate decimal(5,2), credit_grade string, collateral_value decimal(15,2), loan_memo string, status string, origination_date date"
D = date(2024, 1, 5)


@pytest.fixture
def raw(spark):
    def account(i, c, kind, status, balance="100.00"):
        return (i, c, kind, f"N{i}", "BR_01", Decimal(balance), status, D, None)

    return {
        "account": spark.createDataFrame(
            [account(1, 1, "CHECKING", "ACTIVE"), account(2, 1, "SAVINGS", "ACTIVE", "50.50"), account(3, 1, "SAVINGS", "CLOSED"),
             account(4, 2, "MONEY_MARKET", "ACTIVE"), account(5, 9, "CHECKING", "ACTIVE"), account(6, 2, "CHECKING", "INACTIVE")], ACCOUNT),
        "customer": spark.createDataFrame(
            [(1, "A", "X", "PERSON", "123-45-6789", D, "a@x.com", "p", "ad"), (2, "B", "Y", "BUSINESS", "12-3456789", D, "b@x.com", "p", "ad"),
             (3, "C", "Z", "TRUST", None, D, "c@x.com", "p", "ad"), (4, "D", "W", "PERSON", None, D, "d@x.com", "p", "ad")], CUSTOMER),
        "transaction": spark.createDataFrame(
            [(1, 1, "DEBIT", Decimal("10.00"), date(2024, 1, 1), None), (2, 1, "CREDIT", Decimal("3.00"), date(2024, 1, 9), None),
             (3, 1, "CREDIT", Decimal("0.00"), date(2024, 1, 20), None), (4, 1, "TRANSFER", Decimal("5.00"), date(2024, 1, 20), None),
             (5, 2, "CREDIT", Decimal("7.00"), None, None)], TXN),
        "loan": spark.createDataFrame(
            [(1, 1, 1, "HOME", Decimal("100.00"), Decimal("3.00"), "A", Decimal("9.00"), "m", "ACTIVE", D),
             (2, 1, 1, "HOME", Decimal("50.00"), Decimal("4.50"), "D", Decimal("1.00"), "m", "PAID_OFF", D),
             (3, 1, 1, "HOME", Decimal("0.00"), Decimal("9.00"), "A", Decimal("1.00"), "m", "ACTIVE", D),
             (4, 1, 1, "HOME", Decimal("10.00"), Decimal("9.00"), "E", Decimal("1.00"), "m", "ACTIVE", D),
             (5, 1, 1, "HOME", Decimal("10.00"), Decimal("9.00"), "A", Decimal("1.00"), "m", "SOLD", D)], LOAN),
    }


@pytest.fixture
def models(raw, as_of):
    return build.build(raw, as_of)


def test_staging_filters(models, rows):
    assert rows(models.stg_account.select("account_id")) == [(1,), (2,), (3,), (4,), (5,)]
    assert rows(models.stg_customer.select("customer_id")) == [(1,), (2,), (4,)]
    assert rows(models.stg_transaction.select("transaction_id")) == [(1,), (2,), (5,)]
    assert rows(models.stg_loan.select("loan_id")) == [(1,), (2,)]


def test_staging_columns(models):
    assert models.stg_account.columns == [
        "account_id", "customer_id", "account_number", "account_type", "status", "balance", "branch_code", "opened_date",
        "source_created_at", "source_table", "source_system", "dbt_loaded_at",
    ]
    r = models.stg_account.first()
    assert (r.source_table, r.source_system) == ("RAW.PUBLIC.ACCOUNT", "RAW")


def test_mart_deposits(models):
    mart = models.mart_deposits
    assert len(mart.columns) == 20
    got = {r.account_id: r for r in mart.collect()}
    assert sorted(got) == [1, 2, 5]
    assert (got[1].transaction_count, got[1].total_debits, got[1].total_credits, got[1].latest_business_date) == (2, Decimal("10.00"), Decimal("3.00"), date(2024, 1, 9))
    assert (got[2].transaction_count, got[2].latest_business_date) == (1, None)
    assert (got[5].transaction_count, got[5].total_debits, got[5].first_name, got[5].latest_business_date) == (0, 0, None, None)
    assert got[1].mart_name == "ANALYTICS.MARTS.MART_DEPOSITS"


def test_customer_360(models):
    mart = models.mart_customer_360
    assert len(mart.columns) == 28
    got = {r.customer_id: r for r in mart.collect()}
    assert sorted(got) == [1, 2, 4]
    one = got[1]
    assert (one.account_count, one.savings_count, one.checking_count, one.total_balance) == (3, 2, 1, Decimal("250.50"))
    assert (one.total_transactions, one.total_debits, one.total_credits) == (3, Decimal("10.00"), Decimal("10.00"))
    assert (one.loan_count, one.active_loans, one.paid_off_loans, one.defaulted_loans, one.total_loan_amount) == (2, 1, 1, 0, Decimal("150.00"))
    assert float(one.avg_interest_rate) == 3.75
    assert (got[2].total_transactions, got[2].total_debits, got[2].loan_count, got[2].avg_interest_rate) == (0, 0, 0, None)
    assert (got[4].account_count, got[4].total_transactions) == (0, 0)


def test_fused_portfolio_equals_its_parts(models, rows):
    account, txn = models.stg_account, models.stg_transaction
    parts = marts.customer_accounts(account).join(marts.customer_transactions(account, txn), "customer_id")
    assert rows(parts) == rows(marts.customer_portfolio(account, txn))


def test_assessment_of_the_build(models, as_of):
    controls = marts.derive_gl_controls(models.stg_account, "2024-01-31")
    got = {r.check_dimension: r for r in build.assess(models, controls, "run-1", as_of).collect()}
    assert {d: r.failed_rows for d, r in got.items()} == {
        "COMPLETENESS": 0, "UNIQUENESS": 0, "VALIDITY": 1, "CONSISTENCY": 1, "TIMELINESS": 0, "ACCURACY": 0}
    assert got["VALIDITY"].check_result == "FAIL"
    assert got["ACCURACY"].check_result == "PASS"
    assert got["ACCURACY"].snapshot_date == date(2024, 1, 31)
    assert got["TIMELINESS"].snapshot_date is None


def test_assessment_of_an_empty_mart_is_blocked(raw, as_of):
    none = dict(raw, account=raw["account"].limit(0))
    models = build.build(none, as_of)
    got = {r.check_dimension: r.check_result for r in build.assess(models, marts.derive_gl_controls(raw["account"], "2024-01-31"), "r", as_of).collect()}
    assert got["COMPLETENESS"] == "BLOCKED"
    assert got["TIMELINESS"] == "FAIL"
    assert got["ACCURACY"] == "FAIL"


def test_hot_account_counts_every_transaction(spark, raw, as_of):
    """A third of all transactions on one account, the rest spread out."""
    n = 3000
    txn = spark.range(n).select(
        F.col("id").cast("int").alias("transaction_id"),
        F.when(F.col("id") % 3 == 0, 1).otherwise((F.col("id") % 4 + 2)).cast("int").alias("account_id"),
        F.lit("DEBIT").alias("transaction_type"), F.lit(Decimal("1.00")).cast("decimal(12,2)").alias("amount"),
        F.lit(D).alias("business_date"), F.lit(None).cast("string").alias("memo"))
    account = staging.stg_account(raw["account"], as_of)
    mart = marts.mart_deposits(account, staging.stg_customer(raw["customer"], as_of), staging.stg_transaction(txn, as_of), as_of)
    assert mart.filter("account_id = 1").first()["transaction_count"] == n // 3


def test_registry_needs_one_check_per_dimension():
    checks.validate_registry(checks.DEPOSITS_CHECKS)
    with pytest.raises(ValueError, match="exactly one"):
        checks.validate_registry(checks.DEPOSITS_CHECKS[:5])
    with pytest.raises(ValueError, match="exactly one"):
        checks.validate_registry([*checks.DEPOSITS_CHECKS[:5], checks.DEPOSITS_CHECKS[0]])
