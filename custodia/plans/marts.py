"""Marts: the deposits snapshot and the customer 360 view.

Facts are aggregated to their join key before they are joined. An account or a
customer that holds a large share of all rows is collapsed by the map-side
aggregate, so the joins see one row per key and no key can be hot.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The population and the name of the deposits mart.
DEPOSIT_TYPES = ("CHECKING", "SAVINGS")
MART_DEPOSITS = "ANALYTICS.MARTS.MART_DEPOSITS"


def _is(column: str, value: str) -> Column:
    return F.col(column) == value


def _amount_of(kind: str) -> Column:
    return F.sum(F.when(_is("transaction_type", kind), F.col("amount")).otherwise(F.lit(0)))


def account_transactions(txn: DataFrame) -> DataFrame:
    """Per account: latest date, number of transactions, debit and credit totals."""
    return txn.groupBy("account_id").agg(
        F.max("business_date").alias("latest_business_date"),
        F.count(F.lit(1)).alias("transaction_count"),
        _amount_of("DEBIT").alias("total_debits"),
        _amount_of("CREDIT").alias("total_credits"),
    )


def eligible_deposits(account: DataFrame) -> DataFrame:
    return account.filter(F.col("account_type").isin(*DEPOSIT_TYPES) & _is("status", "ACTIVE"))


def mart_deposits(account: DataFrame, customer: DataFrame, txn: DataFrame, as_of: datetime) -> DataFrame:
    """One row per ACTIVE checking or savings account of the staged accounts.

    0 for no transactions, NULL for no dated one. The account keys are unique, so the
    first join has no hot key; the customer join comes last, where adaptive execution
    may split a hot customer's accounts because nothing above needs its partitioning.
    """
    a = eligible_deposits(account).select(
        "account_id", "customer_id", "account_number", "account_type", "status", "branch_code", "opened_date",
        F.col("balance").alias("current_balance"),
    )
    t = account_transactions(txn)
    c = customer.select("customer_id", "first_name", "last_name", "email", "customer_type", "tax_id")
    joined = a.join(t, "account_id", "left").join(c, "customer_id", "left")
    return joined.select(
        "account_id", "customer_id", "account_number",
        "account_type", "status", "branch_code", "opened_date",
        "current_balance",
        "first_name", "last_name", "email", "customer_type", "tax_id",
        "latest_business_date",
        F.lit(MART_DEPOSITS).alias("mart_name"),
        F.coalesce("transaction_count", F.lit(0)).alias("transaction_count"),
        F.coalesce("total_debits", F.lit(0)).alias("total_debits"),
        F.coalesce("total_credits", F.lit(0)).alias("total_credits"),
        F.lit(as_of).alias("dbt_refreshed_at"),
        F.to_date(F.lit(as_of)).alias("dbt_business_date"),
    )


def _account_measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("account_count"),
        F.count_if(_is("account_type", "SAVINGS")).alias("savings_count"),
        F.count_if(_is("account_type", "CHECKING")).alias("checking_count"),
        F.sum("balance").alias("total_balance"),
        F.max("opened_date").alias("most_recent_account_opened"),
    ]


def _transaction_measures() -> list[Column]:
    zero = F.lit(0)
    return [
        F.sum(F.coalesce("n", zero)).alias("total_transactions"),
        F.max("latest").alias("latest_business_date"),
        F.sum(F.coalesce("debits", zero)).alias("total_debits"),
        F.sum(F.coalesce("credits", zero)).alias("total_credits"),
    ]


def _accounts_with_activity(account: DataFrame, txn: DataFrame) -> DataFrame:
    """Accounts with their transactions already counted: one row per account, not per transaction."""
    per_account = txn.groupBy("account_id").agg(
        F.count("transaction_id").alias("n"),
        F.max("business_date").alias("latest"),
        _amount_of("DEBIT").alias("debits"),
        _amount_of("CREDIT").alias("credits"),
    )
    return account.join(per_account, "account_id", "left")


def customer_accounts(account: DataFrame) -> DataFrame:
    """Per customer: accounts, by type, total balance, latest opening."""
    return account.groupBy("customer_id").agg(*_account_measures())


def customer_transactions(account: DataFrame, txn: DataFrame) -> DataFrame:
    """Per customer with an account: transactions over all its accounts, 0 when none."""
    return _accounts_with_activity(account, txn).groupBy("customer_id").agg(*_transaction_measures())


def customer_portfolio(account: DataFrame, txn: DataFrame) -> DataFrame:
    """Both of the above from one join and one grouping."""
    joined = _accounts_with_activity(account, txn)
    return joined.groupBy("customer_id").agg(*_account_measures(), *_transaction_measures())


def customer_loans(loan: DataFrame) -> DataFrame:
    """Per customer: loans by status, amounts, average rate, latest origination."""
    return loan.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("loan_count"),
        F.count_if(_is("status", "ACTIVE")).alias("active_loans"),
        F.count_if(_is("status", "PAID_OFF")).alias("paid_off_loans"),
        F.count_if(_is("status", "DEFAULTED")).alias("defaulted_loans"),
        F.sum("principal").alias("total_loan_amount"),
        F.avg("interest_rate").alias("avg_interest_rate"),
        F.sum("collateral_value").alias("total_collateral_value"),
        F.max("origination_date").alias("most_recent_loan_date"),
    )


def mart_customer_360(
    customer: DataFrame, account: DataFrame, txn: DataFrame, loan: DataFrame, as_of: datetime
) -> DataFrame:
    """One row per customer with account, transaction and loan roll-ups.

    Accounts and transactions are rolled up together, and all inputs are keyed by
    customer_id when they meet, so the joins share one partitioning.
    """
    joined = customer.join(customer_portfolio(account, txn), "customer_id", "left").join(
        customer_loans(loan), "customer_id", "left"
    )
    counted = [
        "account_count", "savings_count", "checking_count", "total_balance",
        "total_transactions", "total_debits", "total_credits",
        "loan_count", "active_loans", "paid_off_loans", "defaulted_loans",
        "total_loan_amount", "total_collateral_value",
    ]
    return joined.select(
        "customer_id", "first_name", "last_name", "email", "phone", "tax_id", "date_of_birth", "customer_type", "address",
        "most_recent_account_opened", "latest_business_date", "avg_interest_rate", "most_recent_loan_date",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counted],
        F.lit(as_of).alias("dbt_refreshed_at"),
        F.to_date(F.lit(as_of)).alias("dbt_business_date"),
    )


def derive_gl_controls(account: DataFrame, as_of_date: str) -> DataFrame:
    """Control totals per account type of the eligible population."""
    return (
        eligible_deposits(account)
        .groupBy("account_type")
        .agg(F.sum("balance").alias("control_total"), F.count(F.lit(1)).cast("int").alias("record_count"))
        .select(
            F.concat(F.lit("GL_"), F.col("account_type")).alias("gl_code"),
            "account_type",
            F.col("control_total").cast("decimal(38,2)").alias("control_total"),
            "record_count",
            F.lit(as_of_date).cast("date").alias("as_of_date"),
        )
    )
