"""Staging tables: explicit columns, validity filter, audit columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Accepted domains, and the columns each staging table carries.
ACCOUNT_STATUSES = ("ACTIVE", "CLOSED")
CUSTOMER_TYPES = ("PERSON", "BUSINESS")
TRANSACTION_TYPES = ("DEBIT", "CREDIT")
LOAN_GRADES = ("A", "B", "C", "D")
LOAN_STATUSES = ("ACTIVE", "DEFAULTED", "PAID_OFF")

ACCOUNT_COLUMNS = ["account_id", "customer_id", "account_number", "account_type", "status", "balance", "branch_code", "opened_date", "created_at"]
CUSTOMER_COLUMNS = ["customer_id", "first_name", "last_name", "email", "phone", "tax_id", "date_of_birth", "address", "customer_type", "created_at"]
TRANSACTION_COLUMNS = ["transaction_id", "account_id", "business_date", "transaction_type", "amount", "memo", "created_at"]
LOAN_COLUMNS = ["loan_id", "customer_id", "account_id", "principal", "loan_type", "status", "interest_rate", "origination_date", "collateral_value", "credit_grade", "loan_memo"]


def stage(
    df: DataFrame,
    columns: Sequence[str],
    source_table: str,
    as_of: datetime,
    renames: Mapping[str, str] | None = None,
    source_system: str = "RAW",
) -> DataFrame:
    """Project the listed columns the input has, rename, and add the audit columns."""
    renames = renames or {"created_at": "source_created_at"}
    return df.select(
        *[F.col(c).alias(renames.get(c, c)) for c in columns if c in df.columns],
        F.lit(source_table).alias("source_table"),
        F.lit(source_system).alias("source_system"),
        F.lit(as_of).alias("dbt_loaded_at"),
    )


def stg_account(account: DataFrame, as_of: datetime) -> DataFrame:
    kept = account.filter(F.col("status").isin(*ACCOUNT_STATUSES))
    return stage(kept, ACCOUNT_COLUMNS, "RAW.PUBLIC.ACCOUNT", as_of)


def stg_customer(customer: DataFrame, as_of: datetime) -> DataFrame:
    kept = customer.filter(F.col("customer_type").isin(*CUSTOMER_TYPES))
    return stage(kept, CUSTOMER_COLUMNS, "RAW.PUBLIC.CUSTOMER", as_of)


def stg_transaction(transaction: DataFrame, as_of: datetime) -> DataFrame:
    kept = transaction.filter((F.col("amount") > 0) & F.col("transaction_type").isin(*TRANSACTION_TYPES))
    return stage(kept, TRANSACTION_COLUMNS, "RAW.PUBLIC.TRANSACTION", as_of)


def stg_loan(loan: DataFrame, as_of: datetime) -> DataFrame:
    kept = loan.filter(
        (F.col("principal") > 0)
        & F.col("credit_grade").isin(*LOAN_GRADES)
        & F.col("status").isin(*LOAN_STATUSES)
    )
    return stage(kept, LOAN_COLUMNS, "RAW.PUBLIC.LOAN", as_of)
