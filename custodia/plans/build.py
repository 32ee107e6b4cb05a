"""The run order: raw -> staging -> marts -> checks -> results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields, replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.operators import checks as Q
from custodia.operators import relational as R
from custodia.plans import marts, staging
from custodia.sinks import store


@dataclass(frozen=True)
class Build:
    """The relations of one run; all lazy."""

    stg_account: DataFrame
    stg_customer: DataFrame
    stg_transaction: DataFrame
    stg_loan: DataFrame
    mart_deposits: DataFrame
    mart_customer_360: DataFrame


def build(raw: Mapping[str, DataFrame], as_of: datetime) -> Build:
    """Declare all models over the raw tables; Spark runs what is asked for."""
    account = staging.stg_account(raw["account"], as_of)
    customer = staging.stg_customer(raw["customer"], as_of)
    txn = staging.stg_transaction(raw["transaction"], as_of)
    loan = staging.stg_loan(raw["loan"], as_of)
    return Build(
        account,
        customer,
        txn,
        loan,
        marts.mart_deposits(account, customer, txn, as_of),
        marts.mart_customer_360(customer, account, txn, loan, as_of),
    )


def materialized(b: Build, folder: str, names: Sequence[str] | None = None) -> Build:
    """The same models read back from tables in ``folder``, each computed once.

    ``names`` limits it to the models that are needed; the others stay lazy.
    """
    wanted = [f.name for f in fields(b)] if names is None else names
    return replace(b, **{n: store.write_all(getattr(b, n), f"{folder.rstrip('/')}/{n}") for n in wanted})


def build_counts(b: Build) -> DataFrame:
    """Rows of every model after a run."""
    return R.labelled_counts(
        {
            "STG_ACCOUNT": b.stg_account,
            "STG_CUSTOMER": b.stg_customer,
            "STG_TRANSACTION": b.stg_transaction,
            "STG_LOAN": b.stg_loan,
            "MART_DEPOSITS": b.mart_deposits,
            "MART_CUSTOMER_360": b.mart_customer_360,
        }
    )


def failing_rows(b: Build, controls: DataFrame) -> dict[str, DataFrame]:
    """The six checks of the deposits mart, by dimension."""
    mart = b.mart_deposits
    eligible = marts.eligible_deposits(b.stg_account)
    dated = b.stg_transaction.join(eligible.select("account_id"), "account_id", "left_semi")
    return {
        "COMPLETENESS": Q.completeness(mart, "account_id", ["account_id", "customer_id", "account_type"]),
        "UNIQUENESS": Q.uniqueness(mart, ["account_id"]),
        "VALIDITY": Q.validity(mart, "tax_id", "customer_type", Q.TAX_ID_FORMATS, ["account_id", "customer_type"]),
        "CONSISTENCY": Q.consistency(mart, b.stg_customer, "customer_id", ["account_id", "customer_id"]),
        "TIMELINESS": Q.timeliness(mart, "latest_business_date", dated, "business_date"),
        "ACCURACY": Q.accuracy(mart, controls, eligible),
    }


def outcomes(b: Build, controls: DataFrame) -> DataFrame:
    """Failure count and status of each check, with the not-empty prerequisite.

    Checks on single rows are counted together in one pass; the others are one-row
    aggregates, all joined to the registry of six rules. Callers that
    keep the marts as tables pass a ``Build`` over those tables, so the models are not
    computed once per check.
    """
    spark = b.mart_deposits.sparkSession
    checks = failing_rows(b, controls)
    row_level = {
        "COMPLETENESS": F.col("account_id").isNull(),
        "VALIDITY": Q.invalid_reason("tax_id", "customer_type", Q.TAX_ID_FORMATS).isNotNull(),
    }
    measured = R.union_all(
        [Q.failure_counts(b.mart_deposits, row_level)]
        + [
            df.agg(F.count(F.lit(1)).alias("failed_rows")).select(F.lit(d).alias("check_dimension"), "failed_rows")
            for d, df in checks.items()
            if d not in row_level
        ]
    )
    empty = Q.not_empty(b.mart_deposits).agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        Q.registry_df(spark, Q.DEPOSITS_CHECKS)
        .join(measured, "check_dimension")
        .withColumn("dbt_status", F.when(F.col("failed_rows") == 0, "pass").otherwise("fail"))
        .withColumn("test_unique_id", F.concat(F.lit("test."), F.col("check_type")))
        .withColumn("failure_relation", F.concat(F.lit("GOVERNANCE.CATALOG."), F.upper("check_type")))
        .withColumn("prerequisite_failures", empty)
        .withColumn("prerequisite_status", F.when(F.col("prerequisite_failures") == 0, "pass").otherwise("fail"))
    )


def assess(b: Build, controls: DataFrame, run_id: str, as_of: datetime, executed_by: str = "SVC_PIPELINE") -> DataFrame:
    """Result rows of one assessment run, ready to be appended once."""
    return Q.result_rows(outcomes(b, controls), controls, run_id, ("ANALYTICS", "MARTS", "MART_DEPOSITS"), as_of, executed_by)
