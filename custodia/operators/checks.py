"""Data-quality checks. A check is a DataFrame of failing rows; no rows means it passed."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia.functions import predicates as P
from custodia.functions import scalars as S
from custodia.operators import relational as R
from custodia.sources.values import values_df

# The six dimensions, tax-id formats and the reconciliation tolerance.
DIMENSIONS = ("COMPLETENESS", "UNIQUENESS", "VALIDITY", "CONSISTENCY", "TIMELINESS", "ACCURACY")
TAX_ID_FORMATS = {
    "PERSON": "[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "BUSINESS": "[0-9]{2}-[0-9]{7}",
}
TOLERANCE = "1.00"


# ---- generic column checks -------------------------------------------------------


def completeness(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """Rows in which a key element is NULL."""
    return df.filter(F.col(column).isNull()).select(*keep)


def uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per repeated key with its count; NULL is a key like any other."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrence_count")).filter("occurrence_count > 1")


def unique(df: DataFrame, column: str) -> DataFrame:
    """Repeated values of one column, NULLs ignored."""
    return uniqueness(df.filter(F.col(column).isNotNull()), [column])


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def accepted_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Values outside the domain with their counts; NULL passes."""
    return df.filter(~F.col(column).isin(*values)).groupBy(column).agg(F.count(F.lit(1)).alias("n_records"))


def relationships(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows with a key that the parent lacks; NULL keys pass."""
    return R.orphans(child.filter(F.col(key).isNotNull()), parent, key, parent_key)


def not_empty(df: DataFrame, alias: str = "mart_row_count") -> DataFrame:
    """One row when the relation has none."""
    return df.agg(F.count(F.lit(1)).alias(alias)).filter(F.col(alias) == 0)


def key_not_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that repeat or have a NULL part."""
    bad = F.col("occurrence_count") > 1
    for k in keys:
        bad = bad | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrence_count")).filter(bad)


def failure_counts(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Failing rows of many row-level checks from one pass, as (check_dimension, failed_rows)."""
    row = df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])
    pairs = [F.struct(F.lit(n).alias("check_dimension"), F.col(n).alias("failed_rows")) for n in conditions]
    return row.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


# ---- the six dimensions ----------------------------------------------------------


def invalid_reason(column: str, by: str, patterns: Mapping[str, str]) -> Column:
    """Why a value does not have the format its type asks for; NULL when it has."""
    c, b = F.col(column), F.col(by)
    return (
        F.when(b.isNull(), F.lit(f"NULL_{by.upper()}"))
        .when(~b.isin(*patterns), F.lit(f"UNSUPPORTED_{by.upper()}"))
        .when(c.isNull(), F.lit(f"NULL_{column.upper()}"))
        .when(~P.format_ok(c, b, patterns), F.lit(f"INVALID_{column.upper()}_FORMAT"))
    )


def validity(
    df: DataFrame, column: str, by: str, patterns: Mapping[str, str], keep: Sequence[str]
) -> DataFrame:
    """Rows whose value does not have the format its type asks for, with a reason.

    The value itself stays out of the evidence.
    """
    return df.withColumn("failure_reason", invalid_reason(column, by, patterns)).filter(F.col("failure_reason").isNotNull()).select(*keep, "failure_reason")


def consistency(child: DataFrame, parent: DataFrame, key: str, keep: Sequence[str]) -> DataFrame:
    """Rows whose foreign key resolves to nothing, NULL keys included."""
    return R.orphans(child, parent, key).select(*keep)


def timeliness(mart: DataFrame, mart_clock: str, source: DataFrame, source_clock: str) -> DataFrame:
    """One row when the watermarks of mart and source differ, are NULL, or the mart is empty.

    Both watermarks are single rows of a union that is aggregated once more, so no join
    is needed to bring them together.
    """
    none = F.lit(None)
    m = mart.agg(F.count(F.lit(1)).alias("mart_rows"), F.max(mart_clock).alias(f"mart_{mart_clock}")).withColumn(
        f"source_{mart_clock}", none.cast("date")
    )
    s = source.agg(F.max(source_clock).alias(f"source_{mart_clock}")).select(
        F.lit(0).cast("bigint").alias("mart_rows"), none.cast("date").alias(f"mart_{mart_clock}"), f"source_{mart_clock}"
    )
    both = m.unionByName(s).agg(
        F.sum("mart_rows").alias("mart_rows"),
        F.max(f"mart_{mart_clock}").alias(f"mart_{mart_clock}"),
        F.max(f"source_{mart_clock}").alias(f"source_{mart_clock}"),
    )
    same = F.col(f"mart_{mart_clock}") == F.col(f"source_{mart_clock}")
    return both.filter((F.col("mart_rows") == 0) | ~F.coalesce(same, F.lit(False)))


@dataclass(frozen=True)
class Ledger:
    """What a control table states about a dataset: which columns hold the group, its total, its row count and the day.

    ``required`` are the fields that a usable control row fills; ``measure`` is the dataset's column that must add up to ``total``.
    """

    group: str = "account_type"
    measure: str = "current_balance"
    total: str = "control_total"
    rows: str = "record_count"
    day: str = "as_of_date"
    required: Sequence[str] = ("gl_code", "control_total", "record_count", "as_of_date")


DEPOSITS_LEDGER = Ledger()


def control_day(controls: DataFrame, day: str = "as_of_date") -> DataFrame:
    """One row: the control table's rows, its first day, and whether all of them are of that day (false without rows)."""
    return controls.agg(
        F.count(F.lit(1)).alias("control_rows"),
        F.min(day).alias("snapshot_date"),
        F.coalesce(F.bool_and(F.col(day).isNotNull()) & (F.min(day) == F.max(day)), F.lit(False)).alias("is_single"),
    )


def balance_totals(mart: DataFrame, ledger: Ledger = DEPOSITS_LEDGER) -> DataFrame:
    """What the dataset holds per group: rows, filled measures, their total."""
    return mart.groupBy(ledger.group).agg(
        F.count(F.lit(1)).alias("mart_rows"),
        F.count(ledger.measure).alias("non_null_balances"),
        F.sum(ledger.measure).alias("mart_total_balance"),
    )


def control_totals(controls: DataFrame, ledger: Ledger = DEPOSITS_LEDGER) -> DataFrame:
    """What the control table states per group, and how many of its rows leave a required field empty."""
    filled = F.lit(True)
    for field in ledger.required:
        filled = filled & F.col(field).isNotNull()
    return controls.groupBy(ledger.group).agg(
        F.count(F.lit(1)).alias("control_rows"),
        F.count_if(~filled).alias("unfilled_rows"),
        *[F.min(c).alias(name) for c, name in ((ledger.day, "control_date"), (ledger.total, "control_total"), (ledger.rows, "record_count"))],
    )


def reconciliation(mart: DataFrame, controls: DataFrame, expected_types: DataFrame, ledger: Ledger = DEPOSITS_LEDGER) -> DataFrame:
    """Expected groups, the dataset's totals and the control's side by side, one row per group.

    Each input is read once and reduced to one row per group; the three sets of rows are
    stacked and grouped once more, so no join is needed whatever the dataset's size. A NULL
    group has no totals, as it would join nothing.
    """
    group = F.col(ledger.group)
    expected = expected_types.select(ledger.group).distinct().withColumn("expected_type", group)
    stacked = R.union_all([expected, balance_totals(mart, ledger), control_totals(controls, ledger)])
    side_by_side = stacked.groupBy(ledger.group).agg(
        *[F.max(F.when(group.isNotNull(), F.col(c))).alias(c) for c in stacked.columns if c != ledger.group]
    )
    return side_by_side.withColumns({
        "snapshot_date": control_day(controls, ledger.day).select("snapshot_date").scalar(),
        "reconciliation_difference": F.abs(F.col("mart_total_balance") - F.col("control_total")),
    })


def reconciliation_rules(tolerance: str = TOLERANCE) -> dict[str, Column]:
    """What must hold for a row of ``reconciliation``, by name. A rule that is NULL does not hold."""
    c = F.col
    return {
        "EXPECTED": c("expected_type").isNotNull(),
        "PRESENT": c("mart_rows") > 0,
        "ONE_CONTROL_ROW": c("control_rows") == 1,
        "CONTROL_FILLED": c("unfilled_rows") == 0,
        "CONTROL_OF_THE_DAY": c("control_date") == c("snapshot_date"),
        "MEASURE_FILLED": c("non_null_balances") == c("mart_rows"),
        "ROWS_AGREE": c("record_count") == c("mart_rows"),
        "TOTAL_AGREES": ~P.outside(c("mart_total_balance"), c("control_total"), tolerance),
    }


def broken_rules(
    mart: DataFrame, controls: DataFrame, expected_types: DataFrame, tolerance: str = TOLERANCE, ledger: Ledger = DEPOSITS_LEDGER
) -> DataFrame:
    """The groups that do not reconcile, with the names of the rules they break in ``broken_rules``."""
    named = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in reconciliation_rules(tolerance).items()]
    return (
        reconciliation(mart, controls, expected_types, ledger)
        .withColumn("broken_rules", F.array_compact(F.array(*named)))
        .filter(F.size("broken_rules") > 0)
    )


# The columns of an accuracy finding; a finding about the snapshot leaves those of a group empty.
FINDING = {
    "snapshot_date": "date", "control_rows": "bigint", "mart_rows": "bigint", "record_count": "bigint",
    "mart_total_balance": "decimal(38,2)", "control_total": "decimal(38,2)", "reconciliation_difference": "decimal(38,2)",
}


def accuracy(
    mart: DataFrame, controls: DataFrame, expected_types: DataFrame, tolerance: str = TOLERANCE, ledger: Ledger = DEPOSITS_LEDGER
) -> DataFrame:
    """A control table that is not of one day, and the groups that do not reconcile to their control row."""

    def finding(reason: str, df: DataFrame, known: Sequence[str]) -> DataFrame:
        return df.select(
            F.lit(reason).alias("failure_reason"),
            (F.col(ledger.group) if ledger.group in known else F.lit(None)).cast("string").alias(ledger.group),
            *[(F.col(n) if n in known else F.lit(None)).cast(t).alias(n) for n, t in FINDING.items()],
        )

    snapshot = control_day(controls, ledger.day).filter(~F.col("is_single"))
    groups = broken_rules(mart, controls, expected_types, tolerance, ledger)
    return finding("INVALID_GL_SNAPSHOT", snapshot, ["control_rows"]).unionByName(
        finding("ACCOUNT_TYPE_RECONCILIATION", groups, [ledger.group, *FINDING])
    )


# ---- registry, outcomes, history -------------------------------------------------


@dataclass(frozen=True)
class Check:
    """What is recorded about a check besides its outcome."""

    name: str
    dimension: str
    target_column: str
    failure_unit: str


# The deposits assessment, one check per dimension.
DEPOSITS_CHECKS = (
    Check("test_mart_deposits_completeness", "COMPLETENESS", "ACCOUNT_ID", "MART_ROW"),
    Check("test_mart_deposits_uniqueness", "UNIQUENESS", "ACCOUNT_ID", "DUPLICATED_KEY"),
    Check("test_mart_deposits_validity", "VALIDITY", "TAX_ID,CUSTOMER_TYPE", "MART_ROW"),
    Check("test_mart_deposits_consistency", "CONSISTENCY", "CUSTOMER_ID", "MART_ROW"),
    Check("test_mart_deposits_timeliness", "TIMELINESS", "LATEST_BUSINESS_DATE", "DATASET_COMPARISON"),
    Check("test_mart_deposits_accuracy", "ACCURACY", "CURRENT_BALANCE,ACCOUNT_TYPE", "RECONCILIATION_ISSUE"),
)


def validate_registry(checks: Sequence[Check]) -> None:
    """Exactly one check per dimension, or the assessment is refused."""
    if Counter(c.dimension for c in checks) != Counter(DIMENSIONS):
        raise ValueError("an assessment needs exactly one check for each of the six dimensions")


def registry_df(spark: SparkSession, checks: Sequence[Check]) -> DataFrame:
    validate_registry(checks)
    return values_df(
        spark,
        [(c.name, c.dimension, c.target_column, c.failure_unit) for c in checks],
        "check_type string, check_dimension string, target_column string, failure_unit string",
    )


def resolve_status(outcomes: DataFrame) -> DataFrame:
    """Turn a runner's outcome into a check result; the first matching rule wins.

    Input: dbt_status, failed_rows, prerequisite_status, prerequisite_failures.
    """
    status, failed = F.col("dbt_status"), F.col("failed_rows")
    ready = F.coalesce((F.col("prerequisite_status") == "pass") & (F.col("prerequisite_failures") == 0), F.lit(False))
    ran = F.coalesce(status.isin("pass", "fail"), F.lit(False))
    return outcomes.withColumn(
        "check_result",
        F.when(status.isin("not_executed", "skipped"), "NOT_EXECUTED")
        .when(~ran | failed.isNull() | (failed < 0), "ERROR")
        .when(failed > 0, "FAIL")
        .when(status != "pass", "ERROR")
        .when(~ready, "BLOCKED")
        .otherwise("PASS"),
    )


def single_snapshot_date(controls: DataFrame) -> DataFrame:
    """The control table's date if it is the only one and never NULL, else NULL."""
    return control_day(controls).select(F.when(F.col("is_single"), F.col("snapshot_date")).alias("snapshot_date"))


def result_rows(
    outcomes: DataFrame,
    controls: DataFrame,
    run_id: str,
    mart: tuple[str, str, str],
    as_of: datetime,
    executed_by: str,
) -> DataFrame:
    """Result rows of one run: id, status, the snapshot date for ACCURACY, and provenance.

    ``outcomes``: test_unique_id, check_type, check_dimension, target_column,
    failure_unit, dbt_status, failed_rows, failure_relation, prerequisite_*. ``mart`` is the
    full name, so that marts of one name in two schemas keep their own results.
    """
    database, schema, mart_name = mart
    ran = F.col("dbt_status").isin("pass", "fail")
    dated = (F.col("check_dimension") == "ACCURACY") & ran & F.col("failed_rows").isNotNull()
    shown = F.coalesce(F.col("prerequisite_failures").cast("string"), F.lit("None"))
    out = resolve_status(outcomes.withColumn("failed_rows", F.when(ran, F.col("failed_rows"))))
    return out.select(
        S.key_id(F.lit(run_id), F.col("test_unique_id")).alias("dq_result_id"),
        F.lit(run_id).alias("invocation_id"),
        "test_unique_id",
        F.lit(mart_name).alias("mart_name"),
        "check_dimension",
        "check_type",
        F.lit(database).alias("target_database"),
        F.lit(schema).alias("target_schema"),
        F.lit(mart_name).alias("target_table"),
        "target_column",
        "check_result",
        "dbt_status",
        "failed_rows",
        "failure_unit",
        F.when(dated, single_snapshot_date(controls).scalar()).alias("snapshot_date"),
        F.when(ran, F.col("failure_relation")).alias("failure_relation"),
        F.concat(
            F.lit("Empty-mart prerequisite: "), F.col("prerequisite_status"), F.lit("; failures="), shown, F.lit(".")
        ).alias("details"),
        F.lit(as_of).alias("executed_at"),
        F.lit(executed_by).alias("executed_by"),
    )


# ---- reading the history ---------------------------------------------------------

TARGET = ["target_database", "target_schema", "target_table"]


def not_passed(result: str = "check_result"):
    """NULL is not a pass; every reader of the history uses this one rule."""
    return ~F.coalesce(F.upper(result) == "PASS", F.lit(False))


def dq_summary(results: DataFrame) -> DataFrame:
    """Per run: checks, dimensions, outcomes, and the assessment result."""
    c = F.col
    unresolved = c("check_result").isin("ERROR", "NOT_EXECUTED", "BLOCKED") | c("check_result").isNull()
    return (
        results.filter(c("invocation_id").isNotNull())
        .groupBy("invocation_id", "mart_name")
        .agg(
            F.count(F.lit(1)).alias("checks_recorded"),
            F.count_distinct("check_dimension").alias("dimensions_recorded"),
            F.count_if(c("check_result") == "PASS").alias("passed"),
            F.count_if(c("check_result") == "FAIL").alias("failed"),
            F.count_if(unresolved).alias("unresolved"),
            F.max("executed_at").alias("executed_at"),
        )
        .withColumn(
            "assessment_result",
            F.when((c("checks_recorded") != 6) | (c("dimensions_recorded") != 6), "INCOMPLETE")
            .when(c("passed") == 6, "PASS")
            .otherwise("NOT_PASSED"),
        )
    )


def dq_framework(results: DataFrame) -> DataFrame:
    """The rules and units recorded for each run."""
    return results.filter(F.col("invocation_id").isNotNull()).select(
        "invocation_id", "mart_name", "check_dimension", "check_type", "target_table", "target_column",
        "failure_unit", "dbt_status", "check_result",
    )


def dimension_counts(results: DataFrame) -> DataFrame:
    """Run and dimension pairs that do not have exactly one result."""
    return (
        results.groupBy("invocation_id", "check_dimension")
        .agg(F.count(F.lit(1)).alias("result_count"))
        .filter("result_count <> 1")
    )


def dimension_coverage(results: DataFrame, keys: Sequence[str] = ("invocation_id",)) -> DataFrame:
    """Dimensions required, present and passing."""
    dim = F.upper("check_dimension")
    known = results.filter(dim.isin(*DIMENSIONS))
    return known.groupBy(*keys).agg(
        F.lit(len(DIMENSIONS)).alias("required_dimensions"),
        F.count_distinct(dim).alias("present_dimensions"),
        F.count_distinct(F.when(F.upper("check_result") == "PASS", dim)).alias("passing_dimensions"),
    )


def run_counts(results: DataFrame) -> DataFrame:
    """History of runs, the legacy group without a run id included."""
    return results.groupBy("invocation_id").agg(
        F.count(F.lit(1)).alias("result_count"),
        F.count_distinct("check_dimension").alias("dimension_count"),
        F.count_if(F.col("check_result") == "PASS").alias("pass_count"),
        F.max("executed_at").alias("executed_at"),
    )


# ---- foundation validations ------------------------------------------------------


def domain_by_layer(layers: Mapping[str, DataFrame], column: str) -> DataFrame:
    """Row count of every value, per layer."""
    return R.union_all(
        [
            df.groupBy(column).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("layer"), column, "row_count")
            for name, df in layers.items()
        ]
    )


def invalid_domain_by_layer(layers: Mapping[str, DataFrame], column: str, values: Sequence[str]) -> DataFrame:
    """The same for values outside the domain, NULL included."""
    bad = {n: df.filter(P.not_in_domain(F.col(column), values)) for n, df in layers.items()}
    return domain_by_layer(bad, column).withColumnRenamed("row_count", "invalid_rows")


def missing_controls(eligible: DataFrame, controls: DataFrame) -> DataFrame:
    """Eligible account types without a control row."""
    return R.orphans(eligible.select("account_type").distinct(), controls, "account_type")


def attributes_off(mart: DataFrame, types: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Mart rows that no longer meet the eligibility rule."""
    c = F.col
    off = P.not_in_domain(c("status"), ["ACTIVE"]) | P.not_in_domain(c("account_type"), types)
    return mart.filter(off).select(*keep)
