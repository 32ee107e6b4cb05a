"""Data-quality checks, outcomes, history and foundation validations."""

from __future__ import annotations

from pyspark.sql import functions as F

from custodia.operators import checks as Q
from custodia.operators import relational as R
from custodia.plans import build as B
from custodia.plans import marts as M
from custodia.queries.bank import VALIDITY_SQL, models
from custodia.queries.inputs import AS_OF, Inputs
from custodia.queries.registry import VIEWS, query
from custodia.session import cut, scratch_path
from custodia.sinks import store

NOW = "timestamp '2024-01-31 00:00:00'"

query("q01_completeness", lambda i: Q.completeness(i.mart_deposits, "account_id", ["account_id", "customer_id", "account_type"]),
      "select account_id, customer_id, account_type from {mart_deposits} where account_id is null")
query("q01_completeness_tax_id", lambda i: Q.completeness(i.mart_deposits, "tax_id", ["account_id", "customer_id"]),
      "select account_id, customer_id from {mart_deposits} where tax_id is null")
query("q02_uniqueness", lambda i: Q.uniqueness(i.mart_deposits, ["account_id"]),
      "select account_id, count(*) as occurrence_count from {mart_deposits} group by 1 having count(*) > 1")
query("q02_uniqueness_transaction", lambda i: Q.uniqueness(i.raw_transaction, ["transaction_id"]),
      "select transaction_id, count(*) as occurrence_count from {raw_transaction} group by 1 having count(*) > 1")
query("q03_validity", lambda i: Q.validity(i.mart_deposits, "tax_id", "customer_type", Q.TAX_ID_FORMATS, ["account_id", "customer_type"]), VALIDITY_SQL)
query("q04_consistency", lambda i: Q.consistency(i.mart_deposits, i.stg_customer, "customer_id", ["account_id", "customer_id"]),
      "select m.account_id, m.customer_id from {mart_deposits} m where not exists (select 1 from {stg_customer} c where c.customer_id = m.customer_id)")
WATERMARK = """with m as (select count(*) as mart_rows, max(latest_business_date) as d from {mart_deposits}), s as (select max(SOURCE) as d from FROM)
select m.mart_rows, cast(m.d as varchar) as mart_latest_business_date, cast(s.d as varchar) as source_latest_business_date from m, s
where m.mart_rows = 0 or s.d is null or m.d is null or m.d <> s.d"""
query("q05_timeliness",
      lambda i: Q.timeliness(i.mart_deposits, "latest_business_date", i.stg_transaction.join(M.eligible_deposits(i.stg_account), "account_id", "left_semi"), "business_date"),
      WATERMARK.replace("SOURCE", "t.business_date").replace("FROM", "{stg_transaction} t join {stg_account} a on t.account_id = a.account_id where a.status = 'ACTIVE' and a.account_type in ('CHECKING', 'SAVINGS')"))
query("q05_timeliness_stale", lambda i: Q.timeliness(i.mart_deposits, "latest_business_date", i.raw_loan, "origination_date"),
      WATERMARK.replace("SOURCE", "origination_date").replace("FROM", "{raw_loan}"))

VIEWS["two_controls"] = """
select * from {gl_control} union all select gl_code, 'MONEY_MARKET', control_total, record_count, as_of_date + 1 from {gl_control_drift} where account_type = 'SAVINGS'
union all select null, account_type, control_total, record_count, as_of_date from {gl_control} where account_type = 'CHECKING'"""


def _two_controls(i: Inputs):
    """An unexpected type with another date, and a second control without a code."""
    odd = i.gl_control_drift.filter("account_type = 'SAVINGS'").select(
        "gl_code", F.lit("MONEY_MARKET").alias("account_type"), "control_total", "record_count", F.date_add("as_of_date", 1).alias("as_of_date"))
    again = i.gl_control.filter("account_type = 'CHECKING'").withColumn("gl_code", F.lit(None).cast("string"))
    return i.gl_control.unionByName(odd).unionByName(again)


# One small statement per way to fail, over each account type that any side knows.
ACCURACY = """with books as (select account_type, count(*) as mart_rows, sum(current_balance) as held, count(*) filter (current_balance is null) as blanks from {mart_deposits} group by all),
ledger as (select account_type, count(*) as control_rows, min(control_total) as stated, cast(min(record_count) as bigint) as record_count, min(as_of_date) as day,
  count(*) filter (gl_code is null or control_total is null or record_count is null or as_of_date is null) as unfilled from {CONTROL} group by all),
due as (select account_type from {stg_account} where status = 'ACTIVE' and account_type in ('SAVINGS', 'CHECKING') group by all),
day as (select min(as_of_date) as day, count(*) as rows, count(distinct as_of_date) + count(distinct (as_of_date is null)) as kinds, bool_or(as_of_date is null) as undated from {CONTROL}),
kinds as (select account_type from due union select account_type from ledger union select account_type from books),
broken as (
  select account_type from kinds where account_type is null or account_type not in (select account_type from due)
  union select account_type from kinds where account_type not in (select account_type from books where account_type is not null)
  union select account_type from kinds where account_type not in (select account_type from ledger where account_type is not null)
  union select account_type from books where blanks > 0 or held is null
  union select account_type from ledger where control_rows > 1 or unfilled > 0
  union select account_type from ledger, day where ledger.day <> day.day
  union select account_type from books join ledger using (account_type) where mart_rows <> record_count or abs(held - stated) > 1.00)
select 'ACCOUNT_TYPE_RECONCILIATION' as failure_reason, b.account_type, cast((select day from day) as varchar) as snapshot_date, control_rows, mart_rows, record_count,
  cast(held as double) as mart_total_balance, cast(stated as double) as control_total, cast(abs(held - stated) as double) as reconciliation_difference
from broken b left join books on books.account_type = b.account_type left join ledger on ledger.account_type = b.account_type
union all
select 'INVALID_GL_SNAPSHOT', null, null, rows, null, null, null, null, null from day where rows = 0 or undated or kinds <> 2"""
for _name, _control, _relation in (
    ("q06_accuracy", "gl_control", lambda i: i.gl_control),
    ("q06_accuracy_drift", "gl_control_drift", lambda i: i.gl_control_drift),
    ("q06_accuracy_bad_controls", "two_controls", _two_controls),
):
    query(_name, lambda i, r=_relation: Q.accuracy(i.mart_deposits, r(i), M.eligible_deposits(i.stg_account)), ACCURACY.replace("{CONTROL}", "{" + _control + "}"))
query("q06_broken_rules",
      lambda i: Q.broken_rules(i.mart_deposits, _two_controls(i), M.eligible_deposits(i.stg_account)).select("account_type", F.explode("broken_rules").alias("rule")),
      """with books as (select account_type, count(*) as n, sum(current_balance) as held, count(*) filter (current_balance is null) as blanks from {mart_deposits} where account_type is not null group by 1),
ledger as (select account_type, count(*) as n, min(control_total) as stated, min(record_count) as counted, min(as_of_date) as day,
  count(*) filter (gl_code is null or control_total is null or record_count is null or as_of_date is null) as unfilled from {two_controls} where account_type is not null group by 1),
due as (select distinct account_type from {stg_account} where status = 'ACTIVE' and account_type in ('SAVINGS', 'CHECKING')),
kinds as (select account_type from due union select account_type from {two_controls} union select account_type from {mart_deposits}),
side as (select k.account_type, d.account_type as due, b.n as mart_rows, b.held, b.blanks, l.n as control_rows, l.stated, l.counted, l.day, l.unfilled, (select min(as_of_date) from {two_controls}) as first_day
  from kinds k left join due d using (account_type) left join books b using (account_type) left join ledger l using (account_type))
select account_type, 'EXPECTED' as rule from side where due is null
union all select account_type, 'PRESENT' from side where mart_rows is null
union all select account_type, 'ONE_CONTROL_ROW' from side where control_rows is distinct from 1
union all select account_type, 'CONTROL_FILLED' from side where unfilled is distinct from 0
union all select account_type, 'CONTROL_OF_THE_DAY' from side where (day = first_day) is not true
union all select account_type, 'MEASURE_FILLED' from side where blanks is distinct from 0
union all select account_type, 'ROWS_AGREE' from side where (counted = mart_rows) is not true
union all select account_type, 'TOTAL_AGREES' from side where (abs(held - stated) <= 1.00) is not true""")
query("q07_not_empty", lambda i: Q.not_empty(i.mart_deposits), "select count(*) as mart_row_count from {mart_deposits} having count(*) = 0")
query("q08_unique", lambda i: Q.unique(i.raw_transaction, "transaction_id"), "select transaction_id, count(*) as occurrence_count from {raw_transaction} where transaction_id is not null group by 1 having count(*) > 1")
query("q08_unique_last_name", lambda i: Q.unique(i.raw_customer, "last_name"), "select last_name, count(*) as occurrence_count from {raw_customer} where last_name is not null group by 1 having count(*) > 1")
query("q09_not_null", lambda i: Q.not_null(i.raw_customer, "tax_id").select("customer_id", "customer_type"), "select customer_id, customer_type from {raw_customer} where tax_id is null")
query("q10_accepted_values", lambda i: Q.accepted_values(i.raw_transaction, "transaction_type", ["DEBIT", "CREDIT"]), "select transaction_type, count(*) as n_records from {raw_transaction} where transaction_type not in ('DEBIT', 'CREDIT') group by 1")
query("q11_relationships", lambda i: Q.relationships(i.raw_loan, i.raw_account, "account_id").select("loan_id", "account_id"),
      "select loan_id, l.account_id from {raw_loan} l left join {raw_account} a on l.account_id = a.account_id where l.account_id is not null and a.account_id is null")

query("q11_relationships_staged", lambda i: Q.relationships(i.raw_account, i.stg_customer, "customer_id").select("account_id", "customer_id"),
      "select account_id, a.customer_id from {raw_account} a left join {stg_customer} c on a.customer_id = c.customer_id where a.customer_id is not null and c.customer_id is null")

VIEWS["failure_counts"] = """
select 'COMPLETENESS' as check_dimension, 'ACCOUNT_ID' as target_column, 'MART_ROW' as failure_unit, (select count(*) from {mart_deposits} where account_id is null) as failed_rows
union all select 'UNIQUENESS', 'ACCOUNT_ID', 'DUPLICATED_KEY', (select count(*) from (select account_id from {mart_deposits} group by 1 having count(*) > 1))
union all select 'VALIDITY', 'TAX_ID,CUSTOMER_TYPE', 'MART_ROW', (select count(*) from (""" + VALIDITY_SQL + """))
union all select 'CONSISTENCY', 'CUSTOMER_ID', 'MART_ROW', (select count(*) from {mart_deposits} m where not exists (select 1 from {stg_customer} c where c.customer_id = m.customer_id))
union all select 'TIMELINESS', 'LATEST_BUSINESS_DATE', 'DATASET_COMPARISON', (select count(*) from (select 1 from (select max(latest_business_date) as a from {mart_deposits}),
  (select max(business_date) as b from {stg_transaction} t join {stg_account} c on t.account_id = c.account_id where c.status = 'ACTIVE' and c.account_type <> 'MONEY_MARKET') where a is null or b is null or a <> b))
union all select 'ACCURACY', 'CURRENT_BALANCE,ACCOUNT_TYPE', 'RECONCILIATION_ISSUE', (select count(*) from (select account_type, sum(current_balance) as s, count(*) as n from {mart_deposits} group by 1) m
  join {gl_control_drift} g on m.account_type = g.account_type where abs(m.s - g.control_total) > 1.00 or g.record_count <> m.n)"""


def built(i: Inputs) -> B.Build:
    """The mart as a written table: the six checks read it once each."""
    return B.materialized(models(i), scratch_path(i.spark, "models"), ["mart_deposits"])


query("q12_outcomes", lambda i: B.outcomes(built(i), i.gl_control_drift).select("check_dimension", "check_type", "target_column", "failure_unit", "failed_rows", "dbt_status", "prerequisite_status"),
      "select check_dimension, concat('test_mart_deposits_', lower(check_dimension)) as check_type, target_column, failure_unit, failed_rows, case when failed_rows = 0 then 'pass' else 'fail' end as dbt_status, 'pass' as prerequisite_status from {failure_counts}")
query("q13_resolve_status", lambda i: i.dq_results.select("test_unique_id", "dbt_status", "failed_rows", "prerequisite_status", "check_result"),
      "select test_unique_id, dbt_status, failed_rows, prerequisite_status, check_result from {dq_results}")


def _persisted_twice(i: Inputs):
    """The same run recorded twice: the second time adds nothing."""
    rows = cut(B.assess(built(i), i.gl_control_drift, "run-1", AS_OF))
    stored = store.append(rows.limit(0), rows)
    return store.insert_missing(stored, rows, ["invocation_id", "test_unique_id"])


query("q14_persist_results", _persisted_twice, f"""
select md5(concat('run-1:test.test_mart_deposits_', lower(check_dimension))) as dq_result_id, 'run-1' as invocation_id,
  concat('test.test_mart_deposits_', lower(check_dimension)) as test_unique_id, 'MART_DEPOSITS' as mart_name, check_dimension,
  concat('test_mart_deposits_', lower(check_dimension)) as check_type,
  'ANALYTICS' as target_database, 'MARTS' as target_schema, 'MART_DEPOSITS' as target_table, target_column,
  case when failed_rows = 0 then 'PASS' else 'FAIL' end as check_result, case when failed_rows = 0 then 'pass' else 'fail' end as dbt_status, failed_rows, failure_unit,
  case when check_dimension = 'ACCURACY' then '2002-01-01' end as snapshot_date,
  concat('GOVERNANCE.CATALOG.TEST_MART_DEPOSITS_', check_dimension) as failure_relation, 'Empty-mart prerequisite: pass; failures=0.' as details,
  {NOW} as executed_at, 'SVC_PIPELINE' as executed_by from {{failure_counts}}""")
VIEWS["dq_summary"] = """
select invocation_id, mart_name, count(*) as checks_recorded, count(distinct check_dimension) as dimensions_recorded,
  count(*) filter (where check_result = 'PASS') as passed, count(*) filter (where check_result = 'FAIL') as failed,
  count(*) filter (where check_result in ('ERROR', 'NOT_EXECUTED', 'BLOCKED') or check_result is null) as unresolved, max(executed_at) as executed_at,
  case when count(*) <> 6 or count(distinct check_dimension) <> 6 then 'INCOMPLETE' when count(*) filter (where check_result = 'PASS') = 6 then 'PASS' else 'NOT_PASSED' end as assessment_result
from {dq_results} where invocation_id is not null group by 1, 2"""
query("q15_dq_summary", lambda i: Q.dq_summary(i.dq_results), "select * from {dq_summary}")
query("q16_dq_framework", lambda i: Q.dq_framework(i.dq_results),
      "select invocation_id, mart_name, check_dimension, check_type, target_table, target_column, failure_unit, dbt_status, check_result from {dq_results} where invocation_id is not null")
VIEWS["latest_results"] = """
select r.* from {dq_results} r join (select target_database, target_schema, target_table, invocation_id from (select target_database, target_schema, target_table, invocation_id,
  row_number() over (partition by target_database, target_schema, target_table order by max(executed_at) desc) as rn from {dq_results} where invocation_id is not null group by 1, 2, 3, 4) where rn = 1) l
on r.target_database = l.target_database and r.target_schema = l.target_schema and r.target_table = l.target_table and r.invocation_id = l.invocation_id"""
query("q17_latest_review", lambda i: Q.dq_summary(R.latest_rows(i.dq_results, Q.TARGET, "invocation_id", "executed_at")).select("mart_name", "invocation_id", "assessment_result", "passed"),
      "select s.mart_name, s.invocation_id, s.assessment_result, s.passed from {dq_summary} s join (select distinct mart_name, invocation_id from {latest_results}) l on s.mart_name = l.mart_name and s.invocation_id = l.invocation_id")
query("q17_dimension_counts", lambda i: Q.dimension_counts(i.dq_results), "select invocation_id, check_dimension, count(*) as result_count from {dq_results} group by 1, 2 having count(*) <> 1")
query("q17_dimension_coverage", lambda i: Q.dimension_coverage(i.dq_results),
      "select invocation_id, 6::bigint as required_dimensions, count(distinct upper(check_dimension)) as present_dimensions, count(distinct case when upper(check_result) = 'PASS' then upper(check_dimension) end) as passing_dimensions from {dq_results} group by 1")
query("q17_run_history", lambda i: Q.run_counts(i.dq_results),
      "select invocation_id, count(*) as result_count, count(distinct check_dimension) as dimension_count, count(*) filter (where check_result = 'PASS') as pass_count, max(executed_at) as executed_at from {dq_results} group by 1")
query("q18_key_not_unique", lambda i: Q.key_not_unique(i.mart_deposits, ["account_id"]), "select account_id, count(*) as occurrence_count from {mart_deposits} group by 1 having account_id is null or count(*) > 1")
query("q18_domain_by_layer", lambda i: Q.domain_by_layer({"RAW": i.raw_transaction, "STAGING": i.stg_transaction}, "transaction_type"),
      "select 'RAW' as layer, transaction_type, count(*) as row_count from {raw_transaction} group by 2 union all select 'STAGING', transaction_type, count(*) from {stg_transaction} group by 2")
query("q18_invalid_domain_by_layer", lambda i: Q.invalid_domain_by_layer({"RAW": i.raw_transaction, "STAGING": i.stg_transaction}, "transaction_type", ["DEBIT", "CREDIT"]),
      "select 'RAW' as layer, transaction_type, count(*) as invalid_rows from {raw_transaction} where transaction_type is null or transaction_type not in ('DEBIT', 'CREDIT') group by 2 union all select 'STAGING', transaction_type, count(*) from {stg_transaction} where transaction_type is null or transaction_type not in ('DEBIT', 'CREDIT') group by 2")
query("q18_missing_controls", lambda i: Q.missing_controls(i.raw_account.filter("status = 'ACTIVE'"), i.gl_control),
      "select distinct account_type from {raw_account} a where status = 'ACTIVE' and not exists (select 1 from {gl_control} g where g.account_type = a.account_type)")
query("q18_population", lambda i: R.compare_keys(M.eligible_deposits(i.raw_account), i.mart_deposits, ["account_id", "account_type"]),
      """with e as (select account_id, account_type, count(*) as source_rows from {raw_account} where status = 'ACTIVE' and account_type in ('CHECKING', 'SAVINGS') group by all), m as (select account_id, account_type, count(*) as mart_rows from {mart_deposits} group by all)
select e.account_id as source_account_id, m.account_id as mart_account_id, e.account_type as source_account_type, m.account_type as mart_account_type, source_rows, mart_rows from e full join m on e.account_id = m.account_id and e.account_type = m.account_type
where e.account_id is null or m.account_id is null or source_rows <> 1 or mart_rows <> 1""")
query("q18_attributes_off", lambda i: Q.attributes_off(i.stg_account, M.DEPOSIT_TYPES, ["account_id", "status", "account_type"]),
      "select account_id, status, account_type from {stg_account} where status is null or status <> 'ACTIVE' or account_type is null or account_type not in ('CHECKING', 'SAVINGS')")
query("q19_validate_build", lambda i: R.labelled_counts({"STG_CUSTOMER": i.stg_customer, "STG_ACCOUNT": i.stg_account, "MART_DEPOSITS": i.mart_deposits, "ORPHAN_TRANSACTION": R.orphans(i.raw_transaction, i.raw_account, "account_id")}),
      "select 'STG_CUSTOMER' as object_name, count(*) as row_count from {stg_customer} union all select 'STG_ACCOUNT', count(*) from {stg_account} union all select 'MART_DEPOSITS', count(*) from {mart_deposits} union all select 'ORPHAN_TRANSACTION', count(*) from {raw_transaction} t left join {raw_account} a on t.account_id = a.account_id where a.account_id is null")
query("q20_source_counts", lambda i: R.labelled_counts({"CUSTOMER": i.raw_customer, "ACCOUNT": i.raw_account, "TRANSACTION": i.raw_transaction, "LOAN": i.raw_loan, "GL_CONTROL": i.gl_control, "BRANCH": i.raw_branch}),
      "select 'CUSTOMER' as object_name, count(*) as row_count from {raw_customer} union all select 'ACCOUNT', count(*) from {raw_account} union all select 'TRANSACTION', count(*) from {raw_transaction} union all select 'LOAN', count(*) from {raw_loan} union all select 'GL_CONTROL', count(*) from {gl_control} union all select 'BRANCH', count(*) from {raw_branch}")
