"""Sources, sinks, projections, joins, aggregates, sorts and marts over the bank tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from custodia.functions import predicates as P
from custodia.functions import scalars as S
from custodia.operators import checks as Q
from custodia.operators import digest
from custodia.operators import relational as R
from custodia.plans import build as B
from custodia.plans import marts as M
from custodia.queries import views  # noqa: F401
from custodia.queries.inputs import AS_OF, Inputs
from custodia.queries.registry import ORACLE, query
from custodia.session import scratch_path
from custodia.sinks import partitions, store
from custodia.sources import catalog, files, schemas
from custodia.sources.values import values_df

NOW = "timestamp '2024-01-31 00:00:00'"
STG_ACCOUNT = "account_id, customer_id, account_number, account_type, status, cast(balance as double) as balance, branch_code, cast(opened_date as varchar) as opened_date, source_table, source_system, dbt_loaded_at"
STG_CUSTOMER = "customer_id, first_name, last_name, email, phone, tax_id, cast(date_of_birth as varchar) as date_of_birth, address, customer_type, source_table, source_system, dbt_loaded_at"
STG_TXN = "transaction_id, account_id, cast(business_date as varchar) as business_date, transaction_type, cast(amount as double) as amount, memo, source_table, source_system, dbt_loaded_at"
STG_LOAN = "loan_id, customer_id, account_id, cast(principal as double) as principal, loan_type, status, cast(interest_rate as double) as interest_rate, cast(origination_date as varchar) as origination_date, cast(collateral_value as double) as collateral_value, credit_grade, loan_memo, source_table, source_system, dbt_loaded_at"
MART = "account_id, customer_id, account_number, account_type, status, branch_code, cast(opened_date as varchar) as opened_date, cast(current_balance as double) as current_balance, first_name, last_name, email, customer_type, tax_id, cast(latest_business_date as varchar) as latest_business_date, mart_name, transaction_count, cast(total_debits as double) as total_debits, cast(total_credits as double) as total_credits, dbt_refreshed_at, cast(dbt_business_date as varchar) as dbt_business_date"

# ---- sources ---------------------------------------------------------------------


def _customer_csv(i: Inputs):
    """The customers as the CSV files that the loader expects, NULL written as text tokens."""
    path = scratch_path(i.spark, "customers")
    token = F.when(F.col("customer_id") % 3 == 0, "NULL").when(F.col("customer_id") % 3 == 1, "null").otherwise("")
    out = i.raw_customer.withColumn("tax_id", F.coalesce("tax_id", token)).withColumn(
        "created_at", F.lit("2024-01-31 00:00:00")
    )
    (out.withColumn("address", F.concat(F.col("address"), F.lit(', "Suite 1"')))
        .select("customer_id", "first_name", "last_name", "customer_type", "tax_id", "date_of_birth", "email", "phone", "address", "created_at")
        .write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path))
    return files.read_csv(i.spark, path, schemas.CUSTOMER)


CSV_SQL = """select cast(customer_id as varchar) as customer_id, first_name, last_name, customer_type, tax_id,
  cast(date_of_birth as varchar) as date_of_birth, email, phone, concat(address, ', "Suite 1"') as address,
  timestamp '2024-01-31 00:00:00' as created_at{extra} from {raw_customer}"""
query("s01_read_csv", _customer_csv, CSV_SQL.replace("{extra}", ""))


def _good_rows(i: Inputs):
    """Branches reread in the mode that stops at the first record of the wrong width."""
    path = scratch_path(i.spark, "branches")
    i.raw_branch.select("branch_code", "branch_name", F.lit("NULL").alias("branch_manager"), "region").write.option("header", True).csv(path)
    return files.read_csv(i.spark, path, schemas.BRANCH)


def _rejected(i: Inputs):
    """Transactions as CSV with planted faults: an amount that is no number, a record with a field too many, and one with too few."""
    path = scratch_path(i.spark, "transactions")
    n = F.col("transaction_id") % 1000
    fields = [F.col("transaction_id"), F.col("account_id"), F.col("transaction_type"), F.when(n == 1, "12,5").otherwise(F.when(n == 0, "many").otherwise(F.col("amount").cast("string"))), F.col("business_date")]
    lines = i.raw_transaction.select(F.when(n == 2, F.concat_ws(",", *fields[:3])).otherwise(F.concat_ws(",", *[f.cast("string") for f in fields])))
    lines.write.text(path)
    bad = files.rejects(i.spark, path, "transaction_id bigint, account_id bigint, transaction_type string, amount decimal(12,2), business_date date", header=False)
    return bad.select(F.split("record", ",")[0].cast("bigint").alias("transaction_id"), "reason", F.col("file_path").contains("/transactions/").alias("named"))


query("s02_rejects", _rejected, """
select transaction_id, case transaction_id % 1000 when 0 then 'amount: not decimal(12,2)' else 'number of fields' end as reason, true as named
from {raw_transaction} where transaction_id % 1000 in (0, 1, 2)""")
query("s02_read_failfast", _good_rows, "select branch_code, branch_name, cast(null as varchar) as branch_manager, region from {raw_branch}")
query(
    "s03_load_table",
    lambda i: files.load_table(i.raw_transaction, ["transaction_id", "account_id", "transaction_type", "amount", "business_date", "memo"], AS_OF),
    f"select transaction_id, account_id, transaction_type, cast(amount as double) as amount, cast(business_date as varchar) as business_date, memo, {NOW} as _load_timestamp from {{raw_transaction}}",
)


def _segments(i: Inputs):
    """Rules as data joined to a fact: each market segment's reporting domain."""
    rules = values_df(
        i.spark, [("BUILDING", "LOAN"), ("AUTOMOBILE", "LOAN"), ("MACHINERY", "DEPOSIT")], "c_mktsegment string, business_domain string"
    )
    return i.customer.join(rules, "c_mktsegment", "left").groupBy("business_domain").agg(F.count(F.lit(1)).alias("row_count"))


query("s04_values", _segments, """
select business_domain, count(*) as row_count from {customer} left join (values ('BUILDING', 'LOAN'), ('AUTOMOBILE', 'LOAN'),
  ('MACHINERY', 'DEPOSIT')) v(seg, business_domain) on c_mktsegment = seg group by business_domain""")


def _sealed_docs(i: Inputs):
    """One truth document per catalog column, one section per half of the columns."""
    b = i.catalog_base
    confirmed = F.struct(F.col("table_name").alias("table"), F.col("column_name").alias("column"), F.lit("PII").alias("classification"), F.col("p_name").alias("reason"))
    hidden = F.struct(F.col("table_name").alias("table"), F.col("column_name").alias("column"), F.lit("SENSITIVE").alias("actual_classification"), F.col("p_type").alias("why_mislabeled"))
    path = scratch_path(i.spark, "sealed")
    b.select(
        F.when(F.col("pos") < 8, F.array(confirmed)).alias("confirmed_sensitive_columns"),
        F.when(F.col("pos") >= 6, F.array(hidden)).otherwise(F.array().cast("array<struct<table:string,column:string,actual_classification:string,why_mislabeled:string>>")).alias("deliberately_mislabeled"),
    ).write.json(path)
    return files.read_sealed(i.spark, path, multi_line=False)


query("s05_read_sealed", _sealed_docs, """
select table_name, column_name, 'PII' as expected_classification, 'CONFIRMED' as source_section, p_name as reason from {catalog_base} where pos < 8
union all select table_name, column_name, 'SENSITIVE', 'MISLABELED', p_type from {catalog_base} where pos >= 6""")


def _dictionary_csv(i: Inputs):
    path = scratch_path(i.spark, "dictionary")
    (i.dictionary.select("table_name", "column_name", F.coalesce("column_description", F.lit("NULL")).alias("column_description"), "data_type",
                         F.coalesce("sensitivity_classification", F.lit("null")).alias("sensitivity_classification"),
                         F.when(F.col("is_cde"), "YES").otherwise("NO").alias("is_cde"), "notes")
        .write.option("header", True).option("escape", '"').csv(path))
    return files.read_dictionary(i.spark, path)


query("s06_read_dictionary", _dictionary_csv, """
select table_name, column_name, nullif(column_description, '') as column_description, data_type, sensitivity_classification, is_cde, notes from {dictionary}""")


def _by_name(i: Inputs):
    store.as_view(i.mart_deposits, "relation_by_name")
    return catalog.relation(i.spark, "relation_by_name").agg(F.count(F.lit(1)).alias("mart_row_count"))


query("s14_relation_by_name", _by_name, "select count(*) as mart_row_count from {mart_deposits}")

# ---- sinks -----------------------------------------------------------------------


def _table(i: Inputs, model: str):
    """A model's table in the session's catalog, its files in the shared folder."""
    path = scratch_path(i.spark, model)
    return f"{model}_{path.split('/')[-2][-32:]}", path


def _written(i: Inputs):
    """The mart as a table object, refreshed whole twice and read back by its name."""
    name, path = _table(i, "mart_deposits")
    store.materialize(i.mart_deposits.limit(0), name, path)
    store.materialize(i.mart_deposits, name, path)
    return catalog.relation(i.spark, name)


query("k01_materialize", _written, f"select {MART} from {{mart_deposits}}")


def _reloaded(i: Inputs):
    """Reload the table of raw accounts with the staged ones; a property of the table object is still there afterwards."""
    columns = ["account_id", "customer_id", "account_type", "status"]
    name, path = _table(i, "account")
    store.materialize(i.raw_account.select(*columns), name, path)
    i.spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('data_owner' = 'Deposits')")
    rows = store.reload(i.stg_account.select(*reversed(columns)), name)
    return rows.withColumn("table_owner", F.lit(store.properties(i.spark, name).get("data_owner")))


query("k02_reload", _reloaded, "select account_id, customer_id, account_type, status, 'Deposits' as table_owner from {stg_account}")


def _non_empty(i: Inputs):
    """The guard passes for the raw tables and names an empty one."""
    raw = {"customer": i.raw_customer, "account": i.raw_account, "transaction": i.raw_transaction}
    store.require_non_empty(raw)
    return R.labelled_counts(raw)


query("k03_require_non_empty", _non_empty, """
select 'customer' as object_name, count(*) as row_count from {raw_customer} union all select 'account', count(*) from {raw_account}
union all select 'transaction', count(*) from {raw_transaction}""")
query(
    "k04_reconcile_counts",
    lambda i: store.reconcile_counts(
        R.labelled_counts({"ACCOUNT": i.raw_account, "CUSTOMER": i.raw_customer, "LOAN": i.raw_loan}),
        R.labelled_counts({"ACCOUNT": i.stg_account, "CUSTOMER": i.customer, "BRANCH": i.raw_branch}),
    ),
    """select * from (
  select 'ACCOUNT' as object_name, (select count(*) from {raw_account}) as expected_rows, (select count(*) from {stg_account}) as loaded_rows
  union all select 'CUSTOMER', (select count(*) from {raw_customer}), (select count(*) from {customer})
  union all select 'LOAN', (select count(*) from {raw_loan}), null
  union all select 'BRANCH', null, (select count(*) from {raw_branch})) x where expected_rows is distinct from loaded_rows""",
)
query(
    "k04_reconcile_content",
    lambda i: digest.reconcile(
        {"ACCOUNT": i.raw_account.select("account_id", "status"), "LOAN": i.raw_loan, "CUSTOMER": i.raw_customer.select("customer_id", "email")},
        {"ACCOUNT": i.stg_account.select("status", "account_id"), "LOAN": i.raw_loan, "BRANCH": i.raw_branch,
         "CUSTOMER": i.raw_customer.select("customer_id", F.when(F.col("customer_id") % 2 == 0, F.col("email")).otherwise("").alias("email"))}),
    """select * from (
  select 'ACCOUNT' as object_name, (select count(*) from {raw_account}) as expected_rows, (select count(*) from {stg_account}) as loaded_rows
  union all select 'CUSTOMER', (select count(*) from {raw_customer}), (select count(*) from {raw_customer})
  union all select 'BRANCH', null, (select count(*) from {raw_branch})) x""",
)
query(
    "k05_replace_scope",
    lambda i: store.replace_scope(
        i.cat_columns.select("database_name", "schema_name", "table_name", "column_name", "column_type"),
        i.cat_columns.filter("database_name = 'ANALYTICS' and schema_name = 'STAGING' and p_size > 10").select(
            "database_name", "schema_name", "table_name", "column_name", F.lit("FRESH").alias("column_type")),
        {"database_name": "ANALYTICS", "schema_name": "STAGING"},
    ),
    """select database_name, schema_name, table_name, column_name, column_type from {cat_columns}
where not (database_name = 'ANALYTICS' and schema_name = 'STAGING')
union all select database_name, schema_name, table_name, column_name, 'FRESH' from {cat_columns}
where database_name = 'ANALYTICS' and schema_name = 'STAGING' and p_size > 10""",
)


def _scope_swapped(i: Inputs):
    """The same on a table partitioned by scope: only that scope's partition is written."""
    columns = ["database_name", "schema_name", "table_name", "column_name", "column_type"]
    name, path = _table(i, "catalog_column")
    scope = {"database_name": "ANALYTICS", "schema_name": "STAGING"}
    partitions.create(i.cat_columns.select(*columns), name, list(scope), path)
    fresh = i.cat_columns.filter("database_name = 'ANALYTICS' and schema_name = 'STAGING' and p_size > 10")
    return partitions.replace_scope(name, fresh.withColumn("column_type", F.lit("FRESH")).select(*columns), scope)


query("k05_replace_scope_partition", _scope_swapped, ORACLE["k05_replace_scope"])


def _replaced(i: Inputs):
    path = scratch_path(i.spark, "edges")
    store.write_all(i.edges.filter("source_column is not null"), path)
    return store.write_all(i.edges, path)


query("k06_replace_all", _replaced, "select * from {edges}")


def _appended(i: Inputs):
    """Two appends to a history; the second batch has a column more than the first."""
    path = scratch_path(i.spark, "dq_result")
    first = i.dq_results.filter("check_result = 'PASS'").select("invocation_id", "test_unique_id", "check_result")
    second = i.dq_results.filter("check_result <> 'PASS'").select("invocation_id", "test_unique_id", "check_result", "dbt_status")
    store.append_to(first, path)
    return store.append_to(second, path)


query("k07_append", _appended, """
select invocation_id, test_unique_id, check_result, case when check_result <> 'PASS' then dbt_status end as dbt_status from {dq_results}""")

DICT = ["table_name", "column_name", "column_description", "data_type", "sensitivity_classification", "is_cde", "notes"]


def _dictionary_upsert(i: Inputs):
    stored = i.dictionary.filter("p_size <= 35").select(*DICT)
    rows = i.dictionary.filter("p_size >= 25").select(*DICT).withColumn("notes", F.concat(F.lit("new "), "notes"))
    return store.upsert(stored, rows, ["table_name", "column_name"])


query("k08_upsert", _dictionary_upsert, """
select table_name, column_name, column_description, data_type, sensitivity_classification, is_cde,
  case when p_size >= 25 then concat('new ', notes) else notes end as notes from {dictionary}""")


def _keyed_upsert(i: Inputs):
    """The same into a table partitioned by its keys' hash: only the partitions of the new rows' keys are written."""
    name, path = _table(i, "dictionary")
    partitions.create_keyed(i.dictionary.filter("p_size <= 35").select(*DICT), name, ["table_name", "column_name"], 8, path)
    rows = i.dictionary.filter("p_size >= 25").select(*DICT).withColumn("notes", F.concat(F.lit("new "), "notes"))
    return partitions.upsert(name, rows).drop(partitions.PART)


query("k08_upsert_partitions", _keyed_upsert, ORACLE["k08_upsert"])


def _partial_upsert(i: Inputs):
    keep = ["table_name", "column_name", "ordinal_position", "column_type", "column_comment"]
    stored = i.cat_columns.filter("p_size <= 40").select(*keep)
    fresh = i.cat_columns.filter("p_size >= 20").select(
        "table_name", "column_name", (F.col("ordinal_position") + 100).alias("ordinal_position"), F.lit("NEW").alias("column_type"), "column_comment")
    return store.upsert(stored, fresh, ["table_name", "column_name"], update=["column_type", "column_comment"])


query("k09_upsert_partial", _partial_upsert, """
select table_name, column_name, case when p_size <= 40 then ordinal_position else ordinal_position + 100 end::bigint as ordinal_position,
  case when p_size >= 20 then 'NEW' else column_type end as column_type, column_comment from {cat_columns}""")


def _conditional_upsert(i: Inputs):
    stored = i.queue.select("review_id", "review_status", "detected_semantic_category")
    fresh = i.queue.filter("review_status <> 'REJECTED'").select("review_id", F.lit("NAME").alias("detected_semantic_category")).unionByName(
        i.catalog_base.filter("p_size > 40").select(F.concat(F.lit("new-"), F.col("p_partkey").cast("string")).alias("review_id"), F.lit("EMAIL").alias("detected_semantic_category")))
    return store.upsert(stored, fresh, ["review_id"], when=F.col("review_status") == "PENDING", insert_values={"review_status": F.lit("PENDING")})


query("k10_upsert_conditional", _conditional_upsert, """
select review_id, review_status, case when review_status = 'PENDING' then 'NAME' else detected_semantic_category end as detected_semantic_category from {queue}
union all select concat('new-', cast(p_partkey as varchar)), 'PENDING', 'EMAIL' from {catalog_base} where p_size > 40""")
query(
    "k11_insert_missing",
    lambda i: store.insert_missing(
        i.dq_results.filter("check_result = 'PASS'").select("test_unique_id", F.lit("stored").alias("origin")),
        i.dq_results.select("test_unique_id", F.lit("incoming").alias("origin")), ["test_unique_id"]),
    "select test_unique_id, case when check_result = 'PASS' then 'stored' else 'incoming' end as origin from {dq_results}",
)
query(
    "k13_transition",
    lambda i: store.transition(
        i.queue.select("review_id", "review_status", "review_notes"),
        i.decisions.select("review_id", "action"), "review_id", "review_status", "PENDING",
        {"review_status": F.col("r.action"), "review_notes": F.lit("decided")}),
    """select q.review_id, case when q.review_status = 'PENDING' and d.review_id is not null then d.action else q.review_status end as review_status,
  case when q.review_status = 'PENDING' and d.review_id is not null then 'decided' end as review_notes
from {queue} q left join {decisions} d on q.review_id = d.review_id""",
)


def _failures(i: Inputs):
    folder = scratch_path(i.spark, "failures")
    bad = Q.validity(i.mart_deposits, "tax_id", "customer_type", Q.TAX_ID_FORMATS, ["account_id", "customer_type"])
    return store.store_failures(bad, "test_mart_deposits_validity", folder)


VALIDITY_SQL = """
select account_id, customer_type, case when customer_type is null then 'NULL_CUSTOMER_TYPE'
  when customer_type not in ('PERSON', 'BUSINESS') then 'UNSUPPORTED_CUSTOMER_TYPE' when tax_id is null then 'NULL_TAX_ID'
  else 'INVALID_TAX_ID_FORMAT' end as failure_reason
from {mart_deposits} where customer_type is null or customer_type not in ('PERSON', 'BUSINESS') or tax_id is null
  or (customer_type = 'PERSON' and not regexp_full_match(tax_id, '[0-9]{3}-[0-9]{2}-[0-9]{4}'))
  or (customer_type = 'BUSINESS' and not regexp_full_match(tax_id, '[0-9]{2}-[0-9]{7}'))"""
query("k14_store_failures", _failures, VALIDITY_SQL)
query(
    "k15_evolve",
    lambda i: store.evolve(i.dq_results.select("test_unique_id", "check_result"), schemas.struct("test_unique_id string, failure_unit string, snapshot_date date")),
    "select test_unique_id, check_result, cast(null as varchar) as failure_unit, cast(null as varchar) as snapshot_date from {dq_results}",
)
query("k16_view", lambda i: store.as_view(i.stg_customer.select("customer_id", "email"), "customer_contacts"), "select customer_id, email from {stg_customer}")

# ---- projections and predicates --------------------------------------------------

query("p01_stage_customer", lambda i: i.stg_customer, f"select {STG_CUSTOMER} from {{stg_customer}}")
query("p02_stg_account", lambda i: i.stg_account, f"select {STG_ACCOUNT} from {{stg_account}}")
query("p03_stg_customer_by_type", lambda i: R.count_by(i.stg_customer, "customer_type"), "select customer_type, count(*) as row_count from {raw_customer} where customer_type = 'PERSON' or customer_type = 'BUSINESS' group by 1")
query("p04_stg_transaction", lambda i: i.stg_transaction, f"select {STG_TXN} from {{stg_transaction}}")
query("p05_stg_loan", lambda i: i.stg_loan, f"select {STG_LOAN} from {{stg_loan}}")
query(
    "p06_not_in_domain",
    lambda i: i.mart_deposits.filter(P.not_in_domain(F.col("customer_type"), ["PERSON"])).select("account_id", "customer_type"),
    "select account_id, customer_type from {mart_deposits} where customer_type is null or customer_type not in ('PERSON')",
)
query(
    "p07_text_mentions",
    lambda i: i.query_history.filter(P.mentions(F.col("query_text"), "ANALYTICS.MARTS.MART_DEPOSITS")).select("query_id"),
    "select query_id from {query_history} where query_text ilike '%ANALYTICS.MARTS.MART_DEPOSITS%'",
)
query(
    "p08_nested_mentions",
    lambda i: i.access_log.filter(P.nested_mentions(F.col("objects_modified"), "mart_deposits") | P.nested_mentions(F.col("direct_objects_accessed"), "tbl_8\"")).select("query_id"),
    "select event_id as query_id from {events} where event_type in ('view', 'purchase') or user_id = 8",
)
query(
    "p09_format_by_type",
    lambda i: i.raw_customer.select("customer_id", "customer_type", P.format_ok(F.col("tax_id"), F.col("customer_type"), Q.TAX_ID_FORMATS).alias("is_valid")),
    """select customer_id, customer_type, coalesce(case customer_type when 'PERSON' then regexp_full_match(tax_id, '[0-9]{3}-[0-9]{2}-[0-9]{4}')
  when 'BUSINESS' then regexp_full_match(tax_id, '[0-9]{2}-[0-9]{7}') else false end, false) as is_valid from {raw_customer}""",
)
query(
    "p10_recent",
    lambda i: i.query_history.filter(P.within_hours(F.col("start_time"), AS_OF, 167)).select("query_id", "start_time"),
    f"select query_id, start_time from {{query_history}} where start_time >= {NOW} - interval 167 hour",
)
query(
    "p11_category",
    lambda i: i.raw_account.select("account_id", F.when(F.col("balance") < 50000, "LOW").when(F.col("balance") < 250000, "MIDDLE").otherwise("HIGH").alias("band")),
    "select account_id, case when balance < 50000 then 'LOW' when balance < 250000 then 'MIDDLE' else 'HIGH' end as band from {raw_account}",
)
query(
    "p12_label",
    lambda i: i.mart_deposits.select("account_id", P.label(F.col("transaction_count") > 0, "PASS", "FAIL").alias("status")),
    "select account_id, if(transaction_count > 0, 'PASS', 'FAIL') as status from {mart_deposits}",
)
query(
    "p13_is_filled",
    lambda i: i.tags.groupBy("tag_name").agg(F.count_if(P.is_filled(F.col("tag_value"))).alias("filled")),
    "select tag_name, count(*) filter (where tag_value is not null and trim(tag_value) <> '') as filled from {tags} group by tag_name",
)
query(
    "p14_outside_tolerance",
    lambda i: Q.reconciliation(i.mart_deposits, i.gl_control_drift, M.eligible_deposits(i.stg_account)).select(
        "account_type", "reconciliation_difference", P.outside(F.col("mart_total_balance"), F.col("control_total"), "1.00").alias("is_outside")),
    """select m.account_type, cast(abs(m.total - g.control_total) as double) as reconciliation_difference, abs(m.total - g.control_total) > 1.00 as is_outside
from (select account_type, sum(current_balance) as total from {mart_deposits} group by 1) m join {gl_control_drift} g on m.account_type = g.account_type""",
)
query("p15_distinct", lambda i: i.edges.select("source_object", "target_object").distinct(), "select distinct source_object, target_object from {edges}")

# ---- joins -----------------------------------------------------------------------

query("j01_left_join", lambda i: i.mart_deposits.select("account_id", "first_name", "transaction_count"),
      "select a.account_id, c.first_name, coalesce(t.n, 0) as transaction_count from {stg_account} a left join {stg_customer} c on a.customer_id = c.customer_id left join (select account_id, count(*) n from {stg_transaction} group by 1) t on t.account_id = a.account_id where status = 'ACTIVE' and account_type <> 'MONEY_MARKET'")
query("j02_four_way_left_join", lambda i: i.mart_customer_360.select("customer_id", "account_count", "total_transactions", "loan_count"),
      "select c.customer_id, coalesce(account_count, 0) as account_count, coalesce(total_transactions, 0) as total_transactions, coalesce(loan_count, 0) as loan_count from {stg_customer} c left join {customer_accounts} a on a.customer_id = c.customer_id left join {customer_transactions} t on t.customer_id = c.customer_id left join {customer_loans} l on l.customer_id = c.customer_id")
query("j03_left_join_then_group", lambda i: M.customer_transactions(i.stg_account, i.stg_transaction).select("customer_id", "total_transactions"),
      "select customer_id, total_transactions from {customer_transactions}")
query("j04_inner_join",
      lambda i: i.stg_transaction.join(M.eligible_deposits(i.stg_account), "account_id").groupBy("branch_code").agg(F.count(F.lit(1)).alias("n"), F.max("business_date").alias("latest")),
      "select branch_code, count(*) as n, cast(max(business_date) as varchar) as latest from {stg_transaction} t join {stg_account} a on t.account_id = a.account_id where status = 'ACTIVE' and account_type in ('CHECKING', 'SAVINGS') group by 1")
query("j05_orphans", lambda i: R.orphans(i.mart_deposits, i.stg_customer, "customer_id").select("account_id", "customer_id"),
      "select m.account_id, m.customer_id from {mart_deposits} m left join {stg_customer} c on m.customer_id = c.customer_id where c.customer_id is null")
query("j06_not_exists", lambda i: R.orphans(i.raw_transaction, M.eligible_deposits(i.raw_account), "account_id").select("transaction_id", "account_id"),
      "select transaction_id, account_id from {raw_transaction} t where not exists (select 1 from {raw_account} a where a.account_id = t.account_id and status = 'ACTIVE' and account_type in ('CHECKING', 'SAVINGS'))")
query("j08_compare_keys", lambda i: R.compare_keys(M.eligible_deposits(i.raw_account), i.stg_transaction.join(i.raw_account.select("account_id", "account_type"), "account_id"), ["account_id", "account_type"]),
      """with e as (select account_id, account_type, count(*) as source_rows from {raw_account} where status = 'ACTIVE' and account_type in ('CHECKING', 'SAVINGS') group by all),
m as (select t.account_id, a.account_type, count(*) as mart_rows from {stg_transaction} t join {raw_account} a on a.account_id = t.account_id group by all)
select e.account_id as source_account_id, m.account_id as mart_account_id, e.account_type as source_account_type, m.account_type as mart_account_type, source_rows, mart_rows
from e full join m on e.account_id = m.account_id and e.account_type = m.account_type
where e.account_id is null or m.account_id is null or source_rows <> 1 or mart_rows <> 1""")
query("j09_one_row_value",
      lambda i: i.gl_control.select("account_type", "control_total", Q.control_day(i.gl_control).select("snapshot_date").scalar().alias("snapshot_date")),
      "select account_type, cast(control_total as double) as control_total, cast(s.d as varchar) as snapshot_date from {gl_control} cross join (select min(as_of_date) as d from {gl_control}) s")
query("j11_join_ignoring_case",
      lambda i: R.join_ignoring_case(i.cat_columns.select("table_name", "column_name"), i.dictionary.select("table_name", "column_name", "column_description"), ["table_name", "column_name"]),
      "select c.table_name, c.column_name, d.column_description from {cat_columns} c left join {dictionary} d on upper(c.table_name) = upper(d.table_name) and upper(c.column_name) = upper(d.column_name)")
query("j12_join_without_prefix",
      lambda i: i.cat_columns.select(R.strip_prefix(F.col("table_name"), "STG_").alias("table_name"), "column_name").join(i.truth.select("table_name", "column_name", "reason"), ["table_name", "column_name"]),
      "select t.table_name, t.column_name, t.reason from {cat_columns} c join {truth} t on regexp_replace(c.table_name, '^STG_', '') = t.table_name and c.column_name = t.column_name")
query("j15_union_of_keys",
      lambda i: Q.reconciliation(i.mart_deposits, i.gl_control_drift, M.eligible_deposits(i.stg_account)).select("account_type", "expected_type", "mart_rows", "mart_total_balance", "control_rows", "control_total", "record_count", "snapshot_date"),
      """with k as (select account_type from {stg_account} where status = 'ACTIVE' and account_type in ('CHECKING', 'SAVINGS') union select account_type from {mart_deposits} union select account_type from {gl_control_drift}),
m as (select account_type, count(*) as n, sum(current_balance) as total from {mart_deposits} group by 1),
g as (select account_type, count(*) as n, min(control_total) as total, min(record_count) as record_count from {gl_control_drift} group by 1)
select k.account_type, k.account_type as expected_type, m.n as mart_rows, cast(m.total as double) as mart_total_balance, g.n as control_rows,
  cast(g.total as double) as control_total, cast(g.record_count as bigint) as record_count, '2002-01-01' as snapshot_date
from k left join m on k.account_type = m.account_type left join g on g.account_type = k.account_type""")

# ---- aggregates ------------------------------------------------------------------

query("a01_account_transactions", lambda i: M.account_transactions(i.stg_transaction), """
select account_id, moves as transaction_count, cast(in_total as double) as total_credits, cast(out_total as double) as total_debits, cast(last_day as varchar) as latest_business_date
from {moved}""")
query("a02_customer_accounts", lambda i: M.customer_accounts(i.stg_account), """
select customer_id, account_count, savings_count, checking_count, cast(total_balance as double) as total_balance,
  cast(most_recent_account_opened as varchar) as most_recent_account_opened from {customer_accounts}""")
query("a03_customer_transactions", lambda i: M.customer_transactions(i.stg_account, i.stg_transaction), """
select customer_id, total_transactions, cast(latest_business_date as varchar) as latest_business_date,
  cast(total_debits as double) as total_debits, cast(total_credits as double) as total_credits from {customer_transactions}""")
LOANS = "loan_count, active_loans, paid_off_loans, defaulted_loans, cast(total_loan_amount as double) as total_loan_amount, avg_interest_rate, cast(total_collateral_value as double) as total_collateral_value, cast(most_recent_loan_date as varchar) as most_recent_loan_date"


def _rounded(df):
    return df.withColumn("avg_interest_rate", F.round(F.col("avg_interest_rate").cast("double"), 6))


query("a04_customer_loans", lambda i: _rounded(M.customer_loans(i.stg_loan)), f"select customer_id, {LOANS} from {{customer_loans}}")
query("a05_group_totals", lambda i: Q.balance_totals(i.mart_deposits), "select account_type, count(*) as mart_rows, count(current_balance) as non_null_balances, cast(sum(current_balance) as double) as mart_total_balance from {mart_deposits} group by 1")
query("a06_global_watermark", lambda i: i.mart_deposits.agg(F.count(F.lit(1)).alias("mart_rows"), F.max("latest_business_date").alias("latest"), F.min("latest_business_date").alias("earliest")),
      "select count(*) as mart_rows, cast(max(latest_business_date) as varchar) as latest, cast(min(latest_business_date) as varchar) as earliest from {mart_deposits}")
query("a07_global_having", lambda i: Q.not_empty(i.mart_deposits.filter("current_balance < 0")), "select count(*) as mart_row_count from {mart_deposits} where current_balance < 0 having count(*) = 0")
query("a08_group_having", lambda i: Q.key_not_unique(i.raw_branch, ["branch_code"]), "select branch_code, count(*) as occurrence_count from {raw_branch} group by 1 having count(*) > 1 or branch_code is null")
query("a09_count_if", lambda i: i.mart_deposits.groupBy("branch_code").agg(F.count_if(F.col("transaction_count") == 0).alias("idle"), F.count_if(F.col("tax_id").isNull()).alias("no_tax_id")),
      "select branch_code, count(*) filter (where transaction_count = 0) as idle, count(*) filter (where tax_id is null) as no_tax_id from {mart_deposits} group by 1")
query("a10_count_distinct", lambda i: i.raw_transaction.groupBy("transaction_type").agg(F.count_distinct("account_id").alias("accounts"), F.count_distinct(F.struct("account_id", "business_date")).alias("account_days"), F.count_distinct(F.when(F.col("amount") > 0, F.col("account_id"))).alias("active_accounts")),
      "select transaction_type, count(distinct account_id) as accounts, count(distinct (account_id, business_date)) as account_days, count(distinct case when amount > 0 then account_id end) as active_accounts from {raw_transaction} group by 1")
query("a11_pivot", lambda i: R.pivot_values(i.raw_account.select("customer_id", "account_type", "status"), ["customer_id"], "account_type", "status", ["CHECKING", "SAVINGS", "MONEY_MARKET"]),
      "select customer_id, max(status) filter (where account_type = 'CHECKING') as checking, max(status) filter (where account_type = 'SAVINGS') as savings, max(status) filter (where account_type = 'MONEY_MARKET') as money_market from {raw_account} group by 1")
query("a12_list_distinct", lambda i: R.list_distinct(i.raw_account, ["customer_id"], F.col("branch_code"), "branches"),
      "select customer_id, string_agg(distinct branch_code, ', ' order by branch_code) as branches from {raw_account} group by 1")
query("a14_max_of_group", lambda i: i.raw_account.groupBy("branch_code").agg(F.max("status").alias("status"), F.max("account_number").alias("account_number")),
      "select branch_code, max(status) as status, max(account_number) as account_number from {raw_account} group by 1")
query("a15_with_total", lambda i: R.with_total(i.raw_account, "account_type"),
      "select account_type, count(*) as object_count from {raw_account} group by 1 union all select 'TOTAL', count(*) from {raw_account}")
query("a16_ratio", lambda i: i.mart_deposits.groupBy("branch_code").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("total_debits") > 0).alias("k"), F.count_if(F.col("current_balance") < 0).alias("z")).select(
    "branch_code", S.ratio(F.col("k"), F.col("n"), 2, 100.0).alias("percent"), S.ratio(F.col("k"), F.col("z"), 4).alias("undefined")),
      "select branch_code, round(100.0::double * count(*) filter (where total_debits > 0) / nullif(count(*), 0), 2) as percent, round(count(*) filter (where total_debits > 0)::double / nullif(count(*) filter (where current_balance < 0), 0), 4) as undefined from {mart_deposits} group by 1")
query("a17_count_by", lambda i: R.count_by(i.raw_account, "branch_code", "account_type", latest="opened_date", latest_as="latest"),
      "select branch_code, account_type, count(*) as row_count, cast(max(opened_date) as varchar) as latest from {raw_account} group by 1, 2")
query("a18_gl_controls", lambda i: i.gl_control, "select gl_code, account_type, cast(control_total as double) as control_total, cast(record_count as bigint) as record_count, cast(as_of_date as varchar) as as_of_date from {gl_control}")

# ---- latest, sorts, set operations -----------------------------------------------

query("w01_latest_by", lambda i: R.latest_by(i.outcomes, ["target_table"], "invocation_id", "executed_at"), """
select target_table, invocation_id, executed_at as latest_executed_at from (select target_table, invocation_id, executed_at,
  row_number() over (partition by target_table order by executed_at desc, invocation_id desc) as rn from {outcomes} where invocation_id is not null) x where rn = 1""")
query("w01_latest_run", lambda i: R.of_latest_run(i.outcomes, "invocation_id", "executed_at").select("invocation_id", "test_unique_id"),
      "select invocation_id, test_unique_id from {outcomes} where invocation_id = (select invocation_id from {outcomes} where invocation_id is not null group by 1 order by max(executed_at) desc limit 1)")
query("o01_order_by_rank", lambda i: R.order_by_rank(R.count_by(i.dq_results, "check_dimension"), "check_dimension", Q.DIMENSIONS).select("check_dimension", "row_count", S.rank_of(F.col("check_dimension"), Q.DIMENSIONS).alias("rank")),
      "select check_dimension, count(*) as row_count, case check_dimension when 'COMPLETENESS' then 1 when 'UNIQUENESS' then 2 when 'VALIDITY' then 3 when 'CONSISTENCY' then 4 when 'TIMELINESS' then 5 when 'ACCURACY' then 6 else 99 end::bigint as rank from {dq_results} group by 1 order by rank")
query("o02_newest", lambda i: R.newest(i.access_log, "query_start_time", 20, "query_id").select("query_id", "query_start_time"),
      "select event_id as query_id, ts as query_start_time from {events} order by ts desc, event_id limit 20")
query("o03_sample_filled", lambda i: R.sample_filled(i.stg_customer, ["tax_id", "date_of_birth", "email"], 5, ["customer_id"]).select("customer_id", "tax_id", "email"),
      "select customer_id, tax_id, email from {stg_customer} where tax_id is not null or date_of_birth is not null or email is not null order by customer_id limit 5")
query("o04_multi_key_sort", lambda i: i.gl_control.unionByName(i.gl_control_drift).select("account_type", "as_of_date", "control_total").orderBy("account_type", "as_of_date", "control_total"),
      "select account_type, cast(as_of_date as varchar) as as_of_date, cast(control_total as double) as control_total from (select * from {gl_control} union all select * from {gl_control_drift}) x order by 1, 2, 3")
query("u01_union_all", lambda i: R.labelled_counts({"CUSTOMER": i.raw_customer, "ACCOUNT": i.raw_account, "TRANSACTION": i.raw_transaction, "LOAN": i.raw_loan, "BRANCH": i.raw_branch}),
      "select 'CUSTOMER' as object_name, count(*) as row_count from {raw_customer} union all select 'ACCOUNT', count(*) from {raw_account} union all select 'TRANSACTION', count(*) from {raw_transaction} union all select 'LOAN', count(*) from {raw_loan} union all select 'BRANCH', count(*) from {raw_branch}")
query("u02_union_distinct", lambda i: i.raw_account.select("customer_id").union(i.raw_loan.select("customer_id")).union(i.raw_customer.select("customer_id")).distinct(),
      "select customer_id from {raw_account} union select customer_id from {raw_loan} union select customer_id from {raw_customer}")
query("u03_multiset_difference", lambda i: R.compare_keys(i.raw_transaction, i.stg_transaction, ["transaction_id"]),
      """with e as (select transaction_id, count(*) as source_rows from {raw_transaction} group by 1), m as (select transaction_id, count(*) as mart_rows from {stg_transaction} group by 1)
select e.transaction_id as source_transaction_id, m.transaction_id as mart_transaction_id, source_rows, mart_rows from e full join m on e.transaction_id = m.transaction_id
where e.transaction_id is null or m.transaction_id is null or source_rows <> 1 or mart_rows <> 1""")


def _doubled(i: Inputs):
    """Transactions and a copy of them that lacks some, repeats some and has lost some of the types."""
    left = i.raw_transaction.select("account_id", "transaction_type", "amount")
    right = i.raw_transaction.filter("transaction_id % 50 <> 1").withColumn("transaction_type", F.expr("case when transaction_id % 50 <> 2 then transaction_type end"))
    return left, right.unionByName(right.filter("transaction_id % 50 = 3")).select(*left.columns)


query("u03_difference_by_digest", lambda i: digest.difference(*_doubled(i)), """
with r as (select transaction_id as k, account_id, case when transaction_id % 50 <> 2 then transaction_type end as transaction_type, amount from {raw_transaction} where transaction_id % 50 <> 1),
sides as (select account_id, transaction_type, amount, 1 as l, 0 as r from {raw_transaction} union all select account_id, transaction_type, amount, 0, 1 from r
  union all select account_id, transaction_type, amount, 0, 1 from r where k % 50 = 3)
select account_id, transaction_type, cast(amount as double) as amount, sum(l)::bigint as left_rows, sum(r)::bigint as right_rows from sides group by account_id, transaction_type, amount having sum(l) <> sum(r)""")

# ---- models ----------------------------------------------------------------------

query("m01_mart_deposits", lambda i: i.mart_deposits, f"select {MART} from {{mart_deposits}}")
query("m02_mart_customer_360", lambda i: _rounded(i.mart_customer_360), f"""
select c.customer_id, first_name, last_name, email, phone, tax_id, cast(date_of_birth as varchar) as date_of_birth, customer_type, address,
  cast(most_recent_account_opened as varchar) as most_recent_account_opened, cast(latest_business_date as varchar) as latest_business_date, avg_interest_rate,
  cast(most_recent_loan_date as varchar) as most_recent_loan_date, coalesce(account_count, 0) as account_count, coalesce(savings_count, 0) as savings_count,
  coalesce(checking_count, 0) as checking_count, cast(coalesce(total_balance, 0) as double) as total_balance, coalesce(total_transactions, 0) as total_transactions,
  cast(coalesce(total_debits, 0) as double) as total_debits, cast(coalesce(total_credits, 0) as double) as total_credits, coalesce(loan_count, 0) as loan_count,
  coalesce(active_loans, 0) as active_loans, coalesce(paid_off_loans, 0) as paid_off_loans, coalesce(defaulted_loans, 0) as defaulted_loans,
  cast(coalesce(total_loan_amount, 0) as double) as total_loan_amount, cast(coalesce(total_collateral_value, 0) as double) as total_collateral_value,
  {NOW} as dbt_refreshed_at, '2024-01-31' as dbt_business_date
from {{stg_customer}} c left join {{customer_accounts}} a on a.customer_id = c.customer_id left join {{customer_transactions}} t on t.customer_id = c.customer_id
left join {{customer_loans}} l on l.customer_id = c.customer_id""")


def models(i: Inputs) -> B.Build:
    raw = {"account": i.raw_account, "customer": i.raw_customer, "transaction": i.raw_transaction, "loan": i.raw_loan}
    return B.build(raw, AS_OF)


query("m03_build", lambda i: B.build_counts(models(i)), """
select 'STG_ACCOUNT' as object_name, count(*) as row_count from {stg_account} union all select 'STG_CUSTOMER', count(*) from {stg_customer}
union all select 'STG_TRANSACTION', count(*) from {stg_transaction} union all select 'STG_LOAN', count(*) from {stg_loan}
union all select 'MART_DEPOSITS', count(*) from {mart_deposits} union all select 'MART_CUSTOMER_360', count(*) from {stg_customer}""")
