"""Input relations over the given tables.

The given tables have no tax ids, branches, tags or check results, so each relation
below projects one of them into the shape an operator expects, violations included.
Every relation grows with its table. The text is plain SQL that Spark and DuckDB read
alike, uses no clock and no random function, and names other relations in braces.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia.operators import checks
from custodia.plans import marts, staging
from custodia.session import cut

# Declared schemas of the given tables, so that opening one runs no inference job.
BASE = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
AS_OF = datetime(2024, 1, 31, tzinfo=UTC)
SNAPSHOT = "2002-01-01"


def named(t: str) -> dict[str, str]:
    """SQL for the three-part name of catalog object number ``t``."""
    staged = f"({t}) % 3 = 1 and ({t}) % 2 = 0"
    return {
        "db": f"case ({t}) % 3 when 0 then 'RAW' when 1 then 'ANALYTICS' else 'GOVERNANCE' end",
        "schema": f"case when ({t}) % 3 = 0 then 'PUBLIC' when {staged} then 'STAGING' when ({t}) % 3 = 1 then 'MARTS' else 'CATALOG' end",
        "table": f"case when {staged} then concat('STG_TBL_', cast({t} as string)) else concat('TBL_', cast({t} as string)) end",
    }


T = named("t")
RUN = "cast(floor(event_id / 6) as bigint)"
EVENT_T = "cast(floor(event_id / 60) as bigint)"
E = named(EVENT_T)
EVENT_OBJECT = f"concat({E['db']}, '.', {E['schema']}, '.', {E['table']})"

SQL: dict[str, str] = {}

# ---- bank tables -----------------------------------------------------------------

SQL["raw_customer"] = """
select c_custkey as customer_id, c_name as first_name, concat('L', cast(c_custkey % 100 as string)) as last_name,
  case when c_custkey % 97 = 0 then 'TRUST' when c_custkey % 2 = 0 then 'PERSON' else 'BUSINESS' end as customer_type,
  case when c_custkey % 53 = 0 then null
       when c_custkey % 41 = 0 then concat('X', cast(c_custkey as string))
       when c_custkey % 2 = 0 then concat(lpad(cast(c_custkey % 900 + 100 as string), 3, '0'), '-',
            lpad(cast(c_custkey % 90 + 10 as string), 2, '0'), '-', lpad(cast(c_custkey % 10000 as string), 4, '0'))
       else concat(lpad(cast(c_custkey % 90 + 10 as string), 2, '0'), '-', lpad(cast(c_custkey as string), 7, '0')) end as tax_id,
  date '1940-01-01' + cast((c_custkey * 37) % 20000 as int) as date_of_birth,
  concat('c', cast(c_custkey as string), '@example.com') as email,
  concat('555-', lpad(cast(c_custkey % 1000 as string), 3, '0'), '-', lpad(cast(c_custkey % 10000 as string), 4, '0')) as phone,
  concat(cast(c_custkey as string), ' Main St') as address
from {customer}"""

SQL["raw_account"] = """
select o_orderkey as account_id, o_custkey as customer_id,
  case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'CHECKING' when o_orderpriority = '5-LOW' then 'MONEY_MARKET'
       else 'SAVINGS' end as account_type,
  lpad(cast(o_orderkey as string), 10, '0') as account_number,
  concat('BR_', lpad(cast(o_orderkey % 15 + 1 as string), 2, '0')) as branch_code,
  cast(o_totalprice as decimal(15,2)) as balance,
  case o_orderstatus when 'O' then 'ACTIVE' when 'P' then 'INACTIVE' else 'CLOSED' end as status,
  cast(o_orderdate as date) as opened_date
from {orders}"""

SQL["raw_transaction"] = """
select l_orderkey * 10 + l_linenumber as transaction_id, l_orderkey as account_id,
  case l_returnflag when 'A' then 'CREDIT' when 'R' then 'DEBIT' else 'TRANSFER' end as transaction_type,
  cast(case when l_quantity = 1 then 0 else l_extendedprice end as decimal(12,2)) as amount,
  cast(l_shipdate as date) as business_date,
  concat('flag ', l_returnflag, l_linestatus) as memo
from {lineitem}"""

SQL["raw_loan"] = """
select p_partkey as loan_id, p_partkey % 150 as customer_id, p_partkey % 1500 as account_id,
  case p_partkey % 4 when 0 then 'PERSONAL' when 1 then 'HOME' when 2 then 'AUTO' else 'BUSINESS' end as loan_type,
  cast(case when p_size = 50 then 0 else p_retailprice end as decimal(15,2)) as principal,
  cast(3.50 + (p_partkey % 61) * 0.10 as decimal(5,2)) as interest_rate,
  case p_size % 5 when 0 then 'A' when 1 then 'B' when 2 then 'C' when 3 then 'D' else 'E' end as credit_grade,
  cast(p_retailprice * 1.5 as decimal(15,2)) as collateral_value,
  case when (p_partkey + 1) % 20 = 0 then 'Auto-pay card on file: 4532-0151-1283-0366 for testing only.' else p_name end as loan_memo,
  case p_size % 3 when 0 then 'ACTIVE' when 1 then 'PAID_OFF' else 'DEFAULTED' end as status,
  date '2015-01-01' + cast(p_partkey % 1800 as int) as origination_date
from {part}"""

SQL["raw_branch"] = """
select concat('BR_', lpad(cast(n_nationkey % 15 + 1 as string), 2, '0')) as branch_code, n_name as branch_name,
  cast(n_regionkey as string) as region
from {nation}"""

SQL["query_history"] = """
select event_id as query_id,
  case user_id % 5 when 0 then 'DATA_OWNER' when 1 then 'DATA_STEWARD' when 2 then 'DEPOSITS_ANALYST'
       when 3 then 'BRANCH_HUDSON' else 'SVC_PIPELINE' end as role_name,
  ts as start_time,
  case when event_type = 'error' then 'FAILED' else 'SUCCESS' end as execution_status,
  case when event_type in ('view', 'purchase') then 'select * from analytics.marts.mart_deposits' else 'select 1' end as query_text
from {events}"""

# The same history over many objects: each query names one catalog object.
SQL["usage_history"] = f"""
select query_id, role_name, start_time, execution_status,
  case when query_text = 'select 1' then query_text else concat('select * from ', lower({EVENT_OBJECT.replace('event_id', 'query_id')}), ' limit 10') end as query_text
from {{query_history}}"""

# ---- catalog: every part is a column of a table of twelve ------------------------

SQL["catalog_base"] = f"""
select p_partkey, t, pos, p_name, p_brand, p_type, p_size, {T['db']} as database_name, {T['schema']} as schema_name, {T['table']} as table_name,
  case pos when 0 then 'CUSTOMER_ID' when 1 then 'FIRST_NAME' when 2 then 'LAST_NAME' when 3 then 'EMAIL' when 4 then 'PHONE'
    when 5 then 'TAX_ID' when 6 then 'DATE_OF_BIRTH' when 7 then 'ADDRESS' when 8 then 'ACCOUNT_NUMBER' when 9 then 'BALANCE'
    when 10 then 'BRANCH_CODE' else 'MEMO' end as column_name
from (select p_partkey, cast(floor(p_partkey / 12) as bigint) as t, cast(p_partkey % 12 as int) as pos,
        p_name, p_brand, p_type, p_size from {{part}}) b"""

SQL["cat_columns"] = """
select database_name, schema_name, table_name, pos + 1 as ordinal_position, column_name,
  case p_size % 8 when 0 then 'VARCHAR' when 1 then 'DATE' when 2 then 'DECIMAL' when 3 then 'TIMESTAMP_NTZ'
    when 4 then 'FLOAT' when 5 then 'BIGINT' when 6 then 'TEXT' else 'NUMBER' end as column_type,
  case p_size % 3 when 0 then null when 1 then '' else p_name end as column_comment,
  case when pos = 0 then 'NO' else 'YES' end as is_nullable,
  cast(date '2024-01-01' + cast(p_size % 30 as int) as timestamp) as harvested_at, p_size
from {catalog_base}"""

SQL["cat_tables"] = """
select database_name, schema_name, table_name,
  case when min(p_size) % 4 = 0 then 'VIEW' else 'BASE TABLE' end as object_type,
  cast(null as string) as table_comment, cast(sum(p_size) as bigint) as row_count,
  cast(date '2023-01-01' + cast(max(p_size) as int) as timestamp) as created_on,
  cast(date '2023-06-01' + cast(min(p_size) as int) as timestamp) as last_altered,
  cast(date '2024-01-01' + cast(min(p_size) as int) as timestamp) as harvested_at,
  min(t) as t, min(p_size) as least, max(p_size) as most
from {catalog_base} group by database_name, schema_name, table_name"""

SQL["dictionary"] = """
select case when p_size % 2 = 0 then lower(table_name) else table_name end as table_name, column_name,
  case p_size % 5 when 0 then null when 1 then '' else concat('About ', p_name) end as column_description,
  'VARCHAR' as data_type,
  case p_size % 7 when 0 then 'PII' when 1 then 'ACCOUNT_DETAILS' when 2 then 'SENSITIVE' when 3 then 'POTENTIALLY_SENSITIVE'
    when 4 then null else 'PUBLIC' end as sensitivity_classification,
  p_size % 10 = 0 as is_cde, p_type as notes, p_size
from {catalog_base} where p_size <> 11"""

SQL["cdes"] = """
select p_partkey as cde_id, database_name, schema_name, lower(table_name) as table_name, column_name, p_name as cde_name,
  case p_size % 3 when 0 then 'CRITICAL' when 1 then 'HIGH' else 'MEDIUM' end as criticality_level,
  p_brand as business_owner, p_type as description, p_size
from {catalog_base} where p_size > 40"""

SQL["terms"] = """
select s_suppkey as term_id, s_name as term_name, concat('Definition of ', s_name) as definition,
  cast(s_nationkey as string) as business_domain, cast(null as string) as synonyms, s_acctbal
from {supplier}"""

SQL["mappings"] = """
select database_name, schema_name, table_name, column_name, cast(floor(p_partkey / 20) as bigint) as term_id, p_size
from {catalog_base} where p_size <> 9"""

SQL["tags"] = """
select database_name, schema_name, table_name, cast(null as string) as column_name, 'TABLE' as domain, 'DATA_OWNER' as tag_name,
  case when least = 4 then ' ' else concat('Team ', cast(t % 7 as string)) end as tag_value, 'MANUAL' as apply_method
from {cat_tables} where least < 8
union all
select database_name, schema_name, table_name, cast(null as string), 'TABLE', 'DATA_STEWARD', concat('Steward ', cast(t % 5 as string)), 'MANUAL'
from {cat_tables} where most > 44
union all
select database_name, schema_name, table_name, cast(null as string), 'TABLE', 'CERTIFICATION', 'IN_PROGRESS', 'MANUAL'
from {cat_tables} where most <> 50
union all
select database_name, schema_name, table_name, column_name, 'COLUMN', 'CLASSIFICATION',
  case p_size % 6 when 0 then 'PII' when 1 then 'ACCOUNT_DETAILS' when 2 then 'SENSITIVE' when 3 then 'QUASI_IDENTIFIER'
    when 4 then 'INTERNAL' else 'PUBLIC' end, case when p_size < 10 then 'PROPAGATED' else 'MANUAL' end
from {catalog_base} where p_size < 20
union all
select database_name, schema_name, table_name, column_name, 'COLUMN', 'CDE', case when p_size > 45 then 'NO' else 'YES' end, 'MANUAL'
from {catalog_base} where p_size > 40
union all
select database_name, schema_name, table_name, column_name, 'COLUMN', 'CDE_TIER', cast(p_size % 3 + 1 as string), 'MANUAL'
from {catalog_base} where p_size > 42
union all
select database_name, schema_name, table_name, column_name, 'COLUMN', 'OLD_TAG', p_brand, 'MANUAL'
from {catalog_base} where p_size = 13"""

SQL["system_tags"] = """
select database_name, schema_name, table_name, column_name,
  case when p_size % 2 = 0 then 'SEMANTIC_CATEGORY' else 'semantic_category' end as tag_name,
  case pos when 3 then 'EMAIL' when 4 then 'PHONE_NUMBER' when 5 then 'NATIONAL_IDENTIFIER' when 6 then 'DATE_OF_BIRTH'
    when 1 then 'NAME' when 11 then 'CARD_PAN' when 10 then 'CITY' else 'ADDRESS' end as tag_value,
  'AUTO_CLASSIFIED' as apply_method
from {catalog_base} where pos in (1, 3, 4, 5, 6, 10, 11) and p_size < 46
union all
select database_name, schema_name, table_name, column_name, 'PRIVACY_CATEGORY', 'IDENTIFIER', 'AUTO_CLASSIFIED'
from {catalog_base} where pos in (0, 3, 4, 5, 11) and p_size > 4
union all
select database_name, schema_name, table_name, column_name, 'CLASSIFICATION', 'PII', 'MANUAL'
from {catalog_base} where pos in (3, 5)"""

SQL["truth"] = """
select replace(table_name, 'STG_', '') as table_name, column_name, 'PII' as expected_classification,
  case when pos < 8 then 'CONFIRMED' else 'MISLABELED' end as source_section, p_name as reason
from {catalog_base} where database_name = 'ANALYTICS' and schema_name = 'STAGING' and pos in (1, 2, 3, 5, 6, 7, 8, 11) and p_size < 48"""

SQL["queue"] = """
select md5(concat(database_name, ':', schema_name, ':', table_name, ':', column_name)) as review_id,
  database_name, schema_name, table_name, column_name,
  'CITY' as detected_semantic_category, 'IDENTIFIER' as detected_privacy_category, 'BUILT_IN' as classifier_source,
  cast(null as string) as suggested_classification,
  case when p_size % 4 = 1 then case p_size % 3 when 0 then 'PII' when 1 then 'SENSITIVE' else 'PUBLIC' end end as confirmed_classification,
  case p_size % 4 when 1 then 'APPROVED' when 2 then 'REJECTED' else 'PENDING' end as review_status,
  case when p_size % 4 in (1, 2) then concat('user', cast(pos as string)) end as reviewed_by,
  case when p_size % 4 in (1, 2) then cast(date '2024-01-01' + cast(p_size as int) as timestamp) end as reviewed_at,
  cast(null as string) as review_notes, cast(date '2023-12-01' as timestamp) as created_at
from {catalog_base} where p_size between 5 and 40"""

SQL["decisions"] = """
select md5(concat(database_name, ':', schema_name, ':', table_name, ':', column_name)) as review_id,
  case when pos % 2 = 0 then 'APPROVE' else 'REJECT' end as action,
  case p_size % 4 when 0 then 'PII' when 3 then 'SENSITIVE' when 1 then 'PUBLIC' else 'POTENTIALLY_SENSITIVE' end as classification,
  p_name as notes, concat('steward', cast(pos as string)) as user
from {catalog_base} where p_size > 20"""

SQL["bindings"] = """
select 'CLASSIFICATION_MASK_VARCHAR' as policy_name, 'MASKING_POLICY' as policy_kind, 'ACTIVE' as policy_status
union all select 'CLASSIFICATION_MASK_DATE', 'MASKING_POLICY', 'ACTIVE'
union all select 'CLASSIFICATION_MASK_NUMBER', 'MASKING_POLICY', 'INACTIVE'
union all select 'BRANCH_ENTITLEMENT_POLICY', 'ROW_ACCESS_POLICY', 'ACTIVE'"""

# One binding per catalog column that carries a policy, for the policy scan.
SQL["policy_refs"] = """
select case p_size % 4 when 0 then 'CLASSIFICATION_MASK_VARCHAR' when 1 then 'CLASSIFICATION_MASK_DATE'
    when 2 then 'CLASSIFICATION_MASK_NUMBER' else 'BRANCH_ENTITLEMENT_POLICY' end as policy_name,
  case when p_size % 4 = 3 then 'ROW_ACCESS_POLICY' else 'MASKING_POLICY' end as policy_kind,
  case when p_size > 40 then 'INACTIVE' else 'ACTIVE' end as policy_status,
  concat(database_name, '.', schema_name, '.', table_name) as ref_entity_name, column_name as ref_column_name
from {catalog_base}"""

SQL["grants"] = """
select concat('ROLE_', cast(n_regionkey as string)) as role, concat('ROLE_', cast(n_regionkey as string), '_', cast(n_nationkey as string)) as granted_role from {nation}
union all
select concat('ROLE_', cast(n_regionkey as string), '_', cast(n_nationkey as string)), concat('USER_', cast(c_custkey as string))
from {customer} join {nation} on c_nationkey = n_nationkey
union all
select 'ROOT', concat('ROLE_', cast(r_regionkey as string)) from {region}"""

SQL["branch_grants"] = """
select concat('BRANCH_ROLE_', cast(c_custkey % 40 as string)) as role_name, concat('BR_', lpad(cast(c_nationkey % 15 + 1 as string), 2, '0')) as branch_code, count(*) as n
from {customer} group by 1, 2"""

# ---- quality history: six events are a run, ten runs a table ---------------------

SQL["outcomes"] = f"""
select case when r % 50 = 49 then null else concat('run-', lpad(cast(r as string), 9, '0')) end as invocation_id,
  concat('test.', cast(event_id as string)) as test_unique_id, {E['db']} as target_database, {E['schema']} as target_schema, {E['table']} as target_table, {E['table']} as mart_name,
  case when event_type = 'signup' and r % 4 = 1 and event_id % 6 = 5 then 'UNIQUENESS' else
    case event_id % 6 when 0 then 'COMPLETENESS' when 1 then 'UNIQUENESS' when 2 then 'VALIDITY' when 3 then 'CONSISTENCY'
      when 4 then 'TIMELINESS' else 'ACCURACY' end end as check_dimension,
  concat('check_', cast(event_id % 6 as string)) as check_type, 'ACCOUNT_ID' as target_column, 'MART_ROW' as failure_unit,
  case when r % 4 = 1 and event_type in ('error', 'view') then 'fail' when r % 4 = 2 and event_type = 'signup' then 'skipped'
    when r % 4 = 2 and event_type = 'error' then 'error' when r % 4 = 2 and event_type = 'click' then 'not_executed' else 'pass' end as dbt_status,
  case when r % 4 = 1 and event_type = 'error' then cast(floor(value) as bigint)
    when r % 4 = 2 and event_type in ('signup', 'error', 'click') then null
    when r % 4 = 2 and event_type = 'purchase' then -1 else 0 end as failed_rows,
  case r % 8 when 3 then 'fail' when 7 then 'error' else 'pass' end as prerequisite_status,
  case r % 8 when 3 then 1 when 7 then null else 0 end as prerequisite_failures,
  ts as executed_at, event_id
from (select *, {RUN} as r from {{events}}) e"""

# ---- lineage: keys of five tables as a graph that grows with them ----------------

SQL["edges"] = """
select 'RAW' as source_database, 'PUBLIC' as source_schema, concat('REGION_', cast(r_regionkey as string)) as source_object,
  'TABLE' as source_object_domain, cast(null as string) as source_column,
  'RAW' as target_database, 'PUBLIC' as target_schema, concat('NATION_', cast(n_nationkey as string)) as target_object,
  'TABLE' as target_object_domain, cast(null as string) as target_column
from {region} join {nation} on n_regionkey = r_regionkey
union all
select 'RAW', 'PUBLIC', concat('NATION_', cast(c_nationkey as string)), 'TABLE', null,
  'ANALYTICS', 'STAGING', concat('CUSTOMER_', cast(c_custkey as string)), 'TABLE', null
from {customer}
union all
select 'RAW', 'PUBLIC', concat('NATION_', cast(c_nationkey as string)), 'TABLE', 'NATIONKEY',
  'ANALYTICS', 'STAGING', concat('CUSTOMER_', cast(c_custkey as string)), 'TABLE', 'NATIONKEY'
from {customer} where c_mktsegment = 'BUILDING'
union all
select 'ANALYTICS', 'STAGING', concat('CUSTOMER_', cast(o_custkey as string)), 'TABLE', null,
  'ANALYTICS', 'MARTS', concat('ORDERS_', cast(o_orderkey as string)), 'VIEW', null
from {orders}
union all
select 'ANALYTICS', 'STAGING', concat('CUSTOMER_', cast(o_custkey as string)), 'TABLE', 'NATIONKEY',
  'ANALYTICS', 'MARTS', concat('ORDERS_', cast(o_orderkey as string)), 'VIEW', 'CUSTKEY'
from {orders} where o_orderpriority = '1-URGENT'
union all
select 'ANALYTICS', 'MARTS', concat('ORDERS_', cast(l_orderkey as string)), 'VIEW', null,
  'ANALYTICS', 'MARTS', concat('LINEITEM_', cast(l_orderkey as string), '_', cast(l_linenumber as string)), 'TABLE', null
from {lineitem}"""

# A captured snapshot: edges into the catalog's objects, in all three evidence kinds.
SQL["snapshot"] = """
select 'RAW' as source_database, 'PUBLIC' as source_schema, concat('SRC_', p_brand) as source_object, 'TABLE' as source_object_domain,
  case when p_size % 2 = 0 then column_name end as source_column,
  database_name as target_database, schema_name as target_schema, table_name as target_object, 'TABLE' as target_object_domain,
  case when p_size % 2 = 0 then column_name end as target_column,
  case p_size % 5 when 0 then 'DOWNSTREAM' else 'UPSTREAM' end as direction, p_size % 5 + 1 as distance,
  case p_size % 4 when 1 then 'OBJECT_DEPENDENCIES' when 2 then 'ACCESS_HISTORY' else 'NATIVE_LINEAGE' end as lineage_source,
  cast(date '2024-01-01' + cast(p_size as int) as timestamp) as captured_at, p_size
from {catalog_base} where p_size < 12"""

SQL["external"] = """
select case when s_nationkey < 5 then 'LEGACY_ETL' else concat('SYSTEM_', cast(s_nationkey as string)) end as source_system,
  concat('job_', cast(s_suppkey as string)) as source_object, cast(null as string) as source_column,
  case when s_acctbal > 5000 then 'BI_TOOL' else 'WAREHOUSE' end as target_system,
  concat('RAW.PUBLIC.T_', cast(s_suppkey as string)) as target_object, cast(null as string) as target_column,
  'LEGACY_UPSTREAM' as relationship_type, case when s_acctbal < 0 then 'AUTOMATIC' else 'EXTERNAL_MANUAL' end as registration_type,
  s_name as notes, cast(date '2024-01-01' as timestamp) as created_at, s_acctbal
from {supplier}"""

SQL["dependencies"] = """
select 'ANALYTICS' as referencing_database, 'MARTS' as referencing_schema,
  case when o_orderpriority = '1-URGENT' then 'MART_DEPOSITS' else concat('MART_', cast(o_custkey as string)) end as referencing_object_name,
  'VIEW' as referencing_object_domain, 'ANALYTICS' as referenced_database,
  case when o_orderpriority = '5-LOW' then 'MARTS' else 'STAGING' end as referenced_schema,
  case when o_orderpriority = '5-LOW' then 'MART_DEPOSITS' else concat('STG_', cast(o_orderkey as string)) end as referenced_object_name,
  'TABLE' as referenced_object_domain, case o_orderstatus when 'O' then 'BY_NAME' else 'BY_ID' end as dependency_type
from {orders}"""

# ---- certification history: every order is a certification run -------------------

SQL["cert_runs"] = """
select concat('cert-', lpad(cast(o_orderkey as string), 12, '0')) as certification_run_id, 'ANALYTICS' as database_name, 'MARTS' as schema_name,
  concat('MART_', cast(o_custkey as string)) as object_name,
  case when o_orderkey % 6 = 0 then 'CERTIFIED' else 'IN_PROGRESS' end as final_status,
  case when o_orderkey % 6 = 0 then 7 else 6 end as passed_controls, 7 as total_controls,
  o_orderdate as completed_at, o_orderkey
from {orders}"""

SQL["cert_scorecard"] = "\nunion all\n".join(
    f"""select certification_run_id, database_name, schema_name, object_name, '{c}' as control_name,
  case when o_orderkey % 6 = 0 or o_orderkey % 7 <> {k} then 'PASS' else 'FAIL' end as control_status,
  cast(o_orderkey % {k + 2} as string) as evidence_value, 'detail' as evidence_details, completed_at as evaluated_at
from {{cert_runs}}"""
    for k, c in enumerate(("OWNED", "DEFINED", "TRACEABLE", "TRUSTED", "SECURE", "ADOPTED", "RECONCILED"))
)


class Inputs:
    """The relations of one data folder as DataFrames, each built once and on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            self._built[name] = self._make(name)
        return self._built[name]

    def _make(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.schema(BASE[name]).parquet(f"{self.folder}/{name}.parquet")
        if name in SQL:
            text, tables = composed(name)
            return self.spark.sql(text, **{t: getattr(self, t) for t in tables})
        if name in DERIVED:
            return DERIVED[name](self)
        raise AttributeError(name)


def needed(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{([a-z_]\w*)\}", sql)))


def composed(name: str) -> tuple[str, list[str]]:
    """One statement for a relation, with the ones it builds on as common table expressions."""
    ctes: dict[str, str] = {}
    tables: set[str] = set()

    def add(text: str) -> None:
        for n in needed(text):
            if n in BASE:
                tables.add(n)
            elif n not in ctes:
                add(SQL[n])
                ctes[n] = SQL[n]

    add(SQL[name])
    text = SQL[name]
    if ctes:
        text = "with " + ",\n".join(f"{n} as ({body})" for n, body in ctes.items()) + text
    for n in ctes:
        text = text.replace("{" + n + "}", n)
    return text, sorted(tables)


def _drift(i: Inputs) -> DataFrame:
    extra = F.when(F.col("account_type") == "CHECKING", F.lit("1.00")).otherwise(F.lit("1.01")).cast("decimal(5,2)")
    return i.gl_control.withColumn("control_total", (F.col("control_total") + extra).cast("decimal(38,2)"))


def _access(i: Inputs) -> DataFrame:
    """Nested access records of every event: what it read, what it wrote, column by column."""
    name = F.concat(F.lit("RAW.PUBLIC.TBL_"), F.col("user_id").cast("string"))
    column = F.concat(F.lit("C_"), F.col("event_type"))

    def obj(full_name, *columns):
        return F.struct(full_name.alias("objectName"), F.lit("TABLE").alias("objectDomain"), F.array(*columns).alias("columns"))

    def read(full_name):
        return obj(full_name, F.struct(column.alias("columnName")))

    def wrote(full_name):
        origin = F.array(F.struct(name.alias("objectName"), column.alias("columnName")))
        return obj(full_name, F.struct(F.concat(F.lit("M_"), column).alias("columnName"), origin.alias("directSources")))

    lookup = F.lit("RAW.PUBLIC.LOOKUP")
    mart = F.lit("ANALYTICS.MARTS.MART_DEPOSITS")
    other = F.concat(F.lit("ANALYTICS.MARTS.TBL_"), (F.col("user_id") % 7).cast("string"))
    kind = F.col("event_type")
    return i.events.select(
        F.col("event_id").alias("query_id"), F.col("ts").alias("query_start_time"), "user_id",
        F.when(kind == "purchase", F.array(read(name), read(lookup))).otherwise(F.array(read(name))).alias("direct_objects_accessed"),
        F.when(kind.isin("view", "purchase"), F.array(wrote(mart), wrote(other))).otherwise(F.array(wrote(other))).alias("objects_modified"),
    )


DERIVED = {
    "stg_customer": lambda i: staging.stg_customer(i.raw_customer, AS_OF),
    "stg_account": lambda i: staging.stg_account(i.raw_account, AS_OF),
    "stg_transaction": lambda i: staging.stg_transaction(i.raw_transaction, AS_OF),
    "stg_loan": lambda i: staging.stg_loan(i.raw_loan, AS_OF),
    "mart_deposits": lambda i: marts.mart_deposits(i.stg_account, i.stg_customer, i.stg_transaction, AS_OF),
    "mart_customer_360": lambda i: marts.mart_customer_360(i.stg_customer, i.stg_account, i.stg_transaction, i.stg_loan, AS_OF),
    "gl_control": lambda i: marts.derive_gl_controls(i.raw_account, SNAPSHOT),
    "gl_control_drift": _drift,
    "dq_results": lambda i: checks.resolve_status(i.outcomes),
    "access_log": _access,
    # Lineage is kept as a table; the hop loops read it once per hop.
    "stored_edges": lambda i: cut(i.edges),
}
