"""Scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from custodia.functions import masks
from custodia.functions import scalars as S
from custodia.operators import relational as R
from custodia.queries.inputs import AS_OF
from custodia.queries.registry import query

NOW = "timestamp '2024-01-31 00:00:00'"

query("f01_coalesce_nullif", lambda i: i.cat_columns.join(i.dictionary.select("column_name", "column_description", F.upper("table_name").alias("u")), (F.upper("table_name") == F.col("u")) & (i.cat_columns.column_name == i.dictionary.column_name), "left").select(i.cat_columns.table_name, i.cat_columns.column_name, S.first_filled(F.col("column_comment"), F.col("column_description")).alias("description")),
      "select c.table_name, c.column_name, coalesce(nullif(column_comment, ''), nullif(column_description, '')) as description from {cat_columns} c left join {dictionary} d on upper(c.table_name) = upper(d.table_name) and c.column_name = d.column_name")
query("f02_casts", lambda i: i.raw_account.select("account_id", F.col("balance").cast("decimal(38,2)").alias("wide"), F.col("account_number").cast("bigint").alias("number"), F.lit(None).cast("string").alias("nothing")),
      "select account_id, cast(cast(balance as decimal(38,2)) as double) as wide, cast(account_number as bigint) as number, cast(null as varchar) as nothing from {raw_account}")
query("f03_abs_round_floor", lambda i: i.customer.select("c_custkey", F.abs("c_acctbal").alias("a"), F.round(F.col("c_acctbal").cast("decimal(15,2)"), 1).alias("r"), (F.floor(F.col("c_acctbal") / 1000) * 1000).alias("f")),
      "select c_custkey, abs(c_acctbal) as a, cast(round(cast(c_acctbal as decimal(15,2)), 1) as double) as r, cast(floor(c_acctbal / 1000) * 1000 as bigint) as f from {customer}")
query("f04_case_and_trim", lambda i: i.documents.select("doc_id", F.upper("lang").alias("u"), F.lower("source").alias("l"), F.length(F.trim("text")).alias("n")),
      "select doc_id, upper(lang) as u, lower(source) as l, length(trim(text, ' ')) as n from {documents}")
query("f05_string_parts", lambda i: i.raw_customer.select("customer_id", masks.partial_string(F.col("email")).alias("email"), masks.partial_string(F.col("last_name")).alias("last_name")),
      "select customer_id, concat(substr(email, 1, 2), repeat('*', length(email) - 4), substr(email, length(email) - 1)) as email, case when length(last_name) <= 4 then '****' else concat(left(last_name, 2), repeat('*', length(last_name) - 4), right(last_name, 2)) end as last_name from {raw_customer}")
query("f06_replace", lambda i: i.part.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("name")), "select p_partkey, replace(p_name, ' ', '_') as name from {part}")
query("f07_split_part", lambda i: i.policy_refs.select("policy_name", *[S.name_part(F.col("ref_entity_name"), k).alias(n) for k, n in enumerate(("database_name", "schema_name", "table_name"), 1)]),
      "select policy_name, split_part(ref_entity_name, '.', 1) as database_name, split_part(ref_entity_name, '.', 2) as schema_name, split_part(ref_entity_name, '.', 3) as table_name from {policy_refs}")
query("f08_position", lambda i: i.pages.select("page_id", F.instr("html", "</").alias("first_close"), F.instr("url", "://").alias("scheme_end")), "select page_id, instr(html, '</') as first_close, instr(url, '://') as scheme_end from {pages}")
query("f09_regexp", lambda i: i.cat_columns.select("table_name", "column_name", R.strip_prefix(F.col("table_name"), "STG_").alias("base"), F.col("column_name").rlike("^[A-Z]+_ID$").alias("is_id")),
      "select table_name, column_name, regexp_replace(table_name, '^STG_', '') as base, regexp_matches(column_name, '^[A-Z]+_ID$') as is_id from {cat_columns}")
query("f10_ilike", lambda i: i.documents.filter(F.col("text").ilike("%the%")).groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "select lang, count(*) as n from {documents} where text ilike '%the%' group by 1")
query("f11_md5", lambda i: i.outcomes.select("test_unique_id", S.key_id(F.coalesce("invocation_id", F.lit("none")), F.col("test_unique_id")).alias("dq_result_id")),
      "select test_unique_id, md5(concat(coalesce(invocation_id, 'none'), ':', test_unique_id)) as dq_result_id from {outcomes}")
query("f12_stable_ids", lambda i: i.cat_columns.select(S.key_id("database_name", "schema_name", "table_name", "column_name").alias("review_id")).groupBy("review_id").agg(F.count(F.lit(1)).alias("n")),
      "select md5(concat(database_name, ':', schema_name, ':', table_name, ':', column_name)) as review_id, count(*) as n from {cat_columns} group by 1")
query("f13_clock", lambda i: i.events.select("event_id", F.lit(AS_OF).alias("now"), F.to_date(F.lit(AS_OF)).alias("today"), F.date_diff(F.lit(AS_OF), "ts").alias("age_days")),
      f"select event_id, {NOW} as now, '2024-01-31' as today, date_diff('day', cast(ts as date), date '2024-01-31') as age_days from {{events}}")
query("f14_dateadd", lambda i: i.events.select("event_id", (F.col("ts") - F.make_interval(hours=F.lit(167))).alias("from_ts"), (F.col("ts") + F.make_interval(days=F.lit(7))).alias("to_ts")),
      "select event_id, ts - interval 167 hour as from_ts, ts + interval 7 day as to_ts from {events}")
query("f15_year_start", lambda i: i.raw_loan.select("loan_id", masks.partial_date(F.col("origination_date")).alias("year_start")), "select loan_id, cast(make_date(year(origination_date), 1, 1) as varchar) as year_start from {raw_loan}")
query("f16_stamp_text", lambda i: i.events.select("event_id", S.stamp(F.col("ts").cast("timestamp")).alias("zoned"), S.stamp(F.col("ts").cast("timestamp"), S.STAMP_COMPACT).alias("compact")),
      "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S +00:00') as zoned, strftime(ts, '%Y_%m_%d_%H_%M_%S') as compact from {events}")
query("f17_object_text", lambda i: i.orders.select("o_orderkey", F.to_json(F.struct("o_custkey", "o_orderstatus")).alias("doc")),
      "select o_orderkey, concat('{\"o_custkey\":', o_custkey, ',\"o_orderstatus\":\"', o_orderstatus, '\"}') as doc from {orders}")
query("f18_variant_path", lambda i: i.events.select("event_id", S.variant_field(F.col("props"), "K", "k").alias("k")), "select event_id, coalesce(json_extract_string(props, '$.K'), json_extract_string(props, '$.k')) as k from {events}")
query("f19_session_role", lambda i: i.query_history.select("query_id", F.col("role_name").isin("DATA_OWNER", "SVC_PIPELINE").alias("sees_clear")), "select query_id, role_name in ('DATA_OWNER', 'SVC_PIPELINE') as sees_clear from {query_history}")
query("f20_policy_for_type", lambda i: i.cat_columns.select("table_name", "column_name", masks.policy_for_type(F.col("column_type")).alias("policy")),
      "select table_name, column_name, case when column_type in ('VARCHAR', 'TEXT') then 'CLASSIFICATION_MASK_VARCHAR' when column_type = 'DATE' then 'CLASSIFICATION_MASK_DATE' when column_type in ('DECIMAL', 'NUMBER', 'BIGINT') then 'CLASSIFICATION_MASK_NUMBER' end as policy from {cat_columns}")
