"""Classification, review and protection."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from custodia.functions import masks
from custodia.operators import classify as C
from custodia.operators import protect as P
from custodia.operators import relational as R
from custodia.operators import review as V
from custodia.queries.inputs import AS_OF, Inputs
from custodia.queries.registry import VIEWS, query
from custodia.session import cut, scratch_path

NOW = "timestamp '2024-01-31 00:00:00'"
KEY = "database_name, schema_name, table_name, column_name"
ALL = (*C.BUILT_IN, C.CARD_PAN)


def sql_scan(relation: str, columns: list[tuple[str, bool]], detectors: list[tuple], table: tuple[str, str, str] | None = None) -> str:
    """One SQL row per (column, detector): (category, privacy, source, pattern, threshold, named columns)."""
    rows = []
    for c, text in columns:
        for cat, priv, src, pattern, threshold, names in detectors:
            hits = f"count(*) filter (where regexp_matches({c}, '{pattern}'))" if pattern and text else "0::bigint"
            share = f"coalesce({hits} / nullif(count({c}), 0), 0.0)::double"
            found = "true" if c in names else f"({share} >= {threshold} and {hits} > 0)"
            name = "" if table is None else f"'{table[0]}' as database_name, '{table[1]}' as schema_name, '{table[2]}' as table_name, "
            rows.append(f"select {name}'{c}' as column_name, '{cat}' as semantic_category, '{priv}' as privacy_category, '{src}' as classifier_source, "
                        f"count({c}) as values_seen, {hits} as values_matched, round({share}, 6) as share, {found} as detected from {{{relation}}}")
    return "\nunion all ".join(rows)


BUILT_IN_SQL = [
    ("EMAIL", "IDENTIFIER", "BUILT_IN", "^[^@ ]+@[^@ ]+[.][a-z]+$", 0.5, ()),
    ("PHONE_NUMBER", "IDENTIFIER", "BUILT_IN", "^[0-9]{3}-[0-9]{3}-[0-9]{4}$", 0.5, ()),
    ("NATIONAL_IDENTIFIER", "IDENTIFIER", "BUILT_IN", "^([0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{2}-[0-9]{7})$", 0.5, ()),
    ("DATE_OF_BIRTH", "QUASI_IDENTIFIER", "BUILT_IN", None, 0, ("date_of_birth",)),
    ("NAME", "IDENTIFIER", "BUILT_IN", None, 0, ("first_name", "last_name")),
    ("ADDRESS", "QUASI_IDENTIFIER", "BUILT_IN", "^[0-9]+ .* (St|Street|Ave|Avenue|Rd|Road)$", 0.5, ()),
    ("CARD_PAN", "IDENTIFIER", "CUSTOM_PAN_CLASSIFIER", "[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}", 0.05, ()),
]


def _shown(df, *extra):
    return df.select(*extra, "column_name", "semantic_category", "privacy_category", "classifier_source", "values_seen", "values_matched", F.round("share", 6).alias("share"), "detected")


# ---- classification --------------------------------------------------------------

query("c01_profile_scope", lambda i: C.in_scope(i.cat_tables, C.Profile(min_object_age_days=348, classify_views=False), AS_OF).select("database_name", "schema_name", "table_name"),
      f"select database_name, schema_name, table_name from {{cat_tables}} where created_on <= {NOW} - interval 348 day and object_type not like '%VIEW%'")
query("c01_profile_expired", lambda i: C.expired(i.queue.withColumn("captured_at", F.col("reviewed_at")), C.Profile(validity_days=10), AS_OF).select("review_id", "captured_at"),
      f"select review_id, reviewed_at as captured_at from {{queue}} where reviewed_at < {NOW} - interval 10 day")
query("c02_regex_detector", lambda i: _shown(C.scan(i.raw_loan, [C.CARD_PAN], ["loan_memo"])), sql_scan("raw_loan", [("loan_memo", True)], BUILT_IN_SQL[-1:]))

STAGED_COLUMNS = {
    "stg_customer": [("customer_id", False), ("first_name", True), ("last_name", True), ("email", True), ("phone", True), ("tax_id", True), ("date_of_birth", False), ("address", True), ("customer_type", True), ("source_table", True), ("source_system", True), ("dbt_loaded_at", False)],
    "stg_account": [("account_id", False), ("customer_id", False), ("account_number", True), ("account_type", True), ("status", True), ("balance", False), ("branch_code", True), ("opened_date", False), ("source_table", True), ("source_system", True), ("dbt_loaded_at", False)],
    "stg_loan": [("loan_id", False), ("customer_id", False), ("account_id", False), ("principal", False), ("loan_type", True), ("status", True), ("interest_rate", False), ("origination_date", False), ("collateral_value", False), ("credit_grade", True), ("loan_memo", True), ("source_table", True), ("source_system", True), ("dbt_loaded_at", False)],
    "stg_transaction": [("transaction_id", False), ("account_id", False), ("business_date", False), ("transaction_type", True), ("amount", False), ("memo", True), ("source_table", True), ("source_system", True), ("dbt_loaded_at", False)],
}


def staged_scan(i: Inputs):
    tables = {("ANALYTICS", "STAGING", n.upper()): getattr(i, n) for n in STAGED_COLUMNS}
    return C.classify_schema(tables, ALL)


VIEWS["staged_scan"] = "\nunion all ".join(sql_scan(n, cols, BUILT_IN_SQL, ("ANALYTICS", "STAGING", n.upper())) for n, cols in STAGED_COLUMNS.items())
query("c03_classify_schema", lambda i: _shown(staged_scan(i), "database_name", "schema_name", "table_name"), "select * from {staged_scan}")


def _rescanned(i: Inputs):
    """Loans classified file by file; then more arrive and only their files are read."""
    path, text = scratch_path(i.spark, "loans"), ["loan_memo", "credit_grade"]
    i.raw_loan.filter("loan_id % 10 < 7").select("loan_id", *text).repartition(3).write.parquet(path)
    first = cut(C.rescan(i.spark.read.parquet(path), None, ALL, AS_OF, columns=text))
    i.raw_loan.filter("loan_id % 10 >= 7").select("loan_id", *text).write.mode("append").parquet(path)
    both = C.rescan(i.spark.read.parquet(path), first, ALL, AS_OF + timedelta(days=1), columns=text)
    return _shown(C.merged(both, ALL))


query("c03_rescan", _rescanned, sql_scan("raw_loan", [("loan_memo", True), ("credit_grade", True)], BUILT_IN_SQL))
query("c01_auto_tag",
      lambda i: R.union_all([C.system_tags(staged_scan(i), C.Profile(auto_tag=on)).select(F.lit(on).alias("auto_tag"), "table_name", "column_name", "tag_name") for on in (True, False)]),
      """select distinct true as auto_tag, table_name, column_name, tag_name from {staged_scan} cross join (values ('SEMANTIC_CATEGORY'), ('PRIVACY_CATEGORY')) t(tag_name) where detected""")
query("c04_classify_table", lambda i: _shown(C.classify_table(i.stg_loan, ("ANALYTICS", "STAGING", "STG_LOAN"), ALL), "table_name").filter("detected"),
      "select column_name, semantic_category, privacy_category, classifier_source, values_seen, values_matched, share, detected, table_name from {staged_scan} where table_name = 'STG_LOAN' and detected")
TEXT_SQL = [
    ("EMAIL", "IDENTIFIER", "BUILT_IN", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", 0.05, ()),
    ("PHONE_NUMBER", "IDENTIFIER", "BUILT_IN", "[0-9]{3}-[0-9]{3}-[0-9]{4}", 0.05, ()),
    ("IP_ADDRESS", "QUASI_IDENTIFIER", "BUILT_IN", "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", 0.05, ()),
]
for _t, _c in (("documents", "text"), ("conversations", "text"), ("pages", "html")):
    query(f"c03_scan_text_{_t}", lambda i, t=_t, c=_c: _shown(C.scan(getattr(i, t), C.FREE_TEXT[:3], [c])), sql_scan(_t, [(_c, True)], TEXT_SQL))


def _cards(i: Inputs):
    """Documents with a card-like number, and whether one of them passes the checksum."""
    card = C.FREE_TEXT[3]
    loose = C.Detector(card.category, card.privacy, card.pattern)
    return i.documents.filter(C.hit(F.col("text"), loose)).select("doc_id", C.hit(F.col("text"), card).alias("is_card"))


query("c05_luhn", _cards, """
select doc_id, list_bool_or(list_transform(regexp_extract_all(text, '[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}'), lambda m: list_sum(list_transform(range(1, 17), lambda k:
  case when k % 2 = 1 then (2 * substr(regexp_replace(m, '[- ]', '', 'g'), k, 1)::int) // 10 + (2 * substr(regexp_replace(m, '[- ]', '', 'g'), k, 1)::int) % 10
    else substr(regexp_replace(m, '[- ]', '', 'g'), k, 1)::int end)) % 10 = 0)) as is_card
from {documents} where regexp_matches(text, '[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}')""")

VIEWS["class_results"] = f"""
select {KEY}, max(case when lower(tag_name) = 'semantic_category' then tag_value end) as semantic_category,
  max(case when lower(tag_name) = 'privacy_category' then tag_value end) as privacy_category,
  case when bool_or(lower(tag_name) = 'semantic_category' and tag_value = 'CARD_PAN') then 'CUSTOM_PAN_CLASSIFIER' else 'BUILT_IN' end as classifier_source,
  max(apply_method) as apply_method, {NOW} as captured_at
from {{system_tags}} where lower(tag_name) in ('semantic_category', 'privacy_category') group by all"""
VIEWS["evaluation"] = """
select u.t as table_name, u.column_name, t.expected_classification, t.source_section, d.semantic_category, d.privacy_category, d.classifier_source,
  t.column_name is not null as actually_sensitive, d.column_name is not null as detected_sensitive,
  case when t.column_name is not null and d.column_name is not null then 'TP' when d.column_name is not null then 'FP' when t.column_name is not null then 'FN' else 'TN' end as outcome, t.reason
from (select regexp_replace(table_name, '^STG_', '') as t, column_name from {cat_columns} where database_name = 'ANALYTICS' and schema_name = 'STAGING') u
left join {truth} t on u.t = t.table_name and u.column_name = t.column_name
left join (select regexp_replace(table_name, '^STG_', '') as t, * from {class_results} where schema_name = 'STAGING') d on u.t = d.t and u.column_name = d.column_name"""


def results(i: Inputs):
    return C.capture_results(i.system_tags, AS_OF)


def _evaluation(i: Inputs):
    staged = "database_name = 'ANALYTICS' and schema_name = 'STAGING'"
    return C.evaluate(i.cat_columns.filter(staged), i.truth, results(i).filter(staged))


query("c06_capture_results", results, "select * from {class_results}")
query("c06_capture_scanned", lambda i: C.capture_results(C.system_tags(staged_scan(i)), AS_OF).select("table_name", "column_name", "semantic_category", "classifier_source"),
      "select table_name, column_name, arg_max(semantic_category, share) as semantic_category, max(classifier_source) as classifier_source from {staged_scan} where detected group by 1, 2")
query("j10_multi_key_join", lambda i: i.cat_columns.join(results(i), C.KEY, "left").select(*C.KEY, "semantic_category", "classifier_source"),
      f"select c.database_name, c.schema_name, c.table_name, c.column_name, r.semantic_category, r.classifier_source from {{cat_columns}} c left join {{class_results}} r on c.database_name = r.database_name and c.schema_name = r.schema_name and c.table_name = r.table_name and c.column_name = r.column_name")
query("c07_evaluate", _evaluation, "select * from {evaluation}")
query("c08_precision_recall", lambda i: C.precision_recall(_evaluation(i)), """
select tp, fp, fn, tn, round(tp::double / nullif(tp + fp, 0), 4) as precision, round(tp::double / nullif(tp + fn, 0), 4) as recall from (
  select count(*) filter (where outcome = 'TP') as tp, count(*) filter (where outcome = 'FP') as fp, count(*) filter (where outcome = 'FN') as fn, count(*) filter (where outcome = 'TN') as tn from {evaluation}) x""")
query("c09_misses", lambda i: C.misses(_evaluation(i)), "select table_name, column_name, expected_classification, source_section, reason from {evaluation} where outcome = 'FN'")
query("c09_false_positives", lambda i: C.false_positives(_evaluation(i)), "select table_name, column_name, semantic_category, privacy_category, classifier_source from {evaluation} where outcome = 'FP'")

# ---- review ----------------------------------------------------------------------

SUGGEST = "case when semantic_category = 'CARD_PAN' then 'ACCOUNT_DETAILS' when semantic_category in ('EMAIL', 'PHONE_NUMBER', 'DATE_OF_BIRTH', 'NATIONAL_IDENTIFIER', 'NAME', 'ADDRESS') then 'PII' end"
RID = "md5(concat(database_name, ':', schema_name, ':', table_name, ':', column_name))"
query("c10_suggest", lambda i: V.candidates(results(i)).groupBy("detected_semantic_category", "suggested_classification").agg(F.count(F.lit(1)).alias("n")),
      f"select semantic_category as detected_semantic_category, {SUGGEST} as suggested_classification, count(*) as n from {{class_results}} group by all")
VIEWS["refreshed_queue"] = f"""
with s as (select {RID} as new_id, *, {SUGGEST} as sug from {{class_results}})
select q.review_id, q.database_name, q.schema_name, q.table_name, q.column_name,
  case when q.review_status = 'PENDING' and s.new_id is not null then s.semantic_category else q.detected_semantic_category end as detected_semantic_category,
  case when q.review_status = 'PENDING' and s.new_id is not null then s.privacy_category else q.detected_privacy_category end as detected_privacy_category,
  case when q.review_status = 'PENDING' and s.new_id is not null then s.classifier_source else q.classifier_source end as classifier_source,
  case when q.review_status = 'PENDING' and s.new_id is not null then s.sug else q.suggested_classification end as suggested_classification,
  q.confirmed_classification, q.review_status, q.reviewed_by, q.reviewed_at, q.review_notes, q.created_at
from {{queue}} q left join s on q.review_id = s.new_id
union all select new_id, database_name, schema_name, table_name, column_name, semantic_category, privacy_category, classifier_source, sug, null, 'PENDING', null, null, null, {NOW}
from s where new_id not in (select review_id from {{queue}})"""


def refreshed(i: Inputs):
    return V.refresh_queue(i.queue, results(i), AS_OF)


query("c11_refresh_queue", refreshed, "select * from {refreshed_queue}")
query("c11_refresh_queue_again", lambda i: V.refresh_queue(refreshed(i), results(i), AS_OF), "select * from {refreshed_queue}")
CLASSES = "('PII', 'ACCOUNT_DETAILS', 'SENSITIVE', 'QUASI_IDENTIFIER', 'INTERNAL', 'PUBLIC')"
VIEWS["decided"] = f"""
select q.review_id, database_name, schema_name, table_name, column_name, detected_semantic_category, detected_privacy_category, classifier_source, suggested_classification,
  case when d.review_id is null then q.confirmed_classification when d.action = 'APPROVE' then d.classification end as confirmed_classification,
  case when d.review_id is null then q.review_status when d.action = 'APPROVE' then 'APPROVED' else 'REJECTED' end as review_status,
  case when d.review_id is null then q.reviewed_by else d.user end as reviewed_by, case when d.review_id is null then q.reviewed_at else {NOW} end as reviewed_at,
  case when d.review_id is null then q.review_notes else d.notes end as review_notes, created_at
from {{queue}} q left join (select * from {{decisions}} where action = 'REJECT' or classification in {CLASSES}) d on q.review_id = d.review_id and q.review_status = 'PENDING'"""
query("c12_decide", lambda i: V.decide(i.queue, i.decisions, AS_OF), "select * from {decided}")
query("c12_messages", lambda i: V.decision_messages(i.queue, i.decisions), f"""
select d.review_id, case when q.review_id is null then concat('Review ID not found or not pending: ', d.review_id)
  when action = 'APPROVE' and classification not in {CLASSES} then concat('Invalid confirmed classification: ', classification)
  when action = 'APPROVE' then concat('Classification approved for review ID: ', d.review_id) else concat('Classification rejected for review ID: ', d.review_id) end as message
from {{decisions}} d left join (select review_id from {{queue}} where review_status = 'PENDING') q on q.review_id = d.review_id""")


def _rejected_only(i: Inputs):
    """Reject every review asked about, whatever the request was."""
    return V.decide(i.queue, i.decisions.withColumn("action", F.lit("REJECT")), AS_OF).select("review_id", "review_status", "confirmed_classification")


query("c13_reject", _rejected_only, """
select review_id, case when review_status = 'PENDING' and review_id in (select review_id from {decisions}) then 'REJECTED' else review_status end as review_status,
  case when review_status = 'PENDING' and review_id in (select review_id from {decisions}) then null else confirmed_classification end as confirmed_classification from {queue}""")
VIEWS["synced"] = f"""
with a as (select {KEY}, confirmed_classification as v from {{queue}} where review_status = 'APPROVED' and confirmed_classification is not null)
select t.database_name, t.schema_name, t.table_name, t.column_name, t.domain, t.tag_name, coalesce(a.v, t.tag_value) as tag_value, case when a.v is not null then 'MANUAL' else t.apply_method end as apply_method
from {{tags}} t left join a on t.tag_name = 'CLASSIFICATION' and t.database_name = a.database_name and t.schema_name = a.schema_name and t.table_name = a.table_name and t.column_name = a.column_name
union all select database_name, schema_name, table_name, column_name, 'COLUMN', 'CLASSIFICATION', v, 'MANUAL' from a
where not exists (select 1 from {{tags}} t where t.tag_name = 'CLASSIFICATION' and t.database_name = a.database_name and t.schema_name = a.schema_name and t.table_name = a.table_name and t.column_name = a.column_name)"""
query("c14_sync_tags", lambda i: V.sync_tags(i.queue, i.tags, i.cat_tables), "select * from {synced}")
query("c14_sync_tags_again", lambda i: V.sync_tags(i.queue, V.sync_tags(i.queue, i.tags, i.cat_tables), i.cat_tables), "select * from {synced}")
query("c14_sync_history", lambda i: V.sync_history(i.queue, i.tags, AS_OF), f"""
select 'CLASSIFICATION' as tag_name, 'COLUMN' as object_type, concat(database_name, '.', schema_name, '.', table_name, '.', column_name) as object_identifier,
  confirmed_classification as tag_value, reviewed_by as assigned_by, {NOW} as assigned_at, concat('STEWARD_APPROVAL:', review_id) as harvest_id
from {{queue}} q where review_status = 'APPROVED' and confirmed_classification is not null and not exists (select 1 from {{tags}} t where t.tag_name = 'CLASSIFICATION'
  and t.database_name = q.database_name and t.schema_name = q.schema_name and t.table_name = q.table_name and t.column_name = q.column_name and t.tag_value = q.confirmed_classification)""")
query("c14_sync_history_again", lambda i: V.sync_history(i.queue, V.sync_tags(i.queue, i.tags, i.cat_tables), AS_OF).groupBy().agg(F.count(F.lit(1)).alias("n")),
      "select 0::bigint as n from {queue} limit 1")
query("c15_unknown_objects", lambda i: V.unknown_objects(V.approved(i.queue), i.cat_tables.filter("most > 46")),
      "select distinct database_name, schema_name, table_name from {queue} where review_status = 'APPROVED' and confirmed_classification is not null and table_name not in (select table_name from {cat_tables} where most > 46)")
query("c16_queue_counts", lambda i: V.queue_counts(i.queue), "select review_status, count(*) as review_count from {queue} group by 1")

# ---- protection ------------------------------------------------------------------

HELD = {
    "DATA_OWNER": ["DATA_OWNER", "DATA_STEWARD", "DEPOSITS_ANALYST", "BRANCH_HUDSON", "SVC_PIPELINE"],
    "DATA_STEWARD": ["DATA_STEWARD"],
    "DEPOSITS_ANALYST": ["DEPOSITS_ANALYST"],
}
TAGS = {"first_name": "PII", "last_name": "PII", "email": "PII", "phone": "PII", "tax_id": "PII", "date_of_birth": "PII", "address": "PII", "customer_type": "INTERNAL"}


def partial(c: str) -> str:
    return f"case when {c} is null then null when length({c}) <= 4 then '****' else concat(left({c}, 2), repeat('*', length({c}) - 4), right({c}, 2)) end"


query("r01_session_roles", lambda i: P.session_roles(i.grants, i.grants.select(F.col("role").alias("login"), "role").distinct(), ["login"]), """
with recursive held as (select distinct role as login, role as role_name from {grants} union select h.login, g.granted_role from held h join {grants} g on h.role_name = g.role) select login, role_name from held""")
query("r01_root_roles", lambda i: P.session_roles(i.grants, i.region.select(F.lit("ROOT").alias("role")).distinct()), """
with recursive held as (select 'ROOT' as role_name union select g.granted_role from held h join {grants} g on h.role_name = g.role) select role_name from held""")
query("r02_mask_string", lambda i: R.union_all([i.stg_customer.select(F.lit(r).alias("role_name"), "customer_id", masks.mask_string(F.col("tax_id"), "PII", held).alias("tax_id"), masks.mask_string(F.col("last_name"), "PII", held).alias("last_name")) for r, held in HELD.items()]),
      f"select 'DATA_OWNER' as role_name, customer_id, tax_id, last_name from {{stg_customer}} union all select 'DATA_STEWARD', customer_id, {partial('tax_id')}, {partial('last_name')} from {{stg_customer}} union all select 'DEPOSITS_ANALYST', customer_id, '***MASKED***', '***MASKED***' from {{stg_customer}}")
query("r03_mask_date", lambda i: R.union_all([i.stg_customer.select(F.lit(r).alias("role_name"), "customer_id", masks.mask_date(F.col("date_of_birth"), "PII", held).alias("date_of_birth")) for r, held in HELD.items()]),
      "select 'DATA_OWNER' as role_name, customer_id, cast(date_of_birth as varchar) as date_of_birth from {stg_customer} union all select 'DATA_STEWARD', customer_id, concat(cast(year(date_of_birth) as varchar), '-01-01') from {stg_customer} union all select 'DEPOSITS_ANALYST', customer_id, null from {stg_customer}")
query("r04_mask_number", lambda i: R.union_all([i.stg_account.select(F.lit(r).alias("role_name"), "account_id", masks.mask_number(F.col("balance"), "SENSITIVE", held, "decimal(15,2)").alias("balance")) for r, held in HELD.items()]),
      "select 'DATA_OWNER' as role_name, account_id, cast(balance as double) as balance from {stg_account} union all select 'DATA_STEWARD', account_id, floor(cast(balance as double) / 10000) * 10000 from {stg_account} union all select 'DEPOSITS_ANALYST', account_id, null from {stg_account}")
query("r05_masked_table", lambda i: P.masked(i.stg_customer, TAGS, HELD["DATA_STEWARD"]).drop("dbt_loaded_at"),
      "select customer_id, " + ", ".join(f"{partial(c)} as {c}" for c in ("first_name", "last_name", "email", "phone", "tax_id", "address")) + ", concat(cast(year(date_of_birth) as varchar), '-01-01') as date_of_birth, customer_type, source_table, source_system from {stg_customer}")


def _tagged_nations(i: Inputs):
    """Column tags on the nations of the key graph, one value per region."""
    return i.nation.select(
        F.lit("RAW").alias("database_name"), F.lit("PUBLIC").alias("schema_name"),
        F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")).alias("table_name"), F.lit("NATIONKEY").alias("column_name"),
        F.lit("COLUMN").alias("domain"), F.lit("CLASSIFICATION").alias("tag_name"),
        F.when(F.col("n_regionkey") < 2, "PII").otherwise("SENSITIVE").alias("tag_value"), F.lit("MANUAL").alias("apply_method"))


query("r06_propagate_tags", lambda i: P.propagate_tags(_tagged_nations(i), i.stored_edges), """
with recursive e as (select * from {edges} where source_column is not null and target_column is not null),
own as (select 'RAW' as d, 'PUBLIC' as s, concat('NATION_', cast(n_nationkey as varchar)) as o, 'NATIONKEY' as c, case when n_regionkey < 2 then 'PII' else 'SENSITIVE' end as v from {nation}),
walk as (select d, s, o, c, v from own union select e.target_database, e.target_schema, e.target_object, e.target_column, w.v from walk w join e on e.source_database = w.d and e.source_schema = w.s and e.source_object = w.o and e.source_column = w.c)
select d as database_name, s as schema_name, o as table_name, c as column_name, 'COLUMN' as domain, 'CLASSIFICATION' as tag_name, v as tag_value,
  case when (d, s, o, c) in (select (d, s, o, c) from own) then 'MANUAL' else 'PROPAGATED' end as apply_method from walk""")
query("r07_grant_branch", lambda i: P.grant_branch(P.entitlements_df(i.spark), i.branch_grants.select("role_name", "branch_code")),
      "select role_name, branch_code from {branch_grants} union select * from (values ('DATA_OWNER', '*'), ('DATA_STEWARD', '*'), ('DEPOSITS_ANALYST', '*'), ('BRANCH_HUDSON', 'BR_01')) v(role_name, branch_code)")
query("r08_row_filter", lambda i: P.row_filter(i.mart_deposits, "branch_code", P.entitlements_df(i.spark), ["BRANCH_HUDSON"]).select("account_id", "branch_code"),
      "select account_id, branch_code from {mart_deposits} where branch_code = 'BR_01'")
query("j07_semi_join", lambda i: P.row_filter(i.raw_account, "branch_code", i.branch_grants, ["BRANCH_ROLE_3", "BRANCH_ROLE_5"]).select("account_id", "branch_code"),
      "select account_id, branch_code from {raw_account} a where exists (select 1 from {branch_grants} g where g.role_name in ('BRANCH_ROLE_3', 'BRANCH_ROLE_5') and g.branch_code = a.branch_code)")
query("r08_row_filter_all", lambda i: P.row_filter(i.mart_deposits, "branch_code", P.entitlements_df(i.spark), ["DATA_STEWARD", "BRANCH_HUDSON"]).select("account_id"), "select account_id from {mart_deposits}")
query("r08_row_filter_none", lambda i: P.row_filter(i.mart_deposits, "branch_code", P.entitlements_df(i.spark), ["SVC_PIPELINE"]).select("account_id"), "select account_id from {mart_deposits} where false")
query("r08_row_filter_join", lambda i: P.row_filter(i.mart_deposits, "branch_code", i.branch_grants, ["BRANCH_ROLE_3"]).select("account_id", "branch_code"),
      "select account_id, branch_code from {mart_deposits} where branch_code in (select branch_code from {branch_grants} where role_name = 'BRANCH_ROLE_3')")


def _attached(i: Inputs):
    """Attach the filter to raw accounts and the mart, then count what one branch role sees."""
    targets = {"RAW.PUBLIC.ACCOUNT": i.raw_account, "ANALYTICS.MARTS.MART_DEPOSITS": i.mart_deposits}
    policies = P.attach_row_filter({"RAW.PUBLIC.ACCOUNT": "BRANCH_ENTITLEMENT_POLICY"}, targets, "BRANCH_ENTITLEMENT_POLICY", "branch_code")
    return R.labelled_counts({n: P.row_filter(targets[n], "branch_code", P.entitlements_df(i.spark), ["BRANCH_HUDSON"]) for n in policies})


query("r09_attach_row_filter", _attached, "select 'RAW.PUBLIC.ACCOUNT' as object_name, count(*) as row_count from {raw_account} where branch_code = 'BR_01' union all select 'ANALYTICS.MARTS.MART_DEPOSITS', count(*) from {mart_deposits} where branch_code = 'BR_01'")
VIEWS["gaps"] = f"""
select * from (select t.database_name, t.schema_name, t.table_name, t.column_name, t.tag_value as classification_tag_value, t.apply_method, c.column_type as data_type,
  case when c.column_type in ('TEXT', 'VARCHAR') then 'CLASSIFICATION_MASK_VARCHAR' when c.column_type = 'DATE' then 'CLASSIFICATION_MASK_DATE' when c.column_type in ('NUMBER', 'DECIMAL', 'BIGINT') then 'CLASSIFICATION_MASK_NUMBER' end as required_policy,
  q.review_id, q.reviewed_by, q.reviewed_at,
  case when c.column_type is null then 'COLUMN_NOT_FOUND' when c.column_type in ('FLOAT', 'TIMESTAMP_NTZ') then 'UNSUPPORTED_MASKING_DATA_TYPE' when c.column_type in ('NUMBER', 'DECIMAL', 'BIGINT') then 'TAG_MASKING_POLICY_NOT_ACTIVE' end as gap_reason
from (select * from {{tags}} where tag_name = 'CLASSIFICATION' and tag_value in ('PII', 'ACCOUNT_DETAILS', 'SENSITIVE')) t
left join (select * from {{cat_columns}} where p_size <> 6) c on t.database_name = c.database_name and t.schema_name = c.schema_name and t.table_name = c.table_name and t.column_name = c.column_name
left join (select * from {{queue}} where review_status = 'APPROVED') q on t.database_name = q.database_name and t.schema_name = q.schema_name and t.table_name = q.table_name and t.column_name = q.column_name) x
where gap_reason is not null"""


def gaps(i: Inputs):
    return P.policy_gaps(i.tags, i.cat_columns.filter("p_size <> 6"), i.bindings, i.queue)


query("r10_policy_gaps", gaps, "select * from {gaps}")
query("r11_masking_by_role", lambda i: P.masking_by_role(i.stg_customer, TAGS, HELD, ["customer_id", "email", "phone"]),
      f"select 'DATA_OWNER' as role_name, customer_id, email, phone from {{stg_customer}} union all select 'DATA_STEWARD', customer_id, {partial('email')}, {partial('phone')} from {{stg_customer}} union all select 'DEPOSITS_ANALYST', customer_id, '***MASKED***', '***MASKED***' from {{stg_customer}}")
query("r12_branch_distribution", lambda i: P.branch_distribution({"RAW.PUBLIC.ACCOUNT": i.raw_account, "ANALYTICS.MARTS.MART_DEPOSITS": i.mart_deposits}, "branch_code", P.entitlements_df(i.spark), {"DATA_OWNER": HELD["DATA_OWNER"], "BRANCH_HUDSON": ["BRANCH_HUDSON"]}),
      """with r as (select 'RAW.PUBLIC.ACCOUNT' as object_name, branch_code, count(*) as row_count from {raw_account} group by 2 union all select 'ANALYTICS.MARTS.MART_DEPOSITS', branch_code, count(*) from {mart_deposits} group by 2)
select 'DATA_OWNER' as role_name, * from r union all select 'BRANCH_HUDSON', * from r where branch_code = 'BR_01'""")
query("r13_protect", lambda i: P.protect(i.mart_deposits, {"email": "PII", "current_balance": "SENSITIVE", "account_number": "ACCOUNT_DETAILS"}, ["BRANCH_HUDSON"], P.entitlements_df(i.spark), "branch_code").select("account_id", "branch_code", "email", "current_balance", "account_number"),
      "select account_id, branch_code, '***MASKED***' as email, cast(null as double) as current_balance, '***MASKED***' as account_number from {mart_deposits} where branch_code = 'BR_01'")
