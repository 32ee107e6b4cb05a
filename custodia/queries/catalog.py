"""Catalog metadata and the questions asked of it."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from custodia.operators import catalog as D
from custodia.operators import certify as C
from custodia.operators import protect as P
from custodia.operators import relational as R
from custodia.operators import search as X
from custodia.queries.inputs import AS_OF, BASE, Inputs
from custodia.queries.registry import VIEWS, query
from custodia.sources import catalog as scans
from custodia.sources import logs

NOW = "timestamp '2024-01-31 00:00:00'"
OBJ = "database_name, schema_name, table_name"
KEY = f"{OBJ}, column_name"

# ---- catalog scans over the given tables -----------------------------------------


def given(i: Inputs):
    return {("TESTDATA", "PUBLIC", t.upper()): getattr(i, t) for t in BASE}


GIVEN_COLUMNS = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"], "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"], "pages": ["page_id", "url", "html"], "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"], "conversations": ["conv_id", "turn", "role", "text"],
}
query("s07_scan_tables", lambda i: scans.tables_of(i.spark, given(i)),
      "\nunion all ".join(f"select 'TESTDATA' as database_name, 'PUBLIC' as schema_name, '{t.upper()}' as table_name, 'BASE TABLE' as object_type, count(*) as row_count from {{{t}}}" for t in BASE))
query("s08_scan_columns", lambda i: scans.filled_counts(i.spark, given(i)).join(scans.columns_of(i.spark, given(i)).select("table_name", "column_name", "is_nullable"), ["table_name", "column_name"]),
      "\nunion all ".join(f"select '{t.upper()}' as table_name, '{c}' as column_name, 'TESTDATA' as database_name, 'PUBLIC' as schema_name, {k}::bigint as ordinal_position, count({c}) as filled, 'YES' as is_nullable from {{{t}}}"
                          for t, cols in GIVEN_COLUMNS.items() for k, c in enumerate(cols, 1)))


def registered(i: Inputs) -> str:
    """The given tables as external tables of a database of their own in the session's catalog; no row is read for it."""
    database = f"custodia_given_{hashlib.md5(i.folder.encode()).hexdigest()[:12]}"
    i.spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for t in BASE:
        if not i.spark.catalog.tableExists(f"{database}.{t}"):
            i.spark.catalog.createTable(f"{database}.{t}", path=f"{i.folder}/{t}.parquet", source="parquet", schema=getattr(i, t).schema, description=f"given table {t}")
    return database


def _catalog_tables(i: Inputs):
    """Tables found in the session's catalog, each counted through its registered name."""
    database = registered(i)
    found = scans.scan_tables(i.spark, [database])
    rows = R.labelled_counts({t: scans.relation(i.spark, f"{database}.{t}") for t in BASE}, "table_name")
    return found.drop("row_count").join(rows, "table_name").select(F.lit("GIVEN").alias("database_name"), "table_name", "object_type", "table_comment", "row_count")


def _catalog_columns(i: Inputs):
    """Columns found in the session's catalog, with their filled values read through the registered names."""
    database = registered(i)
    names = {("C", database, t): scans.relation(i.spark, f"{database}.{t}") for t in BASE}
    found = scans.scan_columns(i.spark, [database], pattern="c*|pa*")
    return found.join(scans.filled_counts(i.spark, names).select("table_name", "column_name", "filled"), ["table_name", "column_name"]).select(
        "table_name", "ordinal_position", "column_name", "is_nullable", "filled")


query("s07_scan_session_catalog", _catalog_tables,
      "\nunion all ".join(f"select 'GIVEN' as database_name, '{t}' as table_name, 'BASE TABLE' as object_type, 'given table {t}' as table_comment, count(*) as row_count from {{{t}}}" for t in BASE))
query("s08_scan_session_catalog", _catalog_columns,
      "\nunion all ".join(f"select '{t}' as table_name, {k}::bigint as ordinal_position, '{c}' as column_name, 'YES' as is_nullable, count({c}) as filled from {{{t}}}"
                          for t, cols in GIVEN_COLUMNS.items() if t.startswith(("c", "pa")) for k, c in enumerate(cols, 1)))
query("s09_tag_references_object", lambda i: logs.tag_references(i.tags, ["data_owner", "DATA_STEWARD"], obj=("RAW", "PUBLIC", "TBL_3")),
      "select * from {tags} where tag_name in ('DATA_OWNER', 'DATA_STEWARD') and database_name = 'RAW' and schema_name = 'PUBLIC' and table_name = 'TBL_3'")
query("s09_tag_references_columns", lambda i: logs.tag_references(i.tags, obj=("RAW", "PUBLIC", "TBL_3"), domains=["COLUMN"]),
      "select * from {tags} where domain = 'COLUMN' and database_name = 'RAW' and schema_name = 'PUBLIC' and table_name = 'TBL_3'")
query("s09_tag_references_all", lambda i: logs.tag_references(i.tags, ["CLASSIFICATION"]), "select * from {tags} where tag_name = 'CLASSIFICATION'")
query("s09_tag_references_propagated", lambda i: logs.tag_references(P.propagate_tags(i.tags, i.edges), ["CLASSIFICATION"], domains=["COLUMN"]).filter("apply_method = 'PROPAGATED'").select("database_name", "schema_name", "table_name", "column_name", "tag_value"), """
with recursive e as (select * from {edges} where source_column is not null and target_column is not null),
own as (select database_name as d, schema_name as s, table_name as o, column_name as c, tag_value as v from {tags} where tag_name = 'CLASSIFICATION' and column_name is not null),
walk as (select d, s, o, c, v from own union select e.target_database, e.target_schema, e.target_object, e.target_column, w.v from walk w join e on e.source_database = w.d and e.source_schema = w.s and e.source_object = w.o and e.source_column = w.c)
select d as database_name, s as schema_name, o as table_name, c as column_name, v as tag_value from walk where (d, s, o, c) not in (select (d, s, o, c) from own)
union all select database_name, schema_name, table_name, column_name, tag_value from {tags} where tag_name = 'CLASSIFICATION' and domain = 'COLUMN' and apply_method = 'PROPAGATED'""")
query("s10_query_history", lambda i: logs.query_history(i.query_history, AS_OF, 167).select("query_id", "role_name", "start_time"),
      f"select query_id, role_name, start_time from {{query_history}} where execution_status = 'SUCCESS' and start_time between {NOW} - interval 167 hour and {NOW}")
query("s10_query_history_newest", lambda i: logs.query_history(i.query_history, AS_OF, 400, limit=100).select("query_id", "start_time"),
      f"select query_id, start_time from {{query_history}} where execution_status = 'SUCCESS' and start_time between {NOW} - interval 400 hour and {NOW} order by start_time desc, query_id limit 100")
MART = ("ANALYTICS", "MARTS", "MART_DEPOSITS")
query("s11_object_dependencies", lambda i: logs.object_dependencies(i.dependencies, MART),
      "select * from {dependencies} where (referencing_schema = 'MARTS' and referencing_object_name = 'MART_DEPOSITS') or (referenced_schema = 'MARTS' and referenced_object_name = 'MART_DEPOSITS')")
VIEWS["object_access"] = """
select event_id, ts, 'RAW' as source_database, 'PUBLIC' as source_schema, s as source_object, split_part(t, '.', 1) as target_database, split_part(t, '.', 2) as target_schema, split_part(t, '.', 3) as target_object, event_type
from (select event_id, ts, event_type, s, unnest(case when event_type in ('view', 'purchase') then ['ANALYTICS.MARTS.MART_DEPOSITS', concat('ANALYTICS.MARTS.TBL_', cast(user_id % 7 as varchar))]
    else [concat('ANALYTICS.MARTS.TBL_', cast(user_id % 7 as varchar))] end) as t
  from (select event_id, ts, event_type, user_id, unnest(case when event_type = 'purchase' then [concat('TBL_', cast(user_id as varchar)), 'LOOKUP'] else [concat('TBL_', cast(user_id as varchar))] end) as s from {events}))"""
EDGE_COLS = "source_database, source_schema, source_object, 'TABLE' as source_object_domain, target_database, target_schema, target_object, 'TABLE' as target_object_domain, event_id as query_id, ts as query_start_time"
query("s12_access_edges", lambda i: logs.access_edges(i.access_log).drop("process_details"), f"select distinct {EDGE_COLS} from {{object_access}}")
query("s12_access_edges_of_object", lambda i: logs.access_edges(i.access_log, ".".join(MART)).drop("process_details"), f"select distinct {EDGE_COLS} from {{object_access}} where target_object = 'MART_DEPOSITS'")
query("s13_policy_references", lambda i: logs.policy_references(i.policy_refs, "MASKING_POLICY", "ACTIVE"), "select * from {policy_refs} where policy_kind = 'MASKING_POLICY' and policy_status = 'ACTIVE'")

# ---- catalog metadata ------------------------------------------------------------

TAXONOMY = "('DOMAIN', 'LAYER', 'CERTIFICATION', 'DATA_OWNER', 'DATA_STEWARD', 'CDE', 'CDE_TIER', 'CLASSIFICATION', 'SOURCE_SYSTEM', 'LAST_CERTIFIED', 'MASKING_REQUIRED')"
query("d01_tag_usage", lambda i: D.tag_usage(i.tags), f"select tag_name, domain, count(*) as assignments, count(distinct tag_value) as distinct_values from {{tags}} where tag_name in {TAXONOMY} group by 1, 2")
query("d01_undefined_tags", lambda i: D.undefined_tags(i.tags), f"select tag_name, count(*) as assignments from {{tags}} where tag_name not in {TAXONOMY} group by 1")


def _tag_rows(i: Inputs):
    """New values for every owner tag and a masking tag for the sensitive columns."""
    owner = i.cat_tables.filter("least < 4").select(*OBJ.split(", "), F.lit(None).cast("string").alias("column_name"), F.lit("TABLE").alias("domain"), F.lit("DATA_OWNER").alias("tag_name"), F.lit("New Team").alias("tag_value"), F.lit("MANUAL").alias("apply_method"))
    mask = i.cat_columns.filter("p_size < 12").select(*KEY.split(", "), F.lit("COLUMN").alias("domain"), F.lit("MASKING_REQUIRED").alias("tag_name"), F.lit("YES").alias("tag_value"), F.lit("MANUAL").alias("apply_method"))
    return owner.unionByName(mask)


query("d02_apply_tags", lambda i: D.apply_tags(i.tags, _tag_rows(i)), """
select t.database_name, t.schema_name, t.table_name, t.column_name, t.domain, t.tag_name, case when t.tag_name = 'DATA_OWNER' and c.least < 4 then 'New Team' else t.tag_value end as tag_value, t.apply_method
from {tags} t join {cat_tables} c on t.table_name = c.table_name
union all select database_name, schema_name, table_name, column_name, 'COLUMN', 'MASKING_REQUIRED', 'YES', 'MANUAL' from {cat_columns} where p_size < 12""")
TABLE_COLS = [*OBJ.split(", "), "object_type", "table_comment", "row_count", "created_on", "last_altered"]


def _harvested_tables(i: Inputs):
    stored = i.cat_tables.filter("least <= 5").select(*TABLE_COLS, "harvested_at")
    scanned = i.cat_tables.filter("most >= 46").select(*TABLE_COLS).withColumn("object_type", F.lit("DYNAMIC TABLE")).withColumn("last_altered", F.lit(AS_OF)).withColumn("row_count", F.lit(None).cast("bigint"))
    return D.harvest_tables(stored, scanned, AS_OF)


query("d03_harvest_tables", _harvested_tables, f"""
select {OBJ}, case when least <= 5 then object_type else 'DYNAMIC TABLE' end as object_type, table_comment, case when least <= 5 then row_count else 0 end as row_count, created_on,
  case when most >= 46 then {NOW} else last_altered end as last_altered, case when most >= 46 then {NOW} else harvested_at end as harvested_at from {{cat_tables}} where least <= 5 or most >= 46""")
COLUMN_COLS = [*KEY.split(", "), "ordinal_position", "column_type", "column_comment", "is_nullable"]


def _harvested_columns(i: Inputs):
    stored = i.cat_columns.filter("p_size <= 40").select(*COLUMN_COLS, "harvested_at")
    scanned = i.cat_columns.filter("p_size >= 20").select(*COLUMN_COLS).withColumn("column_type", F.lit("NEW")).withColumn("is_nullable", F.lit("NO"))
    return D.harvest_columns(stored, scanned, AS_OF)


VIEWS["harvested_columns"] = f"""
select {KEY}, ordinal_position, case when p_size >= 20 then 'NEW' else column_type end as column_type, column_comment,
  case when p_size <= 40 then is_nullable else 'NO' end as is_nullable, case when p_size >= 20 then {NOW} else harvested_at end as harvested_at from {{cat_columns}}"""
query("d03_harvest_columns", _harvested_columns, "select database_name, schema_name, table_name, column_name, ordinal_position::bigint as ordinal_position, column_type, column_comment, is_nullable, harvested_at from {harvested_columns}")
query("d03_stale_columns", lambda i: D.stale(_harvested_columns(i), AS_OF).select("table_name", "column_name"), "select table_name, column_name from {cat_columns} where p_size < 20")
DICT = ["table_name", "column_name", "column_description", "data_type", "sensitivity_classification", "is_cde", "notes"]


def _loaded_dictionary(i: Inputs):
    stored = i.dictionary.filter("p_size <= 35").select(*DICT).withColumn("loaded_at", F.lit(AS_OF) - F.make_interval(days=F.lit(9)))
    return D.load_dictionary(stored, i.dictionary.filter("p_size >= 25").select(*DICT).withColumn("notes", F.lit("new")), AS_OF)


query("d04_load_dictionary", _loaded_dictionary, f"""
select table_name, column_name, column_description, data_type, sensitivity_classification, is_cde, case when p_size >= 25 then 'new' else notes end as notes,
  case when p_size >= 25 then {NOW} else {NOW} - interval 9 day end as loaded_at from {{dictionary}}""")
TERM = ["term_id", "term_name", "definition", "business_domain", "synonyms"]


def _loaded_terms(i: Inputs):
    return D.load_glossary(i.terms.filter("s_acctbal < 6000").select(*TERM), i.terms.filter("s_acctbal > 2000").select(*TERM).withColumn("synonyms", F.lit("alias")))


query("d05_load_glossary", _loaded_terms, "select term_id, term_name, definition, business_domain, case when s_acctbal > 2000 then 'alias' else synonyms end as synonyms from {terms}")
query("d05_load_mappings", lambda i: D.load_mappings(i.mappings.filter("p_size < 30").select(*KEY.split(", "), "term_id"), i.mappings.filter("p_size > 10").select(*KEY.split(", "), "term_id")), f"select {KEY}, term_id from {{mappings}}")
CDE = ["cde_id", *KEY.split(", "), "cde_name", "criticality_level", "business_owner", "description"]
query("d06_load_cdes", lambda i: D.load_cdes(i.cdes.filter("p_size < 47").select(*CDE), i.cdes.filter("p_size > 44").select(*CDE).withColumn("business_owner", F.lit("Finance"))),
      f"select cde_id, {KEY}, cde_name, criticality_level, case when p_size > 44 then 'Finance' else business_owner end as business_owner, description from {{cdes}}")
query("d07_sensitive_columns", lambda i: D.sensitive_columns(i.dictionary), """
select table_name, column_name, column_description, sensitivity_classification, case when sensitivity_classification in ('PII', 'ACCOUNT_DETAILS') then 'MASKING_REQUIRED' else 'REVIEW_NEEDED' end as masking_status
from {dictionary} where sensitivity_classification in ('PII', 'SENSITIVE', 'ACCOUNT_DETAILS', 'POTENTIALLY_SENSITIVE')""")
query("d08_cde_summary", lambda i: D.cde_summary(i.cdes), "select cde_id, cde_name, table_name, column_name, criticality_level, business_owner, description from {cdes}")
query("d08_cde_levels", lambda i: D.cde_levels(i.cdes), "select criticality_level, count(*) as count_by_level from {cdes} group by 1")
query("d09_glossary_coverage", lambda i: D.glossary_coverage(i.terms, i.mappings), """
select term_name, definition, count(column_name) as column_count, coalesce(string_agg(distinct concat(table_name, '.', column_name), ', ' order by concat(table_name, '.', column_name)), '') as mapped_columns
from {terms} t left join {mappings} m on t.term_id = m.term_id group by t.term_id, term_name, definition""")
query("d10_documentation_coverage", lambda i: D.documentation_coverage(i.cat_columns, i.dictionary), """
select c.table_name, count(*) as total_columns, count(d.column_name) as documented_columns, round(100.0::double * count(d.column_name) / count(*), 2) as documentation_percentage
from {cat_columns} c left join (select * from {dictionary} where trim(column_description) <> '') d on upper(c.table_name) = upper(d.table_name) and c.column_name = d.column_name group by 1""")
VIEWS["latest_quality"] = """
select target_database, target_schema, target_table, case when count(*) filter (where check_result is distinct from 'PASS') = 0 and count(*) = 6 then 'PASS' else 'FAIL' end as latest_dq_status, max(executed_at) as latest_dq_run
from {latest_results} group by 1, 2, 3"""
VIEWS["usage_evidence"] = f"""
select t.database_name, t.schema_name, t.table_name as object_name, query_id, role_name, start_time as query_start_time, query_text, {NOW} as captured_at
from {{usage_history}} h join {{cat_tables}} t on h.query_text ilike concat('% ', t.database_name, '.', t.schema_name, '.', t.table_name, ' %')
where execution_status = 'SUCCESS' and start_time between {NOW} - interval 167 hour and {NOW} and role_name in ('DEPOSITS_ANALYST', 'DATA_STEWARD', 'BRANCH_HUDSON')"""
VIEWS["master"] = f"""
select c.database_name, c.schema_name, c.table_name, c.column_name, c.ordinal_position::bigint as ordinal_position, c.column_type, c.is_nullable,
  coalesce(nullif(c.column_comment, ''), nullif(d.column_description, '')) as description, case when e.cde_id is null then 'NO' else 'YES' end as cde_flag, e.criticality_level,
  coalesce(o.tag_value, e.business_owner) as data_owner, s.tag_value as data_steward, ce.tag_value as certification, cl.tag_value as classification,
  q.latest_dq_status, q.latest_dq_run, c.harvested_at as last_metadata_refresh, up.upstream_source, u.query_count, u.distinct_roles
from {{cat_columns}} c left join {{dictionary}} d on upper(c.table_name) = upper(d.table_name) and c.column_name = d.column_name
left join {{cdes}} e on upper(c.table_name) = upper(e.table_name) and c.column_name = e.column_name
left join {{tags}} o on o.table_name = c.table_name and o.tag_name = 'DATA_OWNER' left join {{tags}} s on s.table_name = c.table_name and s.tag_name = 'DATA_STEWARD'
left join {{tags}} ce on ce.table_name = c.table_name and ce.tag_name = 'CERTIFICATION'
left join {{tags}} cl on cl.table_name = c.table_name and cl.column_name = c.column_name and cl.tag_name = 'CLASSIFICATION'
left join {{latest_quality}} q on q.target_database = c.database_name and q.target_schema = c.schema_name and q.target_table = c.table_name
left join (select target_object, min(concat(source_database, '.', source_schema, '.', source_object)) as upstream_source from {{snapshot}} group by 1) up on up.target_object = c.table_name
left join (select object_name, count(*) as query_count, count(distinct role_name) as distinct_roles from {{usage_evidence}} group by 1) u on u.object_name = c.table_name"""


def usage(i: Inputs):
    return C.adoption_of_all(i.usage_history, i.cat_tables, AS_OF)


def master(i: Inputs):
    return D.catalog_master(i.cat_columns, i.dictionary, i.cdes, i.tags, i.dq_results, i.snapshot, usage(i))


query("d11_object_coverage", lambda i: D.object_coverage(master(i), OBJ.split(", ")), f"""
select {OBJ}, count(*) as total_columns, count(*) filter (where trim(description) <> '') as documented_columns, round(100.0::double * count(*) filter (where trim(description) <> '') / count(*), 2) as documentation_percentage from {{master}} group by all""")
query("d12_catalog_master", master, "select * from {master}")
query("d13_cde_tag_references", lambda i: D.cde_tag_references(i.tags), f"select {KEY}, tag_name, tag_value, apply_method from {{tags}} where tag_name in ('CDE', 'CDE_TIER') and tag_value is not null")
query("d13_cde_tagged_columns", lambda i: D.cde_tagged_columns(i.tags), f"select count(distinct concat({KEY.replace(', ', ', chr(46), ')})) as cde_tagged_column_count from {{tags}} where tag_name = 'CDE' and tag_value = 'YES'")
query("d14_owners", lambda i: D.owners(i.tags), f"select {OBJ}, max(tag_value) filter (where tag_name = 'DATA_OWNER') as data_owner, max(tag_value) filter (where tag_name = 'DATA_STEWARD') as data_steward from {{tags}} where tag_name in ('DATA_OWNER', 'DATA_STEWARD') group by all")
query("d15_harvest_freshness", lambda i: D.harvest_freshness(i.cat_columns, "column_objects"), "select database_name, count(*) as column_objects, max(harvested_at) as last_harvest from {cat_columns} group by 1")
query("d16_inventory", lambda i: D.inventory(i.cat_tables), f"""
select 'RAW' as layer, {OBJ}, object_type from {{cat_tables}} where database_name = 'RAW' and schema_name = 'PUBLIC' union all select 'STAGING', {OBJ}, object_type from {{cat_tables}} where database_name = 'ANALYTICS' and schema_name = 'STAGING'
union all select 'MARTS', {OBJ}, object_type from {{cat_tables}} where database_name = 'ANALYTICS' and schema_name = 'MARTS'""")
query("d16_layer_counts", lambda i: D.layer_counts(i.cat_tables), """
with o as (select case schema_name when 'PUBLIC' then 'RAW' else schema_name end as layer from {cat_tables} where schema_name in ('PUBLIC', 'STAGING', 'MARTS'))
select layer, count(*) as object_count from o group by 1 union all select 'TOTAL', count(*) from o""")
query("a13_status_rollup", lambda i: D.latest_quality(i.dq_results), "select * from {latest_quality}")

# ---- catalog questions -----------------------------------------------------------

query("x01_search", lambda i: X.search(master(i), "BRANCH", database="RAW").select(*KEY.split(", ")), f"select {KEY} from {{master}} where database_name = 'RAW' and (contains(lower(table_name), 'branch') or contains(lower(column_name), 'branch') or contains(lower(coalesce(description, '')), 'branch'))")
query("x01_search_critical", lambda i: X.search(master(i), "about", cde_only=True).select(*KEY.split(", "), "description"), f"select {KEY}, description from {{master}} where cde_flag = 'YES' and (table_name ilike '%about%' or column_name ilike '%about%' or description ilike '%about%')")
query("x01_search_indexed", lambda i: X.search_index(X.build_index(master(i)), "BRANCH", database="RAW").select(*KEY.split(", ")), f"select {KEY} from {{master}} where database_name = 'RAW' and (contains(lower(table_name), 'branch') or contains(lower(column_name), 'branch') or contains(lower(coalesce(description, '')), 'branch'))")
query("x01_search_indexed_critical", lambda i: X.search_index(X.build_index(master(i)), "about", cde_only=True).select(*KEY.split(", "), "description"), f"select {KEY}, description from {{master}} where cde_flag = 'YES' and (table_name ilike '%about%' or column_name ilike '%about%' or description ilike '%about%')")
query("x02_catalog_metrics", lambda i: X.catalog_metrics(master(i)), f"select count(distinct ({OBJ})) as objects, count(*) as columns, count(*) filter (where cde_flag = 'YES') as critical_data_elements, count(*) filter (where trim(description) <> '') as documented_columns from {{master}}")
query("x03_object_names", lambda i: X.object_names(i.cat_columns), "select distinct concat(database_name, '.', schema_name, '.', table_name) as object_name from {cat_columns}")
query("x03_assets", lambda i: X.assets(master(i)), """
select concat(database_name, '.', schema_name, '.', table_name) as object_name, coalesce(nullif(arg_min(coalesce(data_owner, ''), ordinal_position), ''), 'Not assigned') as data_owner,
  coalesce(nullif(arg_min(coalesce(data_steward, ''), ordinal_position), ''), 'Not assigned') as data_steward, coalesce(max(certification), 'Not certified') as certification,
  coalesce(max(latest_dq_status), 'Not available') as latest_dq_status, count(*) as columns from {master} group by 1""")
query("x03_asset_columns", lambda i: X.asset_columns(master(i), ("RAW", "PUBLIC", "TBL_6")), "select column_name, column_type, description, cde_flag, criticality_level, classification from {master} where database_name = 'RAW' and table_name = 'TBL_6'")


def _runs_of_tables(i: Inputs):
    """Certification runs of the catalog's own tables: one per order, spread by key."""
    return i.cert_runs.join(i.cat_tables.select(F.concat(F.lit("MART_"), F.col("t").cast("string")).alias("object_name"), F.col("database_name").alias("d"), F.col("schema_name").alias("s"), F.col("table_name").alias("o")), "object_name").select(
        "certification_run_id", F.col("d").alias("database_name"), F.col("s").alias("schema_name"), F.col("o").alias("object_name"), "final_status", "completed_at")


query("x04_certification_status", lambda i: X.certification_status(master(i), _runs_of_tables(i)), f"""
with r as (select t.database_name, t.schema_name, t.table_name, arg_max(final_status, (completed_at, certification_run_id)) as final_status from {{cert_runs}} c join {{cat_tables}} t on c.object_name = concat('MART_', cast(t as varchar)) group by all)
select m.database_name, m.schema_name, m.table_name, coalesce(r.final_status, m.c, 'Not certified') as certification from (select {OBJ}, max(certification) as c from {{master}} group by all) m left join r on m.table_name = r.table_name and m.schema_name = r.schema_name""")
