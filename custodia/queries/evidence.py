"""Lineage, adoption and certification."""

from __future__ import annotations

from pyspark.sql import functions as F

from custodia.operators import certify as C
from custodia.operators import closure as K
from custodia.operators import lineage as L
from custodia.operators import search as X
from custodia.queries.catalog import MART, master, usage
from custodia.queries.inputs import AS_OF, Inputs
from custodia.queries.registry import VIEWS, query
from custodia.queries.sensitive import gaps
from custodia.sources import logs

NOW = "timestamp '2024-01-31 00:00:00'"
EDGE = ", ".join(L.EDGE)
SRC = "e.source_database is not distinct from w.d and e.source_schema is not distinct from w.s and e.source_object is not distinct from w.o and e.source_column is not distinct from w.c"
TGT = SRC.replace("source_", "target_")

# ---- lineage ---------------------------------------------------------------------


def reach_sql(anchor: str, direction: str, distance: int = 5) -> str:
    """Edges within a distance of an anchor node, by a recursive walk over nodes."""
    near, far = (SRC, "target") if direction == "DOWNSTREAM" else (TGT, "source")
    return f"""
with recursive w as (select {anchor}, 0 as n
  union select e.{far}_database, e.{far}_schema, e.{far}_object, e.{far}_column, w.n + 1 from w join {{edges}} e on {near} where w.n < {distance - 1}),
f as (select d, s, o, c, min(n) as n from w group by all)
select e.*, '{direction}' as direction, (w.n + 1)::bigint as distance from f w join {{edges}} e on {near}"""


REGION = "'RAW' as d, 'PUBLIC' as s, 'REGION_1' as o, cast(null as varchar) as c"
query("n02_downstream", lambda i: L.reach(i.stored_edges, L.anchors(i.spark, "RAW.PUBLIC.REGION_1"), "DOWNSTREAM"), reach_sql(REGION, "DOWNSTREAM"))
query("n02_downstream_two_hops", lambda i: L.reach(i.stored_edges, L.anchors(i.spark, "RAW.PUBLIC.REGION_1"), "DOWNSTREAM", 2), reach_sql(REGION, "DOWNSTREAM", 2))
query("n02_upstream", lambda i: L.reach(i.stored_edges, L.anchors(i.spark, "ANALYTICS.MARTS.ORDERS_77"), "UPSTREAM"), reach_sql("'ANALYTICS' as d, 'MARTS' as s, 'ORDERS_77' as o, cast(null as varchar) as c", "UPSTREAM"))
query("n02_downstream_column", lambda i: L.reach(i.stored_edges, L.anchors(i.spark, "RAW.PUBLIC.NATION_3.NATIONKEY"), "DOWNSTREAM"), reach_sql("'RAW' as d, 'PUBLIC' as s, 'NATION_3' as o, 'NATIONKEY' as c", "DOWNSTREAM"))


def _regions(i: Inputs):
    return i.region.select(
        F.lit("RAW").alias("node_database"), F.lit("PUBLIC").alias("node_schema"),
        F.concat(F.lit("REGION_"), F.col("r_regionkey").cast("string")).alias("node_object"), F.lit(None).cast("string").alias("node_column"), F.col("r_name").alias("anchor"))


def _every_region(i: Inputs):
    """All regions at once: the closure of many anchors is one loop."""
    return L.reach(i.stored_edges, _regions(i), "DOWNSTREAM", carry=["anchor"]).groupBy("anchor", "distance").agg(F.count(F.lit(1)).alias("n"))


query("n02_downstream_many", _every_region, """
select r_name as anchor, 1::bigint as distance, count(*) as n from {region} join {nation} on n_regionkey = r_regionkey group by 1
union all select r_name, 2, count(*) from {region} join {nation} on n_regionkey = r_regionkey join {customer} on c_nationkey = n_nationkey group by 1
union all select r_name, 3, count(*) from {region} join {nation} on n_regionkey = r_regionkey join {customer} on c_nationkey = n_nationkey join {orders} on o_custkey = c_custkey group by 1
union all select r_name, 4, count(*) from {region} join {nation} on n_regionkey = r_regionkey join {customer} on c_nationkey = n_nationkey join {orders} on o_custkey = c_custkey join {lineitem} on l_orderkey = o_orderkey group by 1""")


def _refreshed(i: Inputs):
    """The closure of every region over edges of yesterday, refreshed by the one in a hundred that came and the one that went."""
    now = i.stored_edges
    part = F.crc32(F.concat("source_object", F.lit(">"), "target_object").cast("binary")) % 100
    came = now.where(part == 0)
    went = now.where(part == 1).withColumn("target_object", F.concat(F.lit("GONE_"), "target_object"))
    yesterday = now.where(part != 0).unionByName(went)
    return K.refresh(K.build(yesterday, _regions(i), "DOWNSTREAM", ["anchor"]), came, went).snapshot


query("n01_refresh_by_difference", _refreshed, f"""
with recursive w as (select r_name as anchor, 'RAW' as d, 'PUBLIC' as s, concat('REGION_', r_regionkey) as o, cast(null as varchar) as c, 0 as n from {{region}}
  union select w.anchor, e.target_database, e.target_schema, e.target_object, e.target_column, w.n + 1 from w join {{edges}} e on {SRC} where w.n < 4),
f as (select anchor, d, s, o, c, min(n) as n from w group by all)
select distinct anchor, e.*, 'DOWNSTREAM' as direction, (w.n + 1)::bigint as distance from f w join {{edges}} e on {SRC}""")  # repeated edges count once


def _object_graph(i: Inputs):
    """The key graph with one customer's object named as the mart, so that all three evidence kinds meet."""
    def named(side):
        return F.when((F.col(f"{side}_object") == "CUSTOMER_5") & (F.col(f"{side}_schema") == "STAGING"), "MART_DEPOSITS").otherwise(F.col(f"{side}_object"))
    return i.stored_edges.withColumns({"source_object": named("source"), "target_object": named("target")})


STAGED_MART = ("ANALYTICS", "STAGING", "MART_DEPOSITS")
VIEWS["object_graph"] = """
select source_database, source_schema, if(source_object = 'CUSTOMER_5', 'MART_DEPOSITS', source_object) as source_object, source_object_domain, source_column,
  target_database, target_schema, if(target_object = 'CUSTOMER_5', 'MART_DEPOSITS', target_object) as target_object, target_object_domain, target_column from {edges}"""


def _snapshot(i: Inputs):
    deps = i.dependencies.withColumn("referenced_schema", F.when(F.col("referenced_object_name") == "MART_DEPOSITS", "STAGING").otherwise(F.col("referenced_schema")))
    return L.refresh_lineage(_object_graph(i), deps, i.access_log, STAGED_MART, ["NATIONKEY"], AS_OF)


def _walk(direction: str, column: str) -> str:
    anchor = f"'ANALYTICS' as d, 'STAGING' as s, 'MART_DEPOSITS' as o, cast({column} as varchar) as c"
    body = reach_sql(anchor, direction).replace("{edges}", "{object_graph}").strip()
    return f"({body})"


query("n01_refresh_lineage", lambda i: _snapshot(i).select("source_database", "source_schema", "source_object", "source_column", "target_database", "target_schema", "target_object", "target_column", "direction", "distance", "lineage_source", "relationship_type", "captured_at"), f"""
select {EDGE}, direction, distance, 'NATIVE_LINEAGE' as lineage_source, 'NATIVE' as relationship_type, {NOW} as captured_at from (
  select * from {_walk('UPSTREAM', 'null')} union all select * from {_walk('DOWNSTREAM', 'null')} union all select * from {_walk('UPSTREAM', "'NATIONKEY'")})
union all select referenced_database, 'STAGING', referenced_object_name, null, referencing_database, referencing_schema, referencing_object_name, null, 'DOWNSTREAM', 1, 'OBJECT_DEPENDENCIES', dependency_type, {NOW}
  from {{dependencies}} where referenced_object_name = 'MART_DEPOSITS'""")
query("n01_dependency_edges", lambda i: L.dependency_edges(i.dependencies, MART), """
select referenced_database as source_database, referenced_schema as source_schema, referenced_object_name as source_object, referenced_object_domain as source_object_domain,
  referencing_database as target_database, referencing_schema as target_schema, referencing_object_name as target_object, referencing_object_domain as target_object_domain,
  case when referencing_object_name = 'MART_DEPOSITS' then 'UPSTREAM' else 'DOWNSTREAM' end as direction, 1::bigint as distance, 'OBJECT_DEPENDENCIES' as lineage_source, dependency_type as relationship_type
from {dependencies} where referencing_object_name = 'MART_DEPOSITS' or referenced_object_name = 'MART_DEPOSITS'""")
query("n01_runtime_edges", lambda i: L.runtime_edges(i.access_log, MART).select("source_object", "target_object", "query_id", "direction", "lineage_source", "relationship_type"), """
select distinct source_object, target_object, event_id as query_id, 'UPSTREAM' as direction, 'ACCESS_HISTORY' as lineage_source, 'RUNTIME_QUERY' as relationship_type from {object_access} where target_object = 'MART_DEPOSITS'""")
EXT = ["source_system", "source_object", "source_column", "target_system", "target_object", "target_column", "relationship_type", "registration_type", "notes", "created_at"]


def registered(i: Inputs):
    stored = i.external.filter("s_acctbal < 7000").select(*EXT)
    rows = i.external.filter("s_acctbal > 1000").select(*EXT).withColumn("notes", F.lit("registered")).drop("created_at")
    return L.register_external(stored, rows)


query("n03_register_external", registered, """
select source_system, source_object, source_column, target_system, target_object, target_column, relationship_type, registration_type,
  case when s_acctbal > 1000 then 'registered' else notes end as notes, case when s_acctbal < 7000 then created_at end as created_at from {external}""")
query("k12_upsert_external", lambda i: registered(i).groupBy("source_system", "notes").agg(F.count(F.lit(1)).alias("n")).filter("notes = 'registered'"),
      "select source_system, 'registered' as notes, count(*) as n from {external} where s_acctbal > 1000 group by 1")

TARGET = ("ANALYTICS", "MARTS", "ORDERS_77", "CUSTKEY")
INPUTS = (("RAW", "PUBLIC", "SRC_Brand#11", "EMAIL"), ("RAW", "PUBLIC", "SRC_Brand#11", "PHONE"))


def _trace(i: Inputs):
    declared = L.declared_edges([
        ("ANALYTICS.STAGING.STG_TRANSACTION.AMOUNT", "ANALYTICS.MARTS.MART_DEPOSITS.TOTAL_CREDITS", "sum of credit amounts"),
        ("RAW.PUBLIC.TRANSACTION.AMOUNT", "ANALYTICS.STAGING.STG_TRANSACTION.AMOUNT", "projection")], i.spark)
    return L.trace(i.snapshot, declared, ("RAW", "PUBLIC", "TBL_6", "EMAIL"), INPUTS)


VIEWS["traced"] = f"""
select 'NATIVE_LINEAGE' as evidence_type, {EDGE}, distance::bigint as distance, 'Captured lineage edge.' as evidence_note from {{snapshot}}
where lineage_source = 'NATIVE_LINEAGE' and ((target_database = 'RAW' and target_schema = 'PUBLIC' and target_object = 'TBL_6' and target_column = 'EMAIL') or (source_object = 'SRC_Brand#11' and source_column in ('EMAIL', 'PHONE')))
union all select 'TRANSFORMATION_EXPRESSION', 'ANALYTICS', 'STAGING', 'STG_TRANSACTION', 'AMOUNT', 'ANALYTICS', 'MARTS', 'MART_DEPOSITS', 'TOTAL_CREDITS', 1, 'sum of credit amounts'
union all select 'TRANSFORMATION_EXPRESSION', 'RAW', 'PUBLIC', 'TRANSACTION', 'AMOUNT', 'ANALYTICS', 'STAGING', 'STG_TRANSACTION', 'AMOUNT', 1, 'projection'"""
query("n04_trace", _trace, "select * from {traced}")
NODE = "{0}.target_database, '.', {0}.target_schema, '.', {0}.target_object"
NODE_NAME = "concat(" + NODE.format("e") + ", case when e.target_column is null then '' else concat('.', e.target_column) end)"


def impact_sql(start: str, column: str) -> str:
    """All simple paths of up to five hops from a column, or from its object when the column has no edges."""
    name = f"RAW.PUBLIC.{start}.{column}"
    at_object = f"source_database = 'RAW' and source_schema = 'PUBLIC' and source_object = '{start}'"
    return f"""
with recursive w as (
  select e.target_database, e.target_schema, e.target_object, e.target_object_domain, e.target_column, 1 as hop, concat('{name} -> ', {NODE_NAME}) as path, ['{name}', {NODE_NAME}] as seen,
    case when e.source_column is null then 'OBJECT_LEVEL_FALLBACK' else 'COLUMN_LEVEL' end as kind
  from {{edges}} e where {at_object} and (source_column = '{column}'
    or (source_column is null and not exists (select 1 from {{edges}} x where x.source_database = 'RAW' and x.source_schema = 'PUBLIC' and x.source_object = '{start}' and x.source_column = '{column}')))
  union all
  select e.target_database, e.target_schema, e.target_object, e.target_object_domain, e.target_column, w.hop + 1, concat(w.path, ' -> ', {NODE_NAME}), list_append(w.seen, {NODE_NAME}),
    case when w.kind = 'COLUMN_LEVEL' and w.target_column is not null then 'COLUMN_LEVEL' else 'OBJECT_LEVEL_FALLBACK' end
  from w join {{edges}} e
    on e.source_database = w.target_database and e.source_schema = w.target_schema and e.source_object = w.target_object and e.source_column is not distinct from w.target_column
  where w.hop < 5 and not list_contains(w.seen, {NODE_NAME}))
select distinct '{name}' as source_column, target_database, target_schema, target_object, target_object_domain, target_column as affected_column, hop::bigint as hop, path, kind as impact_evidence_type from w"""


def _impact(i: Inputs, *names: str):
    return L.impact(i.stored_edges, L.anchors(i.spark, *names))


query("n05_impact_column", lambda i: _impact(i, "RAW.PUBLIC.NATION_3.NATIONKEY"), impact_sql("NATION_3", "NATIONKEY"))
query("n05_impact_fallback", lambda i: _impact(i, "RAW.PUBLIC.REGION_2.REGIONKEY"), impact_sql("REGION_2", "REGIONKEY"))
query("j13_recursive_join", lambda i: _impact(i, "RAW.PUBLIC.NATION_7.NATIONKEY").select("affected_column", "hop", "target_object"), "select affected_column, hop, target_object from (" + impact_sql("NATION_7", "NATIONKEY") + ")")
query("n05_impacted", lambda i: L.impacted(i.stored_edges, L.anchors(i.spark, "RAW.PUBLIC.REGION_2")).groupBy("distance").agg(F.count(F.lit(1)).alias("n")), """
select 1::bigint as distance, count(*) as n from {nation} where n_regionkey = 2 union all select 2, count(*) from {customer} join {nation} on c_nationkey = n_nationkey where n_regionkey = 2
union all select 3, count(*) from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey where n_regionkey = 2
union all select 4, count(distinct (l_orderkey, l_linenumber)) from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey where n_regionkey = 2""")


LEVELS = "source_column, target_database, target_schema, target_object, target_object_domain, affected_column, hop, impact_evidence_type"


def _levels(i: Inputs, *names: str):
    return L.impact_levels(i.stored_edges, L.anchors(i.spark, *names)).withColumnRenamed("target_column", "affected_column")


def _drawn(i: Inputs, name: str):
    """One path to every node that is affected at the fourth hop."""
    edges = L.impact_edges(i.stored_edges)
    levels = L.impact_levels(edges, L.anchors(i.spark, name))
    return L.draw_paths(edges, levels, levels.where("hop = 4")).select("target_object", "hop", "path")


def levels_sql(*starts: tuple[str, str]) -> str:
    """Paths to a node, counted per hop and evidence, from the list of all of them."""
    return " union all ".join(f"select {LEVELS}, count(*)::double as n_paths from ({impact_sql(*s)}) group by all" for s in starts)


query("n05_impact_levels", lambda i: _levels(i, "RAW.PUBLIC.NATION_3.NATIONKEY", "RAW.PUBLIC.REGION_2.REGIONKEY"), levels_sql(("NATION_3", "NATIONKEY"), ("REGION_2", "REGIONKEY")))
query("n05_drawn_paths", lambda i: _drawn(i, "RAW.PUBLIC.REGION_4.REGIONKEY"),
      "select target_object, hop, min(path) as path from (" + impact_sql("REGION_4", "REGIONKEY") + ") where hop = 4 group by 1, 2")


def _impact_governed(i: Inputs):
    """Owners of what the catalog's own edges reach: every brand source as a seed, one closure."""
    seeds = i.part.select(F.lit("RAW").alias("node_database"), F.lit("PUBLIC").alias("node_schema"), F.concat(F.lit("SRC_"), F.col("p_brand")).alias("node_object"), F.lit("EMAIL").alias("node_column")).distinct()
    return L.impact(i.snapshot, seeds, master(i)).select("source_column", "target_object", "affected_column", "hop", "impact_evidence_type", "data_owner", "data_steward")


VIEWS["governed"] = """
select distinct concat('RAW.PUBLIC.', s.source_object, '.EMAIL') as source_column, s.target_database, s.target_schema, s.target_object, s.target_column as affected_column, 1::bigint as hop,
  case when s.target_column is null then 'OBJECT_LEVEL_FALLBACK' else 'COLUMN_LEVEL' end as impact_evidence_type, g.data_owner, g.data_steward
from {snapshot} s left join (select table_name, max(data_owner) as data_owner, max(data_steward) as data_steward from {master} group by 1) g on g.table_name = s.target_object
where s.target_column = 'EMAIL' or (s.source_column is null and s.source_object not in (select source_object from {snapshot} where source_column = 'EMAIL'))"""
query("n05_impact_governed", _impact_governed, "select source_column, target_object, affected_column, hop, impact_evidence_type, data_owner, data_steward from {governed}")
query("a14_asset_governance", lambda i: L.asset_governance(master(i)), "select database_name, schema_name, table_name, max(data_owner) as data_owner, max(data_steward) as data_steward from {master} group by all")
query("x08_object_impact", lambda i: X.object_impact(L.impact(i.snapshot, i.part.select(F.lit("RAW").alias("node_database"), F.lit("PUBLIC").alias("node_schema"), F.concat(F.lit("SRC_"), F.col("p_brand")).alias("node_object"), F.lit("EMAIL").alias("node_column")).distinct(), master(i))),
      "select source_column, target_database, target_schema, target_object, affected_column, hop, impact_evidence_type, data_owner, data_steward from {governed}")
query("x08_object_trace", lambda i: X.object_trace(_trace(i)).select("evidence_type", "source_object", "target_object", "distance"), "select evidence_type, source_object, target_object, distance from {traced}")
query("n06_lineage_counts", lambda i: L.lineage_counts(i.snapshot, i.external, _trace(i), _impact(i, "RAW.PUBLIC.NATION_3.NATIONKEY"), "LEGACY_ETL", "BI_TOOL", [("RAW", "PUBLIC", "SRC_Brand#11", "EMAIL")]), f"""
select 'native_edges' as check_name, count(*) as observed_count from {{snapshot}} where lineage_source = 'NATIVE_LINEAGE'
union all select 'upstream_edges', count(*) from {{snapshot}} where lineage_source = 'NATIVE_LINEAGE' and direction = 'UPSTREAM' union all select 'downstream_edges', count(*) from {{snapshot}} where lineage_source = 'NATIVE_LINEAGE' and direction = 'DOWNSTREAM'
union all select 'native_column_edges', count(*) from {{snapshot}} where lineage_source = 'NATIVE_LINEAGE' and (source_column is not null or target_column is not null)
union all select 'external_upstream_edges', count(*) from {{external}} where source_system = 'LEGACY_ETL' and registration_type = 'EXTERNAL_MANUAL' union all select 'external_downstream_edges', count(*) from {{external}} where target_system = 'BI_TOOL' and registration_type = 'EXTERNAL_MANUAL'
union all select 'trace_raw_inputs', count(*) from {{traced}} where source_object = 'SRC_Brand#11' and source_column = 'EMAIL' union all select 'downstream_impacts', count(*) from ({impact_sql('NATION_3', 'NATIONKEY')})""")
query("n07_access_column_edges", lambda i: logs.access_column_edges(i.access_log), """
select distinct source_database, source_schema, source_object, concat('C_', event_type) as source_column, target_database, target_schema, target_object, concat('M_C_', event_type) as target_column
from {object_access} where source_object <> 'LOOKUP'""")
query("j14_flatten_two_arrays", lambda i: logs.access_edges(i.access_log).groupBy("source_object", "target_object").agg(F.count(F.lit(1)).alias("n")), "select source_object, target_object, count(*) as n from (select distinct event_id, source_object, target_object from {object_access}) group by 1, 2")
query("n08_edge_freshness", lambda i: L.edge_freshness(i.snapshot), "select lineage_source, direction, count(*) as edge_count, max(captured_at) as last_captured_at from {snapshot} group by 1, 2")
SNAP = f"{EDGE}, direction, distance::bigint as distance, lineage_source"
SNAP_COLS = [*L.EDGE, "direction", "distance", "lineage_source"]
OBJECT6 = ("ANALYTICS", "MARTS", "TBL_37")
query("n09_object_edges", lambda i: L.object_edges(i.snapshot, OBJECT6).select(*SNAP_COLS), f"select {SNAP} from {{snapshot}} where lineage_source = 'NATIVE_LINEAGE' and target_object = 'TBL_37'")
query("n09_column_edges", lambda i: L.column_edges(i.snapshot, OBJECT6).select(*SNAP_COLS), f"select {SNAP} from {{snapshot}} where lineage_source = 'NATIVE_LINEAGE' and target_object = 'TBL_37' and target_column is not null")
query("x05_object_lineage", lambda i: X.object_lineage(i.snapshot, OBJECT6).select(*SNAP_COLS), f"select {SNAP} from {{snapshot}} where target_object = 'TBL_37'")
query("x05_lineage_totals", lambda i: X.lineage_totals(i.snapshot, OBJECT6), "select count(*) as lineage_edges, count(*) filter (where lineage_source = 'NATIVE_LINEAGE') as native_edges from {snapshot} where target_object = 'TBL_37'")

# ---- adoption and ownership ------------------------------------------------------

VIEWS["adoption"] = f"""
select 'ANALYTICS' as database_name, 'MARTS' as schema_name, 'MART_DEPOSITS' as object_name, query_id, role_name, start_time as query_start_time, query_text, {NOW} as captured_at from {{query_history}}
where execution_status = 'SUCCESS' and query_text ilike '%ANALYTICS.MARTS.MART_DEPOSITS%' and role_name in ('DEPOSITS_ANALYST', 'DATA_STEWARD', 'BRANCH_HUDSON') and start_time between {NOW} - interval 167 hour and {NOW}"""


def adopted(i: Inputs):
    return C.adoption(i.query_history, MART, AS_OF)


query("e01_adoption", adopted, "select * from {adoption}")
query("e01_adoption_of_all", usage, "select * from {usage_evidence}")
query("e01_refresh_adoption", lambda i: C.refresh_adoption(usage(i).unionByName(adopted(i)).withColumn("captured_at", F.lit(AS_OF)), adopted(i).filter("role_name = 'DATA_STEWARD'"), MART).select("object_name", "query_id", "role_name"),
      "select object_name, query_id, role_name from {usage_evidence} union all select object_name, query_id, role_name from {adoption} where role_name = 'DATA_STEWARD'")
query("e02_adoption_summary", lambda i: C.adoption_summary(adopted(i)), "select role_name, count(*) as query_count, max(query_start_time) as last_query_time from {adoption} group by 1")
query("x06_adoption_totals", lambda i: X.adoption_totals(usage(i), "object_name"), "select object_name, count(*) as total_queries, count(distinct role_name) as distinct_roles from {usage_evidence} group by 1")
VIEWS["ownership"] = f"""
select database_name, schema_name, table_name as object_name, 'OWNERSHIP_TAG' as evidence_type, tag_name as evidence_key, tag_value as evidence_value, {NOW} as captured_at from {{tags}} where domain = 'TABLE' and tag_name in ('DATA_OWNER', 'DATA_STEWARD')"""


def owned(i: Inputs):
    return C.ownership_evidence(i.tags, AS_OF)


query("e03_ownership_evidence", owned, "select * from {ownership}")

# ---- the seven controls ----------------------------------------------------------

OBJ = "database_name, schema_name, table_name"
CONTROL_SQL = {
    "owned": f"""select database_name, schema_name, object_name as table_name, o > 0 and s > 0 as passed, concat(o, ' owner tag(s), ', s, ' steward tag(s)') as evidence_value from (
  select database_name, schema_name, object_name, count(*) filter (where evidence_key = 'DATA_OWNER' and trim(evidence_value) <> '') as o, count(*) filter (where evidence_key = 'DATA_STEWARD' and trim(evidence_value) <> '') as s from {{ownership}} group by all)""",
    "defined": f"select {OBJ}, d = n as passed, concat(d, '/', n) as evidence_value from (select {OBJ}, count(*) as n, count(*) filter (where trim(description) <> '') as d from {{master}} group by all)",
    "traceable": "select target_database as database_name, target_schema as schema_name, target_object as table_name, true as passed, concat(count(*), ' native upstream edge(s)') as evidence_value from {snapshot} where lineage_source = 'NATIVE_LINEAGE' and direction = 'UPSTREAM' group by 1, 2, 3",
    "trusted": """select t.database_name, t.schema_name, t.table_name, n = 6 and dims = 6 and bad = 0 as passed, concat(dims, '/6 DQ dimensions; ', bad, ' failure(s)') as evidence_value from {cat_tables} t join (
  select target_database, target_schema, target_table, count(*) as n, count(distinct check_dimension) as dims, count(*) filter (where check_result is distinct from 'PASS') as bad from {latest_results} group by 1, 2, 3) r on r.target_database = t.database_name and r.target_schema = t.schema_name and r.target_table = t.table_name""",
    "secure": f"select {OBJ}, false as passed, concat(count(*), ' protection gap(s)') as evidence_value from {{gaps}} group by 1, 2, 3",
    "adopted": "select database_name, schema_name, object_name as table_name, true as passed, concat(count(*), ' consumer query/queries in recent evidence window') as evidence_value from {usage_evidence} group by 1, 2, 3",
    "reconciled": """select t.database_name, t.schema_name, t.table_name, n = 1 as passed, concat(n, ' passing accuracy reconciliation row(s)') as evidence_value from {cat_tables} t join (
  select target_database, target_schema, target_table, count(*) filter (where check_dimension = 'ACCURACY' and check_result = 'PASS') as n from {latest_results} group by 1, 2, 3) r on r.target_database = t.database_name and r.target_schema = t.schema_name and r.target_table = t.table_name""",
}
for _n, _s in CONTROL_SQL.items():
    VIEWS[f"control_{_n}"] = _s
query("e04_control_owned", lambda i: C.control_owned(owned(i)), "select * from {control_owned}")
query("e05_control_defined", lambda i: C.control_defined(master(i)), "select * from {control_defined}")
query("e06_control_traceable", lambda i: C.control_traceable(i.snapshot), "select * from {control_traceable}")
query("e07_control_trusted", lambda i: C.control_trusted(C.latest_results(i.dq_results), i.cat_tables), "select * from {control_trusted}")
query("e08_control_secure", lambda i: C.control_secure(gaps(i)), "select * from {control_secure}")
query("e09_control_adopted", lambda i: C.control_adopted(usage(i), AS_OF), "select * from {control_adopted}")
query("e10_control_reconciled", lambda i: C.control_reconciled(C.latest_results(i.dq_results), i.cat_tables), "select * from {control_reconciled}")


def certified(i: Inputs):
    return C.certify(i.cat_tables, owned(i), master(i), i.snapshot, i.dq_results, gaps(i), usage(i), "certify-1", AS_OF)


VIEWS["controls"] = "\nunion all ".join(
    f"""select t.database_name, t.schema_name, t.table_name, '{n.upper()}' as control_name, {k} as k, coalesce(c.passed, {str(n == 'secure').lower()}) as passed, coalesce(c.evidence_value, '{C.NOTHING[n.upper()]}') as evidence_value
from {{cat_tables}} t left join {{control_{n}}} c on c.database_name = t.database_name and c.schema_name = t.schema_name and c.table_name = t.table_name""" for k, n in enumerate(CONTROL_SQL))
RUN_ID = "md5(concat('certify-1:', database_name, ':', schema_name, ':', table_name))"
query("e11_certify_scorecard", lambda i: certified(i)[0].drop("evidence_details"), f"select {RUN_ID} as certification_run_id, database_name, schema_name, table_name as object_name, control_name, case when passed then 'PASS' else 'FAIL' end as control_status, evidence_value, {NOW} as evaluated_at from {{controls}}")
query("e11_certify_runs", lambda i: certified(i)[1], f"""
select {RUN_ID} as certification_run_id, database_name, schema_name, table_name as object_name, case when count(*) filter (where passed) = 7 then 'CERTIFIED' else 'IN_PROGRESS' end as final_status, count(*) filter (where passed) as passed_controls,
  7::bigint as total_controls, 'DATA_OWNER' as certified_by, {NOW} as started_at, {NOW} as completed_at from {{controls}} group by 2, 3, 4""")
query("e11_certify_tags", lambda i: C.certification_tags(i.cert_runs.withColumn("completed_at", F.col("completed_at").cast("timestamp"))).groupBy("tag_name", "tag_value").agg(F.count(F.lit(1)).alias("n")), """
select 'CERTIFICATION' as tag_name, final_status as tag_value, count(*) as n from {cert_runs} group by 2 union all select 'LAST_CERTIFIED', strftime(completed_at, '%Y-%m-%d %H:%M:%S +00:00'), count(*) from {cert_runs} where final_status = 'CERTIFIED' group by 2""")
VIEWS["current_runs"] = """select * from (select *, row_number() over (partition by object_name order by completed_at desc, certification_run_id desc) as rn from {cert_runs}) where rn = 1"""
VIEWS["current_card"] = """select s.* from {cert_scorecard} s join {current_runs} r on s.certification_run_id = r.certification_run_id"""
query("e12_scorecard_current", lambda i: C.scorecard_current(i.cert_scorecard, i.cert_runs), """
select database_name, schema_name, object_name, control_name, control_status, evidence_value, evidence_details, evaluated_at,
  list_position(['OWNED', 'DEFINED', 'TRACEABLE', 'TRUSTED', 'SECURE', 'ADOPTED', 'RECONCILED'], control_name)::bigint as control_rank from {current_card}""")
query("e13_score", lambda i: C.score(C.scorecard_current(i.cert_scorecard, i.cert_runs)), """
select database_name, schema_name, object_name, count(*) as total_controls, count(*) filter (where control_status = 'PASS') as passed_controls,
  case when count(*) = 7 and count(*) filter (where control_status = 'PASS') = 7 then '7/7' else 'NOT_7/7' end as score from {current_card} group by 1, 2, 3""")
query("e14_run_history", lambda i: C.run_history(i.cert_runs, "object_name"), "select object_name, final_status, count(*) as run_count, max(completed_at) as latest_run from {cert_runs} group by 1, 2")
query("x07_scorecard_summary", lambda i: X.scorecard_summary(C.scorecard_current(i.cert_scorecard, i.cert_runs)), """
select database_name, schema_name, object_name, concat(count(*) filter (where control_status = 'PASS'), '/7') as scorecard,
  case when count(*) filter (where control_status = 'PASS') = 7 then 'CERTIFIED' else 'IN PROGRESS' end as overall_status, max(evaluated_at) as last_evaluated from {current_card} group by 1, 2, 3""")
