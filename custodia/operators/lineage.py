"""Lineage: closures, snapshot, traces and impact over an edge table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.functions import scalars as S
from custodia.operators import graph
from custodia.operators import relational as R
from custodia.session import cut_counted
from custodia.sinks import store
from custodia.sources import logs
from custodia.sources.values import values_df

PARTS = ["database", "schema", "object", "column"]
NODE = [f"node_{p}" for p in PARTS]
SOURCE = [f"source_{p}" for p in PARTS]
TARGET = [f"target_{p}" for p in PARTS]
EDGE = [*SOURCE, *TARGET]

# How far lineage is followed, and the labels of its evidence.
MAX_DISTANCE = 5
NATIVE = "NATIVE_LINEAGE"
DEPENDENCIES = "OBJECT_DEPENDENCIES"
ACCESS = "ACCESS_HISTORY"
DECLARED = "TRANSFORMATION_EXPRESSION"
BY_COLUMN = "COLUMN_LEVEL"
BY_OBJECT = "OBJECT_LEVEL_FALLBACK"

EDGE_SCHEMA = (
    "source_database string, source_schema string, source_object string, source_object_domain string, source_column string, "
    "target_database string, target_schema string, target_object string, target_object_domain string, target_column string"
)


def node(*parts: Column) -> Column:
    return S.dotted(*parts)


def node_struct(prefix: str) -> Column:
    """A node as one value: comparing it compares all parts, NULL column included."""
    return F.struct(*[F.col(f"{prefix}{p}").alias(p) for p in PARTS])


def anchors(spark, *names: str) -> DataFrame:
    """Anchor nodes from dotted names; a fourth part names a column."""
    rows = [tuple((n.split(".") + [None])[:4]) for n in names]
    return values_df(spark, rows, ", ".join(f"{c} string" for c in NODE))


def ends(direction: str) -> tuple[list[str], list[str]]:
    """The end of an edge that a walk in this direction comes from, and the one it goes to."""
    return (SOURCE, TARGET) if direction == "DOWNSTREAM" else (TARGET, SOURCE)


def stored(edges: DataFrame | graph.EdgeTable, direction: str) -> graph.EdgeTable:
    """The edges as a table bucketed by the end that a walk in this direction comes from."""
    return graph.as_table(edges, *ends(direction))


def reach(
    edges: DataFrame | graph.EdgeTable, start: DataFrame, direction: str, max_distance: int = MAX_DISTANCE, carry: Sequence[str] = ()
) -> DataFrame:
    """Edges within ``max_distance`` of the anchors, each with its distance.

    An anchor without a column follows object edges, one with a column follows column
    edges. Node distances come from the hop loop; one last join with the edges gives
    every edge that leaves a found node exactly once per anchor. Edges that are stored by
    ``stored`` serve any number of calls.
    """
    table = stored(edges, direction)
    found = graph.distances(table, start, table.near, table.far, NODE, carry, max_distance - 1)
    return (
        table.leaving(found, NODE)
        .select(*[F.col(f"n.{c}") for c in carry], *[F.col(f"e.{c}") for c in table.columns], (F.col("n.distance") + 1).alias("hop"))
        .withColumn("direction", F.lit(direction))
        .withColumn("distance", F.col("hop"))
        .drop("hop")
    )


def declared_edges(specs: Sequence[tuple[str, str, str]], spark) -> DataFrame:
    """Column edges declared with a model: (input column, output column, note), dotted names."""
    rows = [(*s.split("."), *t.split("."), note) for s, t, note in specs]
    return values_df(spark, rows, ", ".join(f"{c} string" for c in [*EDGE, "evidence_note"]))


def dependency_edges(deps: DataFrame, obj: tuple[str, str, str]) -> DataFrame:
    """Declared object dependencies that touch the object, as edges at distance 1."""
    touching = logs.object_dependencies(deps, obj)
    referrer = (
        (F.col("referencing_database") == obj[0])
        & (F.col("referencing_schema") == obj[1])
        & (F.col("referencing_object_name") == obj[2])
    )
    return touching.select(
        F.col("referenced_database").alias("source_database"),
        F.col("referenced_schema").alias("source_schema"),
        F.col("referenced_object_name").alias("source_object"),
        F.col("referenced_object_domain").alias("source_object_domain"),
        F.col("referencing_database").alias("target_database"),
        F.col("referencing_schema").alias("target_schema"),
        F.col("referencing_object_name").alias("target_object"),
        F.col("referencing_object_domain").alias("target_object_domain"),
        F.when(referrer, "UPSTREAM").otherwise("DOWNSTREAM").alias("direction"),
        F.lit(1).alias("distance"),
        F.lit(DEPENDENCIES).alias("lineage_source"),
        F.col("dependency_type").alias("relationship_type"),
    )


def runtime_edges(access: DataFrame, obj: tuple[str, str, str]) -> DataFrame:
    """Reads behind each write of the object, as edges at distance 1."""
    return (
        logs.access_edges(access, ".".join(obj))
        .withColumn("direction", F.lit("UPSTREAM"))
        .withColumn("distance", F.lit(1))
        .withColumn("lineage_source", F.lit(ACCESS))
        .withColumn("relationship_type", F.lit("RUNTIME_QUERY"))
    )


def native_edges(
    edges: DataFrame, obj: tuple[str, str, str], columns: Sequence[str], max_distance: int = MAX_DISTANCE
) -> DataFrame:
    """Both directions of the object and the upstream of the named columns.

    All upstream anchors go through one closure, kept apart by the anchor's name.
    """
    spark = edges.sparkSession
    name = ".".join(obj)
    up_from = [name, *[f"{name}.{c}" for c in columns]]
    upstream = anchors(spark, *up_from).withColumn("anchor", node(*[F.col(c) for c in NODE]))
    up = reach(edges, upstream, "UPSTREAM", max_distance, ["anchor"]).drop("anchor")
    down = reach(edges, anchors(spark, name), "DOWNSTREAM", max_distance)
    return (
        up.unionByName(down)
        .withColumn("lineage_source", F.lit(NATIVE))
        .withColumn("relationship_type", F.lit("NATIVE"))
    )


def refresh_lineage(
    edges: DataFrame,
    deps: DataFrame,
    access: DataFrame,
    obj: tuple[str, str, str],
    columns: Sequence[str],
    as_of: datetime,
) -> DataFrame:
    """The full snapshot of one object's lineage, labelled by evidence source."""
    parts = [native_edges(edges, obj, columns), dependency_edges(deps, obj), runtime_edges(access, obj)]
    return R.union_all(parts).withColumn("captured_at", F.lit(as_of))


def register_external(store_df: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges to systems outside, keyed by both ends."""
    return store.upsert(
        store_df, rows, ["source_system", "source_object", "target_system", "target_object"],
        update=["relationship_type", "registration_type", "notes"],
    )


def trace(snapshot: DataFrame, declared: DataFrame, target: Sequence[str], inputs: Sequence[Sequence[str]]) -> DataFrame:
    """Worked trace of one measure: captured edges that end in it or leave its inputs, and declared ones."""

    def is_node(side: str, name: Sequence[str]) -> Column:
        return graph.same([F.col(f"{side}_{p}") for p in PARTS], [F.lit(x) for x in name])

    touches = is_node("target", target)
    for name in inputs:
        touches = touches | is_node("source", name)
    captured = snapshot.filter((F.col("lineage_source") == NATIVE) & touches).select(
        F.lit(NATIVE).alias("evidence_type"), *EDGE, "distance",
        F.lit("Captured lineage edge.").alias("evidence_note"),
    )
    stated = declared.select(
        F.lit(DECLARED).alias("evidence_type"), *EDGE, F.lit(1).alias("distance"), "evidence_note"
    )
    return captured.unionByName(stated)


IMPACT = ["target_database", "target_schema", "target_object", "target_object_domain", "target_column"]


def impact_edges(edges: DataFrame | graph.EdgeTable) -> graph.EdgeTable:
    """Distinct edges as impact analysis follows them, stored by the node they leave."""
    if isinstance(edges, graph.EdgeTable):
        return graph.as_table(edges, SOURCE, TARGET)
    return graph.store_edges(edges.select(*SOURCE, *IMPACT), SOURCE, TARGET, distinct=True)


def impact_levels(edges: DataFrame | graph.EdgeTable, sources: DataFrame, max_hops: int = MAX_DISTANCE) -> DataFrame:
    """Everything downstream of the source columns, one row per node and hop: how many paths of that length lead there, and on what evidence.

    Columns source_column, the IMPACT columns, hop, impact_evidence_type and n_paths (a decimal; counts outgrow 64 bits). Starts, evidence
    and hops are those of ``impact``, but paths are added up hop by hop and never listed, so a hop costs no more than the edges and holds
    one row per node and evidence. A path is a chain of edges; on a cycle within ``max_hops`` it may meet a node again, which ``impact``
    leaves out. ``draw_paths`` lists single paths of chosen nodes.
    """
    table = impact_edges(edges)
    s, _ = cut_counted(sources.select(*NODE).distinct().withColumn("source_column", node(*[F.col(c) for c in NODE])))
    one = F.lit(1).cast("decimal(38,0)")
    starts = s.withColumns({"impact_evidence_type": F.lit(BY_COLUMN), "n_paths": one})
    first, _ = cut_counted(_level(table, starts, NODE, 1))
    without = s.join(first.select("source_column").distinct(), "source_column", "left_anti")
    whole = without.withColumns({"node_column": F.lit(None).cast("string"), "impact_evidence_type": F.lit(BY_OBJECT), "n_paths": one})
    levels, (frontier, rows) = [], cut_counted(first.unionByName(_level(table, whole, NODE, 1)))
    for hop in range(2, max_hops + 2):
        levels.append(frontier)
        if rows == 0 or hop > max_hops:
            break
        by_column = (F.col("impact_evidence_type") == BY_COLUMN) & F.col("target_column").isNotNull()
        onward = frontier.withColumn("impact_evidence_type", F.when(by_column, BY_COLUMN).otherwise(BY_OBJECT))
        frontier, rows = cut_counted(_level(table, onward, TARGET, hop))
    return R.union_all(levels)


def _level(table: graph.EdgeTable, nodes: DataFrame, columns: Sequence[str], hop: int) -> DataFrame:
    """The nodes one edge on, with the paths that lead there added up."""
    renamed = nodes.select("source_column", "impact_evidence_type", "n_paths", *[F.col(c).alias(n) for c, n in zip(columns, NODE, strict=True)])
    return (
        table.leaving(renamed, NODE)
        .select("n.source_column", "n.impact_evidence_type", "n.n_paths", *[F.col(f"e.{c}") for c in IMPACT])
        .groupBy("source_column", *IMPACT, "impact_evidence_type")
        .agg(F.sum("n_paths").cast("decimal(38,0)").alias("n_paths"))
        .withColumn("hop", F.lit(hop))
    )


def draw_paths(edges: DataFrame | graph.EdgeTable, levels: DataFrame, chosen: DataFrame, max_hops: int = MAX_DISTANCE) -> DataFrame:
    """One path for each chosen row of ``impact_levels`` (source_column, TARGET columns and hop), as ``impact`` prints it.

    Each row of ``levels`` is first given its least predecessor among those that the level before holds, over the edges that leave these: only
    what was reached is looked at. Then the chosen nodes walk back a hop at a time, so there is one row per chosen node throughout.
    """
    if isinstance(edges, graph.EdgeTable) and edges.near == tuple(TARGET):
        edges = edges.rows
    table = edges if isinstance(edges, graph.EdgeTable) else graph.store_edges(edges.select(*SOURCE, *TARGET), SOURCE, TARGET, distinct=True)
    held = levels.select(F.col("source_column").alias("start"), *[F.col(t).alias(n) for n, t in zip(NODE, TARGET, strict=True)], F.col("hop").alias("level")).distinct()
    before = F.struct(*[F.col(s).alias(n) for n, s in zip(NODE, SOURCE, strict=True)])
    least, _ = cut_counted(
        graph.as_table(table, SOURCE, TARGET).leaving(held, NODE)
        .select("n.start", (F.col("n.level") + 1).alias("level"), *[F.col(f"e.{c}") for c in [*TARGET, *SOURCE]])
        .groupBy("start", "level", *TARGET).agg(F.min(before).alias("before"))
    )
    wanted = chosen.select(F.col("source_column").alias("start"), *TARGET, "hop").distinct()
    open_ = wanted.select("*", F.col("hop").alias("level"), *[F.col(t).alias(n) for n, t in zip(NODE, TARGET, strict=True)],
                          node(*[F.col(t) for t in TARGET]).alias("path"))
    key = ["start", *TARGET, "hop"]
    done = []
    for _ in range(max_hops):
        open_, rows = cut_counted(open_)
        if rows == 0:
            break
        done.append(open_.where("level = 1").withColumn("path", F.concat_ws(" -> ", "start", "path")).select(*key, "path"))
        o, b = open_.where("level > 1").alias("o"), least.alias("b")
        on = graph.same([F.col(f"o.{c}") for c in ["start", "level", *NODE]], [F.col(f"b.{c}") for c in ["start", "level", *TARGET]])
        open_ = o.join(b, on).select(
            *[F.col(f"o.{c}") for c in key], (F.col("o.level") - 1).alias("level"), *[F.col(f"b.before.{n}").alias(n) for n in NODE],
            F.concat_ws(" -> ", node(*[F.col(f"b.before.{n}") for n in NODE]), F.col("o.path")).alias("path"))
    out = R.union_all(done) if done else wanted.withColumn("path", F.lit(None).cast("string"))
    return out.withColumnRenamed("start", "source_column")


def impact(
    edges: DataFrame | graph.EdgeTable,
    sources: DataFrame,
    governance: DataFrame | None = None,
    max_hops: int = MAX_DISTANCE,
) -> DataFrame:
    """Everything downstream of the source columns, one row per simple path.

    ``sources`` has the node columns. A source follows its column edges if it has any,
    otherwise the object edges of its table. A path never visits a node twice: visited
    nodes are kept as an array and compared whole. ``governance`` adds owner and steward
    per object. The result is as large as the number of paths; ``impact_levels`` counts
    them instead and ``impacted`` gives the affected nodes alone. The sources are written first: their size is then known
    and the edges are not moved to meet a few of them.
    """
    table = impact_edges(edges)
    s, _ = cut_counted(sources.select(*NODE).distinct().withColumn("source_name", node(*[F.col(c) for c in NODE])))

    def seeds(found: DataFrame, evidence: str) -> DataFrame:
        return found.select(
            "source_name", *IMPACT, F.lit(1).alias("hop"),
            F.array(node_struct("node_"), node_struct("target_")).alias("visited"), F.lit(evidence).alias("impact_evidence_type"),
        ).distinct()

    by_column, _ = cut_counted(seeds(table.leaving(s, NODE), BY_COLUMN))
    without = s.join(by_column.select("source_name").distinct(), "source_name", "left_anti")
    object_only = without.withColumns({"column_asked": F.col("node_column"), "node_column": F.lit(None).cast("string")})
    by_object = seeds(table.leaving(object_only, NODE).withColumn("node_column", F.col("column_asked")), BY_OBJECT)
    frontier, rows = cut_counted(by_column.unionByName(by_object))
    hops = [frontier]
    for hop in range(2, max_hops + 1):
        if rows == 0:
            break
        there = node_struct("e.target_")
        ends = frontier.withColumnsRenamed(dict(zip(TARGET, NODE, strict=True))).drop("target_object_domain", "hop")
        frontier, rows = cut_counted(
            table.leaving(ends, NODE)
            .filter(~F.array_contains(F.col("n.visited"), there))
            .select(
                "n.source_name", *[F.col(f"e.{c}") for c in IMPACT], F.lit(hop).alias("hop"),
                F.array_append(F.col("n.visited"), there).alias("visited"),
                F.when(
                    (F.col("n.impact_evidence_type") == BY_COLUMN) & F.col("n.node_column").isNotNull(), F.lit(BY_COLUMN)
                ).otherwise(F.lit(BY_OBJECT)).alias("impact_evidence_type"),
            )
            .distinct()
        )
        hops.append(frontier)
    out = R.union_all(hops).select(
        F.col("source_name").alias("source_column"), *IMPACT[:4], F.col("target_column").alias("affected_column"),
        "hop",
        F.array_join(F.transform("visited", lambda v: node(*[v[x] for x in PARTS])), " -> ").alias("path"),
        "impact_evidence_type",
    )
    return with_governance(out, governance)


def with_governance(rows: DataFrame, governance: DataFrame | None) -> DataFrame:
    if governance is None:
        return rows
    g = asset_governance(governance).select(
        F.col("database_name").alias("target_database"), F.col("schema_name").alias("target_schema"),
        F.col("table_name").alias("target_object"), "data_owner", "data_steward",
    )
    return rows.join(g, ["target_database", "target_schema", "target_object"], "left")


def impacted(edges: DataFrame | graph.EdgeTable, sources: DataFrame, max_hops: int = MAX_DISTANCE) -> DataFrame:
    """Affected nodes with their least hop, however many paths lead there."""
    s = sources.select(*NODE).distinct().withColumn("source_column", node(*[F.col(c) for c in NODE]))
    return graph.distances(edges, s, SOURCE, TARGET, NODE, ["source_column"], max_hops).filter("distance > 0")


def asset_governance(catalog: DataFrame) -> DataFrame:
    """One owner and one steward per object (the largest value, whichever column carries it)."""
    return catalog.groupBy("database_name", "schema_name", "table_name").agg(
        F.max("data_owner").alias("data_owner"), F.max("data_steward").alias("data_steward")
    )


def lineage_counts(snapshot: DataFrame, external: DataFrame, traced: DataFrame, impacts: DataFrame,
                   upstream_system: str, downstream_system: str, inputs: Sequence[Sequence[str]]) -> DataFrame:
    """Eight labelled counts; each relation is read once and its counters become rows afterwards."""
    c = F.col
    native = c("lineage_source") == NATIVE
    manual = c("registration_type") == "EXTERNAL_MANUAL"
    is_input = F.lit(False)
    for name in inputs:
        is_input = is_input | graph.same([c(f"source_{p}") for p in PARTS], [F.lit(x) for x in name])
    return R.union_all(
        [
            counters(snapshot, {
                "native_edges": native,
                "upstream_edges": native & (c("direction") == "UPSTREAM"),
                "downstream_edges": native & (c("direction") == "DOWNSTREAM"),
                "native_column_edges": native & (c("source_column").isNotNull() | c("target_column").isNotNull()),
            }),
            counters(external, {
                "external_upstream_edges": (c("source_system") == upstream_system) & manual,
                "external_downstream_edges": (c("target_system") == downstream_system) & manual,
            }),
            counters(traced, {"trace_raw_inputs": is_input}),
            counters(impacts, {"downstream_impacts": F.lit(True)}),
        ]
    )


def counters(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """(check_name, observed_count) rows from one aggregate."""
    row = df.agg(*[F.count_if(cond).alias(name) for name, cond in conditions.items()])
    pairs = [F.struct(F.lit(n).alias("check_name"), F.col(n).alias("observed_count")) for n in conditions]
    return row.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def edge_freshness(snapshot: DataFrame) -> DataFrame:
    return R.count_by(snapshot, "lineage_source", "direction", count="edge_count", latest="captured_at", latest_as="last_captured_at")


def touches(obj: tuple[str, str, str]) -> Column:
    """Predicate: the edge starts or ends at the object."""

    def side(s: str) -> Column:
        return (F.col(f"{s}_database") == obj[0]) & (F.col(f"{s}_schema") == obj[1]) & (F.col(f"{s}_object") == obj[2])

    return F.coalesce(side("source"), F.lit(False)) | F.coalesce(side("target"), F.lit(False))


def object_edges(snapshot: DataFrame, obj: tuple[str, str, str], native_only: bool = True) -> DataFrame:
    """Captured edges that touch an object, nearest first."""
    out = snapshot.filter(touches(obj))
    if native_only:
        out = out.filter(F.col("lineage_source") == NATIVE)
    return out


def column_edges(snapshot: DataFrame, obj: tuple[str, str, str]) -> DataFrame:
    """Captured edges into an object that name a column."""
    into = (
        (F.col("target_database") == obj[0]) & (F.col("target_schema") == obj[1]) & (F.col("target_object") == obj[2])
    )
    named = F.col("source_column").isNotNull() | F.col("target_column").isNotNull()
    return snapshot.filter((F.col("lineage_source") == NATIVE) & into & named)
