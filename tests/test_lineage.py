"""Graph operators against a brute-force walk on a small graph."""

import pytest

from custodia.operators import lineage as L

# Diamond, cycle, names that are prefixes of each other, a chain of seven, and a hub.
OBJECT_EDGES = [
    ("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "A"),
    ("N", "NA"), ("NA", "N1"), ("N1", "NA1"),
    *[(f"S{k}", f"S{k + 1}") for k in range(7)],
    *[("HUB", f"H{k}") for k in range(30)],
]
COLUMN_EDGES = [("A", "x", "B", "x"), ("B", "x", "D", "y"), ("D", "y", "E", "y"), ("D", "y", "A", "x")]


def edge(a, x, b, y):
    return ("D", "S", a, "TABLE", x, "D", "S", b, "TABLE", y)


@pytest.fixture
def edges(spark):
    rows = [edge(a, None, b, None) for a, b in OBJECT_EDGES] + [edge(*e) for e in COLUMN_EDGES]
    return spark.createDataFrame(rows + rows[:3], L.EDGE_SCHEMA)


ADJACENT = {}
for _a, _b in OBJECT_EDGES:
    ADJACENT.setdefault((_a, None), set()).add((_b, None))
for _a, _x, _b, _y in COLUMN_EDGES:
    ADJACENT.setdefault((_a, _x), set()).add((_b, _y))


def brute_distances(start, limit):
    seen, frontier = {start: 0}, {start}
    for d in range(1, limit + 1):
        frontier = {b for a in frontier for b in ADJACENT.get(a, ())} - set(seen)
        seen.update(dict.fromkeys(frontier, d))
    return seen


def brute_paths(start, limit=5):
    out, stack = set(), [(start,)]
    while stack:
        path = stack.pop()
        for b in ADJACENT.get(path[-1], ()):
            if b not in path and len(path) <= limit:
                out.add((*path, b))
                stack.append((*path, b))
    return out


def text(node):
    return "D.S." + ".".join(p for p in node if p)


@pytest.mark.parametrize("start", ["A", "N", "S0", "HUB", "NOWHERE"])
@pytest.mark.parametrize("limit", [1, 2, 5])
def test_reach_downstream(spark, edges, start, limit):
    got = {(r.source_object, r.target_object, r.distance) for r in L.reach(edges, L.anchors(spark, f"D.S.{start}"), "DOWNSTREAM", limit).collect()}
    near = brute_distances((start, None), limit - 1)
    assert got == {(a, b, d + 1) for (a, _), d in near.items() for (b, _) in ADJACENT.get((a, None), ())}


def test_reach_upstream_of_a_column(spark, edges):
    got = {(r.source_object, r.source_column, r.distance) for r in L.reach(edges, L.anchors(spark, "D.S.E.y"), "UPSTREAM").collect()}
    assert got == {("D", "y", 1), ("B", "x", 2), ("A", "x", 3), ("D", "y", 4)}


def test_many_anchors_are_kept_apart(spark, edges):
    starts = L.anchors(spark, "D.S.S0", "D.S.S5").withColumn("anchor", L.node("node_object"))
    got = {(r.anchor, r.target_object, r.distance) for r in L.reach(edges, starts, "DOWNSTREAM", 5, ["anchor"]).collect()}
    assert got == {("S0", f"S{k}", k) for k in range(1, 6)} | {("S5", "S6", 1), ("S5", "S7", 2)}


@pytest.mark.parametrize("start", ["N", "S0", "HUB"])
def test_impact_falls_back_to_the_object(spark, edges, start):
    got = L.impact(edges, L.anchors(spark, f"D.S.{start}.col")).collect()
    want = {(text(p[-1]), len(p) - 1) for p in brute_paths((start, None))}
    assert {(f"D.S.{r.target_object}", r.hop) for r in got} == want
    assert {r.impact_evidence_type for r in got} == {"OBJECT_LEVEL_FALLBACK"}


def test_impact_follows_columns_only_when_there_are_any(spark, edges):
    got = L.impact(edges, L.anchors(spark, "D.S.A.x")).collect()
    assert {r.path for r in got} == {" -> ".join(text(n) for n in p) for p in brute_paths(("A", "x"))}
    assert {r.impact_evidence_type for r in got} == {"COLUMN_LEVEL"}


def test_prefix_names_are_not_taken_for_visited(spark, edges):
    """N1 is a prefix of no visited node's name as a node, though it is as text."""
    got = {r.target_object: r.hop for r in L.impact(edges, L.anchors(spark, "D.S.N.c")).collect()}
    assert got == {"NA": 1, "N1": 2, "NA1": 3}


def test_impact_stops_after_five_hops(spark, edges):
    got = {r.target_object for r in L.impact(edges, L.anchors(spark, "D.S.S0.c")).collect()}
    assert got == {"S1", "S2", "S3", "S4", "S5"}


def test_impact_adds_one_owner_per_object(spark, edges):
    catalog = spark.createDataFrame(
        [("D", "S", "NA", "x", "Team A", None), ("D", "S", "NA", "y", "Team B", "Ann")],
        "database_name string, schema_name string, table_name string, column_name string, data_owner string, data_steward string")
    got = {r.target_object: (r.data_owner, r.data_steward) for r in L.impact(edges, L.anchors(spark, "D.S.N.c"), catalog).collect()}
    assert got == {"NA": ("Team B", "Ann"), "N1": (None, None), "NA1": (None, None)}


def test_impacted_gives_the_least_hop(spark, edges):
    got = {(r.node_object, r.distance) for r in L.impacted(edges, L.anchors(spark, "D.S.A")).collect()}
    assert got == {("B", 1), ("C", 1), ("D", 2)}


def test_closure_of_a_cycle_ends(spark, edges):
    got = L.reach(edges, L.anchors(spark, "D.S.A"), "DOWNSTREAM", 50)
    assert {r.target_object for r in got.collect()} == {"A", "B", "C", "D"}


def test_external_edges_are_registered_once(spark):
    schema = "source_system string, source_object string, source_column string, target_system string, target_object string, target_column string, relationship_type string, registration_type string, notes string"
    rows = spark.createDataFrame([("ETL", "job", None, "DW", "T", None, "UP", "EXTERNAL_MANUAL", "n1")], schema)
    once = L.register_external(spark.createDataFrame([], schema), rows)
    again = L.register_external(once, rows.replace("n1", "n2", "notes"))
    assert [r.notes for r in again.collect()] == ["n2"]


def test_trace_joins_captured_and_declared(spark, edges):
    snap = L.reach(edges, L.anchors(spark, "D.S.D.y"), "UPSTREAM").selectExpr("*", f"'{L.NATIVE}' as lineage_source")
    declared = L.declared_edges([("D.S.B.x", "D.S.D.y", "sum of x")], spark)
    got = L.trace(snap, declared, ("D", "S", "D", "y"), [("D", "S", "A", "x")])
    assert {(r.evidence_type, r.source_object, r.target_object) for r in got.collect()} == {
        (L.NATIVE, "B", "D"), (L.NATIVE, "A", "B"), (L.DECLARED, "B", "D")}
