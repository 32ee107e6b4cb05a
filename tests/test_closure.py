"""Refresh by difference against a closure built anew, level counts against listed paths, and the plans of hops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from custodia.operators import closure as K
from custodia.operators import graph
from custodia.operators import lineage as L


def edge(a, b):
    return ("D", "S", a, "TABLE", None, "D", "S", b, "TABLE", None)


def frame(spark, pairs):
    return spark.createDataFrame([edge(*p) for p in pairs], L.EDGE_SCHEMA)


def snapshot(closure):
    got = [(r.anchor, r.source_object, r.target_object, r.distance) for r in closure.snapshot.collect()]
    assert len(got) == len(set(got))
    return set(got)


def brute(pairs, anchors, limit):
    out, step = set(), {}
    for a, b in pairs:
        step.setdefault(a, set()).add(b)
    for anchor in anchors:
        seen, frontier = {anchor: 0}, {anchor}
        for d in range(1, limit):
            frontier = {b for a in frontier for b in step.get(a, ())} - set(seen)
            seen.update(dict.fromkeys(frontier, d))
        out |= {(anchor, a, b, d + 1) for a, d in seen.items() for b in step.get(a, ())}
    return out


def starts(spark, names):
    return L.anchors(spark, *[f"D.S.{n}" for n in names]).withColumn("anchor", F.col("node_object"))


def test_refresh_equals_a_new_build(spark):
    """Two rounds on a graph with cycles, of edges that come, go, come twice, were there already or never were."""
    draw = random.Random(4)
    nodes = [f"N{k}" for k in range(14)]
    pairs = {(draw.choice(nodes), draw.choice(nodes)) for _ in range(26)}
    anchors = nodes[:3]
    closure = K.build(frame(spark, [*pairs, *list(pairs)[:4]]), starts(spark, anchors), "DOWNSTREAM", ["anchor"], 4)
    assert snapshot(closure) == brute(pairs, anchors, 4)
    for _ in range(2):
        came = {(draw.choice(nodes), draw.choice(nodes)) for _ in range(3)} | {next(iter(pairs))}
        went = set(draw.sample(sorted(pairs), 3)) | {("N0", "NOWHERE")}
        closure = K.refresh(closure, frame(spark, [*came, *came]), frame(spark, went))
        pairs = (pairs - went) | came
        assert snapshot(closure) == brute(pairs, anchors, 4)


def test_untouched_anchors_are_not_expanded(spark):
    pairs = {(f"{s}{k}", f"{s}{k + 1}") for s in "ABC" for k in range(6)}
    closure = K.build(frame(spark, pairs), starts(spark, ["A0", "B0", "C0"]), "DOWNSTREAM", ["anchor"])
    after = K.refresh(closure, frame(spark, [("A2", "X")]), frame(spark, [("A3", "A4"), ("B6", "B7")]))
    assert {(r.anchor, r.node_object) for r in after.touched.collect()} == {("A0", "A2"), ("A0", "A3"), ("A0", "A4"), ("A0", "X")}
    assert snapshot(after) == brute((pairs | {("A2", "X")}) - {("A3", "A4")}, ["A0", "B0", "C0"], 5)


def test_upstream_closure_and_empty_changes(spark):
    pairs = {("A", "B"), ("B", "C"), ("X", "C")}
    closure = K.build(frame(spark, pairs), starts(spark, ["C"]), "UPSTREAM", ["anchor"])
    none = frame(spark, pairs).limit(0)
    assert snapshot(K.refresh(closure, none, none)) == {("C", "B", "C", 1), ("C", "X", "C", 1), ("C", "A", "B", 2)}
    assert K.refresh(closure, none, none).touched.count() == 0


@pytest.fixture
def dense(spark):
    """A layered graph with 5 * 6 * 6 * 6 paths, and a node met at two hops."""
    layers = [["S"], *[[f"L{d}{k}" for k in range(6)] for d in range(4)]]
    pairs = [(a, b) for one, two in zip(layers, layers[1:], strict=False) for a in one for b in two if (a, b) != ("S", "L05")]
    return frame(spark, [*pairs, ("S", "L10")])


def test_levels_count_the_listed_paths(spark, dense):
    levels = L.impact_levels(dense, L.anchors(spark, "D.S.S.col"))
    got = {(r.target_object, r.hop, r.impact_evidence_type): int(r.n_paths) for r in levels.collect()}
    listed = Counter((r.target_object, r.hop, r.impact_evidence_type) for r in L.impact(dense, L.anchors(spark, "D.S.S.col")).collect())
    assert got == dict(listed) and max(got.values()) == 180 and len(got) < 40


def test_drawn_paths_are_listed_paths(spark, dense):
    source = L.anchors(spark, "D.S.S.col")
    levels = L.impact_levels(dense, source)
    listed = {(r.target_object, r.hop, r.path) for r in L.impact(dense, source).collect()}
    drawn = {(r.target_object, r.hop, r.path) for r in L.draw_paths(dense, levels, levels).collect()}
    assert drawn <= listed and len(drawn) == levels.count()


def test_paths_are_drawn_over_the_edges_that_levels_walked(spark, dense, rows):
    """The table stored by the node its edges leave serves both, so edges are dealt to buckets once."""
    table = L.impact_edges(dense.unionByName(dense))
    levels = L.impact_levels(table, L.anchors(spark, "D.S.S.col"))
    assert rows(L.draw_paths(table, levels, levels)) == rows(L.draw_paths(dense, levels, levels))


def test_repeated_edges_are_stored_once(spark):
    """Also where a hub is spread over buckets: equal edges meet in the shuffle that deals them."""
    pairs = [("HUB", f"H{k}") for k in range(300)] + [(f"A{k}", None) for k in range(20)]
    table = graph.store_edges(frame(spark, pairs * 3), L.SOURCE, L.TARGET, 4, distinct=True)
    assert table.hubs is not None and table.rows.count() == 320 and table.rows.select(*table.columns).distinct().count() == 320


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_hops_do_not_move_the_edges(spark, capsys, threshold):
    """At any size of the frontier: dealt to the buckets where it is large, broadcast where it is small."""
    pairs = [(f"A{k % 50}", f"B{k}") for k in range(400)] + [("HUB", f"H{k}") for k in range(300)]
    table = L.stored(frame(spark, pairs), "DOWNSTREAM")
    assert table.hubs.count() >= 1
    nodes = starts(spark, [f"A{k}" for k in range(50)] + ["HUB"])
    found, _ = graph.bucketed(nodes.withColumn(graph.STATE, F.xxhash64("anchor", *L.NODE)), graph.STATE, table.buckets)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        reached = graph.hop_nodes(table, nodes, L.NODE, ["anchor"], [found])
        capsys.readouterr()
        reached.explain()
        lines = capsys.readouterr().out.splitlines()
        assert reached.count() == 700
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scans = [k for k, line in enumerate(lines) if "FileScan parquet spark_catalog" in line]
    assert len(scans) == 2
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for at in scans:  # climb from the scan to the join above it
        above, k = depth(lines[at]), at
        while "Join" not in lines[k]:
            k -= 1
            if depth(lines[k]) < above:
                above = depth(lines[k])
                assert "Exchange hash" not in lines[k] and "Exchange Round" not in lines[k], lines[k]


def test_hub_is_spread_over_buckets(spark):
    table = L.stored(frame(spark, [("HUB", f"H{k}") for k in range(1000)] + [("A", "B")]), "DOWNSTREAM")
    places = table.rows.where("source_object = 'HUB'").select(graph.BUCKET).distinct().count()
    assert places >= 4
    assert {r.target_object for r in L.reach(table, L.anchors(spark, "D.S.HUB"), "DOWNSTREAM", 1).collect()} == {f"H{k}" for k in range(1000)}
    with pytest.raises(ValueError):
        L.reach(table, L.anchors(spark, "D.S.HUB"), "UPSTREAM")
