"""A lineage snapshot that is refreshed by what changed in the edges, not by walking them again.

For every anchor, node and hop the state holds how many walks of that many edges lead from
the anchor to the node. These counts are sums of products of edges, so a change of the edges
changes them by a sum that can be followed hop by hop from the changed edges on: a walk over
a changed edge starts where the old state has the edge's near node, and goes on over the new
edges. A node whose last walk is gone is no longer reached, on cycles too, because walks are
counted hop by hop up to a greatest distance. Anchors that reach no changed edge take part
in no join beyond the first lookup of the changed edges' near nodes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.operators import graph
from custodia.operators import lineage as L
from custodia.session import cut

WALKS = "decimal(38,0)"
HASH = "__hash"


@dataclass(frozen=True)
class Closure:
    """Edges within a distance of many anchors (``snapshot``), and what a refresh needs.

    ``edges`` is the stored table as of the first build, ``delta`` what changed since then
    (an edge and +1 or -1). ``state`` has the walks per anchor, node and hop, ``touched``
    the anchors and nodes that the last refresh looked at.
    """

    edges: graph.EdgeTable
    delta: DataFrame | None
    state: DataFrame
    snapshot: DataFrame
    touched: DataFrame | None
    direction: str
    carry: tuple[str, ...]
    max_distance: int

    @property
    def key(self) -> list[str]:
        return [*self.carry, *L.NODE]


def build(edges: DataFrame, start: DataFrame, direction: str, carry: Sequence[str], max_distance: int = L.MAX_DISTANCE) -> Closure:
    """The closure of the anchors in ``start`` (node columns and ``carry``), from the edges as they are. Repeated edges count once."""
    columns = edges.columns
    near, far = L.ends(direction)
    table = graph.store_edges(edges, near, far, distinct=True)
    key = [*carry, *L.NODE]
    level = cut(start.select(*key).distinct().withColumns({"hop": F.lit(0), "walks": F.lit(1).cast(WALKS)}))
    levels = [level]
    for hop in range(1, max_distance):
        level = cut(_add_up(_onward(table, None, level, carry, key), key, hop))
        levels.append(level)
    state = reduce(DataFrame.unionByName, levels)
    closure = Closure(table, None, state, state, None, direction, tuple(carry), max_distance)
    return replace(closure, snapshot=cut(_edges_of(closure, state, columns)))


def refresh(closure: Closure, added: DataFrame, removed: DataFrame) -> Closure:
    """The closure after edges came and went.

    An added edge that is there already and a removed one that is not change nothing; an edge
    that is both added and removed is there afterwards. Only the changed edges, the state rows
    at their near nodes and what is reached from there on is expanded.
    """
    columns = closure.edges.columns
    change = cut(_effective(closure, added.select(*columns), removed.select(*columns)))
    delta = change if closure.delta is None else _signed(closure.delta.unionByName(change), columns)
    near = list(closure.edges.near)
    old = closure.state
    n, d = old.withColumn(HASH, F.xxhash64(*L.NODE)).alias("n"), change.withColumn(HASH, F.xxhash64(*near)).alias("d")
    met = cut(  # old walks that lead to the near node of a changed edge
        n.join(d, _at(near)).select(*[F.col(f"n.{c}") for c in [*closure.key, "hop", "walks"]], F.col("d.sign"),
                                    *[F.col(f"d.{f}").alias(f"far_{c}") for f, c in zip(closure.edges.far, L.NODE, strict=True)])
    )
    changes: list[DataFrame] = []
    for hop in range(1, closure.max_distance):
        by_edge = met.where(F.col("hop") == hop - 1).select(
            *closure.carry, *[F.col(f"far_{c}").alias(c) for c in L.NODE], (F.col("walks") * F.col("sign")).cast(WALKS).alias("walks"))
        if changes:
            by_edge = by_edge.unionByName(_onward(closure.edges, delta, changes[-1], closure.carry, closure.key))
        changes.append(cut(_add_up(by_edge, closure.key, hop).where("walks <> 0")))
    moved = reduce(DataFrame.unionByName, changes) if changes else old.limit(0)
    touched = cut(moved.select(*closure.key).unionByName(met.select(*closure.key)).distinct())
    state = cut(old.unionByName(moved).groupBy(*closure.key, "hop").agg(F.sum("walks").cast(WALKS).alias("walks")).where("walks > 0"))
    after = replace(closure, delta=cut(delta), state=state, touched=touched)
    s, t = closure.snapshot.alias("s"), touched.alias("t")
    there = graph.same([F.col(f"s.{c}") for c in [*closure.carry, *near]], [F.col(f"t.{c}") for c in closure.key])
    kept = s.join(t, there, "left_anti").select("s.*")
    s, t = state.alias("s"), touched.alias("t")
    again = s.join(t, graph.same([F.col(f"s.{c}") for c in closure.key], [F.col(f"t.{c}") for c in closure.key]), "left_semi").select("s.*")
    return replace(after, snapshot=cut(kept.unionByName(_edges_of(after, again, columns))))


def _at(near: Sequence[str]) -> Column:
    """Join of nodes ``n`` with changed edges ``d`` on the edge's near node."""
    return (F.col(f"n.{HASH}") == F.col(f"d.{HASH}")) & graph.alike([F.col(f"n.{c}") for c in L.NODE], [F.col(f"d.{c}") for c in near])


def _onward(table: graph.EdgeTable, delta: DataFrame | None, level: DataFrame, carry: Sequence[str], key: Sequence[str]) -> DataFrame:
    """The walks of a level, one edge longer, over the stored edges and what changed in them."""
    far = list(zip(table.far, L.NODE, strict=True))
    out = table.leaving(level, L.NODE).select(*[F.col(f"n.{c}") for c in carry], *[F.col(f"e.{f}").alias(c) for f, c in far], "n.walks")
    if delta is None:
        return out
    n, d = level.withColumn(HASH, F.xxhash64(*L.NODE)).alias("n"), delta.withColumn(HASH, F.xxhash64(*table.near)).alias("d")
    return out.unionByName(
        n.join(d, _at(table.near)).select(
            *[F.col(f"n.{c}") for c in carry], *[F.col(f"d.{f}").alias(c) for f, c in far], (F.col("n.walks") * F.col("d.sign")).cast(WALKS).alias("walks"))
    )


def _add_up(walks: DataFrame, key: Sequence[str], hop: int) -> DataFrame:
    return walks.groupBy(*key).agg(F.sum("walks").cast(WALKS).alias("walks")).withColumn("hop", F.lit(hop)).select(*key, "hop", "walks")


def _signed(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.groupBy(*columns).agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")


def _effective(closure: Closure, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The changes that change something, as (edge, sign): what the edges are at now is looked up at the changed edges' near nodes only."""
    columns = closure.edges.columns
    asked = added.withColumn("wanted", F.lit(1)).unionByName(removed.withColumn("wanted", F.lit(0)))
    asked = cut(asked.groupBy(*columns).agg(F.max("wanted").alias("wanted")))
    near = asked.select(*[F.col(c).alias(n) for c, n in zip(closure.edges.near, L.NODE, strict=True)]).distinct()
    here = closure.edges.leaving(near, L.NODE).select(*[F.col(f"e.{c}") for c in columns], F.lit(1).alias("sign"))
    if closure.delta is not None:
        here = _signed(here.unionByName(closure.delta), columns).where("sign > 0")
    merged = asked.select(*columns, "wanted", F.lit(0).alias("there")).unionByName(
        here.select(*columns, F.lit(None).cast("int").alias("wanted"), F.lit(1).alias("there")))
    merged = merged.groupBy(*columns).agg(F.max("wanted").alias("wanted"), F.max("there").alias("there"))
    return merged.where("wanted <> there").select(*columns, (F.col("wanted") - F.col("there")).alias("sign"))


def _edges_of(closure: Closure, state: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The edges that leave the nodes of some state rows, with their distance from the anchor."""
    nearest = state.groupBy(*closure.key).agg((F.min("hop") + 1).alias("distance"))
    out = closure.edges.leaving(nearest, L.NODE).select(*[F.col(f"n.{c}") for c in closure.carry], *[F.col(f"e.{c}") for c in columns], "n.distance", F.lit(1).alias("sign"))
    if closure.delta is not None:
        near = closure.edges.near
        n, d = nearest.withColumn(HASH, F.xxhash64(*L.NODE)).alias("n"), closure.delta.withColumn(HASH, F.xxhash64(*near)).alias("d")
        later = n.join(d, _at(near)).select(*[F.col(f"n.{c}") for c in closure.carry], *[F.col(f"d.{c}") for c in columns], "n.distance", "d.sign")
        out = _signed(out.unionByName(later), [*closure.carry, *columns, "distance"]).where("sign > 0")
    return out.select(*closure.carry, *columns, F.lit(closure.direction).alias("direction"), "distance")
