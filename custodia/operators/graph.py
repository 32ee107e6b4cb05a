"""Reachability over an edge relation, shared by lineage, roles and tag propagation.

The edges are stored once, bucketed and sorted by the node they leave. A hop joins the
nodes found last with that table: the nodes are dealt to its buckets, or broadcast where
they are few by their measured size, and the edges stay where they are. The nodes found so
far are stored bucketed too, so telling old from new moves only what a hop has reached.
A node with very many edges is spread over several buckets by the other end of each edge;
such hubs are so few, whatever the graph, that the list of them is a bounded broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from custodia.session import scratch_path

#: A node is a hub if its edges are more than this share of a bucket; so there are at most 4 hubs a bucket.
HUB_SHARE = 0.25
#: Tables of found nodes that are compared one by one before they are written as one.
MOST_TABLES = 8
KEY, BUCKET, STATE = "__key", "__bucket", "__state"


def same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Pairwise equality in which NULL equals NULL; still a hash-joinable condition."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right, strict=True)])


def alike(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """The same as a condition that is no join key: a join that also has a bucket key is then dealt by that key alone."""
    return reduce(lambda a, b: a + b, [x.eqNullSafe(y).cast("int") for x, y in zip(left, right, strict=True)]) == len(left)


def bucketed(df: DataFrame, key: str, buckets: int, distinct: bool = False) -> tuple[DataFrame, int]:
    """``df`` (its distinct rows) stored with one sorted file per bucket of ``key``, and its number of rows.

    The files lie in the shared scratch folder; the session's catalog holds the bucketing.
    """
    spark = df.sparkSession
    name = f"custodia_{uuid.uuid4().hex}"
    seen = Observation()
    dealt = df.repartition(buckets, key)
    if distinct:  # equal rows lie in one bucket, so they do not move again
        dealt = dealt.distinct()
    dealt = dealt.observe(seen, F.count(F.lit(1)).alias("rows"))
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", scratch_path(spark, name)).format("parquet").saveAsTable(name)
    return spark.table(name), seen.get["rows"]


def default_buckets(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@dataclass(frozen=True)
class EdgeTable:
    """Edges stored by the node they leave (``near``); ``hubs`` lists nodes that are spread over several buckets."""

    rows: DataFrame
    near: tuple[str, ...]
    far: tuple[str, ...]
    buckets: int
    hubs: DataFrame | None

    def frontier(self, nodes: DataFrame, columns: Sequence[str]) -> DataFrame:
        """``nodes`` with the bucket of their edges, a row for each bucket that holds some."""
        keyed = nodes.withColumn(KEY, F.xxhash64(*columns))
        if self.hubs is None:
            return keyed.withColumn(BUCKET, F.xxhash64(F.col(KEY), F.lit(0).cast("long"))).drop(KEY)
        keyed = keyed.join(F.broadcast(self.hubs), KEY, "left")
        slot = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__slots", F.lit(1)) - 1))
        return keyed.withColumn("__slot", slot).withColumn(BUCKET, F.xxhash64(KEY, "__slot")).drop(KEY, "__slots", "__slot")

    def leaving(self, nodes: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Join of nodes (alias ``n``) with the edges that leave them (alias ``e``)."""
        n, e = self.frontier(nodes, columns).alias("n"), self.rows.alias("e")
        on = (F.col(f"n.{BUCKET}") == F.col(f"e.{BUCKET}")) & alike([F.col(f"n.{c}") for c in columns], [F.col(f"e.{c}") for c in self.near])
        return n.join(e, on)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c != BUCKET]


def store_edges(edges: DataFrame, near: Sequence[str], far: Sequence[str], buckets: int | None = None, distinct: bool = False) -> EdgeTable:
    """Store an edge relation, or its distinct edges, by the node its edges leave. It moves here, once, and in no hop."""
    spark = edges.sparkSession
    buckets = buckets or default_buckets(spark)
    keyed = edges.withColumn(KEY, F.xxhash64(*near))
    seen = Observation()
    degrees = keyed.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).observe(seen, F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))
    most = int(buckets / HUB_SHARE)
    top = degrees.orderBy(F.desc("n")).limit(most).collect()  # more nodes than these cannot be hubs
    limit = max(1, int(HUB_SHARE * seen.get["edges"] / buckets))
    large = [(r[KEY], -(-r["n"] // limit)) for r in top if r["n"] > limit]
    hubs, slot = None, F.lit(0).cast("long")
    if large:
        hubs = spark.createDataFrame(large, f"{KEY} bigint, __slots bigint")
        keyed = keyed.join(F.broadcast(hubs), KEY, "left")
        slot = F.pmod(F.xxhash64(F.lit(1), *far), F.coalesce("__slots", F.lit(1)))
    placed = keyed.withColumn(BUCKET, F.xxhash64(F.col(KEY), slot)).drop(KEY, "__slots")
    return EdgeTable(bucketed(placed, BUCKET, buckets, distinct)[0], tuple(near), tuple(far), buckets, hubs)


def as_table(edges: DataFrame | EdgeTable, near: Sequence[str], far: Sequence[str]) -> EdgeTable:
    if isinstance(edges, EdgeTable):
        if edges.near != tuple(near):
            raise ValueError(f"edges are stored by {edges.near}, not by {tuple(near)}")
        return edges
    return store_edges(edges, near, far)


def distances(
    edges: DataFrame | EdgeTable,
    seeds: DataFrame,
    near: Sequence[str],
    far: Sequence[str],
    nodes: Sequence[str],
    carry: Sequence[str] = (),
    max_distance: int | None = None,
) -> DataFrame:
    """Nodes reachable from the seeds with their least distance; seeds have distance 0.

    ``near``/``far`` are the edge's columns of the side we come from and go to, ``nodes``
    the node columns of ``seeds``; ``carry`` are further seed columns (an anchor, a tag)
    for which reachability is kept apart. Without ``max_distance`` the loop ends when a
    hop finds nothing new. Every node is expanded once for each carry; each hop is
    written, so a lost executor costs one hop. A node that most carries reach is a key of
    many frontier rows, which its buckets take in a streamed join.
    """
    carry, nodes = list(carry), list(nodes)
    key = [*carry, *nodes]
    if max_distance == 0:
        return seeds.select(*key).distinct().withColumn("distance", F.lit(0))
    table = as_table(edges, near, far)
    columns = [*key, "distance"]
    state = F.xxhash64(*key)
    first, rows = bucketed(seeds.select(*key).distinct().withColumn("distance", F.lit(0)).withColumn(STATE, state), STATE, table.buckets)
    found, frontier, hop = [first], first, 0
    while rows and (max_distance is None or hop < max_distance):
        hop += 1
        fresh = hop_nodes(table, frontier.select(*key), nodes, carry, found).withColumn("distance", F.lit(hop))
        frontier, rows = bucketed(fresh, STATE, table.buckets)
        if rows:
            found.append(frontier)
        if len(found) > MOST_TABLES:
            found = [bucketed(reduce(DataFrame.unionByName, found), STATE, table.buckets)[0]]
    return reduce(DataFrame.unionByName, [f.select(*columns) for f in found])


def hop_nodes(table: EdgeTable, frontier: DataFrame, nodes: Sequence[str], carry: Sequence[str], found: Sequence[DataFrame]) -> DataFrame:
    """Nodes one hop from the frontier that are in none of the found tables, with their state key."""
    key = [*carry, *nodes]
    reached = (
        table.leaving(frontier, nodes)
        .select(*[F.col(f"n.{c}") for c in carry], *[F.col(f"e.{f}").alias(n) for f, n in zip(table.far, nodes, strict=True)])
        .withColumn(STATE, F.xxhash64(*key))
        .repartition(table.buckets, STATE)
        .dropDuplicates([STATE, *key])
    )
    for old in found:
        r, k = reached.alias("r"), old.select(STATE, *key).alias("k")
        on = (F.col(f"r.{STATE}") == F.col(f"k.{STATE}")) & alike([F.col(f"r.{c}") for c in key], [F.col(f"k.{c}") for c in key])
        reached = r.join(k, on, "left_anti")
    return reached
