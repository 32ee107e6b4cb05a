"""Connected components of a graph given as a table of links: tasks join the links they hold, large-star steps join what tasks know."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.llm.common import cut, release, runs

#: Links that a task joins at once, or somewhat more. A round has so many tasks that each is dealt about as many links, or one for each core.
AT_ONCE = 200_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it is connected with) of all nodes of some links but the smallest of each component."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    ends, low = place.reshape(2, -1), np.arange(len(nodes))
    while True:
        left, right = low[ends]
        if (left == right).all():
            break
        np.minimum.at(low, np.maximum(left, right), np.minimum(left, right))
        while ((further := low[low]) != low).any():
            low = further
    far = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[far], nodes[low[far]]


def _some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows, some at a time: no more once they are so many."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= AT_ONCE:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if size:
        yield pd.concat(held, ignore_index=True)


def _within_tasks(links: DataFrame, kind: str) -> DataFrame:
    """As many links at most that connect the same nodes: of those a task holds, each node has one."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in _some(batches):
            a, b = forest(some["a"].to_numpy(), some["b"].to_numpy())
            yield pd.DataFrame({"a": a, "b": b, "open": np.ones(len(a), bool)})

    return links.select("a", "b").mapInPandas(join, f"a {kind}, b {kind}, open boolean")


def _by_node(links: DataFrame, kind: str, parts: int) -> DataFrame:
    """The same where a task holds all links of a node to smaller ones. open: whether these links differ from those given, or any of these was open.

    The more links a task holds, the more it can join, so there are no more tasks than `parts`.
    """

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in _some(frame for frame, _ in runs(batches, ["a"])):
            ends = some["a"].to_numpy()
            a, b = forest(ends, some["b"].to_numpy())
            yield pd.DataFrame({"a": a, "b": b, "open": np.full(len(a), some["open"].any()) | ~np.isin(a, ends)})

    return links.repartition("a").coalesce(parts).sortWithinPartitions("a").mapInPandas(join, f"a {kind}, b {kind}, open boolean")


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours the smallest node it knows. Links run from the larger node to the smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "node")
    known = links.join(least, F.col("b") == F.col("node"), "left")
    return known.select("a", F.coalesce("low", "b").alias("b"), F.col("low").isNotNull().alias("open"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link: the component is its smallest node. links: columns a and b; order and repeats are free.

    First each task makes a forest of the links it reads, AT_ONCE at a time, so that a node has at most one link for each such lot, however many it
    had. Then rounds follow until nothing changes: a large-star step, a plain equi-join whose large partitions adaptive execution splits, and a
    forest of the links of the nodes that a task is dealt. Both leave no more links than they find and only lower their ends. Each round is written to
    the shared folder, and the round before deleted.
    """
    links = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    kind, before = links.schema["a"].dataType.simpleString(), cut(links)
    parts = max(links.sparkSession.sparkContext.defaultParallelism, before.count() // AT_ONCE + 1)
    links = cut(_by_node(_within_tasks(before, kind), kind, parts))
    release(before)
    while True:
        before, links = links, cut(_by_node(_large_star(links), kind, parts))
        release(before)
        if links.where("open").isEmpty():
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
