"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first, as many leaves wide as a calibrated recall needs."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custodia.llm.common import cut, release

#: Numbers (vectors times components) of the sample that the tree is fitted on, children of a node, sampled vectors of a leaf, Lloyd rounds.
SAMPLE, BRANCH, LEAF, ROUNDS = 1 << 22, 16, 256, 12
#: Queries that calibrate the search, and the share of their true neighbours that it must find.
CALIBRATION, RECALL = 200, 0.96
#: Rows and queries that meet in one cell at most (on average; rows are dealt evenly).
CELL_ROWS, CELL_QUERIES = 8192, 2048


@dataclass
class Tree:
    """centers[n] is the mean of node n, children[n] its child nodes (none: a leaf). Node 0 is the root."""

    centers: np.ndarray
    children: list[np.ndarray]
    rows: dict[int, int] = field(default_factory=dict)

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: from the root on, always the child with the nearest center."""
        out = np.zeros(len(vectors), np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, at = todo.pop()
            kids = self.children[node]
            if not len(kids):
                out[at] = node
                continue
            nearest = _squares(vectors[at], self.centers[kids]).argmin(1)
            todo += [(int(kid), at[nearest == k]) for k, kid in enumerate(kids) if (nearest == k).any()]
        return out

    def visits(self, distances: np.ndarray, leaves: int, rows: int) -> Iterator[int]:
        """Leaves in best-bin-first order, from a query's distances to all centers: the nearest open node is opened next.

        Ends after so many leaves that have rows, but not before these hold at least so many rows.
        """
        queue = [(float(distances[0]), 0)]
        seen = held = 0
        while queue and (seen < leaves or held < rows):
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            for kid in kids:
                heapq.heappush(queue, (float(distances[kid]), int(kid)))
            if not len(kids) and self.rows.get(node, 0):
                seen += 1
                held += self.rows[node]
                yield node


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all a to all b, by a matrix product: quick, but only nearly exact. Not finite counts as farthest."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.where(np.isnan(out), np.inf, out)


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; scaled where squares would overflow."""
    gap = vectors - query
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.sqrt((gap * gap).sum(1))
        wild = ~np.isfinite(out)
        if wild.any():
            half = vectors[wild] / 4 - query / 4
            most = np.abs(half).max(1)
            out[wild] = most * np.sqrt(((half / most[:, None]) ** 2).sum(1)) * 4
    return out


def fit(sample: np.ndarray, seed: int = 7) -> Tree:
    """Split the sample by k-means into BRANCH parts, and each part again, until parts have at most LEAF vectors or cannot be split."""
    draw = np.random.default_rng(seed)
    centers, children = [sample.mean(0) if len(sample) else np.zeros(sample.shape[1])], [np.empty(0, np.int64)]
    todo = [(0, np.arange(len(sample)))]
    while todo:
        node, at = todo.pop()
        if len(at) <= LEAF:
            continue
        own = sample[at]
        means = own[draw.permutation(len(own))[:BRANCH]]
        for _ in range(ROUNDS):
            part = _squares(own, means).argmin(1)
            size = np.bincount(part, minlength=len(means))
            total = np.zeros_like(means)
            np.add.at(total, part, own)
            means, before = total[size > 0] / size[size > 0, None], means
            if means.shape == before.shape and np.array_equal(means, before):
                break
        part = _squares(own, means).argmin(1)
        used = np.unique(part)
        if len(used) < 2:
            continue
        children[node] = np.arange(len(centers), len(centers) + len(used))
        for k, p in enumerate(used):
            centers.append(means[p])
            children.append(np.empty(0, np.int64))
            todo.append((int(children[node][k]), at[part == p]))
    return Tree(np.array(centers), children)


def usable(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """(vec_id, vector) as doubles of the rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    out = rows.select(F.col(f"`{id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    return out.where(F.col("vec_id").isNotNull() & F.exists("vector", lambda x: x != 0) & ~F.exists("vector", bad))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64) if len(column) else np.empty((0, 0))


def _best(query: int, vector: np.ndarray, near: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of some rows: places and exact distances, by distance and id, without the query's own row and repeated ids.

    near holds nearly exact squares. All rows that rounding could bring among the first are measured exactly.
    """
    own = ids == query
    near = np.where(own, np.inf, near)
    take = np.arange(len(ids))
    wanted = k
    while len(ids) > wanted:
        bound = np.partition(near, wanted - 1)[wanted - 1]
        if not np.isfinite(bound):
            break
        slack = 1e-9 * (bound + (vector * vector).sum())
        take = np.flatnonzero(near <= bound + slack)
        if len(np.unique(ids[take])) >= k:
            break
        take, wanted = np.arange(len(ids)), wanted * 4
    take = take[~own[take]]
    score = exact(vector, vectors[take])
    order = np.lexsort((ids[take], score))
    _, first = np.unique(ids[take][order], return_index=True)
    order = order[np.sort(first)][:k]
    return take[order], score[order]


def _sample(rows: DataFrame, total: int, most: int, salt: int) -> DataFrame:
    """About `most` rows, those with the least hashes of their id; never more than twice as many."""
    if total <= most:
        return rows
    bound = int(most / total * 2.0**63)
    return rows.where(F.xxhash64(F.lit(salt), "vec_id").bitwiseAND(F.lit(2**63 - 1)) < bound).limit(2 * most)


def true_neighbours(index: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score, leaf): the exact k nearest rows of a bounded set of queries, by a scan of all rows.

    Each task keeps k rows a query; they meet by query.
    """
    context = index.sparkSession.sparkContext
    shared = context.broadcast((ids, vectors))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = shared.value
        held: list[list[tuple]] = [[] for _ in ids]
        for batch in batches:
            if not len(batch):
                continue
            own, rows, leaves = batch["vec_id"].to_numpy(), _matrix(batch["vector"]), batch["leaf"].to_numpy()
            near = _squares(vectors, rows)
            for q in range(len(ids)):
                at, score = _best(ids[q], vectors[q], near[q], own, rows, k)
                merged = sorted(held[q] + [(s, int(own[a]), int(leaves[a])) for a, s in zip(at, score, strict=True)])
                first = {i: (s, i, leaf) for s, i, leaf in reversed(merged)}
                held[q] = sorted(first.values())[:k]
        records = [(int(ids[q]), i, s, leaf) for q in range(len(ids)) for s, i, leaf in held[q]]
        if records:
            yield pd.DataFrame(records, columns=["query_id", "vec_id", "score", "leaf"])

    return _ranked(index.mapInPandas(run, "query_id bigint, vec_id bigint, score double, leaf bigint"), k, "leaf")


def _ranked(hits: DataFrame, k: int, *carry: str) -> DataFrame:
    """The k best hits of each query with their rank; repeated ids count once."""
    once = hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), *[F.min_by(c, "score").alias(c) for c in carry])
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *carry)


def calibrated(tree: Tree, ids: np.ndarray, vectors: np.ndarray, truth: list[tuple[int, int]], k: int, recall: float) -> tuple[int, float]:
    """(leaves, recall): how many leaves a search must visit so that it finds that share of the true neighbours of the calibrating queries.

    truth: (query, leaf of a true neighbour). The number of leaves is widened from one on, by doubling and then by bisection; a query's leaf
    order does not depend on it, so a neighbour is found once its leaf's place in that order is reached.
    """
    by_query: dict[int, list[int]] = {}
    for query, leaf in truth:
        by_query.setdefault(query, []).append(leaf)
    places: list[int] = []
    centers = np.sqrt(np.maximum(_squares(vectors, tree.centers), 0))
    for q, query in enumerate(ids):
        wanted = by_query.get(int(query), [])
        missing = set(wanted)
        place: dict[int, int] = {}
        for n, leaf in enumerate(tree.visits(centers[q], len(tree.children), 0), 1):
            place[leaf] = n
            missing.discard(leaf)
            if not missing:
                break
        places += [place[leaf] for leaf in wanted]
    if not places:
        return 1, 1.0
    found = lambda leaves: float((np.array(places) <= leaves).mean())
    high = 1
    while found(high) < recall:
        high *= 2
    low = high // 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if found(middle) >= recall else (middle, high)
    return high, found(high)


def nearest(rows: DataFrame, k: int = 10, every: int = 100, id: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found of every row whose id is divisible by `every`, nearest first.

    Score is the Euclidean distance in double precision on the vectors as given; ties go to the smaller id. A query's own id is no candidate.
    With at most k candidates all of them come.

    Rows with a null id, and vectors that are null, empty, zero or hold a null, NaN or infinite component, take no part; nor do vectors of
    another length than the most frequent (the shortest of equally frequent ones). Of rows that share an id the least vector is the query,
    and of its hits with one id the nearest counts. An empty table gives no row. Other columns are not read.

    The tree is fitted on a sample of at most 2 * SAMPLE numbers (twice 65,536 vectors of 64); every row is assigned to a leaf. A bounded set of
    queries (CALIBRATION) is answered exactly by a scan of all rows; the search visits as many leaves as find the share `recall` of
    these answers. Then rows and queries meet by leaf. A leaf with many rows or many queries, such as one vector repeated in a third of all
    rows, is dealt into cells of about CELL_ROWS rows and CELL_QUERIES queries, in which all are compared; nothing is left out. Tables by
    leaf are as long as the tree, so they have a bound.
    """
    spark = rows.sparkSession
    clean = usable(rows, id, vector)
    lengths = clean.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    hits = "query_id bigint, vec_id bigint, score double"
    if not lengths:
        return _ranked(spark.createDataFrame([], hits), k)
    size, total = lengths[0]["size"], lengths[0]["n"]
    clean = clean.where(F.size("vector") == size)
    tree = fit(_matrix(_sample(clean, total, max(1, SAMPLE // size), 1).select("vector").toPandas()["vector"]))
    shared = spark.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(leaf=shared.value.leaves_of(_matrix(batch["vector"])))

    index = cut(clean.mapInPandas(assign, "vec_id bigint, vector array<double>, leaf bigint"))
    tree.rows = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # no longer than the tree
    queries = cut(index.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector")))
    asked = queries.count()
    chosen = _sample(queries.withColumnRenamed("query_id", "vec_id"), asked, CALIBRATION, 2).toPandas()
    ids, vectors = chosen["vec_id"].to_numpy(np.int64), _matrix(chosen["vector"])
    leaves = 1
    if len(ids):
        truth = [(r["query_id"], r["leaf"]) for r in true_neighbours(index, ids, vectors, k).collect()]  # k rows a calibrating query
        leaves, _ = calibrated(tree, ids, vectors, truth, k, recall)
    shared.unpersist()
    searched = spark.sparkContext.broadcast(tree)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = searched.value
        for batch in batches:
            for begin in range(0, len(batch), 256):
                part = batch.iloc[begin : begin + 256]
                distances = np.sqrt(np.maximum(_squares(_matrix(part["vector"]), tree.centers), 0))
                found = [(q, leaf) for q in range(len(part)) for leaf in tree.visits(distances[q], leaves, k + 1)]
                at = part.iloc[[q for q, _ in found]]
                yield at.assign(leaf=[leaf for _, leaf in found])

    visits = cut(queries.mapInPandas(visit, "query_id bigint, vector array<double>, leaf bigint"))
    asked_of = visits.groupBy("leaf").agg(F.count(F.lit(1)).alias("asked")).collect()  # no longer than the tree
    release(queries)
    if not asked_of:
        return _ranked(spark.createDataFrame([], hits), k)
    plan = [(r["leaf"], max(1, -(-tree.rows[r["leaf"]] // CELL_ROWS)), max(1, -(-r["asked"] // CELL_QUERIES))) for r in asked_of]
    cells = F.broadcast(spark.createDataFrame(plan, "leaf bigint, row_cells bigint, query_cells bigint"))  # no longer than the tree

    def dealt(n: str) -> Column:
        return F.pmod(F.monotonically_increasing_id(), F.col(n))

    def copied(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    right = index.join(cells, "leaf").withColumn("a", dealt("row_cells")).withColumn("b", copied("query_cells")).select("leaf", "a", "b", "vec_id", "vector")
    left = visits.join(cells, "leaf").withColumn("b", dealt("query_cells")).withColumn("a", copied("row_cells")).select("leaf", "a", "b", "query_id", "vector")

    def compare(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        ids, vectors = rows["vec_id"].to_numpy(), _matrix(rows["vector"])
        asked, points = queries["query_id"].to_numpy(), _matrix(queries["vector"])
        places, scores = [], []
        for begin in range(0, len(asked), 256):
            near = _squares(points[begin : begin + 256], vectors)
            for q in range(len(near)):
                at, score = _best(asked[begin + q], points[begin + q], near[q], ids, vectors, k)
                places.append(at)
                scores.append(score)
        return pd.DataFrame({"query_id": np.repeat(asked, [len(at) for at in places]), "vec_id": ids[np.concatenate(places)], "score": np.concatenate(scores)})

    keys = ["leaf", "a", "b"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, hits)
    return _ranked(found, k)


def recall_of(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true neighbours that were found."""
    pairs = truth.select("query_id", "vec_id")
    return pairs.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count() / max(1, pairs.count())
