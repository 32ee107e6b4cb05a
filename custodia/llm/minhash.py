"""Near-duplicate groups by min-max hashing: banded signatures propose, exact shingle sets confirm.

1. One pass over the texts gives each its shingle count, a digest of its shingle set and its band keys.
2. Equal sets are one class, known by a 64-bit number of one of its rows, so exact copies cost one row from here on, whatever the ids are.
3. Classes that meet in a band are chained to the band's smallest class; the components of these unconfirmed chains are candidate
   groups. Every pair that any band proposes lies within one group.
4. Groups are dealt into cells of a bounded number of documents and shingles, each with the group's pivot block beside it. A cell compares
   all its full sets at once and returns at most one link for each document, never the pairs.
5. In a group of more than one block, what is not yet in the group's largest component meets all blocks of the group, again in cells.
   So every pair of a group is compared unless both are already known to be connected.
6. The components of the confirmed links are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.llm.common import cut, release, runs
from custodia.llm.components import components
from custodia.llm.shingles import MinMaxHash, banding, overlaps, shingle_sets


#: log2 of the bits of the largest table that tells wanted ids from others, bits of one row of such a table, and bits for each id.
TABLE_BITS, ROW_BITS, BITS_EACH = 28, 15, 16
#: Documents in a block, and shingles in it on average, at most. A cell holds two blocks.
BLOCK, BLOCK_SHINGLES = 512, 32_768


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def lots(texts: list[str | None], most: int = 500, characters: int = 1_000_000) -> Iterator[list[str | None]]:
    """The texts, some at a time: so many at most, and no more once they have so many characters."""
    lot, size = [], 0
    for text in texts:
        lot.append(text)
        size += len(text or "")
        if len(lot) == most or size >= characters:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


def features(rows: DataFrame, size: int, hasher: MinMaxHash) -> DataFrame:
    """(id, n_shingles, digest, bands) of each (id, text); texts without words have no digest and no bands."""

    def sketch(texts: pd.Series) -> pd.DataFrame:
        parts = []
        for some in lots(texts.tolist()):
            flat, sizes = shingle_sets(some, size)
            keys, ends = iter(hasher.band_keys(flat, sizes[sizes > 0])), np.cumsum(sizes)
            digests = [_digest(flat[end - n : end]) if n else None for end, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            parts.append(pd.DataFrame({"n_shingles": sizes, "digest": digests, "bands": [next(keys) if n else None for n in sizes]}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"n_shingles": [], "digest": [], "bands": []})

    sketched = F.pandas_udf(sketch, "n_shingles bigint, digest binary, bands array<bigint>").asNondeterministic()
    return rows.select("id", sketched("text").alias("s")).select("id", "s.*")


def _linked(inter: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (left[:, None] + right[None, :] - inter)


def _labels(link: np.ndarray) -> np.ndarray:
    """For each document of a cell, the first document it is connected with."""
    labels = np.arange(len(link))
    while True:
        low = np.where(link, labels[None, :], len(link)).min(axis=1)
        low = low[low]
        if (low == labels).all():
            return labels
        labels = low


def _some_cells(texts: list[str | None], starts: list[int], characters: int = 1_000_000) -> Iterator[list[int]]:
    """Where cells begin and the last ends, some cells at a time: no more once they have so many characters."""
    some, size = starts[:1], 0
    for begin, end in zip(starts[:-1], starts[1:], strict=True):
        some.append(end)
        size += sum(len(t or "") for t in texts[begin:end])
        if size >= characters:
            yield some
            some, size = [end], 0
    if len(some) > 1:
        yield some


def _confirm(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) of nodes found within the cells (gid, cell, side, node, root, digest, text). With both sides present, side 0 meets side 1 only.

    A text whose set is not the one of its digest belongs to another row with the same id, and is left out.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in runs(batches, ["gid", "cell"]):
            columns = [frame[c].to_numpy() for c in ("side", "node", "root")]
            texts, digests = frame["text"].tolist(), frame["digest"].tolist()
            found = [np.empty((2, 0), np.int64)]
            for cells in _some_cells(texts, starts.tolist()):
                begin, end = cells[0], cells[-1]
                flat, sizes = shingle_sets(texts[begin:end], size)
                sets = np.split(flat, np.cumsum(sizes)[:-1])
                own = np.array([_digest(s) == bytes(d) for s, d in zip(sets, digests[begin:end], strict=True)])
                for first, last in zip(cells[:-1], cells[1:], strict=True):
                    part = slice(first, last)
                    found.append(links(*(c[part] for c in columns), sets[first - begin : last - begin], own[first - begin : last - begin]))
            a, b = np.concatenate(found, axis=1)
            yield pd.DataFrame({"a": a, "b": b})

    def links(sides: np.ndarray, nodes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], own: np.ndarray) -> np.ndarray:
        """The links of one cell: ends a, ends b."""
        order = np.argsort(sides, kind="stable")
        order = order[own[order]]
        left = int((sides[order] == 0).sum())
        if len(order) < 2 or not left:
            return np.empty((2, 0), np.int64)
        sets, ids = [sets[k] for k in order.tolist()], nodes[order]
        sizes = np.array([len(s) for s in sets])
        if left == len(ids):
            labels = _labels(_linked(overlaps(sets), sizes, sizes, percent))
            far = np.flatnonzero(labels != np.arange(len(ids)))
            return np.stack([ids[far], ids[labels[far]]])
        x, y = _linked(overlaps(sets, left), sizes[:left], sizes[left:], percent).nonzero()
        return np.unique(np.stack([ids[x], roots[order][left + y]]), axis=1) if len(x) else np.empty((2, 0), np.int64)

    dealt = rows.repartition("gid", "cell").sortWithinPartitions("gid", "cell")
    return dealt.select("gid", "cell", "side", "node", "root", "digest", "text").mapInPandas(compare, "a bigint, b bigint")


def only_wanted(rows: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """rows without most of those whose id is not among `ids` (about `count` of them), so that only few texts move to meet their ids.

    A table of bits over hashes of the ids, 32 MB at most, goes to every task and is asked while rows are scanned. It knows every wanted id; of the
    others it lets some through, one in 16 while the table may grow and more beyond. The join that follows decides.
    """
    size = min(TABLE_BITS, max(ROW_BITS, (BITS_EACH * max(1, count)).bit_length()))
    bit = F.xxhash64("id").bitwiseAND(F.lit((1 << size) - 1))
    within = F.lit((1 << ROW_BITS) - 1).cast("long")
    table = ids.select(F.shiftright(bit, ROW_BITS).alias("__row"), bit.bitwiseAND(within).alias("__at")).groupBy("__row").agg(F.bitmap_construct_agg("__at").alias("__bits"))
    marked = rows.withColumns({"__row": F.shiftright(bit, ROW_BITS), "__at": bit.bitwiseAND(within)}).join(F.broadcast(table), "__row")  # 8,192 rows of 4 KB at most
    byte = F.conv(F.hex(F.substring("__bits", (F.shiftright("__at", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return marked.where(F.getbit(byte, F.col("__at").bitwiseAND(F.lit(7)).cast("int")) == 1).drop("__row", "__at", "__bits")


def near_groups(rows: DataFrame, size: int = 5, percent: int = 80, miss: float = 1e-6, values: int = 256, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """(id, n_shingles, digest, component) of each row (id, text): texts whose shingle sets satisfy 100 * intersection >= percent * union
    are linked, and the component is the smallest id that links reach.

    The bands overlook a pair at the threshold with a probability below `miss`. Null ids take part in nothing; rows that repeat
    an id are separate texts with that id. A text without words is linked with nothing.
    """
    rows = rows.select("id", "text")
    known = rows.where("id is not null")
    hasher = MinMaxHash(*banding(percent / 100, miss, values), seed=seed)
    sketched = cut(features(rows, size, hasher).withColumn("node", F.monotonically_increasing_id()))
    usable = sketched.where("digest is not null and id is not null")
    classes = cut(usable.groupBy("digest").agg(F.min("node").alias("node"), F.min("id").alias("least"), F.max("n_shingles").alias("size")))

    keys = usable.join(classes.select("node"), "node", "left_semi").select("node", F.explode("bands").alias("key"))
    first = keys.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").select("key", "first")
    chains = keys.join(first, "key").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    members = components(chains).withColumnRenamed("component", "gid").join(classes, "node")
    parts = lambda: F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(block), F.sum("size") / F.lit(BLOCK_SHINGLES))).cast("int")
    groups = members.groupBy("gid").agg(parts().alias("blocks"))
    members = cut(members.join(groups, "gid").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")))

    own = F.when(F.col("blocks") == 1, F.array(F.lit(0))).when(F.col("block") > 0, F.array("block")).otherwise(F.sequence(F.lit(1), F.col("blocks") - 1))
    cells = members.select("gid", "node", F.col("least").alias("id"), "digest", F.explode(own).alias("cell"), F.lit(0).alias("side"), F.col("node").alias("root"))
    few = only_wanted(known, members.select(F.col("least").alias("id")), members.count())
    links = cut(_confirm(few.join(cells, "id"), size, percent))

    found = cut(components(links))
    large = members.where("blocks > 1").join(found, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    tops = large.groupBy("gid", "root").count().groupBy("gid").agg(F.max(F.struct("count", "root"))["root"].alias("top"))
    loose = cut(large.join(tops, "gid").where("root <> top").select("gid", "node", "root", "blocks", "size"))
    if loose.isEmpty():
        for done in (links, loose, members):
            release(done)
        return _result(sketched, classes, found)
    sizes = loose.groupBy("gid").agg(parts().alias("parts"))
    cell = F.struct("part", "block")
    left = (
        loose.join(sizes, "gid").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("gid", "node", F.to_json(cell).alias("cell"), F.lit(0).alias("side"), "root")
    )
    right = (
        large.join(sizes, "gid").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
        .select("gid", "node", F.to_json(cell).alias("cell"), F.lit(1).alias("side"), "root")
    )
    cells = left.unionByName(right).join(members.select("node", F.col("least").alias("id"), "digest"), "node")
    wanted = cut(cells)
    few = only_wanted(known, wanted.select("id").distinct(), wanted.select("id").distinct().count())
    more = _confirm(few.join(wanted, "id"), size, percent)
    out = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    for done in (links, loose, members, wanted):
        release(done)
    return _result(sketched, classes, out)


def _result(sketched: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """The smallest id of each component, handed to all rows of its classes."""
    labels = found.join(classes, "node").select("digest", "least", "component")
    lows = labels.groupBy("component").agg(F.min("least").alias("low"))
    lows = labels.join(lows, "component").select("digest", "low")
    component = F.when(F.col("id").isNotNull(), F.coalesce("low", "least", "id"))
    return (
        sketched.select("id", "n_shingles", "digest")
        .join(classes.select("digest", "least"), "digest", "left")
        .join(lows, "digest", "left")
        .select("id", "n_shingles", "digest", component.alias("component"))
    )


def minmax_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of docs; kept marks the smallest id of each group of near-duplicates.

    Null and empty texts, and rows with a null id, form groups of their own and are kept. Other columns of docs are not read. An empty table
    gives an empty result.
    """
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return near_groups(rows, size, percent).select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )
