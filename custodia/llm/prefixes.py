"""Conversation prefix trie: conversations meet by digests of whole blocks of turns, and single turns are told apart only where blocks part."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.llm.common import cut, release
from custodia.llm.turns import WORD, before, ordered

#: Turns of a block, and log2 of the neighbouring conversation ids that are joined into one piece of an id list.
BLOCK, PIECE = 4, 12
NODE = ["depth", "n1", "n2"]


def turn_table(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, x1, x2, words): turns in order, with 128 bits of role and text in place of them, and the number of words of the text."""
    return ordered(conversations).select(
        "conv_id", "pos", F.xxhash64("role", "text").alias("x1"), F.xxhash64(F.lit(1), "role", "text").alias("x2"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
    )


def with_shared_heads(turns: DataFrame, convs: DataFrame, every: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after each conversation c takes its first h turns from conversation c - c % every, h = crc32(c) % heads.

    c keeps its own turns after its first h. A conversation that is left without turns stays a conversation, of length 0.
    """
    sizes = convs.select("conv_id", "length", (F.col("conv_id") - F.col("conv_id") % every).alias("base"),
                         (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("length").alias("there"))
    plan = sizes.join(bases, "base", "left").withColumn("lead", F.least("h", F.coalesce("there", F.lit(0))))
    plan = plan.select("conv_id", "base", "h", "lead", (F.col("lead") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length"))
    tail = turns.join(plan.drop("base"), "conv_id").where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("lead"))
    first = turns.where((F.col("pos") < heads) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    head = first.join(plan, "base").where("pos <= h")
    columns = ["conv_id", "pos", "x1", "x2", "words", "length"]
    return head.select(*columns).unionByName(tail.select(*columns)), plan.select("conv_id", "length")


def blocks_of(turns: DataFrame) -> DataFrame:
    """One row a block: its turns, whether its conversation ends in it, and digests of all that comes before (p1, p2) and up to its end (e1, e2).

    A turn's digest covers its position, and a prefix's digest is the exclusive or of its turns' digests, so that prefixes of a conversation
    of any length come from running totals.
    """
    rows = turns.select(
        "conv_id", "pos", "length", "words", F.shiftright(F.col("pos") - 1, BLOCK.bit_length() - 1).alias("block"),
        F.xxhash64("pos", "x1", "x2").alias("g1"), F.xxhash64(F.lit(2), "pos", "x1", "x2").alias("g2"),
    )
    blocks = rows.groupBy("conv_id", "block").agg(  # at most BLOCK rows a group
        F.sort_array(F.collect_list(F.struct("pos", "g1", "g2", "words"))).alias("turns"),
        F.bit_xor("g1").alias("b1"), F.bit_xor("g2").alias("b2"), (F.max("pos") == F.max("length")).alias("last"),
    )
    out = before(blocks, "conv_id", F.col("block"), {"p1": F.bit_xor("b1"), "p2": F.bit_xor("b2")}, F.lit(0).cast("long"))
    return out.select("conv_id", "block", "turns", "last", "p1", "p2", F.col("p1").bitwiseXOR(F.col("b1")).alias("e1"), F.col("p2").bitwiseXOR(F.col("b2")).alias("e2"))


def _prefixes(*carry: Column) -> list[Column]:
    """Explodes a block into its turns: depth, digests up to the turn and up to the one before, its words, its place in the block, and carry."""

    def up_to(digest: str, t: Column) -> Column:
        return F.aggregate(F.slice("turns", F.lit(1), t), F.col(f"p{digest[-1]}"), lambda a, x: a.bitwiseXOR(x[digest]))

    def turn(t: Column) -> Column:
        own = F.get("turns", t - 1)
        return F.struct(
            own["pos"].alias("depth"), up_to("g1", t).alias("n1"), up_to("g2", t).alias("n2"), up_to("g1", t - 1).alias("q1"),
            up_to("g2", t - 1).alias("q2"), own["words"].alias("words"), t.alias("t"),
        )

    return [F.explode(F.transform(F.sequence(F.lit(1), F.size("turns")), turn)).alias("turn"), *carry]


def turn_nodes(blocks: DataFrame, cut: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Nodes of the trie: depth, digest (n1, n2), parent's digest (q1, q2), members n, smallest member, members that end here, words.

    Conversations are first grouped by whole blocks. Where all that share a prefix go on with the same block, every turn in it has the
    block's members. Only where different blocks follow, their turns are grouped one by one; these rows are distinct blocks, not members.
    """
    distinct = blocks.groupBy("block", F.size("turns").alias("size"), "e1", "e2").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.count_if("last").alias("ends"),
        F.first("turns").alias("turns"), F.first("p1").alias("p1"), F.first("p2").alias("p2"),
    )
    distinct = cut(distinct)
    alone = distinct.groupBy("block", "p1", "p2").agg(F.count(F.lit(1)).alias("siblings"), F.min(F.struct("size", "e1", "e2")).alias("one"))
    alone = alone.where("siblings = 1").select("block", "one.*", F.lit(True).alias("alone"))
    marked = distinct.join(alone, ["block", "size", "e1", "e2"], "left")
    turns = marked.select(*_prefixes(F.col("n"), F.col("least"), F.col("ends"), F.col("size"), F.col("alone")))
    turns = turns.select("turn.*", "n", "least", F.when(F.col("turn.t") == F.col("size"), F.col("ends")).otherwise(0).alias("ends"), "alone")
    columns = [*NODE, "q1", "q2", "words", "n", "least", "ends"]
    refined = turns.where("alone is null").groupBy(*NODE).agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("ends").alias("ends"),
        *[F.first(c).alias(c) for c in ("q1", "q2", "words")],
    )
    return turns.where("alone").select(*columns).unionByName(refined.select(*columns))


def subtree_sums(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, saved, leaves): over the node and all below it, words of members beyond the first, and nodes without children.

    A conversation is the smallest member of the nodes of a last part of its own path, and of no others. So the sums over a subtree are sums
    over its members: each adds the words of its path up to where it becomes the smallest member, and 1 if it is that of a leaf. Both are
    running totals along the conversation, which then combine by block; nothing is followed level by level.
    """
    held = nodes.groupBy(F.col("least").alias("conv_id"), F.shiftright(F.col("depth") - 1, BLOCK.bit_length() - 1).alias("block")).agg(
        F.count(F.lit(1)).alias("owned"), F.max((F.col("ends") == F.col("n")).cast("long")).alias("leaf")
    )
    rows = blocks.join(held, ["conv_id", "block"], "left").na.fill(0, ["owned", "leaf"])
    shared = F.aggregate(F.slice("turns", F.lit(1), F.size("turns") - F.col("owned").cast("int")), F.lit(0).cast("long"), lambda a, x: a + x["words"])
    rows = before(rows.withColumn("shared", shared), "conv_id", F.col("block"), {"below": F.sum("shared"), "leaves": F.sum("leaf")}, F.lit(0).cast("long"), backwards=True)
    sums = rows.groupBy("block", F.size("turns").alias("size"), "e1", "e2").agg(
        F.count(F.lit(1)).alias("n"), F.sum("below").alias("below"), F.sum(F.col("leaves") + F.col("leaf")).alias("leaves"),
        F.max("owned").cast("int").alias("owned"), F.first("turns").alias("turns"), F.first("p1").alias("p1"), F.first("p2").alias("p2"),
    )

    def words_from(t: Column) -> Column:
        return F.aggregate(F.slice("turns", t, F.greatest(F.size("turns") - t + 1, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x["words"])

    sums = sums.select(*_prefixes(*[F.col(c) for c in ("n", "below", "leaves", "owned", "turns")]))
    saved = F.col("n") * words_from(F.col("turn.t")) - words_from(F.greatest(F.col("turn.t"), F.size("turns") - F.col("owned") + 1)) + F.col("below")
    return sums.select("turn.depth", "turn.n1", "turn.n2", saved.alias("saved"), "leaves")


def id_list_digests(ends: DataFrame, cut: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(node, sha): SHA-256 of the ascending, comma-joined decimal conv_ids of each node's rows.

    Ids are joined in pieces of 4,096 neighbouring numbers, in parallel. A node with one piece is hashed at once; the pieces of the others
    stream in order through one hash, which holds no more than a piece.
    """
    pieces = ends.groupBy(*NODE, F.shiftright("conv_id", PIECE).alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )
    pieces = cut(pieces)
    counted = pieces.groupBy(*NODE).agg(F.count(F.lit(1)).alias("pieces"), F.first("ids").alias("ids"))
    whole = counted.where("pieces = 1").select(*NODE, F.sha2("ids", 256).alias("sha"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state, done = None, None, []
        for batch in batches:
            for *key, ids in zip(*[batch[c].tolist() for c in (*NODE, "ids")], strict=True):
                if key != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=[*NODE, "sha"])
            done = []
        if node is not None:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=[*NODE, "sha"])

    long = pieces.join(counted.where("pieces > 1").select(*NODE), NODE)
    long = long.repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "ids")
    return whole.unionByName(long.mapInPandas(run, "depth bigint, n1 bigint, n2 bigint, sha string"))


def prefix_trie(conversations: DataFrame, share_every: int | None = None, share_heads: int = 4) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row per distinct prefix of turns.

    conversations has conv_id, turn, role and text; other columns, whatever their names, are not read. Turns are ordered by turn, null turns
    first, ties by role and text; null roles and texts are empty. A prefix is named by its smallest member conv_id and its depth; the empty
    prefix, depth 0, is every conversation's. saved_tokens is the number of words that a cache of shared prefixes saves: over the subtree,
    members beyond the first times words of the node's last text. ends_sha256 is over the ids of the members that end at the node.
    With share_every, conversations first take their first turns from another one, see with_shared_heads.

    Rows with a null conv_id belong to no conversation. Repeated rows are turns like others. Texts of any length are hashed whole, once, and
    only 128-bit digests go on. An empty table has no conversation and gives no row, not even a root.
    """
    written: list[DataFrame] = []

    def keep(frame: DataFrame) -> DataFrame:
        written.append(cut(frame))
        return written[-1]

    turns = keep(turn_table(conversations))
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))
    if share_every:
        turns, convs = with_shared_heads(turns, keep(convs), share_every, share_heads)
    else:
        turns = turns.join(convs, "conv_id")
    convs = keep(convs)
    blocks = keep(blocks_of(turns))
    nodes = keep(turn_nodes(blocks, keep))
    sums = subtree_sums(blocks, nodes)
    zero = F.lit(0).cast("long")
    root = [zero.alias("depth"), zero.alias("n1"), zero.alias("n2")]
    ends = blocks.where("last").select(
        F.element_at("turns", -1)["pos"].alias("depth"), F.col("e1").alias("n1"), F.col("e2").alias("n2"), "conv_id"
    ).unionByName(convs.where("length = 0").select(*root, "conv_id"))
    facts = [
        nodes.select(*NODE, "q1", "q2", F.col("least").alias("conv_id"), F.col("n").alias("n_convs")),
        convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(*root, "conv_id", "n_convs"),
        nodes.select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("n1"), F.col("q2").alias("n2"), F.lit(1).cast("long").alias("n_children")),
        sums.select(*NODE, "saved", "leaves"),
        sums.where("depth = 1").select(*root, "saved", "leaves"),
        id_list_digests(ends, keep),
    ]
    merged = facts[0]
    for more in facts[1:]:
        merged = merged.unionByName(more, allowMissingColumns=True)
    merged = merged.groupBy(*NODE).agg(
        *[F.max(c).alias(c) for c in ("conv_id", "q1", "q2", "sha")], *[F.coalesce(F.sum(c), zero).alias(c) for c in ("n_convs", "n_children", "saved", "leaves")]
    )
    merged = cut(merged)
    for frame in written:
        release(frame)
    parents = merged.select((F.col("depth") + 1).alias("depth"), F.col("n1").alias("q1"), F.col("n2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    return merged.join(parents, ["depth", "q1", "q2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("leaves")).alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


#: crc32 of a text in SQL: the table of 256 entries follows from the polynomial.
CRC_SQL = """
crc_table as (
  select list(list_reduce(list_prepend(n, range(8)), lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by n) as steps
  from (select unnest(range(256)) as n))
"""


def crc_sql(text: str) -> str:
    """SQL for crc32 of an ASCII text; needs CRC_SQL, and crc_table in the FROM clause."""
    bytes_ = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bytes_}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


def trie_sql(table: str, every: int = 20, heads: int = 4) -> str:
    """The same rows in SQL, from whole prefixes."""
    return f"""
with {CRC_SQL},
turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as body,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from {table} where conv_id is not null),
convs as (
  select conv_id, conv_id - conv_id % {every} as base, {crc_sql("conv_id::varchar")} % {heads} as h
  from (select distinct conv_id from turns), crc_table),
rebuilt as (
  select c.conv_id, 0 as part, t.pos, t.role, t.body from convs c join turns t on t.conv_id = c.base and t.pos <= c.h
  union all
  select c.conv_id, 1, t.pos, t.role, t.body from convs c join turns t on t.conv_id = c.conv_id and t.pos > c.h),
steps as (
  select conv_id, row_number() over (partition by conv_id order by part, pos) as depth, sha256(role) || sha256(body) as mark,
    len(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+')) as words
  from rebuilt),
paths as (
  select conv_id, depth, words, sha256(string_agg(mark, ',') over (partition by conv_id order by depth)) as node from steps
  union all
  select conv_id, 0, 0, 'root' from convs),
linked as (
  select p.*, lag(node) over (partition by conv_id order by depth) as parent, depth = max(depth) over (partition by conv_id) as ending from paths p),
nodes as (
  select depth, node, min(parent) as parent, min(conv_id) as conv_id, count(*) as n, max(words) as words,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ending), '')) as ends_sha256
  from linked group by depth, node),
kids as (select parent, depth - 1 as depth, count(*) as n_children from nodes where depth > 0 group by all),
full_nodes as (select n.*, coalesce(k.n_children, 0) as n_children from nodes n left join kids k on k.parent = n.node and k.depth = n.depth),
sums as (
  select a.depth, a.node, sum((v.n - 1) * v.words) as saved, count(*) filter (where v.n_children = 0) as leaves
  from full_nodes v join paths a on a.conv_id = v.conv_id and a.depth <= v.depth group by a.depth, a.node)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n as n_convs, n.n_children, s.leaves as n_leaves,
  s.saved::bigint as saved_tokens, n.ends_sha256
from full_nodes n join sums s using (depth, node) left join nodes p on p.node = n.parent and p.depth = n.depth - 1
"""
