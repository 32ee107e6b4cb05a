"""Substring dedup: repeated paragraphs and repeated passages within paragraphs.

Paragraphs (lines of at least MIN_WORDS words) go through MinHash banding, exact Jaccard confirmation and components. A passage that is
copied into the middle of other paragraphs is found by windows: WINDOW words from every anchor, an anchor being the smallest hash of five
words among REACH neighbours. Anchors depend only on the words around them, so every copied run of RUN words holds one whole window that is
equal in both documents, at most REACH - 1 words from its start. So only the runs of RUN words that start there are compared, and of those all
that another document holds are found. Runs that overlap are one passage, which is thus the whole of what was copied.

Runs that start next to each other are cut into stretches, again at anchors, so that copies mostly have the same ones. Equal stretches are one class, and
its runs are compared once, whatever the number of documents that hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.llm.common import WHITE, cut, release
from custodia.llm.minhash import BITS_EACH, ROW_BITS, TABLE_BITS, lots, near_groups
from custodia.llm.shingles import mix, run_hashes, shingle_hashes, shingle_hashes_at, words_of_all

#: Words in the shortest paragraph and in a window; anchors are the least of so many neighbours. 26 + 20 + 4 = 50 words are never overlooked.
MIN_WORDS, WINDOW, REACH = 30, 26, 20
RUN = WINDOW + REACH + 4
#: A run that more than this share of all rows hold is spread over several parts, so at most so many runs are; and the least rows of a part.
HOT_SHARE, HOT_ROWS = 1 / 1024, 2_000
#: Probability that the bands overlook two paragraphs at the threshold, and signature values at most: 14 bands of 3 values.
MISS, VALUES = 1e-4, 48


def least_places(values: np.ndarray, reach: int) -> np.ndarray:
    """The place of the least value (the last of equals) in every run of `reach` values, by runs of twice the length at a time; they never decrease."""
    place, width = np.arange(len(values)), 1
    while width < reach:
        step = min(width, reach - width)
        left, right = place[:-step], place[step:]
        place = np.where(values[left] < values[right], left, right)
        width += step
    return place


def anchors(words: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Places of the least five-word hash in every run of `reach` places of one text, or of all places where there are fewer."""
    order = shingle_hashes(words, 5)
    return np.unique(least_places(order, min(reach, len(order)))) if len(order) else np.empty(0, np.int64)


def anchored(texts: list[str | None], hashed: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, hash) of the windows of all texts. No run of places reaches over the end of a text. hashed: their words, where known."""
    words, counts = hashed or words_of_all([t or "" for t in texts])
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(words) < REACH + 4:
        return owner[:0], owner[:0], words[:0]
    places = least_places(shingle_hashes(words, 5), REACH)
    first = np.arange(len(places))
    places = places[first + REACH + 4 <= ends[owner[first]]]
    places = places[np.flatnonzero(np.diff(places, prepend=-1))]
    places = places[places + WINDOW <= ends[owner[places]]]
    return owner[places], places - (ends - counts)[owner[places]], shingle_hashes_at(words, places, WINDOW)


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, start, h): a row for each window of each text; h is a 64-bit hash of its words."""

    def cut_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, done = batch["doc_id"].to_numpy(), 0
            for some in lots(batch["text"].tolist()):
                owner, starts, marks = anchored(some)
                yield pd.DataFrame({"doc_id": ids[done + owner], "start": starts, "h": marks.view(np.int64)})
                done += len(some)

    return docs.select("doc_id", "text").mapInPandas(cut_windows, "doc_id bigint, start int, h bigint")


def wanted_bits(hashes: DataFrame, count: int) -> np.ndarray:
    """A table of bits, 32 MB at most, that knows every h of `hashes` (about `count` rows) by two bits, and few others while it may grow."""
    size = min(TABLE_BITS, max(ROW_BITS, (BITS_EACH * max(1, count)).bit_length()))
    last = F.lit((1 << size) - 1)
    bits = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(last), F.shiftrightunsigned("h", 32).bitwiseAND(last))).alias("bit"))
    rows = bits.groupBy(F.shiftright("bit", ROW_BITS).alias("row")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit((1 << ROW_BITS) - 1))).alias("bits")).collect()
    table = np.zeros((1 << (size - ROW_BITS), (1 << ROW_BITS) // 8), np.uint8)
    for row in rows:
        table[row["row"]] = np.frombuffer(row["bits"], np.uint8)
    return table.ravel()


def known(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a table of wanted_bits knows."""

    def marked(at: np.ndarray) -> np.ndarray:
        at = at & np.uint64(8 * len(bits) - 1)
        return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    out = marked(hashes)
    out[out] = marked(hashes[out] >> np.uint64(32))
    return out


def stretches_at(texts: list[str | None], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, number, hash) of stretches, and the hashes of all their runs: runs of RUN words that start one word after another.

    Only runs that hold a known window at most REACH - 1 words from their start are in one. A stretch begins wherever the run before is in none, and at
    anchors, so it has REACH runs at most. The hash is one of its runs in order.
    """
    words, counts = words_of_all([t or "" for t in texts])
    ends = np.cumsum(counts)
    owner, places, marks = anchored(texts, (words, counts))
    cuts = np.zeros(len(words), bool)
    cuts[(ends - counts)[owner] + places] = True
    hit = known(bits, marks)
    owner, places = owner[hit], places[hit]
    begins = (ends - counts)[owner]
    starts = (begins + places)[:, None] - np.arange(REACH)
    inside = (starts >= begins[:, None]) & (starts + RUN <= ends[owner][:, None])
    begin = np.zeros(len(words), bool)
    begin[starts[inside]] = True
    starts = np.flatnonzero(begin)
    if not len(starts):
        return owner[:0], starts, starts, words[:0], words[:0]
    heads = np.flatnonzero(cuts[starts] | (np.diff(starts, prepend=-2) != 1))
    numbers = np.diff(np.append(heads, len(starts)))
    runs = run_hashes(words, RUN)[starts]
    place = (np.arange(len(starts)) - np.repeat(heads, numbers)).astype(np.uint64)
    hashes = mix(np.add.reduceat(mix(runs ^ mix(place + np.uint64(1))), heads) + numbers.astype(np.uint64))
    of = np.searchsorted(ends, starts[heads], "right")
    return of, starts[heads] - (ends - counts)[of], numbers, hashes, runs


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, words, first, removed) of the passages of RUN words or more that several documents hold.

    A run belongs to the smallest document that holds it; there it stays, everywhere else it is removed. Overlapping runs of a document that
    are removed, or that stay, are one passage, and first is the smallest document that any of them belongs to. The windows only say where to
    look: a table of bits over those that several documents hold goes to the tasks, which hash the runs around them in a second pass. Equal
    stretches of runs are one class; its runs are compared with those of other classes, and what is found is handed to all documents that hold it.
    """
    several = F.min("doc_id").alias("first"), F.max("doc_id").alias("last")
    windowed = cut(windows(docs).groupBy("h").agg(*several).where("first <> last").select("h"))
    table = docs.sparkSession.sparkContext.broadcast(wanted_bits(windowed, windowed.count()))
    release(windowed)

    def cut_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, done = batch.column("doc_id").to_numpy(), 0
            for some in lots(batch.column("text").to_pylist()):
                owner, starts, numbers, marks, runs = stretches_at(some, table.value)
                edges = np.concatenate([[0], np.cumsum(numbers)]).astype(np.int32)
                columns = [ids[done + owner], starts.astype(np.int32), marks.view(np.int64), pa.ListArray.from_arrays(edges, runs.view(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "start", "stretch", "runs"])
                done += len(some)

    stretches = cut(docs.select("doc_id", "text").mapInArrow(cut_stretches, "doc_id bigint, start int, stretch bigint, runs array<bigint>"))
    table.destroy()
    classes = stretches.groupBy("stretch").agg(*several, F.first("runs").alias("runs"))
    marks = cut(classes.select("stretch", "first", "last", F.posexplode("runs").alias("place", "h")))
    holders = marks.groupBy("h").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("n"))
    shared = cut(holders.where("first <> last").select("h", "first", "n"))
    most = max(HOT_ROWS, int((shared.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE))
    parts = F.ceil(F.col("n") / F.lit(most)).cast("int")
    hot = shared.where(F.col("n") > most).select("h", parts.alias("parts"))  # 1 / HOT_SHARE rows at most
    part = F.coalesce(F.pmod(F.xxhash64("stretch", "place"), F.col("parts")).cast("int"), F.lit(0))
    dealt = marks.select("stretch", "place", "h").join(F.broadcast(hot), "h", "left").withColumn("part", part).drop("parts")
    found = dealt.join(shared.select("h", "first", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")), ["h", "part"]).select("stretch", "place", "first")
    found = found.repartition("stretch").sortWithinPartitions("stretch").mapInPandas(joined_places, "stretch bigint, low int, high int, first bigint")
    placed = stretches.select("doc_id", "start", "stretch").join(found, "stretch").select(
        "doc_id", (F.col("first") != F.col("doc_id")).alias("removed"), (F.col("start") + F.col("low")).alias("start"), (F.col("start") + F.col("high")).alias("last"), "first"
    )
    return placed.repartition("doc_id").sortWithinPartitions("doc_id", "removed", "start").mapInPandas(joined_runs, "doc_id bigint, removed boolean, start int, words int, first bigint")


def joined_places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(stretch, low, high, first) from the shared runs (stretch, place, first) of stretches that come one after another: places in a row with one first."""
    held: list[np.ndarray] = []  # the last stretch so far, which the next batch may go on with
    for batch in batches:
        if not len(batch):
            continue
        part = [batch[c].to_numpy() for c in ("stretch", "place", "first")]
        part = [np.concatenate(x) for x in zip(held, part, strict=True)] if held else part
        whole = np.flatnonzero(part[0] != part[0][-1])
        end = whole[-1] + 1 if len(whole) else 0
        held = [x[end:] for x in part]
        yield _places(*(x[:end] for x in part))
    if held:
        yield _places(*held)


def _places(stretch: np.ndarray, place: np.ndarray, first: np.ndarray) -> pd.DataFrame:
    order = np.lexsort((place, stretch))
    stretch, place, first = stretch[order], place[order], first[order]
    heads = np.ones(len(stretch), bool)
    heads[1:] = (stretch[1:] != stretch[:-1]) | (place[1:] != place[:-1] + 1) | (first[1:] != first[:-1])
    heads = np.flatnonzero(heads)
    return pd.DataFrame({"stretch": stretch[heads], "low": place[heads], "high": place[np.append(heads[1:], len(place)) - 1] if len(heads) else place, "first": first[heads]})


def joined_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Passages from runs (doc_id, removed, start, first) sorted by the first three: runs that overlap are one passage. Holds one batch and one passage.

    A row may stand for all runs from start to a column `last`.
    """
    names = ["doc_id", "removed", "start", "last", "first"]
    held: list[np.ndarray] = []  # the last passage so far, which the next batch may go on with; last is where its last run starts
    for batch in batches:
        if not len(batch):
            continue
        part = [batch[c].to_numpy() for c in ("doc_id", "removed", "start", "last" if "last" in batch else "start", "first")]
        doc, removed, start, last, first = (np.concatenate(x) for x in zip(held, part, strict=True)) if held else part
        heads = np.ones(len(doc), bool)
        heads[1:] = (doc[1:] != doc[:-1]) | (removed[1:] != removed[:-1])
        above = np.cumsum(heads) << 32  # rows that repeat a document may lie within each other
        last = np.maximum.accumulate(last + above) - above
        heads[1:] |= start[1:] >= last[:-1] + RUN
        heads = np.flatnonzero(heads)
        found = [doc[heads], removed[heads], start[heads], last[np.append(heads[1:], len(doc)) - 1], np.minimum.reduceat(first, heads)]
        held = [x[-1:] for x in found]
        yield _passages(dict(zip(names, (x[:-1] for x in found), strict=True)))
    if held:
        yield _passages(dict(zip(names, held, strict=True)))


def _passages(found: dict[str, np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": found["doc_id"], "removed": found["removed"], "start": found["start"], "words": found["last"] - found["start"] + RUN, "first": found["first"]})


def paragraphs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, doc_id, line, text) of the paragraphs with enough words; id orders them by document and line."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    enough = F.col("text").rlike(f"^[{WHITE}]*+(?:[^{WHITE}]++[{WHITE}]++){{{min_words - 1}}}[^{WHITE}]")  # reads no further than the last word it needs
    return lines.where((F.length("text") >= 2 * min_words - 1) & enough).select(
        (F.col("doc_id").cast("decimal(19,0)") * F.lit(4294967296).cast("decimal(10,0)") + F.col("line").cast("decimal(10,0)")).cast("decimal(30,0)").alias("id"),
        "doc_id", "line", "text",
    )


def substring_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """(doc_id, n_passages, n_removed, first_docs, spans): one row per document that shares a passage with another document.

    spans holds (kind, start, words, first_doc, removed): kind paragraph counts start in lines, kind passage in words; words is null for a
    paragraph. first_doc is the smallest document of the paragraph's component or of the passage's holders, and only its copy stays: removed marks
    all others. A word lies in a span of kind passage if and only if it lies in RUN words that another document holds as well.

    Null texts, empty texts, empty tables and rows with a null id have no passages. Repeats within one document alone are not reported. Rows that
    repeat a doc_id count as one document. An id that is no whole number fails. Other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id is not null and text is not null")
    units = paragraphs(rows)
    groups = near_groups(units, 5, percent, MISS, VALUES)
    places = groups.select(
        F.floor(F.col("id") / F.lit(4294967296).cast("decimal(10,0)")).cast("long").alias("doc_id"),
        (F.col("id") % F.lit(4294967296).cast("decimal(10,0)")).cast("int").alias("start"),
        F.floor(F.col("component") / F.lit(4294967296).cast("decimal(10,0)")).cast("long").alias("first"),
        "component",
    )
    shared = places.groupBy("component").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").select("component")
    near = places.join(shared, "component").select("doc_id", F.lit("paragraph").alias("kind"), "start", F.lit(None).cast("int").alias("words"), "first")
    near = near.withColumn("removed", F.col("first") != F.col("doc_id"))
    same = repeated_runs(rows).select("doc_id", F.lit("passage").alias("kind"), "start", "words", "first", "removed")
    span = F.struct("kind", "start", "words", F.col("first").alias("first_doc"), "removed")
    return (
        near.unionByName(same).groupBy("doc_id").agg(F.sort_array(F.collect_set(span)).alias("spans"))
        .select(
            "doc_id", F.size("spans").cast("long").alias("n_passages"),
            F.size(F.filter("spans", lambda s: s["removed"])).cast("long").alias("n_removed"),
            F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["first_doc"]))).alias("first_docs"), "spans",
        )
    )
