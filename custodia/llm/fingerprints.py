"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests that subtract, and peel to what differs.

A printed fingerprint has the least cells, doubled from CELLS, from which its own digests peel, so its size grows with the text. Two of them are
folded to the size of the smaller and subtracted; if the difference does not peel, both are peeled by themselves. So `compare` gets the exact
likeness of any two texts from their fingerprints alone.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custodia.llm.shingles import mix

#: Hash functions, cells of the smallest sketch, and the mean length of a piece of a long paragraph.
HASHES, CELLS, PIECE = 3, 30, 64
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests of a text's paragraphs, and of the pieces that long paragraphs fall into.

    A paragraph ends at a newline. Within it a cut is made where a hash of the last four characters falls into one of PIECE classes, so cuts
    move with the text and an edit changes only the pieces it touches. The k-th occurrence of a piece has a digest of its own.
    """
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(chars):
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        state = chars.copy()
        for back, factor in ((1, 31), (2, 961), (3, 29791)):
            state[back:] += chars[:-back] * np.uint64(factor)
        ends = (mix(state) % np.uint64(PIECE) == 0) | (chars == 10)
        ends[-1] = True
        stops = np.flatnonzero(ends) + 1
        starts = np.concatenate([[0], stops[:-1]])
        place = np.arange(len(chars)) - np.repeat(starts, stops - starts)
        pieces = np.add.reduceat(mix(chars + place.astype(np.uint64) * _SEEDS[0]), starts)
        pieces = mix(pieces + (stops - starts).astype(np.uint64))
        order = np.argsort(pieces, kind="stable")
        ordered = pieces[order]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        group = np.maximum.accumulate(np.where(first, np.arange(len(ordered)), 0))
        return mix(ordered + (np.arange(len(ordered)) - group).astype(np.uint64) * _SEEDS[1])


def _cells(keys: np.ndarray, cells: np.ndarray | int) -> np.ndarray:
    """For each key, one cell in each third of a sketch of so many cells (a multiple of three)."""
    third = np.asarray(cells, np.uint64) // np.uint64(HASHES)
    return np.stack([(mix(keys ^ s) % third + third * np.uint64(k)).astype(np.int64) for k, s in enumerate(_SEEDS)])


def _check(keys: np.ndarray) -> np.ndarray:
    return mix(keys + _SEEDS[2])


def fold(cells: np.ndarray, size: int, join: np.ufunc) -> np.ndarray:
    """One row of a sketch, as a sketch of the same keys with fewer cells (a doubling of whose number gives the present one) has it."""
    return join.reduce(cells.reshape(HASHES, -1, size // HASHES), axis=1).ravel()


def peel(count: np.ndarray, total: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The keys of a sketch, or of the difference of two, with 1 or -1 for each; None if they do not come out. check: the upper 32 bits."""
    count, total, check = count.copy(), total.copy(), check.copy()
    upper = lambda keys: (_check(keys) >> np.uint64(32)).astype(np.uint32)
    keys, signs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    while len(pure := np.flatnonzero((np.abs(count) == 1) & (check == upper(total)))):
        found, first = np.unique(total[pure], return_index=True)
        sign = count[pure[first]].astype(np.int64)
        for at in _cells(found, len(count)):
            np.add.at(count, at, -sign)
            np.bitwise_xor.at(total, at, found)
            np.bitwise_xor.at(check, at, upper(found))
        keys.append(found)
        signs.append(sign)
        if sum(map(len, keys)) > 4 * len(count):  # a false key turns up again and again
            return None
    return None if count.any() or total.any() or check.any() else (np.concatenate(keys), np.concatenate(signs))


def printed(keys: list[np.ndarray]) -> list[str]:
    """Each text's fingerprint as text: the number of its digests, and the least sketch that they peel from."""
    out, todo = [""] * len(keys), np.arange(len(keys))
    sizes = np.array([CELLS * (1 << max(0, -(-len(k) // CELLS) - 1).bit_length()) for k in keys], np.int64)
    none = [np.empty(0, np.uint64)] * len(keys)
    while len(todo):
        cells, offset, _, dirty = _peeled([keys[t] for t in todo], none[: len(todo)], sizes[todo])
        count, total, upper = cells[0].astype(np.int32), cells[1], (cells[2] >> np.uint64(32)).astype(np.uint32)
        for k in np.flatnonzero(~dirty):
            at = slice(offset[k], offset[k + 1])
            out[todo[k]] = base64.b64encode(np.int64(len(keys[todo[k]])).tobytes() + count[at].tobytes() + total[at].tobytes() + upper[at].tobytes()).decode()
        todo = todo[dirty]
        sizes[todo] *= 2
    return out


def read(fingerprint: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(number of digests, counts, keys, check sums) of a printed fingerprint."""
    data = base64.b64decode(fingerprint)
    cells = (len(data) - 8) // 16
    parts = data[8 : 8 + 4 * cells], data[8 + 4 * cells : 8 + 12 * cells], data[8 + 12 * cells :]
    return int(np.frombuffer(data[:8], np.int64)[0]), *(np.frombuffer(p, t) for p, t in zip(parts, (np.int32, np.uint64, np.uint32), strict=True))


def compare(left: str, right: str) -> float:
    """The likeness of two texts, from their printed fingerprints alone: common digests over all; two without any are alike."""
    (n, *a), (m, *b) = read(left), read(right)
    size = min(len(a[0]), len(b[0]))
    small = [[fold(x, size, join) for x, join in zip(side, (np.add, np.bitwise_xor, np.bitwise_xor), strict=True)] for side in (a, b)]
    found = peel(small[0][0] - small[1][0], small[0][1] ^ small[1][1], small[0][2] ^ small[1][2])
    if found is not None:
        less, more = int((found[1] > 0).sum()), int((found[1] < 0).sum())
    else:  # each peels by itself
        own, other = peel(*a)[0], peel(*b)[0]
        less, more = len(np.setdiff1d(own, other)), len(np.setdiff1d(other, own))
    return (n - less) / (n + more) if n + more else 1.0


def _peeled(left: list[np.ndarray], right: list[np.ndarray], size: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray, np.ndarray]:
    """The differences of the sketches of all pairs, peeled side by side: (cells before peeling, where each pair's begin, how many digests only
    the left and only the right text has, whether something is left that does not peel)."""
    pairs = len(left)
    lengths = [[len(x) for x in side] for side in (left, right)]
    owner = np.concatenate([np.repeat(np.arange(pairs), n) for n in lengths])
    keys = np.concatenate([*left, *right])
    sign = np.repeat([1, -1], [sum(n) for n in lengths])
    offset = np.concatenate([[0], np.cumsum(size)])
    count, total, check = np.zeros(offset[-1], np.int64), np.zeros(offset[-1], np.uint64), np.zeros(offset[-1], np.uint64)
    home = np.repeat(np.arange(pairs), size)
    found = np.zeros((2, pairs), np.int64)

    def toggle(keys: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> None:
        sums = _check(keys)
        for at in _cells(keys, size[owner]):
            at = at + offset[owner]
            np.add.at(count, at, sign)
            np.bitwise_xor.at(total, at, keys)
            np.bitwise_xor.at(check, at, sums)

    toggle(keys, owner, sign)
    before = count.copy(), total.copy(), check.copy()
    active = np.arange(offset[-1])
    while len(active):
        pure = active[(np.abs(count[active]) == 1) & (check[active] == _check(total[active]))]
        if not len(pure):
            break
        order = np.lexsort((total[pure], home[pure]))
        pure = pure[order]
        again = (home[pure][1:] == home[pure][:-1]) & (total[pure][1:] == total[pure][:-1])
        pure = pure[np.concatenate([[True], ~again])]
        marks, owners, signs = total[pure], home[pure], count[pure]
        toggle(marks, owners, -signs)
        np.add.at(found, (np.where(signs > 0, 0, 1), owners), 1)
        active = np.unique(np.concatenate([at + offset[owners] for at in _cells(marks, size[owners])]))
    dirty = np.bincount(home, (count != 0) | (total != 0) | (check != 0), pairs) > 0
    return before, offset, found, dirty


def differences(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How many digests only the left and only the right text of each pair has, recovered by peeling the difference of their sketches.

    All pairs are peeled side by side. A pair whose sketch does not peel to nothing is sketched again with twice the cells.
    """
    only_left, only_right = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    sizes = np.full(len(left), CELLS)
    todo = np.arange(len(left))
    while len(todo):
        _, _, found, dirty = _peeled([left[t] for t in todo], [right[t] for t in todo], sizes[todo])
        only_left[todo[~dirty]], only_right[todo[~dirty]] = found[0][~dirty], found[1][~dirty]
        todo = todo[dirty]
        sizes[todo] *= 2
    return only_left, only_right


def likeness(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common digests over all digests of each pair; two texts without any are alike."""
    less, more = differences(left, right)
    sizes = np.array([len(x) for x in left])
    return np.where(sizes + more > 0, (sizes - less) / np.maximum(sizes + more, 1), 1.0)


def in_order(docs: DataFrame, splits: int) -> DataFrame:
    """(part, doc_id, text, borrowed): rows dealt into parts of neighbouring ids, each with a copy of the row that follows its last.

    Parts are cut at quantiles of the ids. The copies are one row a part: the first of the next part that has rows, and for the last part the
    first of all. Descending ids, null ids last, ties by text. Only the copies' ids come from an aggregate; texts move once.
    """
    spark = docs.sparkSession
    bounds = docs.where("doc_id is not null").approxQuantile("doc_id", [k / splits for k in range(1, splits)], 0.001) if splits > 1 else []
    cuts = sorted(set(bounds))
    part = F.lit(len(cuts) + 1)  # null ids
    for bucket in [F.aggregate(F.array(*[F.lit(float(c)) for c in cuts]), F.lit(0), lambda n, c: n + (F.col("doc_id") < c).cast("int"))] if cuts else [F.lit(0)]:
        part = F.when(F.col("doc_id").isNotNull(), bucket).otherwise(part)
    dealt = docs.withColumn("part", part.cast("int"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), (-F.col("doc_id").cast("decimal(20,0)")).alias("down"), F.coalesce("text", F.lit("")).alias("text"))
    lead = dealt.groupBy("part").agg(F.max("doc_id").alias("top")).collect()
    tops = sorted((r["part"], r["top"]) for r in lead)
    if not tops:
        return dealt.select("part", "doc_id", "text", F.lit(False).alias("borrowed"))
    follows = {part: tops[(k + 1) % len(tops)] for k, (part, _) in enumerate(tops)}
    heads = spark.createDataFrame([(p, t[0], t[1]) for p, t in follows.items()], T.StructType([T.StructField("part", T.IntegerType()), T.StructField("of", T.IntegerType()), T.StructField("top", T.LongType())]))
    first = (
        dealt.join(F.broadcast(heads.select("top", "of").distinct()), (F.col("part") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top")))  # a row a part
        .groupBy("of").agg(F.min(order)["text"].alias("text"), F.first("doc_id").alias("doc_id"))
    )
    borrowed = first.join(F.broadcast(heads.select("part", "of")), "of").select("part", "doc_id", "text", F.lit(True).alias("borrowed"))
    return dealt.select("part", "doc_id", "text", F.lit(False).alias("borrowed")).unionByName(borrowed)


def fingerprint(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per row of docs.

    The edited text has its last third replaced by as many code points from the start of the next document (all, if it has fewer). The next
    document is the one that follows in descending order of ids; rows that share an id follow each other by text, null ids come last, and after
    the last row comes the first. Null texts count as empty. A single row is its own next. An empty table gives no rows, an id that is no whole
    number fails. Other columns are not read, whatever their names. near_edited and near_next are what `compare` gives for the fingerprints; here
    they are had for many rows at once, from the digests at hand.
    """
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    dealt = in_order(rows, 8 * width).repartition(width, "part")
    dealt = dealt.sortWithinPartitions("part", "borrowed", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            for begin in range(0, len(batch), 500):
                part = batch.iloc[begin : begin + 500]
                records = list(zip(part["part"], part["doc_id"], part["text"], part["borrowed"], strict=True))
                chain = records if held is None else [held, *records]
                held = chain[-1]
                pairs = [(a, b) for a, b in zip(chain[:-1], chain[1:], strict=True) if not a[3]]
                if not pairs:
                    continue
                known: dict[str, np.ndarray] = {}
                of = lambda t: known[t] if t in known else known.setdefault(t, digests(t))  # noqa: B023, E731
                texts, nexts = [a[2] for a, _ in pairs], [b[2] for _, b in pairs]
                edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, nexts, strict=True)]
                own, changed, after = [of(t) for t in texts], [digests(t) for t in edited], [of(t) for t in nexts]
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([None if pd.isna(a[1]) else int(a[1]) for a, _ in pairs], "Int64"),
                        "n_chars": [len(t) for t in texts],
                        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                        "fingerprint": printed(own),
                        "edited_fingerprint": printed(changed),
                        "near_edited": likeness(own, changed),
                        "near_next": likeness(own, after),
                    }
                )

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInPandas(run, schema)
