"""Benchmark decontamination by latent semantic retrieval: randomised SVD of TF-IDF passages, cosine search, then subsequence and answer checks.

What the cosine overlooks is found by counting: an item of which enough words stand in a region has some of its rarest words there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.llm.common import cut, release
from custodia.llm.shingles import WORD_BYTES, word_hashes, words_of_all

#: Bits of a term's hash, latent dimensions with spare ones, words in a passage that the space is fitted on, passages in a lot, and power rounds.
BITS, RANK, SPARE, PASSAGE, LOT, ROUNDS = 14, 48, 16, 40, 50, 2
#: Words in a block. Windows are whole blocks, this much longer than their items, start every so-many-th of their length (rounded down), and are
#: candidates from this cosine.
BLOCK, SLACK, STEP, COSINE = 6, 1.1, 3, 0.48
#: An item is found where this share of its words occurs in order, or the lower share together with its answer (its last words).
SHARE, LOWER, ANSWER, ANSWER_SHARE = 0.7, 0.5, 0.2, 0.8
#: Of the words that a leak must hold at least, the share that is asked of an item's rarest words; and bits of the table that finds these.
RARE, FILTER_BITS = 0.4, 20
#: Lots that are read at once, passages whose own terms are multiplied at once, and lots that are added up in single precision.
LOTS_AT_ONCE, TOGETHER, ADDED = 32, 5, 256
#: Items that are searched for in one pass over the documents, words that are searched at once, and items that make a word a common one.
ITEMS, WORDS_AT_ONCE, COMMON = 2000, 40_000, 4


def terms(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text: runs of letters and digits, A-Z lower-cased."""
    return word_hashes(text, WORD_BYTES)


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def passage_terms(docs: DataFrame) -> DataFrame:
    """The terms of all passages of all documents, written once, in lots of LOT passages at most; and in how many documents each occurs.

    A lot holds the distinct term buckets of its passages (2 bytes each): first those that one passage has, one passage after another, then the others.
    Besides how many of the first each passage has (1 byte), and of the others in how many passages each is (1 byte) and, one bucket after another,
    these passages' numbers (1 byte each); and of all how often a passage has them (1 byte each). Each partition ends with a row that has no lot but,
    for each bucket, the number of its documents with it, and for -1 of all.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, rows, some, row_bits, time_bits = np.zeros(1 << BITS, np.int64), 0, (1 << BITS) - 1, LOT.bit_length(), PASSAGE.bit_length()
        for batch in batches:
            rows += len(batch)
            for begin in range(0, len(batch), 200):
                hashes, counts = words_of_all(list(batch["text"].iloc[begin : begin + 200]), WORD_BYTES)
                if not len(hashes):
                    continue
                terms_, owner = buckets(hashes), np.repeat(np.arange(len(counts)), counts)
                cells = ((owner << BITS) + terms_).astype(np.int32)
                cells.sort()
                found += np.bincount(cells[np.diff(cells, prepend=-1) > 0] & some, minlength=1 << BITS)
                first = (np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)) % PASSAGE == 0
                passage = np.cumsum(first) - 1
                keys, times = np.unique(((passage // LOT << BITS) + terms_ << row_bits) + passage % LOT, return_counts=True)
                one = np.ones(len(keys), bool)  # entries whose bucket is in no other passage of the lot
                one[1:] = keys[1:] >> row_bits != keys[:-1] >> row_bits
                heads = np.flatnonzero(one)
                one[:-1] &= one[1:]
                lot, place = keys >> BITS + row_bits, keys & (1 << row_bits) - 1
                passages = np.bincount(passage[first] // LOT)
                own = lot * LOT + place  # all lots but the last are full
                alone = np.bincount(own[one], minlength=passages.sum()).astype(np.uint8)
                order = np.sort(((own[one] << BITS) + (keys[one] >> row_bits & some) << time_bits) + times[one])
                several = heads[~one[heads]]
                held = np.diff(np.append(heads, len(keys)))[~one[heads]].astype(np.uint8)
                parts = [
                    ((order >> time_bits & some).astype(np.uint16), np.bincount(lot[one], minlength=len(passages))),
                    ((order & (1 << time_bits) - 1).astype(np.uint8), np.bincount(lot[one], minlength=len(passages))),
                    (alone, passages), (held, np.bincount(lot[several], minlength=len(passages))),
                    ((keys[several] >> row_bits & some).astype(np.uint16), np.bincount(lot[several], minlength=len(passages))),
                    (place[~one].astype(np.uint8), np.bincount(lot[~one], minlength=len(passages))), (times[~one].astype(np.uint8), np.bincount(lot[~one], minlength=len(passages))),
                ]
                terms_one, times_one, alone, held, terms_more, places, times_more = ([x.tobytes() for x in np.split(part, np.cumsum(sizes)[:-1])] for part, sizes in parts)
                yield pd.DataFrame({
                    "terms": [a + b for a, b in zip(terms_one, terms_more, strict=True)], "alone": alone, "held": held, "places": places,
                    "times": [a + b for a, b in zip(times_one, times_more, strict=True)], "bucket": None, "n": None,
                })
        used = np.flatnonzero(found)
        yield pd.DataFrame({"terms": [None], "alone": [None], "held": [None], "places": [None], "times": [None], "bucket": [np.append(used, -1)], "n": [np.append(found[used], rows)]})

    return cut(docs.select("text").mapInPandas(count, "terms binary, alone binary, held binary, places binary, times binary, bucket array<bigint>, n array<bigint>"))


def document_counts(passages: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each term bucket occurs, over all documents, and their number. Partitions have added up theirs."""
    pairs = passages.where("terms is null").select(F.explode(F.arrays_zip("bucket", "n")).alias("x")).select("x.*")
    out, rows = np.zeros(1 << BITS, np.int64), 0
    for r in pairs.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r["bucket"] < 0:
            rows = r["n"]
        else:
            out[r["bucket"]] = r["n"]
    return out, rows


def _lots(rows: pd.DataFrame, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(distinct term buckets, how many each passage has alone, cells, values) of each lot. Values are first those of the buckets that one passage has.

    The others have a cell each: the place of the bucket among those that several passages have, times the number of passages, plus the passage.
    """
    joined = [b"".join(rows[c]) for c in ("terms", "alone", "held", "places", "times")]
    distinct, alone, held, places, times = (np.frombuffer(x, np.uint16 if k == 0 else np.uint8) for k, x in enumerate(joined))
    passages, several, entries = (rows[c].str.len().to_numpy() for c in ("alone", "held", "times"))
    distinct, passages_to, entries_to = distinct.astype(np.int64), np.cumsum(passages), np.cumsum(entries)
    buckets_in = rows["terms"].str.len().to_numpy() // 2
    buckets_to = np.cumsum(buckets_in)
    single = np.arange(len(distinct)) < np.repeat(buckets_to - several, buckets_in)
    each = np.ones(len(distinct), np.int64)
    each[~single] = held
    first, passage = np.repeat(single, each), np.empty(len(times), np.int64)
    passage[first] = np.repeat(np.arange(len(alone)), alone)
    local, count = places.astype(np.int64), np.repeat(passages, entries)[~first]
    passage[~first] = local + np.repeat(passages_to - passages, entries)[~first]
    values = times * np.repeat(idf[distinct], each)
    values /= np.maximum(np.sqrt(np.bincount(passage, values**2, len(alone))), 1e-9).astype(np.float32)[passage]
    cells = np.repeat(np.arange(len(held)) - np.repeat(np.cumsum(several) - several, several), held) * count + local
    cells_to = np.cumsum(entries - buckets_in + several)
    for k in range(len(rows)):
        cell, bucket, entry, passage_to = cells_to[k], buckets_to[k], entries_to[k], passages_to[k]
        yield distinct[bucket - buckets_in[k] : bucket], alone[passage_to - passages[k] : passage_to], cells[cell - (entries[k] - buckets_in[k] + several[k]) : cell], values[entry - entries[k] : entry]


def _products(passages: DataFrame, idf: np.ndarray, basis: np.ndarray, small: bool = False) -> np.ndarray:
    """A'A times a basis, A being the unit TF-IDF rows of all passages; small: the square matrix of the basis, A'A and the basis.

    Each task adds up its part, Spark adds the parts by slices.
    """
    context = passages.sparkSession.sparkContext
    shared = context.broadcast((idf.astype(np.float32), basis.astype(np.float32)))
    slices = 64

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, basis = shared.value
        total = np.zeros((basis.shape[1], basis.shape[1]) if small else basis.shape)
        room, taken, product, added, some = np.empty(basis.shape[0] * LOT, np.float32), *(np.empty_like(basis) for _ in range(3)), np.zeros_like(basis)  # kept, as new memory costs more than the sums
        done = 0
        for batch in batches:
            for distinct, alone, cells, values in (lot for at in range(0, len(batch), LOTS_AT_ONCE) for lot in _lots(batch[at : at + LOTS_AT_ONCE], idf)):
                begins, single = np.cumsum(alone, dtype=np.int64) - alone, int(alone.sum(dtype=np.int64))
                lot, narrow = room[: (len(distinct) - single) * len(alone)], np.zeros((single, TOGETHER), np.float32)
                lot[:] = 0
                lot[cells] = values[single:]
                lot = lot.reshape(-1, len(alone))
                narrow[np.arange(single), np.repeat(np.arange(len(alone)) % TOGETHER, alone)] = values[:single]
                edges = [*begins[::TOGETHER].tolist(), single]
                groups = [(slice(k * TOGETHER, min((k + 1) * TOGETHER, len(alone))), slice(low, high)) for k, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
                vectors = basis.take(distinct, axis=0, out=taken[: len(distinct)], mode="clip")
                placed = lot.T @ vectors[single:]
                for these, own in groups:
                    placed[these] += narrow[own, : these.stop - these.start].T @ vectors[own]
                if small:
                    total += placed.T @ placed
                    continue
                more = product[: len(distinct)]
                np.matmul(lot, placed, out=more[single:])
                for these, own in groups:
                    np.matmul(narrow[own, : these.stop - these.start], placed[these], out=more[own])
                more += some.take(distinct, axis=0, out=added[: len(distinct)], mode="clip")
                some[distinct] = more
                done += 1
                if done % ADDED == 0:
                    total += some
                    some[:] = 0
        if not small:
            total += some
        yield pd.DataFrame({"slice": range(slices), "part": [x.tobytes() for x in np.split(total, slices)]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x) for x in rows["part"]], axis=0)
        return pd.DataFrame({"slice": rows["slice"][:1], "part": [total.tobytes()]})

    lots = passages.where("terms is not null").select("terms", "alone", "held", "places", "times").coalesce(2 * context.defaultParallelism)  # so many parts to add
    summed = lots.mapInPandas(multiply, "slice int, part binary").groupBy("slice").applyInPandas(add, "slice int, part binary")
    got = sorted((r["slice"], bytes(r["part"])) for r in summed.collect())
    shared.destroy()
    return np.concatenate([np.frombuffer(x) for _, x in got]).reshape(-1, basis.shape[1])


def latent_space(passages: DataFrame, idf: np.ndarray, seed: int = 7) -> np.ndarray:
    """A vector for each term bucket: its idf times its row of the leading right singular vectors, each divided by its singular value."""
    basis = np.random.default_rng(seed).normal(size=(1 << BITS, RANK + SPARE))
    for _ in range(ROUNDS):
        basis = np.linalg.qr(_products(passages, idf, basis))[0]
    inner = _products(passages, idf, basis, small=True)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-values)[:RANK]
    return (idf[:, None] * (basis @ vectors[:, order]) / np.sqrt(np.maximum(values[order], 1e-9))).astype(np.float32)


def bits_of(needle: np.ndarray) -> dict[int, int]:
    """For each word of the needle, a number with the bits of its places."""
    masks: dict[int, int] = {}
    for k, word in enumerate(needle.tolist()):
        masks[word] = masks.get(word, 0) | 1 << k
    return masks


def subsequence(needle: np.ndarray, text: np.ndarray, masks: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, a word of the text at a time, with one bit for each word of the needle. masks: bits_of it, if known."""
    masks = bits_of(needle) if masks is None else masks
    every = (1 << len(needle)) - 1
    state = every
    for mask in filter(None, map(masks.get, text.tolist())):
        hit = state & mask
        state = (state + hit) | (state - hit)  # what is carried beyond the last bit reaches no other
    return len(needle) - (state & every).bit_count()


def answer_of(item: np.ndarray) -> np.ndarray:
    return item[-max(4, int(len(item) * ANSWER)) :]


def confirmed(item: np.ndarray, region: np.ndarray, masks: dict[int, int] | None = None) -> tuple[float, bool]:
    """(share of the item's words found in order, whether that is a leak): many of them, or fewer that hold the answer."""
    share = subsequence(item, region, masks) / len(item)
    if share >= SHARE:
        return share, True
    answer = answer_of(item)
    return share, share >= LOWER and subsequence(answer, region) >= ANSWER_SHARE * len(answer)


@dataclass
class Items:
    """Benchmark items: ids, words, unit vectors, and for each window length in blocks the items it is made for.

    vocabulary holds all words, sorted; table says where those with the same leading bits begin there, and most how many these are at most.
    counted has, for each window length, its items' distinct words as places in the vocabulary (filled up with a place after the last), how often
    an item has each, and how often its answer has. holders has the same by word: for each word of the vocabulary where its items begin in a
    list of all, this list, and both numbers. Words that COMMON items have or more are not there but in common: their places in the vocabulary, and
    both numbers as matrices, words by items. masks are the items' words as subsequence takes them, lengths their number, answered the words of its
    answer that an item needs.

    Besides, the rare words: for each word of the vocabulary where the items that it is rare for begin in a list of all; rare_needed says for
    each item how many of its rare words a region must hold at least.
    """

    ids: list[int]
    words: list[np.ndarray]
    vectors: np.ndarray
    scales: list[tuple[int, np.ndarray]]
    vocabulary: np.ndarray
    table: np.ndarray
    most: int
    counted: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    holders: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    common: tuple[np.ndarray, np.ndarray, np.ndarray]
    masks: list[dict[int, int]]
    lengths: np.ndarray
    answered: np.ndarray
    rare_begins: np.ndarray
    rare_items: np.ndarray
    rare_needed: np.ndarray


def rare_words(words: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, int]:
    """(rare words of an item, how many places of a region must hold one of them if the region holds LOWER of the item in order).

    If `least` of n words are there, at most n - least are not, so of any n - least + k words at least k are there.
    """
    least = int(np.ceil(LOWER * len(words) - 1e-9))
    needed = max(1, int(least * RARE))
    return np.unique(words[np.argsort(often, kind="stable")[: len(words) - least + needed]]), needed


def make_items(rows: list[tuple[int, str]], space: np.ndarray, often: np.ndarray | None = None) -> Items:
    """Items with at least four words, grouped by the window length that suits them. often: in how many documents each term bucket occurs."""
    usable = [(i, w) for i, w in ((i, terms(t)) for i, t in rows) if len(w) >= 4]
    vectors = np.array([space[buckets(w)].sum(axis=0) for _, w in usable]).reshape(len(usable), RANK)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    lengths, scales, at = np.array([len(w) for _, w in usable]), [], 2
    left = np.ones(len(usable), bool)
    while left.any():
        fits = left & (lengths * SLACK <= at * BLOCK)
        if fits.any():
            scales.append((at, np.flatnonzero(fits)))
        left &= ~fits
        at += max(1, at // 2)
    words = [w for _, w in usable]
    vocabulary = np.unique(np.concatenate(words)) if words else np.empty(0, np.uint64)
    counted = []
    for _, chosen in scales:
        distinct = [np.unique(words[k], return_counts=True) for k in chosen]
        where = np.full((len(chosen), max(len(u) for u, _ in distinct)), len(vocabulary))
        times, answers = np.zeros(where.shape, np.int64), np.zeros(where.shape, np.int64)
        for row, (k, (u, n)) in enumerate(zip(chosen, distinct, strict=True)):
            where[row, : len(u)], times[row, : len(u)] = np.searchsorted(vocabulary, u), n
            np.add.at(answers[row], np.searchsorted(u, answer_of(words[k])), 1)
        counted.append((where, times, answers))
    every = np.arange(len(vocabulary) + 2)  # with the place after the last, which no item has
    held = [(where, np.broadcast_to(chosen[:, None], where.shape), times, answers) for (_, chosen), (where, times, answers) in zip(scales, counted, strict=True)]
    held = np.concatenate([np.empty((4, 0), np.int64), *(np.stack([x[part[2] > 0] for x in part]) for part in held)], axis=1)
    held = held[:, np.argsort(held[0], kind="stable")]
    shared = (np.bincount(held[0], minlength=len(vocabulary)) >= COMMON)[held[0]]
    common, row = np.unique(held[0, shared], return_inverse=True)
    numbers = np.zeros((2, len(common), len(usable)), np.float32)
    numbers[:, row, held[1, shared]] = held[2:, shared]
    held = held[:, ~shared]
    rare = [rare_words(w, (np.zeros(1 << BITS) if often is None else often)[buckets(w)]) for w in words]
    rare_places = np.searchsorted(vocabulary, np.concatenate([np.empty(0, np.uint64), *(w for w, _ in rare)]))
    order = np.argsort(rare_places, kind="stable")
    leading = (vocabulary >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return Items(
        ids=[i for i, _ in usable], words=words, vectors=vectors.astype(np.float32), scales=scales, vocabulary=vocabulary,
        table=np.searchsorted(leading, np.arange(1 << FILTER_BITS)).astype(np.int32), most=int(np.bincount(leading).max(initial=0)), counted=counted,
        holders=(np.searchsorted(held[0], every), *held[1:]), common=(common, *numbers), masks=[bits_of(w) for w in words],
        lengths=lengths, answered=ANSWER_SHARE * np.array([len(answer_of(w)) for w in words]),
        rare_begins=np.searchsorted(rare_places[order], every), rare_items=np.repeat(np.arange(len(rare)), [len(w) for w, _ in rare])[order],
        rare_needed=np.array([k for _, k in rare], np.int64),
    )


def places_of(hashes: np.ndarray, items: Items) -> np.ndarray:
    """The place in the vocabulary of each word; the place after the last for those that no item has."""
    out, last = np.full(len(hashes), len(items.vocabulary)), len(items.vocabulary) - 1
    begins = items.table[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
    for k in range(items.most):
        place = np.minimum(begins + k, last)
        same = np.flatnonzero(items.vocabulary[place] == hashes)
        out[same] = place[same]
    return out


@dataclass
class Parts:
    """Parts of texts that overlap by half, so that `reach` words of a text that stand together lie within one part.

    A text is cut into pieces of `reach` words. A part is two pieces, from `first` to `last`, or one if its text has no more; begins has each
    text's first part, ends its last.
    """

    reach: int
    begins: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, reach: int) -> Parts:
        """The parts of texts with so many words, none without."""
        pieces = -(-words // reach)
        count = np.maximum(pieces - 1, 1)
        ends = np.cumsum(count) - 1
        first = np.arange(count.sum()) + np.repeat(np.cumsum(pieces) - pieces - (ends + 1 - count), count)
        return cls(reach, ends + 1 - count, ends, first, first + np.repeat(pieces > 1, count))

    def at(self, text: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The part that holds the next `reach` words of a text from a word on, or those left."""
        return np.minimum(self.begins[text] + word // self.reach, self.ends[text])


def held_by_texts(place: np.ndarray, owner: np.ndarray, texts: int, items: Items, parts: Parts | None = None) -> np.ndarray:
    """Whether a text holds enough of an item's words, anywhere and in any order, for the checks to accept a region of it: texts by items.

    place is the place in the vocabulary of every word of the texts, owner its text. With parts, owner is the piece of a word, and parts are
    asked for instead of texts.
    """
    begins, holder, times, answers = items.holders
    common, common_times, common_answers = items.common
    size, count = len(items.vocabulary) + 1, len(items.ids)
    firsts, lasts = (np.arange(texts), np.arange(texts)) if parts is None else (parts.first, parts.last)
    out, step = np.zeros((len(firsts), count), bool), max(1, 4_000_000 // max(size, count))
    for at in range(0, len(out), step):
        first, last = firsts[at : at + step], lasts[at : at + step]
        words, rows = slice(*np.searchsorted(owner, [first[0], last[-1] + 1])), len(first)
        seen = np.zeros((last[-1] + 1 - first[0], size), bool)
        seen[owner[words] - first[0], place[words]] = True
        if parts is not None:
            seen = seen.take(first - first[0], axis=0) | seen.take(last - first[0], axis=0)
        often = seen[:, common].astype(np.float32)
        seen[:, common] = False
        text, word = np.divmod(np.flatnonzero(seen), size)
        row, entry = ranges(begins[word], begins[word + 1] - 1)
        cell = text[row] * count + holder[entry]
        share = (np.bincount(cell, times[entry], rows * count).reshape(rows, count) + often @ common_times) / items.lengths
        unsure = ((share >= LOWER) & (share < SHARE)).ravel()
        some, unsure = np.flatnonzero(unsure[cell]), np.flatnonzero(unsure)
        text, item = np.divmod(unsure, count)
        answered = np.bincount(cell[some], answers[entry[some]], rows * count)[unsure] + np.einsum("ij,ji->i", often[text], common_answers[:, item])
        held = share >= SHARE
        held[text, item] = answered >= items.answered[item]
        out[at : at + rows] = held
    return out


def rare_places(place: np.ndarray, at: np.ndarray, one: np.ndarray, other: np.ndarray, held: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(item, place) of all places where a rare word of an item stands, sorted, in parts of texts that hold enough of the item.

    at are the places of the items' words, place their places in the vocabulary, one and other the parts that they lie in.
    """
    some = held.any(axis=1)
    chosen = np.flatnonzero(some[one] | some[other])
    row, entry = ranges(items.rare_begins[place[chosen]], items.rare_begins[place[chosen] + 1] - 1)
    item, row = items.rare_items[entry], chosen[row]
    kept = held[one[row], item] | held[other[row], item]
    item, at = item[kept], at[row[kept]]
    end = at.max(initial=0) + 1
    return np.divmod(np.sort(item * end + at), end)


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of all numbers from low to high, both inside, of each row."""
    sizes = np.maximum(high - low + 1, 0)
    row = np.repeat(np.arange(len(low)), sizes)
    return row, np.repeat(low, sizes) + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def possible(region: np.ndarray, begins: np.ndarray, ends: np.ndarray, place: np.ndarray, item: np.ndarray, scale: int, items: Items) -> np.ndarray:
    """Whether a region holds enough of an item's words, in any order, for the checks to accept it. Regions are sorted; begins and ends are theirs.

    place is the place in the vocabulary of every word of the texts, item the place of the item in its scale.
    """
    where, times, answers = items.counted[scale]
    sizes = times.sum(axis=1)[item]
    needed = ANSWER_SHARE * answers.sum(axis=1)[item]
    out = np.zeros(len(region), bool)
    step = max(1, min(4_000_000 // (len(items.vocabulary) + 1), 1_000_000 // where.shape[1]))
    for at in range(0, len(region), step):
        part = slice(at, at + step)
        new = np.diff(region[part], prepend=-1) > 0
        row = np.cumsum(new) - 1
        seen = np.zeros((row[-1] + 1, len(items.vocabulary) + 1), bool)
        owner, word = ranges(begins[part][new], ends[part][new] - 1)
        seen[owner, place[word]] = True
        held = seen[row[:, None], where[item[part]]]
        share = (held * times[item[part]]).sum(axis=1) / sizes[part]
        out[part] = (share >= SHARE) | (share >= LOWER) & ((held * answers[item[part]]).sum(axis=1) >= needed[part])
    return out


def own_parts(held: np.ndarray, parts: Parts, begins: np.ndarray, sizes: np.ndarray, place: np.ndarray, items: Items) -> list[tuple[Parts, np.ndarray]]:
    """For each window length, parts of texts that reach as far as its regions do, and which of them hold enough of its items: parts by items.

    held says so for parts that reach as far as the longest region, and only those that do are cut into shorter ones. begins and sizes are those of the texts,
    place is the place in the vocabulary of every word.
    """
    out = []
    for scale, (length, chosen) in enumerate(items.scales):
        reach, own, enough = (length + 2 * (length // 2)) * BLOCK, parts, held[:, chosen]
        if 2 * reach <= parts.reach and enough.any():
            own = Parts.of(sizes, reach)
            text = np.repeat(np.arange(len(sizes)), own.ends + 1 - own.begins)
            piece = own.first[own.begins][text]
            low, high = (own.first - piece) * reach, np.minimum((own.last + 1 - piece) * reach, sizes[text])
            enough = enough[parts.at(text, low)]  # a part of two pieces lies within one of the longer parts
            part, item = enough.nonzero()
            enough[part, item] = possible(part, (begins[text] + low)[part], (begins[text] + high)[part], place, item, scale, items)
        out.append((own, enough))
    return out


def block_sums(hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray, blocks: np.ndarray, looked_at: list[tuple[Parts, np.ndarray]], space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, place): running sums of the vectors of all words of the blocks in parts that hold enough of an item, none first, and each block's place.

    The sums before and after a block are those at its place and the next; parts hold whole blocks, so blocks of a part stand one after another.
    """
    text = np.repeat(np.arange(len(blocks)), blocks)
    word = (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
    kept = np.zeros(len(text), bool)
    for parts, enough in looked_at:
        some = enough.any(axis=1)
        if some.any():
            kept |= some[parts.at(text, word)] | some[parts.at(text, np.maximum(word - parts.reach, 0))]
    at = (begins[text] + word)[kept]
    left, buckets_of = ends[text[kept]] - at, buckets(hashes)
    sums, more = np.empty((len(at) + 1, RANK), np.float32), np.empty((len(at), RANK), np.float32)
    sums[0], summed = 0, sums[1:]
    space.take(buckets_of[at], axis=0, out=summed, mode="clip")
    for k in range(1, BLOCK):  # a word of every block at a time
        space.take(buckets_of[np.minimum(at + k, len(hashes) - 1)], axis=0, out=more, mode="clip")
        more[left <= k] = 0
        summed += more
    np.cumsum(summed, axis=0, out=summed)
    return sums, np.cumsum(kept) - kept


def leaks_in(hashes: np.ndarray, counts: np.ndarray, items: Items, space: np.ndarray) -> list[tuple[int, int, float, float]]:
    """(text, item, cosine, share) of the items that texts hold; the texts' words stand one after another, counts says how many each has.

    A window's region is the window and half of it to both sides. A window is a candidate for an item where their cosine is high, or where
    its region holds as many of the item's rare words as a leak must. The latter overlooks none that the checks accept, so the outcome is that
    of checking every region for every item. Regions are compared word by word if they hold enough of the item's words, and of its
    answer's, in any order, which bounds the subsequences from above; the same is asked of parts of
    texts first, for all of their regions at once (of long parts, then of those as long as an item's regions need), and only windows in parts that may
    hold an item have a vector and cosines, as no other can be a leak.
    Of an item's regions in a text the one with the largest share counts, then the largest cosine.
    """
    texts = np.flatnonzero(counts)
    if not len(texts):
        return []
    sizes = counts[texts]
    ends_of = np.cumsum(counts)[texts]
    begins = ends_of - sizes
    blocks = -(-sizes // BLOCK)
    first = np.cumsum(blocks) - blocks
    best: dict[tuple[int, int], tuple[float, float]] = {}
    place, text_of = places_of(hashes, items), np.repeat(np.arange(len(texts)), sizes)
    known = np.flatnonzero(place < len(items.vocabulary))  # no other word is in any subsequence
    known_words = hashes[known]
    reach = max((length + 2 * (length // 2)) * BLOCK for length, _ in items.scales)  # the longest region
    parts, known_text = Parts.of(sizes, reach), text_of[known]
    word = known - begins[known_text]
    one, two = parts.at(known_text, word), parts.at(known_text, np.maximum(word - reach, 0))
    held = held_by_texts(place[known], parts.first[parts.begins][known_text] + word // reach, len(texts), items, parts)
    rare_item, rare_place = rare_places(place[known], known, one, two, held, items)
    rare_text = text_of[rare_place]
    looked_at = own_parts(held, parts, begins, sizes, place, items)
    sums, summed_to = block_sums(hashes, begins, ends_of, blocks, looked_at, space)
    for scale, ((length, chosen), (parts, enough)) in enumerate(zip(items.scales, looked_at, strict=True)):
        wanted = enough.any(axis=1)
        if not wanted.any():
            continue
        step = max(1, length // STEP)
        windows = np.maximum(1, -(-(blocks - length + step) // step))
        before = np.cumsum(windows) - windows
        owner = np.repeat(np.arange(len(texts)), windows)
        offset = (np.arange(len(owner)) - np.repeat(before, windows)) * step
        part = parts.at(owner, np.maximum(offset - length // 2, 0) * BLOCK)
        looked = np.flatnonzero(wanted[part])  # no other window is a candidate for any of these items
        if not len(looked):
            continue
        text, offset_in = owner[looked], offset[looked]
        starts, ends = first[text] + offset_in, first[text] + np.minimum(offset_in + length, blocks[text])
        rows = sums[summed_to[ends - 1] + 1] - sums[summed_to[starts]]
        rows /= np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-9)[:, None]
        cosines = rows @ items.vectors[chosen].T
        w, c = np.divmod(np.flatnonzero(cosines >= COSINE), len(chosen))
        w = looked[w]
        # Regions that hold enough rare places: all from the first to the last window that reaches over a place and the needed-th from it.
        local = np.full(len(items.words), -1)
        local[chosen] = np.arange(len(chosen))
        own = local[rare_item] >= 0
        at_item, at_place, at_text = rare_item[own], rare_place[own], rare_text[own]
        last = np.arange(len(at_item)) + items.rare_needed[at_item] - 1
        inside = last < len(at_item)
        at_item, at_text, low, last = at_item[inside], at_text[inside], at_place[inside], last[inside]
        high = at_place[last]
        near = (rare_item[own][last] == at_item) & (rare_text[own][last] == at_text) & (high - low < (length + 2 * (length // 2)) * BLOCK)
        at_item, at_text, low, high = at_item[near], at_text[near], low[near] - begins[at_text[near]], high[near] - begins[at_text[near]]
        over = (length + length // 2) * BLOCK
        row, number = ranges(np.maximum(0, (high - over) // (BLOCK * step) + 1), np.minimum(windows[at_text] - 1, (low // BLOCK + length // 2) // step))
        pairs = np.unique(np.concatenate([w * len(chosen) + c, (before[at_text[row]] + number) * len(chosen) + local[at_item[row]]]))
        w, c = pairs // len(chosen), pairs % len(chosen)
        stays = enough[part[w], c]
        w, c = w[stays], c[stays]
        if not len(w):
            continue
        left = np.maximum(begins[owner[w]], begins[owner[w]] + (offset[w] - length // 2) * BLOCK)
        right = np.minimum(ends_of[owner[w]], begins[owner[w]] + (offset[w] + length + length // 2) * BLOCK)
        stays = possible(w, left, right, place, c, scale, items)
        w, c, left, right = w[stays], c[stays], left[stays], right[stays]
        left, right = np.searchsorted(known, left), np.searchsorted(known, right)
        for text, item, begin, end, cosine in zip(owner[w].tolist(), chosen[c].tolist(), left.tolist(), right.tolist(), cosines[np.searchsorted(looked, w), c].tolist(), strict=True):
            share, leak = confirmed(items.words[item], known_words[begin:end], items.masks[item])
            if leak and (share, cosine) > best.get((text, item), (-1.0, 0.0))[::-1]:
                best[text, item] = (cosine, share)
    return [(int(texts[t]), items.ids[k], *v) for (t, k), v in sorted(best.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, share): the benchmark items that each document holds, word for word or reworded. Clean documents have no row.

    Term statistics and the latent space cover all passages of all documents, whose terms are written once and read by each round of the fit;
    every part of every text is asked for every item's words, and every window of the parts that hold enough of them is searched. The space cannot lose a
    leak, for windows that it overlooks are found by their rare words. Items are taken ITEMS at a time, one pass over the documents for each lot. Null or empty texts, items of fewer
    than four words, and rows with a null id hold or are nothing. Rows that repeat an id are searched on their own.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id is not null and text is not null")
    kind = rows.schema["doc_id"].dataType.simpleString()
    passages = passage_terms(rows)
    counts, total = document_counts(passages)
    schema = f"doc_id {kind}, item_id bigint, cosine double, share double"
    if not counts.any():
        release(passages)
        return spark.createDataFrame([], schema)
    idf = np.where(counts > 0, np.log((1 + total) / (1 + counts)) + 0.1, 0.0)
    space = latent_space(passages, idf)
    release(passages)
    wanted = benchmark.select(F.col(f"`{item}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text")).where("item_id is not null and text is not null")

    def search(items: Items) -> DataFrame:
        shared = spark.sparkContext.broadcast((items, space))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            items, space = shared.value
            for batch in batches:
                ids = batch["doc_id"].to_numpy()
                hashes, counts = words_of_all(list(batch["text"]), WORD_BYTES)
                ends, begin = np.cumsum(counts), 0
                while begin < len(ids):  # some texts at a time, so that sums stay short
                    done = ends[begin - 1] if begin else 0
                    end = max(begin + 1, int(np.searchsorted(ends, done + WORDS_AT_ONCE, side="right")))
                    found = leaks_in(hashes[done : ends[end - 1]], counts[begin:end], items, space)
                    yield pd.DataFrame([(ids[begin + t], *leak) for t, *leak in found], columns=["doc_id", "item_id", "cosine", "share"])
                    begin = end

        return rows.mapInPandas(run, schema)

    out, after = spark.createDataFrame([], schema), None
    while True:
        lot = wanted if after is None else wanted.where(F.struct("item_id", "text") > F.struct(F.lit(after[0]).alias("item_id"), F.lit(after[1]).alias("text")))
        got = [(r["item_id"], r["text"]) for r in lot.orderBy("item_id", "text").limit(ITEMS).collect()]
        items = make_items(got, space, counts)
        if items.ids:
            out = out.unionByName(search(items)) if after is not None else search(items)
        if len(got) < ITEMS:
            return out
        after = got[-1]
