"""Word shingles of a text as sorted 64-bit hashes, and min-max signatures cut into bands."""

from __future__ import annotations

import math
from functools import cache

import numpy as np

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


#: Bytes that belong to a word: all but ASCII white space, and letters, digits and all of UTF-8 beyond ASCII.
NOT_WHITE = ~np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
WORD_BYTES = np.array([x > 127 or chr(x).isalnum() for x in range(256)])
_BASE = 0x5851F42D4C957F2D
_PIECE = 1 << 20
#: Bytes of short texts that are hashed together: few enough that the sums stay near the processor.
_TOGETHER = 1 << 16


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(_PIECE - 1, base, np.uint64)]))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    return _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def word_hashes(text: str | None, members: np.ndarray = NOT_WHITE) -> np.ndarray:
    """A 64-bit hash of each word, in order. A word is a run of member bytes of the UTF-8 text with A-Z lower-cased.

    Words are hashed all at once: sums of bytes times powers of a base, shifted back to each word's start.
    """
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() knows only ASCII
    if len(data) <= _PIECE:
        return _word_hashes(data, members)[0]
    out, begin = [], 0
    while begin < len(data):
        end = min(begin + _PIECE, len(data))
        if end < len(data):  # cut between words
            gaps = np.flatnonzero(~members[np.frombuffer(data, np.uint8, end - begin, begin)])
            if not len(gaps):
                word, begin = _long_word(data, begin, members)
                out.append(word)
                continue
            end = begin + int(gaps[-1]) + 1
        out.append(_word_hashes(data[begin:end], members)[0])
        begin = end
    return np.concatenate(out)


def _long_word(data: bytes, begin: int, members: np.ndarray) -> tuple[np.ndarray, int]:
    """The hash of a word of more than one piece and where it ends: its pieces' sums are shifted to their place in the word and added."""
    powers, total, place = _tables()[0], 0, begin
    while place < len(data):
        raw = np.frombuffer(data, np.uint8, min(_PIECE, len(data) - place), place)
        gaps = np.flatnonzero(~members[raw])
        raw = raw[: gaps[0]] if len(gaps) else raw
        with np.errstate(over="ignore"):
            part = int(((raw + np.uint64(1)) * powers[: len(raw)]).sum(dtype=np.uint64))
        total = (total + part * pow(_BASE, place - begin, 1 << 64)) % (1 << 64)
        place += len(raw)
        if len(gaps):
            break
    with np.errstate(over="ignore"):
        return mix(np.array([total], np.uint64) + np.array([place - begin], np.uint64) * _A), place


def words_of_all(texts: list[str], members: np.ndarray = NOT_WHITE) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of many texts one after another, and how many each text has; faster than a text at a time."""
    out, counts, held, size = [], [], [], 0

    def flush() -> None:
        nonlocal size
        hashes, starts = _word_hashes(b" ".join(held), members)
        edges = np.cumsum([0, *(len(d) + 1 for d in held)])
        counts.append(np.diff(np.searchsorted(starts, edges)))
        out.append(hashes)
        held.clear()
        size = 0

    for text in texts:
        data = text.encode("utf-8", "surrogatepass").lower()
        if held and size + len(data) + 1 > _TOGETHER:
            flush()
        if len(data) > _TOGETHER:
            out.append(word_hashes(text, members))
            counts.append(np.array([len(out[-1])]))
        else:
            held.append(data)
            size += len(data) + 1
    if held:
        flush()
    empty = np.empty(0, np.int64)
    return np.concatenate([empty.astype(np.uint64), *out]), np.concatenate([empty, *counts])


def _word_hashes(data: bytes, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    members.take(raw, out=inside[1:-1], mode="clip")
    starts, ends = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2).T
    powers, inverse = _tables()
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        values = sums[1:]
        np.add(raw, np.uint64(1), out=values)
        values *= powers[: len(raw)]
        np.cumsum(values, out=values)
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _A), starts


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` words, in order; with fewer words, one for the whole sequence; without words, none."""
    if not len(words):
        return words
    size = min(size, len(words))
    count = len(words) - size + 1
    out = np.full(count, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out ^ (out >> np.uint64(29))) * _A + words[k : k + count]
    return mix(out)


def shingle_hashes_at(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The hashes of shingle_hashes at the given places only, each with `size` words from there on."""
    out = np.full(len(starts), size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out ^ (out >> np.uint64(29))) * _A + words[starts + k]
    return mix(out)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` words, in order, put together from runs of twice the length at a time; none with fewer words."""
    count = max(len(words) - size + 1, 0)
    out, run, width, done = np.full(count, size, np.uint64), words, 1, 0
    with np.errstate(over="ignore"):
        while count:
            if size & width:
                out = mix(out * _A + run[done : done + count])
                done += width
            if done == size:
                break
            run, width = mix(run[:-width] * _A + run[width:]), 2 * width
    return out


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text), size))


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle sets of many texts one after another, and the size of each; the same sets as shingle_set, faster than a text at a time."""
    words, counts = words_of_all([t or "" for t in texts])
    ends = np.cumsum(counts)
    room = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    flat, owner = np.empty(room.sum(), np.uint64), np.repeat(np.arange(len(counts)), room)
    stops = np.cumsum(room)
    if len(words) >= size:
        place = np.repeat(np.arange(len(counts)), counts)[: len(words) - size + 1]
        flat[(counts >= size)[owner]] = shingle_hashes(words, size)[np.arange(len(place)) + size <= ends[place]]
    for k in np.flatnonzero((counts > 0) & (counts < size)):
        flat[stops[k] - 1] = shingle_hashes(words[ends[k] - counts[k] : ends[k]], size)[0]
    for begin, end in zip((stops - room).tolist(), stops.tolist(), strict=True):
        flat[begin:end].sort()
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    return flat[new], np.bincount(owner[new], minlength=len(counts))


def banding(threshold: float, miss: float = 1e-6, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the longest bands whose signature of at most `most` values overlooks a pair at the threshold with at most this probability."""
    best = (math.ceil(math.log(miss) / math.log(1 - threshold)), 1)
    for rows in range(2, 17):
        bands = math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))
        bands += bands % 2
        if bands * rows <= most:
            best = (bands, rows)
    return best


class MinMaxHash:
    """Signatures that keep the smallest and the largest value of each permutation: two signature values for one hash evaluation.

    Half of the bands are made of minima, half of maxima, so no band holds both values of one permutation.
    """

    def __init__(self, bands: int, rows: int, seed: int = 7):
        self.bands, self.rows = bands + bands % 2, rows
        draw = np.random.default_rng(seed)
        count = self.bands * rows // 2
        self.factors = draw.integers(0, 2**63, count, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.offsets = draw.integers(0, 2**64, count, dtype=np.uint64)
        self.weights = draw.integers(0, 2**63, rows, dtype=np.uint64) << np.uint64(1) | np.uint64(1)

    def signatures(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A row of minima and maxima for each set; flat holds the sets (none empty) one after another."""
        count, width = len(sizes), len(self.factors)
        low, high = np.empty((count, width), np.uint64), np.empty((count, width), np.uint64)
        ends = np.cumsum(sizes)
        step, first = max(64, 131_072 // width), 0
        while first < count:
            begin = ends[first] - sizes[first]
            last = max(first + 1, int(np.searchsorted(ends, begin + step, side="right")))
            if last == first + 1:  # a long set, in pieces
                parts = [self._values(flat[k : min(k + step, ends[first])]) for k in range(begin, ends[first], step)]
                low[first] = np.min([x.min(axis=0) for x in parts], axis=0)
                high[first] = np.max([x.max(axis=0) for x in parts], axis=0)
            else:
                values, starts = self._values(flat[begin : ends[last - 1]]), ends[first:last] - sizes[first:last] - begin
                low[first:last] = np.minimum.reduceat(values, starts, axis=0)
                high[first:last] = np.maximum.reduceat(values, starts, axis=0)
            first = last
        return np.concatenate([low, high], axis=1)

    def _values(self, shingles: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            values = shingles[:, None] * self.factors
            values += self.offsets
        return values

    def band_keys(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A row of 64-bit band keys for each set (none empty); keys of different bands never meet but by chance."""
        if not len(sizes):
            return np.empty((0, self.bands), np.int64)
        values = self.signatures(flat, sizes)
        with np.errstate(over="ignore"):
            keys = (values.reshape(len(sizes), self.bands, self.rows) * self.weights).sum(axis=2, dtype=np.uint64)
            keys = mix(mix(keys) + np.arange(1, self.bands + 1, dtype=np.uint64) * _A)
        return keys.view(np.int64)


def overlaps(sets: list[np.ndarray], left: int | None = None) -> np.ndarray:
    """Exact sizes of the intersections of sorted sets, as a matrix. left: only the first `left` sets against the rest.

    Only values found in two sets or more can count; they are laid out as a 0/1 matrix of a bounded number of columns at a time.
    """
    sizes = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(often) - 1
    row, column = row[often[column]], place[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    top, rest = (len(sets), 0) if left is None else (left, left)
    out = np.zeros((top, len(sets) - rest))
    step = max(1024, 2_000_000 // max(1, len(sets)))
    for start in range(0, int(often.sum()), step):
        begin, end = np.searchsorted(column, [start, start + step])
        block = np.zeros((len(sets), min(step, int(often.sum()) - start)), np.float32)
        block[row[begin:end], column[begin:end] - start] = 1
        out += block[:top] @ block[rest:].T
    if left is None:
        np.fill_diagonal(out, sizes)
    return out
