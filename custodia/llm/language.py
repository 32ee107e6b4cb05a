"""Language identification with a blended-spectrum string kernel, Nyström landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.llm.common import crc_mod

#: Longest n-gram, bits of the n-gram hash, labelled texts to fit on, landmarks among them, n-grams kept, and the ridge.
ORDERS, BITS, SAMPLE, LANDMARKS, GRAMS, RIDGE = 4, 16, 2400, 128, 8192, 1e-2
#: How steeply a lead over the other languages turns into a score.
SHARPNESS = 6.0
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_FACTORS = np.array([0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1], np.uint32)


def gram_hashes(text: str) -> Iterator[np.ndarray]:
    """For n = 1..ORDERS, the hash of every run of n characters of the lower-cased text."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    with np.errstate(over="ignore"):
        state = np.zeros(len(chars), np.uint32)
        for n in range(min(ORDERS, len(chars))):
            state = (state[: len(chars) - n] ^ (chars[n:] + np.uint32(n))) * _FACTORS[n]
            state ^= state >> np.uint32(15)
            yield (state * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def presence(text: str | None) -> np.ndarray:
    """The n-gram hashes that occur in a text, each once and in order."""
    out = np.zeros(1 << BITS, bool)
    for hashes in gram_hashes(text or ""):
        out[hashes] = True
    return np.flatnonzero(out).astype(np.uint16)


@dataclass
class LanguageModel:
    """languages, the n-gram hashes in use, the landmarks' presence rows, and the weights from kernel values to languages."""

    languages: list[str]
    place: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        """Shared n-grams with each landmark over the geometric mean of both counts."""
        norm = np.sqrt(np.maximum(rows.sum(axis=1), 1))[:, None] * np.sqrt(np.maximum(self.landmarks.sum(axis=1), 1))[None, :]
        return rows @ self.landmarks.T / norm

    def rows_of(self, texts: list[str | None]) -> np.ndarray:
        width = self.landmarks.shape[1]
        out = np.zeros((len(texts), width + 1), np.float32)
        for k, text in enumerate(texts):
            for hashes in gram_hashes(text or ""):
                out[k, self.place[hashes]] = 1
        return out[:, :width]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """A language and a score for each text; und, 0 without a letter."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        names, scores = [], []
        for begin in range(0, len(texts), 256):
            part = texts[begin : begin + 256]
            values = np.exp(SHARPNESS * (self.kernel(self.rows_of(part)) @ self.weights))
            share = values / values.sum(axis=1, keepdims=True)
            best = share.argmax(axis=1)
            known = np.array([t is not None and _LETTER.search(t) is not None for t in part])
            names += [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            scores.append(np.where(known, share[np.arange(len(part)), best], 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def fit_grams(grams: list[np.ndarray], names: list[str], landmarks: int = LANDMARKS, most: int = GRAMS, ridge: float = RIDGE) -> LanguageModel:
    """The model of texts' n-gram hashes and their languages. Landmarks are taken from the languages in turn; only n-grams of theirs are in use."""
    languages = sorted(set(names))
    if not languages:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    labels = np.array([languages.index(n) for n in names])
    turn = np.concatenate([np.column_stack([np.arange((labels == k).sum()), np.flatnonzero(labels == k)]) for k in range(len(languages))])
    chosen = turn[np.argsort(turn[:, 0], kind="stable")][:landmarks, 1]
    often = np.bincount(np.concatenate([grams[k] for k in chosen]), minlength=1 << BITS)
    kept = np.sort(np.argsort(-often, kind="stable")[: min(most, int((often > 0).sum()))])
    place = np.full(1 << BITS, len(kept))
    place[kept] = np.arange(len(kept))

    def rows_of(some: np.ndarray | range) -> np.ndarray:
        out = np.zeros((len(some), len(kept) + 1), np.float32)
        for at, k in enumerate(some):
            out[at, place[grams[k]]] = 1
        return out[:, : len(kept)]

    model = LanguageModel(languages, place, rows_of(chosen), np.zeros((0, 0)))
    values, vectors = np.linalg.eigh(model.kernel(model.landmarks).astype(float))
    good = values > 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    features = np.concatenate([model.kernel(rows_of(range(k, min(k + 256, len(grams))))) for k in range(0, len(grams), 256)]) @ root
    goal = np.where(labels[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weights = np.linalg.solve(features.T @ features + ridge * len(grams) * np.eye(features.shape[1]) / 10, features.T @ goal)
    model.weights = root @ weights
    return model


def fit(docs: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Fit on about `sample` texts of the rows that `learn` allows, the same number of each language, chosen by a hash of the id.

    Only the n-grams that occur, 2 bytes each and at most 128 KB a text, come to the driver. Rows without a language are not learned from.
    """
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), learn.alias("learn")).where("learn and lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    each = sample / max(1, len(counts))
    chosen = rows.limit(0)
    if counts:
        bounds = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(2**63 - 1, int(min(1.0, each / n) * 2.0**63)))])
        chosen = rows.where(F.xxhash64("id").bitwiseAND(F.lit(2**63 - 1)) <= bounds[F.col("lang")])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "lang": batch["lang"], "grams": [presence(t).tobytes() for t in batch["text"]]})

    kind = rows.schema["id"].dataType.simpleString()
    packed = chosen.select("id", "text", "lang").mapInPandas(pack, f"id {kind}, lang string, grams binary").toArrow().to_pylist()
    packed.sort(key=lambda r: (r["lang"], str(r["id"]), r["grams"]))
    return fit_grams([np.frombuffer(r["grams"], np.uint16) for r in packed], [r["lang"] for r in packed])


def annotate(docs: DataFrame, model: LanguageModel, name: str, score: str, text: str = "text") -> DataFrame:
    """docs with the language and the score of each row's text added. Null texts and texts without a letter are und with a score of 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: pd.Series) -> pd.DataFrame:
        names, scores = shared.value.predict(list(texts))
        return pd.DataFrame({"lang": names, "score": scores})

    judged = F.pandas_udf(judge, "lang string, score double").asNondeterministic()  # so that a filter on the result does not run it twice
    both = docs.withColumn("__judged", judged(F.col(f"`{text}`")))
    return both.withColumns({name: F.col("__judged.lang"), score: F.col("__judged.score")}).drop("__judged")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from rows whose crc32 of the id modulo 3 is not 1, applied to all. A null id is held out."""
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(True))
    model = fit(docs, ~held_out)
    return annotate(docs.select("doc_id", "text"), model, "lang_pred", "score").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
