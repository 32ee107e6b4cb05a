"""Toxicity by weak supervision: mined lexicon and pattern voters, a generative label model, a linear classifier on its posterior labels."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.llm.common import crc_mod, hashed_below

#: Labelled texts to learn from, mined voters, lengths of word beginnings that may vote, and the score from which a text is called toxic.
SAMPLE, VOTERS, STEMS, CUTOFF = 12_000, 160, (3, 4, 5, 6, 7, 8), 0.3
#: A mined voter occurs in at least so many toxic texts, this share of them, and so many times as often among toxic texts as among others.
LEAST_TOXIC, LEAST_SHARE, LEAST_LIFT = 5, 0.012, 30.0
_WORD = re.compile(r"[^\W\d_]+")
#: General patterns that vote besides the mined ones; the label model finds out what they are worth.
PATTERNS = {"shouting": re.compile(r"(?:\b[A-Z]{2,}\b\W+){5}"), "marks": re.compile(r"[!?]{3,}"), "stars": re.compile(r"\w\*+\w")}


def word_set(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def terms_of(words: Counter) -> set[str]:
    """What a text could be voted on: its words, the beginnings of its longer words (one star), and those that two words share (two stars)."""
    stems = Counter(w[:n] for w in words for n in STEMS if len(w) > n)
    return set(words) | {s + "*" for s in stems} | {s + "**" for s, n in stems.items() if n > 1}


@dataclass
class ToxicityModel:
    """Voters (words, beginnings, beginnings shared by two words), what the label model found out about them, and the classifier."""

    words: dict[str, int]
    stems: dict[str, int]
    pairs: dict[str, int]
    accuracy: np.ndarray
    correlation: np.ndarray
    weights: np.ndarray

    @property
    def mined(self) -> int:
        return len(self.words) + len(self.stems) + len(self.pairs)

    def votes(self, text: str | None) -> np.ndarray:
        """How often each voter fires on a text, then the general patterns (0 or 1), and the number of words at the end."""
        counts = word_set(text)
        out = np.zeros(self.mined + len(PATTERNS) + 1)
        shared: dict[str, list[int]] = {}
        for word, n in counts.items():
            if (k := self.words.get(word)) is not None:
                out[k] += n
            for length in STEMS:
                if len(word) > length:
                    stem = word[:length]
                    if (k := self.stems.get(stem)) is not None:
                        out[k] += n
                    if stem in self.pairs:
                        shared.setdefault(stem, []).append(n)
        for stem, times in shared.items():
            if len(times) > 1:
                out[self.pairs[stem]] += sum(times)
        out[self.mined : -1] = [bool(p.search(text or "")) for p in PATTERNS.values()]
        out[-1] = sum(counts.values())
        return out

    def features(self, votes: np.ndarray) -> np.ndarray:
        """Which voters fire, how many, how often and how densely, and a constant."""
        mined = votes[:, : self.mined]
        hits = mined.sum(axis=1)
        return np.column_stack(
            [votes[:, :-1] > 0, np.log1p(hits), np.log1p((mined > 0).sum(axis=1)), hits > 1, 10 * hits / np.maximum(votes[:, -1], 1), np.ones(len(votes))]
        )

    def scores(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(votes) @ self.weights, -30, 30)))


def label_model(fires: np.ndarray, gold: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, accuracy, correlation) of 0/1 votes, by expectation maximisation.

    Each voter has a rate of firing on toxic and on other texts. Correlations between voters are measured within the classes; a voter's log
    odds are divided by how much of it other voters repeat, so a hundred voters for one insult do not count a hundred times. The given
    label is one more voter, right 98 times in 100.
    """
    posterior = np.where(gold == 1, 0.9, 0.05)
    prior_gold = np.where(gold == 1, math.log(0.98 / 0.02), math.log(0.02 / 0.98))
    count = fires.shape[1]
    accuracy, correlation = np.zeros((2, count)), np.eye(count)
    for step in range(rounds):
        mass = np.array([posterior.sum(), (1 - posterior).sum()])
        rates = (np.array([posterior @ fires, (1 - posterior) @ fires]) + [[0.5], [0.05]]) / (mass[:, None] + 1)
        accuracy = rates
        if step % 5 == 0:
            rest = fires - np.outer(posterior, rates[0]) - np.outer(1 - posterior, rates[1])
            spread = np.sqrt(np.maximum((rest**2).mean(axis=0), 1e-9))
            correlation = (rest.T @ rest) / len(rest) / np.outer(spread, spread)
        weight = 1 / np.maximum(1, np.clip(correlation, 0, 1).sum(axis=1))
        on, off = np.log(rates[0] / rates[1]) * weight, np.log((1 - rates[0]) / np.maximum(1 - rates[1], 1e-9)) * weight
        odds = math.log(mass[0] / mass[1]) + prior_gold + fires @ on + (1 - fires) @ off
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return posterior, accuracy, correlation


def logistic(x: np.ndarray, p: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton steps."""
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        now = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (now - p) + ridge * weights
        curve = (x * (now * (1 - now) + 1e-6)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def choose_voters(terms: list[tuple[str, int, int]], toxic: int, clean: int, most: int = VOTERS) -> list[str]:
    """Terms by how many toxic texts they mark and how surely, the longest of equals first.

    Left out are terms that a chosen beginning covers, and beginnings that mark the same texts as a chosen longer term.
    """
    rated = []
    for term, bad, good in terms:
        lift = ((bad + 0.5) / (toxic + 1)) / ((good + 0.5) / (clean + 1))
        if bad >= max(LEAST_TOXIC, LEAST_SHARE * toxic) and lift >= LEAST_LIFT:
            rated.append((-bad * math.log(lift), -len(term.rstrip("*")), term, (bad, good)))
    chosen: list[tuple[str, tuple[int, int]]] = []
    for _, _, term, counts in sorted(rated):
        bare = term.rstrip("*")
        covered = any(c.endswith("*") and bare.startswith(c.rstrip("*")) and (c[-2:] != "**" or term[-2:] == "**") for c, _ in chosen)
        repeated = any(n == counts and c.startswith(bare) for c, n in chosen)
        if not covered and not repeated and len(chosen) < most:
            chosen.append((term, counts))
    return [c for c, _ in chosen]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> ToxicityModel:
    """Fit on about `sample` labelled texts that `learn` allows (an expression over doc_id), chosen by a hash of the id.

    Term counts are added up by Spark; only the strongest terms and the sample's votes come to the driver. Conflicting labels of one id count
    as toxic. Without labels of both kinds every text scores 0.
    """
    known = labels.select(F.col("doc_id"), "toxic").where(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, known.count()))
    known = known.where(hashed_below(share, "doc_id"))
    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(known), "doc_id")  # about `sample` rows

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bad, good = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                (bad if toxic == 1 else good).update(terms_of(word_set(text)))
        names = sorted(bad.keys() | good.keys())
        for begin in range(0, len(names), 20_000):
            part = names[begin : begin + 20_000]
            yield pd.DataFrame({"term": part, "bad": [bad[n] for n in part], "good": [good[n] for n in part]})

    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    if not toxic or not clean:
        return ToxicityModel({}, {}, {}, np.zeros((2, 0)), np.eye(0), np.zeros(0))
    counted = rows.mapInPandas(count, "term string, bad bigint, good bigint").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    lift = (F.col("bad") + 0.5) / (toxic + 1) / ((F.col("good") + 0.5) / (clean + 1))
    best = counted.where((F.col("bad") >= max(LEAST_TOXIC, LEAST_SHARE * toxic)) & (lift >= LEAST_LIFT)).orderBy(F.desc(F.col("bad") * F.log(lift)), "term").limit(20 * VOTERS)
    chosen = choose_voters([(r["term"], r["bad"], r["good"]) for r in best.collect()], toxic, clean)
    words = [c for c in chosen if not c.endswith("*")]
    stems = [c[:-1] for c in chosen if c.endswith("*") and c[-2:] != "**"]
    pairs = [c[:-2] for c in chosen if c.endswith("**")]
    at = {c: k for k, c in enumerate([*words, *(s + "*" for s in stems), *(p + "**" for p in pairs)])}
    model = ToxicityModel({w: at[w] for w in words}, {s: at[s + "*"] for s in stems}, {p: at[p + "**"] for p in pairs}, np.zeros((2, 0)), np.eye(0), np.zeros(0))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "votes": [model.votes(t).tolist() for t in batch["text"]]})

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = sorted(rows.mapInPandas(vote, f"doc_id {kind}, toxic int, votes array<double>").collect(), key=lambda r: (r["doc_id"], r["toxic"], r["votes"]))
    votes, gold = np.array([r["votes"] for r in got]), np.array([r["toxic"] for r in got])
    posterior, model.accuracy, model.correlation = label_model((votes[:, :-1] > 0).astype(float), gold)
    model.weights = logistic(model.features(votes), posterior)
    return model


def annotate(docs: DataFrame, model: ToxicityModel, name: str = "score", text: str = "text") -> DataFrame:
    """docs with the score of each row's whole text added; null and empty texts get the score of a text that no voter fires on."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(texts: pd.Series) -> pd.Series:
        model, out = shared.value, [np.zeros(0)]
        for begin in range(0, len(texts), 1000):
            part = texts.iloc[begin : begin + 1000]
            out.append(model.scores(np.array([model.votes(t) for t in part])) if len(model.weights) else np.zeros(len(part)))
        return pd.Series(np.concatenate(out))

    return docs.withColumn(name, F.pandas_udf(rate, "double").asNondeterministic()(F.col(f"`{text}`")))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from labels whose crc32 of the id modulo 4 is not 2, applied to all. A null id is held out."""
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(True))
    scored = annotate(docs.select("doc_id", "text"), fit(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
