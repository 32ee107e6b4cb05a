"""URL filter: allow and block rules first, gradient-boosted trees on lexical features for the rest. Column expressions and Spark ML only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.llm.common import UPPER, hashed_below

#: Words that mark a host as unwanted; urls are labelled by them where no labels are given.
SEED_TERMS = ("ads", "adult", "bet", "bets", "casino", "cheap", "escort", "gambling", "loans", "pills", "poker", "porn", "sex", "spam", "torrent", "track", "viagra", "warez", "xxx")


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, where the path starts with a given text."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path; both empty for a null or a text without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, UPPER.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, else null. The rules are a short list and part of the plan."""
    out: Column = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits."""
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size
    return F.coalesce(F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda s, c: s - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c)))), F.lit(0.0))


def _count(text: Column, what: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{what}]", ""))


def lexical_features() -> dict[str, Column]:
    """Features of the columns url, host and path."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    longest = F.array_max(F.transform(F.split(host, "\\."), lambda x: F.length(x)))
    return {
        "length": F.length(url),
        "host_length": F.length(host),
        "depth": _count(path, "/"),
        "labels": _count(host, "."),
        "longest_label": longest,
        "hyphens": _count(host, "\\-"),
        "digit_ratio": _count(url, "0-9") / F.greatest(F.length(url), F.lit(1)),
        "vowel_ratio": _count(host, "aeiou") / F.greatest(F.length(host), F.lit(1)),
        "host_entropy": _entropy(host),
        "entropy": _entropy(url),
        "parameters": _count(url, "&=?"),
        "fragment": _count(url, "#"),
        "secure": url.startswith("https").cast("int"),
    }


def suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def seed_label(host: Column, terms: Sequence[str] = SEED_TERMS) -> Column:
    """1 where a word of the host is an unwanted term."""
    return F.arrays_overlap(F.split(host, "[.\\-_]"), F.array(*map(F.lit, terms))).cast("int")


def judge_urls(
    pages: DataFrame,
    labelled: DataFrame | None = None,
    rules: Sequence[Rule] = (),
    id: str = "page_id",
    url: str = "url",
    sample: int = 20_000,
    seed: int = 7,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), one row per row of pages.

    labelled: (url, label), label 1 to block; without it the pages' own urls are labelled by SEED_TERMS. The trees are fitted on at most about
    `sample` labelled urls, chosen by a hash of the url; suffix statistics (how many urls share the last two labels of the host, and which
    share of them is blocked, smoothed) come from all labelled urls. A rule's verdict stands; elsewhere the trees block at a score of 0.5.

    Null urls and texts without :// have an empty host and path and are judged by the trees like any other. If the labelled urls hold only
    one class, or none, no trees are fitted and the verdict is that class, or allow.
    """
    where, path = host_and_path(F.col("url"))
    parts = lambda f: f.withColumns({"host": where, "path": path})
    rows = parts(pages.select(F.col(f"`{id}`").alias("page_id"), F.col(f"`{url}`").alias("url")))
    if labelled is None:
        known = rows.select("url", "host", "path", seed_label(F.col("host")).alias("label"))
    else:
        known = parts(labelled.select("url", "label").where("label is not null"))
    known = known.withColumn("suffix", suffix(F.col("host")))
    stats = known.groupBy("suffix").agg(
        F.log1p(F.count(F.lit(1))).alias("suffix_count"), ((F.sum("label") + 1) / (F.count(F.lit(1)) + 2)).alias("suffix_blocked")
    )
    classes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    ruled = rows.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    if len(classes) < 2:
        score = F.lit(float(next(iter(classes), 0)))
        scored = ruled.withColumn("score", score)
    else:
        names = [*lexical_features(), "suffix_count", "suffix_blocked"]
        assemble = VectorAssembler(inputCols=names, outputCol="features")
        share = min(1.0, sample / sum(classes.values()))
        chosen = known.where(hashed_below(share, F.lit(seed), "url"))
        prepare = lambda f: assemble.transform(f.withColumns(lexical_features()).join(stats, "suffix", "left").fillna(0.5, ["suffix_blocked"]).fillna(0.0, names))
        trees = GBTClassifier(maxIter=12, maxDepth=3, maxBins=32, stepSize=0.3, seed=seed, checkpointInterval=-1)
        model = trees.fit(prepare(chosen).select("features", F.col("label").cast("double")))
        scored = model.transform(prepare(ruled.withColumn("suffix", suffix(F.col("host"))))).withColumn("score", vector_to_array("probability")[1])
    verdict = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", verdict).alias("verdict"), "score")
