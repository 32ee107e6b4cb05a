"""The corpus pipeline: language, line dedup, near-dedup, decontamination and mixing, each stage over all that the one before kept.

Null doc_ids, texts, languages and sources, empty tables and repeated rows go through as each operator's docstring says; no stage fails on them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia.llm import decontaminate, language, lines, minhash, mixing
from custodia.llm.common import shared_folder, table

#: Columns that every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without any letter go. A null lang becomes the prediction.

    The identifier learns from rows with a lang whose crc32 of the id modulo 3 is not 1; a null id is not learned from. Where nothing can be
    learned, nothing is rejected but texts without letters.
    """
    model = language.fit(docs, F.coalesce(language.crc_mod("doc_id", 3) != 1, F.lit(False)))
    judged = language.annotate(docs, model, "__lang", "__score")
    kept = judged.where((F.col("__lang") != language.UNKNOWN) | (F.lit(not model.languages) & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))))
    return kept.withColumn("lang", F.coalesce("lang", F.when(F.col("__lang") != language.UNKNOWN, F.col("__lang")))).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many documents repeat. A document that loses every line stays, with an empty text."""
    kept = lines.drop_repeated_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the smallest id. Empty texts and null ids stay."""
    judged = minhash.minmax_dedup(docs)
    dropped = judged.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics meet their raked weights, with topic, n_tokens and weight."""
    out = mixing.mix(docs.select(*COLUMNS)).where("kept")
    return out.select(*COLUMNS, "topic", "n_tokens", F.round("weight", 6).alias("weight"))


STAGES = [
    ("language", known_language),
    ("line dedup", without_repeated_lines),
    ("near dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: Language identification, near-dedup and latent retrieval are not expressible in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
