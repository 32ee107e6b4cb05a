"""Delimited and JSON files with a declared format."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia.sources import schemas

# The texts that stand for NULL in the source files.
NULL_TOKENS = ("NULL", "null", "")


def nulls_from_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Replace every text value that is a NULL token."""
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    return df.select(
        *[
            F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")).alias(c) if c in text else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def read_csv(
    spark: SparkSession, path: str, schema: str, null_tokens: Sequence[str] = NULL_TOKENS
) -> DataFrame:
    """Comma-separated, double-quoted, one header line; any bad record stops the load.

    The reader knows a single NULL text only, so all columns are read as text, the
    tokens are removed, and the declared types are applied by ANSI casts, which fail
    on text that does not fit the type. ``FAILFAST`` refuses rows of the wrong width.
    """
    declared = schemas.struct(schema)
    as_text = ", ".join(f"`{f.name}` string" for f in declared.fields)
    raw = (
        spark.read.schema(as_text)
        .option("header", True)
        .option("sep", ",")
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .csv(path)
    )
    clean = nulls_from_tokens(raw, null_tokens)
    return clean.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in declared.fields])


def _checked(spark: SparkSession, path: str, schema: str, null_tokens: Sequence[str], header: bool) -> DataFrame:
    """Records as text with file_path, the record's own text where its width is wrong, and the reason why it cannot be loaded, if any."""
    declared = schemas.struct(schema)
    as_text = ", ".join(f"`{f.name}` string" for f in declared.fields)
    raw = (
        spark.read.schema(f"{as_text}, __record string")
        .options(header=header, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="__record", enforceSchema=True)
        .csv(path)
        .withColumn("file_path", F.col("_metadata.file_path"))
    )
    reason = F.when(F.col("__record").isNotNull(), F.lit("number of fields"))
    for f in declared.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind != "string":
            filled = c.isNotNull() & ~c.isin(*null_tokens)
            reason = reason.when(filled & c.try_cast(f.dataType).isNull(), F.lit(f"{f.name}: not {kind}"))
    return raw.withColumn("__reason", reason)


def rejects(spark: SparkSession, path: str, schema: str, null_tokens: Sequence[str] = NULL_TOKENS, header: bool = True) -> DataFrame:
    """(file_path, record, reason) of the records that a load would refuse: those of the wrong width, and those with a
    text that does not fit its declared type (the first such column is named). One pass over the files."""
    names = [f"`{f.name}`" for f in schemas.struct(schema).fields]
    whole = F.coalesce(F.col("__record"), F.concat_ws(",", *[F.coalesce(F.col(n), F.lit("")) for n in names]))
    return _checked(spark, path, schema, null_tokens, header).where("__reason is not null").select("file_path", whole.alias("record"), F.col("__reason").alias("reason"))


def load_or_refuse(spark: SparkSession, path: str, schema: str, null_tokens: Sequence[str] = NULL_TOKENS, header: bool = True) -> DataFrame:
    """The typed records; the job that reads them fails at the first bad one, naming its file and what is wrong with it."""
    checked = _checked(spark, path, schema, null_tokens, header)
    fault = F.concat(F.col("file_path"), F.lit(": "), F.col("__reason"))
    good = checked.where(F.assert_true(F.col("__reason").isNull(), fault).isNull())
    fields = schemas.struct(schema).fields
    return good.select(*[F.when(~F.col(f"`{f.name}`").isin(*null_tokens), F.col(f"`{f.name}`")).try_cast(f.dataType).alias(f.name) for f in fields])


def load_table(df: DataFrame, columns: Sequence[str], as_of: datetime) -> DataFrame:
    """Keep the listed columns and add the load clock column of the wider target."""
    return df.select(*columns).withColumn("_load_timestamp", F.lit(as_of).cast("timestamp_ntz"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary file with the YES/NO flag as a boolean."""
    return dictionary_flags(read_csv(spark, path, schemas.DICTIONARY))


def dictionary_flags(df: DataFrame) -> DataFrame:
    return df.withColumn("is_cde", F.upper("is_cde") == "YES")


def read_sealed(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Truth set of sensitive columns: two JSON arrays become one relation.

    ``multi_line=False`` reads one document per line, which Spark can split.
    """
    docs = spark.read.schema(schemas.SEALED).option("multiLine", multi_line).json(path)
    return sealed_rows(docs)


def sealed_rows(docs: DataFrame) -> DataFrame:
    """One pass over the documents: tag each array's entries with its section, then explode once."""
    confirmed = F.transform(
        F.coalesce(F.col("confirmed_sensitive_columns"), F.array()),
        lambda e: F.struct(
            e["table"].alias("table_name"),
            e["column"].alias("column_name"),
            e["classification"].alias("expected_classification"),
            F.lit("CONFIRMED").alias("source_section"),
            e["reason"].alias("reason"),
        ),
    )
    mislabeled = F.transform(
        F.coalesce(F.col("deliberately_mislabeled"), F.array()),
        lambda e: F.struct(
            e["table"].alias("table_name"),
            e["column"].alias("column_name"),
            e["actual_classification"].alias("expected_classification"),
            F.lit("MISLABELED").alias("source_section"),
            e["why_mislabeled"].alias("reason"),
        ),
    )
    return docs.select(F.explode(F.concat(confirmed, mislabeled)).alias("entry")).select("entry.*")
