"""What the operators share: where intermediate results go, how the driver's splits are drawn, how sorted rows are grouped."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only characters that part words and are stripped from lines.
WHITE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Whether a query's shuffle files are deleted when it ends; otherwise they stay until the driver collects garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir; only a session that names none gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        shared = not spark.sparkContext.master.startswith("local")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints" if shared else tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, written as a table in the shared folder and read back, so that a lost executor does not repeat what came before.

    A written table also tells the planner its true size, which a checkpoint of a chain of joins does not.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")  # the table is there, so what was shuffled to write it need not stay on disk
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(frame.schema).parquet(path)
    out._cut_path = path
    return out


def release(frame: DataFrame) -> None:
    """Delete the table of a cut that nothing will read again."""
    context = frame.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(frame._cut_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of a value's text, modulo a number: the split that decides which rows may be learned from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def hashed_below(share: float, *columns: Column | str) -> Column:
    """A share of all rows, chosen by a hash of some columns; shares of any smallness are met, as the bound has 63 bits."""
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(*columns).bitwiseAND(F.lit(2**63 - 1)) < F.lit(int(share * 2.0**63))


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """The rows of many keys at once, from batches that are sorted by key, and where each key's rows begin and the last end. Holds one batch and one key's rows."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        if not len(batch):
            continue
        frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        changed = (frame[keys].ne(frame[keys].shift())).any(axis=1).to_numpy().copy()
        changed[0] = True
        starts = changed.nonzero()[0]
        if len(starts) > 1:
            yield frame.iloc[: starts[-1]], starts
        rest = frame.iloc[starts[-1] :].reset_index(drop=True)
    if rest is not None:
        yield rest, np.array([0, len(rest)])
