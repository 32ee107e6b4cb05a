"""Rules as data: small relations written in the program."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_ARROW = {
    T.StringType: pa.string(),
    T.IntegerType: pa.int32(),
    T.LongType: pa.int64(),
    T.BooleanType: pa.bool_(),
    T.TimestampType: pa.timestamp("us", "UTC"),
    T.TimestampNTZType: pa.timestamp("us"),
}


def values_df(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """The rows as a local relation.

    Made from an Arrow table, Spark knows its size and a join with it does not move the
    other side; made from a Python list it would be an RDD of unknown size.
    """
    fields = T.StructType.fromDDL(schema).fields
    columns = {f.name: pa.array([r[i] for r in rows], type=_ARROW[type(f.dataType)]) for i, f in enumerate(fields)}
    return spark.createDataFrame(pa.table(columns), schema=schema)
