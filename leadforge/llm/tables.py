"""Table helpers of the operators: reading columns, cutting lineage, Arrow batch sizes."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import read_table

__all__ = ["bounded_batches", "digits", "hashed", "materialise", "read_table", "text_of"]


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts; a size the user set is left alone."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The written table cuts the lineage and outlives lost executors; it is also
    what lets adaptive execution split a hot key in the joins that follow.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column as a string, null as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def hashed(column: Column) -> Column:
    return F.xxhash64(column)


def digits(n: int) -> str:
    return f"{n:,}"


def arrow_schema(fields: Sequence[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([pa.field(k, t) for k, t in fields])
