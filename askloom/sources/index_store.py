"""The vector index as a parquet table: save, reset, load, describe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def save_index(
    index: DataFrame, path: str, *, reset: bool = False, partition_by: str | None = None
) -> None:
    """Write an index folder; ``reset`` drops what was there, otherwise an existing index is an error.

    ``partition_by`` a low-cardinality metadata column lets filtered retrieval
    skip whole folders.
    """
    writer = index.write.mode("overwrite" if reset else "errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def load_index(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Open a saved index; pass the schema to skip reading file footers for it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def describe_index(index: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: number of rows, smallest and largest dimension, rows without a vector."""
    return index.agg(
        F.count("*").alias("n_rows"),
        F.min(F.size(vector)).cast("long").alias("min_dim"),
        F.max(F.size(vector)).cast("long").alias("max_dim"),
        F.sum(F.col(vector).isNull().cast("long")).alias("n_missing"),
    )


def index_size(index: DataFrame) -> DataFrame:
    """Number of indexed chunks."""
    return index.agg(F.count("*").alias("n_rows"))
