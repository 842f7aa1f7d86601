"""Document tables, raw JSON documents and evaluation sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVAL_SCHEMA = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("correct_source", T.StringType()),
    ]
)
CORRUPT = "_corrupt_record"

# Cells a pandas TSV reader takes for missing.
MISSING_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def load_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A folder of JSON files, one (multi-line) object each, under an explicit schema.

    An unreadable file becomes a row with its text in ``_corrupt_record``.
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(with_corrupt)
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def save_table(df: DataFrame, target: str, *, as_table: bool = False) -> None:
    """Replace a table and its schema: a parquet path, or a catalog name with ``as_table``."""
    writer = df.write.mode("overwrite")
    writer.saveAsTable(target) if as_table else writer.parquet(target)


def scan(spark: SparkSession, target: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a table by catalog name, or by path when the target holds a slash."""
    if "/" not in target:
        return spark.table(target)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(target)


def spread(table: DataFrame, least: int | None = None) -> DataFrame:
    """Rebalance a table that is read in fewer tasks than the session has cores.

    Meant for a scan in front of costly per-row work: a few files with one row
    group each would keep most cores idle. A table with enough splits, as any
    large one, comes back as it is, without a shuffle.
    """
    least = least or table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= least else table.repartition(least)


def all_columns(df: DataFrame) -> DataFrame:
    """Every column the table has at run time, as result columns."""
    return df.select(*df.columns)


def select_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A few fields (or SQL expressions) of a source table."""
    return df.selectExpr(*fields)


def save_eval(df: DataFrame, path: str) -> None:
    """Write an evaluation set as tab-separated text with a header."""
    (
        df.write.mode("overwrite")
        .option("sep", "\t")
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def load_eval(
    spark: SparkSession,
    path: str,
    schema: T.StructType = EVAL_SCHEMA,
    missing: Sequence[str] = MISSING_CELLS,
) -> DataFrame:
    """Read a tab-separated evaluation set with header; missing-value cells become null.

    Quoted cells may span lines, so one file is read by one task: write large
    sets as many files.
    """
    raw = (
        spark.read.schema(schema)
        .option("sep", "\t")
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )
    text = {f.name for f in schema.fields if isinstance(f.dataType, T.StringType)}
    return raw.select(
        *[
            F.when(~F.col(c).isin(*missing), F.col(c)).alias(c) if c in text else F.col(c)
            for c in raw.columns
        ]
    )


def use_database(spark: SparkSession, name: str) -> None:
    """Create a database if it is missing and make it the current one."""
    quoted = "`" + name.replace("`", "``") + "`"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted}")
    spark.catalog.setCurrentDatabase(name)
