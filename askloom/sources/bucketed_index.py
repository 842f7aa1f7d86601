"""The index as a bucketed table: merges and look-ups by key leave its rows where they lie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.operators.index import latest_per_key
from askloom.session import materialize


def save_bucketed(index: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Write an index as table ``name``, cut by the hash of ``key`` and sorted by it; one shuffle, once.

    ``path`` is the table's folder, by default one in the warehouse. An existing table is an error.
    """
    return _write(index.repartition(buckets, key), name, key, buckets, path)


def _write(index: DataFrame, name: str, key: str, buckets: int, path: str | None) -> DataFrame:
    writer = index.write.bucketBy(buckets, key).sortBy(key)
    if path is not None:
        writer = writer.option("path", path)
    writer.mode("errorifexists").saveAsTable(name)
    return index.sparkSession.table(name)


def bucket_count(spark: SparkSession, name: str) -> int:
    """Number of buckets of a table; one without buckets is an error."""
    facts = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").collect()
    if not facts:
        raise ValueError(f"{name} is no bucketed table")
    return int(facts[0].data_type)


def merged_rows(
    spark: SparkSession,
    name: str,
    changes: DataFrame,
    key: str = "doc_id",
    version: str = "version",
    op_col: str = "op",
) -> DataFrame:
    """The rows of table ``name`` after ``changes``; only the changes are shuffled, to the buckets.

    The last version of a key wins, a change of the same version replaces the row, an older one and one
    without a version do not; ``delete`` removes. Rows without a key match none and stay.
    """
    last = materialize(latest_per_key(changes, key, version), "changes")
    held = spark.table(name)
    new = last.repartition(bucket_count(spark, name), key).withColumn("__new", F.lit(True)).alias("n")
    old = held.withColumn("__old", F.lit(True)).alias("o")
    both = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    older = F.col(f"n.{version}").isNull() | F.coalesce(F.col(f"n.{version}") < F.col(f"o.{version}"), F.lit(False))
    wins = F.col("n.__new").isNotNull() & (F.col("o.__old").isNull() | ~older)
    gone = wins & F.col(f"n.{op_col}").eqNullSafe("delete")
    columns = [F.when(wins, F.col(f"n.`{c}`")).otherwise(F.col(f"o.`{c}`")).alias(c) for c in held.columns]
    return both.where(~gone).select(*columns)


def merge_bucketed(
    spark: SparkSession,
    name: str,
    into: str,
    changes: DataFrame,
    key: str = "doc_id",
    path: str | None = None,
    **columns: str,
) -> DataFrame:
    """Table ``name`` after ``changes`` as the bucketed table ``into``: each task writes its own bucket.

    The old table stays, so a failed merge is simply run again under another name.
    """
    merged = merged_rows(spark, name, changes, key, **columns)
    return _write(merged, into, key, bucket_count(spark, name), path)


def look_up(spark: SparkSession, name: str, hits: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """``hits`` with the ``payload`` columns of their keys; null where table ``name`` has no such key.

    The wanted keys, each once, go to the buckets; the table is not shuffled, and a key that very many
    hits share meets the table as one row. The found rows then join the hits, where adaptive execution
    broadcasts a small side or splits a hot key.
    """
    wanted = hits.select(key).where(F.col(key).isNotNull()).distinct().repartition(bucket_count(spark, name), key)
    found = spark.table(name).select(key, *payload).join(wanted.hint("shuffle_merge"), key)
    return hits.join(found, key, "left")
