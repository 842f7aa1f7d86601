"""A change feed from two snapshots of a keyed table.

A stored snapshot lies in buckets of its key's hash, and a small table holds each bucket's row count and
sums of content hashes. Two snapshots are compared by these tables first: buckets that agree are never
read again. In the others, key and content hash alone meet in a full outer join; the rows that changed are
then fetched by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askloom.operators.index import content_hash
from askloom.session import materialize

BUCKETS = 1024
_BUCKET, _HASH = "__bucket", "__hash"
_DIGEST = ("n_rows", "total", "mixed")


def key_bucket(key: str, buckets: int) -> Column:
    """The bucket of a key, from 0."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def save_snapshot(df: DataFrame, path: str, key: str = "doc_id", buckets: int = BUCKETS) -> None:
    """Store a table for later comparison; both of a pair need the same ``key`` and number of ``buckets``.

    One shuffle by bucket, which adaptive execution balances. The digests are taken from the stored rows.
    """
    rows = df.withColumn(_BUCKET, key_bucket(key, buckets)).hint("rebalance", _BUCKET)
    rows.write.mode("errorifexists").partitionBy(_BUCKET).parquet(f"{path}/rows")
    # An empty table has no files to tell its columns.
    df.limit(0).write.mode("errorifexists").parquet(f"{path}/columns")
    stored = load_snapshot(df.sparkSession, path)
    hashed = stored.select(_BUCKET, _content(df).alias(_HASH))
    digests = hashed.groupBy(_BUCKET).agg(
        F.count("*").alias("n_rows"),
        F.sum(F.col(_HASH).cast("decimal(38,0)")).alias("total"),
        F.bit_xor(_HASH).alias("mixed"),
    )
    # One row per bucket.
    digests.withColumn("buckets", F.lit(buckets)).coalesce(1).write.mode("errorifexists").parquet(f"{path}/buckets")


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows, with their bucket as the last column, ``__bucket``."""
    columns = spark.read.parquet(f"{path}/columns")
    schema = columns.withColumn(_BUCKET, F.lit(0)).schema
    return spark.read.schema(schema).parquet(f"{path}/rows")


def _content(df: DataFrame) -> Column:
    return content_hash(df.select(sorted(c for c in df.columns if c not in (_BUCKET, _HASH))))


def differing_buckets(spark: SparkSession, before: str, after: str) -> DataFrame:
    """Buckets whose rows differ between two stored snapshots, one row each."""
    old, new = (spark.read.parquet(f"{path}/buckets") for path in (before, after))
    counts = {r.buckets for r in old.select("buckets").union(new.select("buckets")).distinct().collect()}
    if len(counts) > 1:
        raise ValueError(f"snapshots have different numbers of buckets: {sorted(counts)}")
    new = new.select(_BUCKET, *(F.col(c).alias(f"new_{c}") for c in _DIGEST))
    same = [F.col(c).eqNullSafe(F.col(f"new_{c}")) for c in _DIGEST]
    return old.join(new, _BUCKET, "full_outer").filter(~(same[0] & same[1] & same[2])).select(_BUCKET)


def snapshot_changes(
    spark: SparkSession, before: str, after: str, key: str = "doc_id", version: int | None = None
) -> DataFrame:
    """What leads from the snapshot stored at ``before`` to that at ``after``: its columns and ``op``.

    ``op`` is ``insert``, ``update`` or ``delete``; a delete has nulls beside its key. ``version`` adds a
    column of that name and value, so that ``apply_changes`` can take the rows. Where a snapshot holds a
    key more than once, the row of greatest content hash stands for it. Rows without a key are left out:
    no change could name them. Columns are compared by name, in any order.
    """
    # At most one number per bucket comes to the driver.
    buckets = [row[0] for row in differing_buckets(spark, before, after).collect()]
    old, new = (load_snapshot(spark, path) for path in (before, after))
    columns = [c for c in new.columns if c != _BUCKET]
    if set(columns) != set(old.columns) - {_BUCKET}:
        raise ValueError("snapshots have different columns")

    def rows(df: DataFrame) -> DataFrame:
        kept = df.where(F.col(_BUCKET).isin(buckets)).where(F.col(key).isNotNull())
        return kept.withColumn(_HASH, _content(df)).drop(_BUCKET)

    def heads(df: DataFrame, name: str) -> DataFrame:
        return rows(df).groupBy(key).agg(F.max(_HASH).alias(name))

    op = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "delete").otherwise("update")
    both = heads(old, "__old").join(heads(new, "__new"), key, "full_outer")
    marks = both.where(~F.col("__old").eqNullSafe(F.col("__new"))).select(key, F.col("__new").alias(_HASH), op.alias("op"))
    marks = materialize(marks, "marks")
    once = Window.partitionBy(key).orderBy(_HASH)
    # Of equal rows of a key one is enough; each task cuts its own before they meet.
    live = rows(new).join(marks, [key, _HASH]).withColumn("__row", F.row_number().over(once)).where("__row = 1")
    gone = marks.where("op = 'delete'").select(
        *(F.col(c) if c == key else F.lit(None).cast(new.schema[c].dataType).alias(c) for c in columns), "op"
    )
    changes = live.select(*columns, "op").unionByName(gone)
    return changes if version is None else changes.withColumn("version", F.lit(version).cast("long"))
