"""Index upkeep: append, keyed merge, keyed changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.session import materialize


def append_index(a: DataFrame, b: DataFrame) -> DataFrame:
    """Append one index to another; nothing is deduplicated, so a rerun doubles the rows."""
    return a.unionByName(b)


def content_hash(df: DataFrame) -> Column:
    """A number fixed by the row's content, to settle equal versions the same way every time.

    Maps count by their sorted entries.
    """
    parts = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        entries = isinstance(field.dataType, T.MapType)
        parts.append(F.array_sort(F.map_entries(column)) if entries else column)
    return F.xxhash64(*parts)


def latest_per_key(df: DataFrame, key: str, version: str, *then: str) -> DataFrame:
    """One row per key, the one with the highest version (then ``then``, then content hash).

    One shuffle by key and no join back. Spark cuts every task's own rows to the first of each key before
    that shuffle (its window group limit), so a key with a third of all rows is no hot spot. Rows without
    a key are one key; a null version is the lowest.
    """
    order = [F.col(c).desc_nulls_last() for c in (version, *then)]
    best = Window.partitionBy(key).orderBy(*order, content_hash(df).desc())
    return df.withColumn("__place", F.row_number().over(best)).filter("__place = 1").select(*df.columns)


def merge_index(
    a: DataFrame, b: DataFrame, key: str = "chunk_id", version: str = "version"
) -> DataFrame:
    """Union with one row per key: the newest version, on equal versions the row of ``b``.

    Regroups both sides, so it also cleans up repeated keys inside one of them.
    To fold a small delta into a large keyed index, ``apply_changes`` leaves the
    index where it is.
    """
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))
    return latest_per_key(both, key, version, "_side").drop("_side")


def apply_changes(
    index: DataFrame,
    changes: DataFrame,
    key: str = "doc_id",
    version: str = "version",
    op_col: str = "op",
) -> DataFrame:
    """Insert, update and delete by primary key; the last version of a key wins.

    ``changes`` has the index columns plus ``op`` (``delete`` removes, anything
    else, null too, inserts or replaces). Changes older than what the index holds are
    ignored. The changes are reduced to one per key and stored, so that Spark
    knows their size when it plans: next to a small set the index is not
    shuffled at all, next to a large one both sides meet by key.
    """
    last = materialize(latest_per_key(changes, key, version), "changes")
    marks = last.select(key, F.col(version).alias("_changed"))
    held = index.join(marks, key, "left")
    untouched = held.filter(F.col("_changed").isNull() | (F.col("_changed") < F.col(version)))
    newer = (
        index.select(key, version).join(marks, key).filter(F.col("_changed") < F.col(version))
    )
    arriving = last.filter(~F.col(op_col).eqNullSafe("delete")).join(newer, key, "left_anti")
    return untouched.select(*index.columns).unionByName(arriving.select(*index.columns))
