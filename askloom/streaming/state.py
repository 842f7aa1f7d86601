"""What a stream remembers of every key, so that only fresh content goes on."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from askloom.operators.index import content_hash

BUCKETS = 1024
_STATE = "held string"


def _name(df: DataFrame, key: str) -> Column:
    """A key as text, another one for every other key."""
    kind = df.schema[key].dataType
    if isinstance(kind, T.BinaryType):
        return F.hex(key)
    if isinstance(kind, (T.StructType, T.ArrayType)):
        return F.to_json(F.struct(key))
    return F.col(key).cast("string")


def fresh_changes(
    changes: DataFrame, key: str = "doc_id", version: str = "version", op_col: str = "op", buckets: int = BUCKETS
) -> DataFrame:
    """The changes of a stream that alter what their key holds, with all its columns, in any order of arrival.

    The state of a key is its last version, that change's content hash to settle equal versions, and the
    hash of its content: everything but key and version, any ``op`` other than ``delete`` being alike. A
    change that is not newer is dropped; one that is newer but holds the same content, or deletes what was
    deleted, moves the version on and is dropped too. So a model behind this operator sees each content of
    a key once, and again only if there was another in between. Of the changes of a key in one micro-batch
    only the last counts. Rows without a key or version are left out. Columns with maps are not supported.

    The state is three numbers per key, held together for each of ``buckets`` buckets of the key's hash:
    one call of Python for a bucket and micro-batch, where a call for every key would take most of the
    time. The number of buckets belongs to the checkpoint. Keep the state in RocksDB on a cluster
    (``spark.sql.streaming.stateStore.providerClass``); the checkpoint restores it. A bucket's changes meet
    in one task, some rows at a time, of which the last of each key are held; so a hot key costs time but
    no memory.
    """
    columns = changes.columns
    deleted = F.col(op_col).eqNullSafe("delete")
    held = [c for c in columns if c not in (key, version, op_col)]
    content = F.when(deleted, F.lit(0).cast("long")).otherwise(content_hash(changes.select(*held)))
    known = changes.where(F.col(key).isNotNull() & F.col(version).isNotNull())
    rows = known.select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).alias("__bucket"),
        _name(changes, key).alias("__key"),
        F.col(version).cast("long").alias("__version"),
        content_hash(changes).alias("__tie"),
        content.alias("__content"),
        F.struct(*columns).alias("__row"),
    )

    def last(own: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest: dict[str, tuple] = {}
        for part in parts:
            numbers = (part[c].tolist() for c in ("__key", "__version", "__tie", "__content"))
            for name, number, tie, content, row in zip(*numbers, part["__row"]):
                if name not in newest or (number, tie) > newest[name][:2]:
                    newest[name] = number, tie, content, row
        held = json.loads(state.get[0]) if state.exists else {}
        fresh = []
        for name, (number, tie, content, row) in newest.items():
            before = held.get(name)
            if before is not None and (number, tie) <= (before[0], before[1]):
                continue
            held[name] = number, tie, content
            if before is None or before[2] != content:
                fresh.append(row)
        state.update((json.dumps(held),))
        if fresh:
            yield pd.DataFrame({"__row": pd.Series(fresh, dtype=object)})

    schema = T.StructType([T.StructField("__row", T.StructType([changes.schema[c] for c in columns]))])
    made = rows.groupBy("__bucket").applyInPandasWithState(last, schema, _STATE, "append", GroupStateTimeout.NoTimeout)
    return made.select("__row.*")
