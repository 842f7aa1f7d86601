"""Exact top-k search by inner product: tiled matrix products, selection per tile, tree of merges.

Vectors are turned into whole numbers, so scores are exact. Queries are cut into groups of bounded
size; each group is broadcast in turn, and every task multiplies it tile by tile with its own shard of
the vectors, which never move. A task keeps each query's best k of all its tiles; the lists of the
tasks then merge in a tree, so that no merge takes more than ``FAN`` lists of a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askloom.session import materialize

SCALE = 1024.0
GROUP_BYTES = 16 << 20
TILE_QUERIES = 1024
TILE_BYTES = 8 << 20
FAN = 32
_EXACT = float(1 << 53)
_LIMITS = np.iinfo(np.int64)


def whole(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids and floor(1024 * x) of the vectors that are usable, as doubles."""
    vectors = pc.cast(vectors, pa.large_list(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    named = pc.is_valid(ids).to_numpy(zero_copy_only=False)
    out = {}
    for size in np.unique(sizes[(sizes >= 0) & named]).tolist():
        rows = np.flatnonzero((sizes == size) & named)
        flat = pc.list_flatten(vectors.take(pa.array(rows)))
        matrix = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), size)
        with np.errstate(over="ignore", invalid="ignore"):
            matrix = np.floor(SCALE * matrix)
        fine = np.isfinite(matrix).all(1)
        out[size] = ids.take(pa.array(rows[fine])).to_numpy(zero_copy_only=False), matrix[fine]
    return out


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles where they hold whole numbers, else integers, held within 64 bits."""
    bound = max(queries.shape[1], 1) * abs(queries).max(initial=0) * abs(vectors).max(initial=0)
    if bound < _EXACT:
        return queries @ vectors.T
    if bound < 2.0**62:
        return queries.astype(np.int64) @ vectors.astype(np.int64).T
    exact = np.frompyfunc(int, 1, 1)
    held = np.frompyfunc(lambda s: min(max(s, _LIMITS.min), _LIMITS.max), 1, 1)
    return held(exact(queries) @ exact(vectors).T)


def _best(scores: np.ndarray, barred: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k best scores, ties to the left; barred ones come last."""
    n = scores.shape[1]
    k = min(k, n)
    if scores.dtype == np.float64 and abs(scores).max(initial=0) * n < _EXACT / 2:
        # One number orders by score, then by column; partial selection is enough then.
        keys = scores * n - np.arange(n)
        keys[barred] = -np.inf
        picked = np.argpartition(-keys, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(keys), 1))
        order = np.argsort(-np.take_along_axis(keys, picked, 1), axis=1, kind="stable")
        return np.take_along_axis(picked, order, 1)
    columns = np.arange(n)
    rows = [sorted(columns.tolist(), key=lambda c: (b[c], -s[c], c))[:k] for s, b in zip(scores, barred)]
    return np.array(rows, np.int64).reshape(len(scores), k)


class _Lists:
    """The best k scores and ids so far of the queries of one length."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int):
        self.ids, self.matrix, self.k = ids, matrix, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        rows = max(1, TILE_BYTES // (8 * max(vectors.shape[1], TILE_QUERIES)))
        for q in range(0, len(self.ids), TILE_QUERIES):
            for v in range(0, len(ids), rows):
                self._tile(q, ids[v : v + rows], vectors[v : v + rows])

    def _tile(self, start: int, ids: np.ndarray, vectors: np.ndarray) -> None:
        own = self.ids[start : start + TILE_QUERIES]
        scores = _products(self.matrix[start : start + TILE_QUERIES], vectors)
        barred = own[:, None] == ids[None, :]
        for i, columns in enumerate(_best(scores, barred, self.k)):
            columns = columns[~barred[i, columns]]
            if not len(columns) or float(scores[i, columns[0]]) < self.least[start + i]:
                continue
            fresh = [(int(scores[i, c]), int(ids[c])) for c in columns]
            kept = sorted(self.found[start + i] + fresh, key=lambda x: (-x[0], x[1]))[: self.k]
            self.found[start + i] = kept
            if len(kept) == self.k:
                self.least[start + i] = float(kept[-1][0])


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = {size: _Lists(ids, matrix, k) for size, (ids, matrix) in shared.value.items()}
        for batch in batches:
            for size, (ids, vectors) in whole(batch.column(0), batch.column(1)).items():
                if size in lists and len(ids):
                    lists[size].add(ids, vectors)
        task = TaskContext.get().partitionId()
        for own in lists.values():
            rows = [(q, i, s) for q, found in zip(own.ids.tolist(), own.found) for s, i in found]
            for at in range(0, len(rows), 10_000):
                query, vec, score = zip(*rows[at : at + 10_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (query, vec, score, [task] * len(query))],
                    ["query_id", "vec_id", "score", "shard"],
                )

    return run


def _merge(lists: DataFrame, k: int, shards: int) -> DataFrame:
    while True:
        shards = -(-shards // FAN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN))
        order = Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if shards <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query the k vectors of highest inner product.

    Both inputs have a long id and a list of numbers, in this order. Components become
    floor(1024 * x). Ties go to the smaller id; a query's own id is no candidate. Rows whose id or
    vector is null, or that hold a null or non-finite component, take no part; vectors of another
    length than the query are no candidates. Of queries that share an id one list is returned, over
    all of them. Scores beyond 64 bits count as the nearest long.
    """
    spark = vectors.sparkSession
    vectors = vectors.toDF("vec_id", "vector").where("vec_id IS NOT NULL")
    queries = queries.toDF("query_id", "vector").where("query_id IS NOT NULL AND vector IS NOT NULL")
    size = queries.agg(F.sum(8 * (F.size("vector") + 1))).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    parts = []
    for group in range(groups):
        of_group = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == group)
        table = of_group.toArrow().combine_chunks()
        held = whole(
            pa.chunked_array(table.column(0)).combine_chunks(), pa.chunked_array(table.column(1)).combine_chunks()
        )
        shared = spark.sparkContext.broadcast(held)
        found = vectors.mapInArrow(_search(shared, k), "query_id long, vec_id long, score long, shard long")
        parts.append(materialize(found, "lists"))
        shared.unpersist()
    lists = parts[0]
    for part in parts[1:]:
        lists = lists.union(part)
    shards = (lists.agg(F.max("shard")).first()[0] or 0) + 1
    return _merge(lists, k, shards)
