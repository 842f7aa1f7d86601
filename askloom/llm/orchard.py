"""Centroid clustering with Orchard's search for the nearest centroid.

Every centroid has a list of the others, nearest first. The search of a vector stands at one centroid
and walks down its list; a closer one that turns up becomes the new place, with its own list. What was
looked at is marked and never measured again. Past a centroid strictly more than twice as far from the
present one as the vector is, nothing on the list can be as near, and the search ends. A batch of vectors
walks together, a step of all at a time.

Components are whole numbers, so distances, sums and means are exact and no order of additions matters.
Only the centroids, a table of fixed size, go from round to round over the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256.0
CENTROIDS, ROUNDS, LENGTH = 40, 5, 64
_LONG = (1 << 63) - 1


def limit(length: int) -> int:
    """What a component is held within, either way, so that squared distances fit 64 bits: 2^27 for 64."""
    return 1 << 30 - ((max(length, 1) - 1).bit_length() + 1) // 2


def whole_vectors(vectors: pa.Array, length: int, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Places and floor(scale * x), within ``limit``, of the vectors of ``length`` finite components."""
    vectors = pc.cast(vectors, pa.large_list(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == length)
    flat = pc.fill_null(pc.list_flatten(vectors.take(pa.array(rows))), float("nan"))
    matrix = flat.to_numpy(zero_copy_only=False).reshape(len(rows), length)
    fine = np.isfinite(matrix).all(1)
    with np.errstate(over="ignore"):
        matrix = np.clip(np.floor(scale * matrix[fine]), -limit(length), limit(length))
    return rows[fine], matrix.astype(np.int64)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(-1)


class Centroids:
    """Centroids with their neighbour lists."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.apart = np.stack([_squared(rows, row) for row in rows])
        self.lists = np.argsort(self.apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(self.apart, self.lists, 1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each vector's nearest centroid; ties go to the smaller number."""
        n, k = len(vectors), len(self.rows)
        here = np.zeros(n, np.int64)
        best = np.zeros(n, np.int64)
        distance = _squared(vectors, self.rows[0])
        at = np.zeros(n, np.int64)
        marked = np.zeros((n, k), bool)
        marked[:, 0] = True
        walking = np.arange(n)
        while len(walking):
            place, step = here[walking], at[walking]
            # Twice a distance, squared, can pass 64 bits where a quarter of the other side cannot.
            inside = (step < k) & ((self.apart[place, np.minimum(step, k - 1)] + 3) // 4 <= distance[walking])
            walking, place, step = walking[inside], place[inside], step[inside]
            found = self.lists[place, step]
            at[walking] += 1
            fresh = ~marked[walking, found]
            rows, found = walking[fresh], found[fresh]
            marked[rows, found] = True
            measured = _squared(vectors[rows], self.rows[found])
            closer, tied = measured < distance[rows], measured == distance[rows]
            best[rows[tied]] = np.minimum(best[rows[tied]], found[tied])
            rows, found = rows[closer], found[closer]
            here[rows] = best[rows] = found
            distance[rows], at[rows] = measured[closer], 0
        return best, distance


def _assign(shared, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, vectors = whole_vectors(batch.column(1), length)
            number, distance = shared.value.nearest(vectors)
            columns = [batch.column(0).take(pa.array(rows)), pa.array(number, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return run


def _sums(shared, length: int):
    """A task's row counts and component sums by cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(shared.value.rows)
        count, total = np.zeros(k, np.int64), np.zeros((k, length), np.int64)
        for batch in batches:
            _, vectors = whole_vectors(batch.column(1), length)
            number, _ = shared.value.nearest(vectors)
            count += np.bincount(number, minlength=k)
            np.add.at(total, number, vectors)
        used = np.flatnonzero(count)
        columns = [
            pa.array(np.repeat(used, length).astype(np.int32)),
            pa.array(np.tile(np.arange(length, dtype=np.int32), len(used))),
            pa.array(np.repeat(count[used], length)),
            pa.array(total[used].ravel()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "place", "n", "total"])

    return run


def _first(vectors: DataFrame, k: int, length: int, seed: str) -> np.ndarray:
    """The ``k`` usable vectors whose seeded id has the least hash, as whole numbers."""

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, whole = whole_vectors(batch.column(1), length)
            offsets = np.arange(0, whole.size + 1, length, dtype=np.int32)
            whole = pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), whole], ["vec_id", "whole"])

    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    kept = vectors.mapInArrow(usable, "vec_id long, whole array<long>")
    # Of ``k`` rows of ``length`` numbers, whatever the table's size, the driver takes the least.
    rows = kept.orderBy(order, "whole").limit(k).collect()
    return np.array([row.whole for row in rows], np.int64).reshape(len(rows), length)


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of its vectors' mean; one without vectors stays."""
    length = centroids.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(Centroids(centroids))
    sums = vectors.mapInArrow(_sums(shared, length), "cluster int, place int, n long, total long")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "total")]
    # One row per cluster and component.
    out = centroids.copy()
    for row in sums.groupBy("cluster", "place").agg(*wide).collect():
        out[row.cluster, row.place] = int(row.total) // int(row.n)
    shared.unpersist()
    return out


def cluster_vectors(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, length: int = LENGTH, seed: str = "2"
) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each usable vector.

    The first two columns of ``vectors`` are a long id and a list of numbers, whatever their names; further
    columns are not looked at. Vectors that are
    null, of another length, or hold a null or non-finite component take no part; nor do rows without an
    id. Components become floor(256 * x), held within ``limit``. The first centroids are the ``k`` vectors
    (all, if fewer) whose id after ``seed:`` has the least sha256, equal ids by their components. Each
    round assigns every vector to the nearest centroid by squared distance, ties to the smaller number,
    and moves every centroid that has vectors to the floor of their mean; then vectors are assigned once
    more. Repeated rows are rows of their own. Inertias beyond 64 bits count as the greatest long.
    Without usable vectors there are no rows.
    """
    spark = vectors.sparkSession
    named = vectors.toDF(*["vec_id", "vector", *(f"_{i}" for i in range(2, len(vectors.columns)))])
    vectors = named.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long"), "vector")
    centroids = _first(vectors, k, length, seed)
    if not len(centroids):
        shape = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], shape)
    for _ in range(rounds):
        centroids = _moved(vectors, centroids)
    shared = spark.sparkContext.broadcast(Centroids(centroids))
    placed = vectors.mapInArrow(_assign(shared, length), "vec_id long, cluster int, distance long")
    by_cluster = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("spread")).collect()
    spread = {row.cluster: int(row.spread) for row in by_cluster}
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    about = [
        (c, min(spread[c], _LONG), min(sum(spread.values()), _LONG), digests[c]) for c in sorted(spread)
    ]
    # One row per cluster, ``k`` at most.
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
