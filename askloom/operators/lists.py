"""Nearest-chunk search over an index laid out by centroid: fewer files to read.

``build_lists`` puts every row into the list of its nearest centroid and keeps, of each list, centre,
radius and number of files. ``probe`` searches each question's nearest few lists: an answer that is mostly
right. ``nearest_in_lists`` is exact: what the nearest lists hold bounds the k-th distance, and a list
whose centre is further away than that bound and its radius together cannot hold a better one, so its
files are not read.

Lists are folders, so the lists that nobody needs are pruned from the scan. The others are searched where
they lie; each task compares a list's rows with just the questions that need it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.operators.retrieval import (
    BROADCAST_BYTES,
    _arrow_schema,
    _Best,
    _ids,
    _in_blocks,
    _matrix,
    _search_block,
    topk,
)
from askloom.session import materialize

LISTS = 256
SAMPLE_ROWS = 20_000  # rows that the centroids are fitted on, at most; every row is indexed
SAMPLE_BYTES = 64 * 1024 * 1024
ROUNDS = 10
LIST = "list_id"
REST = -1  # the list of rows that have no place among centroids; every search reads it
_TILE = 256
_SLACK = 1e-6  # room for rounding, relative to distances and vectors; it can only cost reads


def _placeable(vectors: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as points between which distances order as the metric does, and which have such a point."""
    fine = np.isfinite(vectors).all(1)
    if metric == "cosine":
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            norms = np.sqrt((vectors**2).sum(1, keepdims=True))
            fine &= (norms[:, 0] > 0) & np.isfinite(norms[:, 0])
            vectors = vectors / norms
    return np.where(fine[:, None], vectors, 0.0), fine


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squared = (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)
    return np.sqrt(np.maximum(squared, 0))


def _to_centre(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(1))


def _scale(points: np.ndarray, lists: Lists) -> float:
    """The length of the longest vector that distances are taken from."""
    return float(np.sqrt(max((p**2).sum(1).max(initial=0) for p in (points, lists.centres))))


def _fit(points: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Centroids of a sample by Lloyd's rounds; the first are drawn by their squared distance to those drawn before."""
    random = np.random.default_rng(0)
    drawn = [int(random.integers(len(points)))]
    away = _to_centre(points, points[drawn[0]]) ** 2
    while len(drawn) < lists and away.max() > 0:
        drawn.append(int(random.choice(len(points), p=away / away.sum())))
        away = np.minimum(away, _to_centre(points, points[drawn[-1]]) ** 2)
    centres = points[drawn]
    for _ in range(rounds):
        near = np.concatenate([_distances(points[i : i + 4096], centres).argmin(1) for i in range(0, len(points), 4096)])
        order = np.argsort(near, kind="stable")
        used, first = np.unique(near[order], return_index=True)
        centres = centres.copy()
        centres[used] = np.add.reduceat(points[order], first) / np.diff(np.r_[first, len(order)])[:, None]
    return centres


def _list_column(spark: SparkSession, vector: str, centres: np.ndarray, metric: str):
    shared = spark.sparkContext.broadcast(centres)

    def run(vectors: pa.Array) -> pa.Array:
        centres = shared.value
        number, distance = np.full(len(vectors), REST, np.int32), np.zeros(len(vectors))
        there = np.flatnonzero(np.asarray(vectors.is_valid()))
        if len(centres) and len(there):
            points, fine = _placeable(_matrix(vectors.take(pa.array(there))), metric)
            if points.shape[1] != centres.shape[1]:
                raise ValueError("vectors differ in length")
            for at in range(0, len(there), 1024):
                part = slice(at, at + 1024)
                own = _distances(points[part], centres).argmin(1)
                number[there[part]] = np.where(fine[part], own, REST)
                distance[there[part]] = np.sqrt(((points[part] - centres[own]) ** 2).sum(1))
        return pa.StructArray.from_arrays([pa.array(number), pa.array(distance)], [LIST, "centre_distance"])

    return F.arrow_udf(run, f"struct<{LIST}: int, centre_distance: double>")(F.col(vector))


def build_lists(
    index: DataFrame,
    path: str,
    *,
    lists: int = LISTS,
    metric: str = "l2sq",
    index_key: str = "chunk_id",
    vector: str = "embedding",
    sample_rows: int = SAMPLE_ROWS,
) -> None:
    """Write ``index`` by list to ``path``. ``metric`` is ``l2sq`` or ``cosine``; lists serve no other.

    Centroids are fitted on at most ``sample_rows`` rows (``SAMPLE_BYTES`` of vectors), those whose keys
    have the least hashes. All rows are written, those without a vector or place too. One shuffle by list,
    which adaptive execution balances: a list with much of the index becomes several files.
    """
    if metric not in ("l2sq", "cosine"):
        raise ValueError("lists need a metric with a triangle inequality: l2sq or cosine")
    spark = index.sparkSession
    known = index.filter(F.col(vector).isNotNull())
    dim = known.agg(F.max(F.size(vector))).first()[0] or 0
    rows = max(1, min(sample_rows, SAMPLE_BYTES // (8 * max(dim, 1))))
    sample = known.orderBy(F.xxhash64(index_key), index_key).select(vector).limit(rows).toArrow()
    points, fine = _placeable(_matrix(sample[vector]), metric) if sample.num_rows else (np.zeros((0, dim)), np.zeros(0, bool))
    centres = _fit(points[fine], lists, ROUNDS) if fine.any() else np.zeros((0, dim))
    placed = index.withColumn("_place", _list_column(spark, vector, centres, metric))
    placed = placed.select(*index.columns, "_place.*").hint("rebalance", LIST)
    placed.write.mode("errorifexists").partitionBy(LIST).parquet(f"{path}/rows")
    index.limit(0).write.mode("errorifexists").parquet(f"{path}/columns")
    stored = _stored(spark, path).select(LIST, "centre_distance", F.col("_metadata.file_path").alias("file"))
    stored = stored.groupBy(LIST).agg(
        F.count("*").alias("n_rows"),
        F.max("centre_distance").alias("radius"),
        F.count_distinct("file").alias("n_files"),
    )
    # One row per list.
    about = {r[LIST]: r for r in stored.collect()}
    found = [(i, about[i].n_rows, about[i].n_files, about[i].radius, [] if i == REST else centres[i].tolist(), metric) for i in sorted(about)]
    schema = f"{LIST} int, n_rows long, n_files long, radius double, centre array<double>, metric string"
    spark.createDataFrame(found, schema).coalesce(1).write.mode("errorifexists").parquet(f"{path}/lists")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}/columns").withColumn("centre_distance", F.lit(0.0)).withColumn(LIST, F.lit(0))
    return spark.read.schema(columns.schema).parquet(f"{path}/rows")


@dataclass
class Lists:
    """A laid out index: its rows, and centre, radius and size of each list."""

    rows: DataFrame
    ids: np.ndarray
    centres: np.ndarray
    radius: np.ndarray
    n_rows: np.ndarray
    n_files: dict[int, int]
    metric: str


def open_lists(spark: SparkSession, path: str) -> Lists:
    """Open what ``build_lists`` wrote; one row per list comes to the driver."""
    table = spark.read.parquet(f"{path}/lists").orderBy(LIST).collect()
    own = [r for r in table if r[LIST] != REST]
    return Lists(
        _stored(spark, path),
        np.array([r[LIST] for r in own], np.int64),
        np.array([r.centre for r in own], np.float64) if own else np.zeros((0, 0)),
        np.array([r.radius for r in own], np.float64),
        np.array([r.n_rows for r in own], np.int64),
        {r[LIST]: r.n_files for r in table},
        table[0].metric if table else "l2sq",
    )


@dataclass
class Found:
    """Hits (question_key, index_key, distance, rank), and how many of the index's files were searched."""

    hits: DataFrame
    files_read: int
    files: int


def _needs(points: np.ndarray, fine: np.ndarray, centre: np.ndarray, radius: float, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Questions that need a list: near enough by ``high``, and not yet within ``low``."""
    away = _to_centre(points, centre)
    return np.where(fine, away <= high + radius, np.isinf(high)) & ~(away <= low)


def _search_pass(lists: Lists, taken: pa.Table, found: DataFrame, schema, k: int, vector: str, low, high, reach: bool):
    """One pass over the lists whose centres lie within ``high`` (``reach``: of their radius, too) and past ``low``."""
    question_key, index_key = schema[0].name, schema[1].name
    metric = lists.metric
    matrix = _matrix(taken[vector])
    points, fine = _placeable(matrix, metric)
    room = _SLACK * _scale(points, lists)
    wide = high * (1 + _SLACK) + room
    past = np.where(np.isinf(low), low, low - (np.where(np.isinf(low), 0, abs(low)) * _SLACK + room) / 2)
    needed = np.zeros(len(lists.ids), bool)
    for at in range(0, len(points), _TILE):
        part = slice(at, at + _TILE)
        away = _distances(points[part], lists.centres) if len(lists.ids) else np.zeros((len(points[part]), 0))
        near = (away <= wide[part, None] + reach * lists.radius) & ~(away < past[part, None])
        needed |= (near | ~fine[part, None] & np.isinf(high[part, None])).any(0)
    first = bool((low < 0).any())
    chosen = lists.ids[needed].tolist() + [REST] * (first and REST in lists.n_files)
    about = {int(i): (c, float(r) * reach) for i, c, r in zip(lists.ids, lists.centres, lists.radius)}
    shipped = found.sparkSession.sparkContext.broadcast((_ids(taken[question_key]), matrix, points, fine, low, high, about))
    arrow_schema = _arrow_schema(schema)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_ids, asked, points, fine, low, high, about = shipped.value
        best = _Best(len(asked), k)
        for table in _in_blocks(batches, vector):
            number = table[LIST].to_numpy()
            order = np.argsort(number, kind="stable")
            own, cuts = np.unique(number[order], return_index=True)
            hits = []
            for one, a, b in zip(own.tolist(), cuts, [*cuts[1:], len(order)]):
                wants = low < 0 if one == REST else _needs(points, fine, *about[one], low, high)
                wants = np.flatnonzero(wants)
                if len(wants):
                    part = table.take(pa.array(order[a:b]))
                    for q, ids, dist in _search_block(asked[wants], _ids(part[index_key]), _matrix(part[vector]), k, metric, best.bound[wants]):
                        hits.append((wants[q], ids, dist))
            best.add(hits)
        yield from best.batches(asked_ids, arrow_schema)

    kept = found.filter(F.col(LIST).isin(chosen))
    hits = materialize(kept.mapInArrow(search, schema), "hits")
    return hits.groupBy(question_key, index_key).agg(F.min("distance").alias("distance")), set(chosen)


def _searched(questions, lists: Lists, k: int, probes: int, exact: bool, question_key, index_key, vector, broadcast_bytes) -> Found:
    if k < 1 or probes < 1:
        raise ValueError("k and probes must be at least 1")
    asked = questions.select(question_key, vector).filter(F.col(vector).isNotNull())
    found = lists.rows.select(index_key, vector, LIST).filter(F.col(vector).isNotNull())
    schema = T.StructType([asked.schema[question_key], found.schema[index_key], T.StructField("distance", T.DoubleType())])
    count, dim = asked.agg(F.count("*"), F.max(F.size(vector))).first()
    groups = -(-count // max(1, broadcast_bytes // (16 * ((dim or 0) + 8))))
    pairs, read = asked.sparkSession.createDataFrame([], schema), set()
    for group in range(groups):
        own = asked if groups == 1 else asked.filter(F.pmod(F.xxhash64(question_key), F.lit(groups)) == group)
        taken = own.toArrow()
        if not taken.num_rows:
            continue
        points, fine = _placeable(_matrix(taken[vector]), lists.metric)
        if len(lists.ids) and points.shape[1] != lists.centres.shape[1]:
            raise ValueError("vectors differ in length")
        # The distance of each question's furthest list that is searched first: as many lists as are asked
        # for, more if these hold fewer than k rows, and all if the question has no place.
        near = np.full(len(points), np.inf)
        if len(lists.ids) > probes:
            for at in range(0, len(points), _TILE):
                away = _distances(points[at : at + _TILE], lists.centres)
                order = np.argsort(away, axis=1)
                enough = (np.cumsum(lists.n_rows[order], axis=1) < k).sum(1)
                last = np.clip(enough, probes - 1, len(lists.ids) - 1)
                near[at : at + _TILE] = np.take_along_axis(away, np.take_along_axis(order, last[:, None], 1), 1)[:, 0]
        room = _SLACK * _scale(points, lists)
        near = np.where(fine, near * (1 + _SLACK) + room, np.inf)
        part, chosen = _search_pass(lists, taken, found, schema, k, vector, np.full(len(points), -1.0), near, False)
        read |= chosen
        pairs = pairs.union(part)
        if exact and np.isfinite(near).any():
            bound = _bounds(part, taken, k, question_key, lists.metric) * (1 + _SLACK) + room
            part, chosen = _search_pass(lists, taken, found, schema, k, vector, near, np.where(np.isinf(near), -1.0, bound), True)
            read |= chosen
            pairs = pairs.union(part)
    pairs = pairs.groupBy(question_key, index_key).agg(F.min("distance").alias("distance"))
    hits = topk(pairs, k, question_key, ("distance", index_key))
    return Found(hits, sum(lists.n_files[i] for i in read), sum(lists.n_files.values()))


def _bounds(pairs: DataFrame, taken: pa.Table, k: int, question_key: str, metric: str) -> np.ndarray:
    """How far away a question's k-th neighbour can be, at most; one number per question of the group."""
    ranked = topk(pairs, k, question_key, ("distance", pairs.columns[1])).filter(F.col("rank") == k)
    kth = {r[0]: r[1] for r in ranked.select(question_key, "distance").collect()}
    bound = np.array([kth.get(q, np.inf) for q in taken[question_key].to_pylist()], np.float64)
    bound = np.where(np.isnan(bound), np.inf, np.maximum(bound, 0))
    return np.sqrt(2 * bound + _SLACK**2 if metric == "cosine" else bound)


def probe(
    questions: DataFrame,
    lists: Lists,
    k: int = 5,
    probes: int = 8,
    *,
    question_key: str = "question_id",
    index_key: str = "chunk_id",
    vector: str = "embedding",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> Found:
    """The k nearest rows of each question among its ``probes`` nearest lists, or more if these hold fewer than k.

    Approximate: a neighbour in another list is missed. With as many probes as lists it is exact.
    """
    return _searched(questions, lists, k, probes, False, question_key, index_key, vector, broadcast_bytes)


def nearest_in_lists(
    questions: DataFrame,
    lists: Lists,
    k: int = 5,
    probes: int = 1,
    *,
    question_key: str = "question_id",
    index_key: str = "chunk_id",
    vector: str = "embedding",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> Found:
    """The exact k nearest rows of each question, as ``retrieval.nearest`` finds them, without reading every list.

    A first pass searches each question's ``probes`` nearest lists, a second those that the triangle
    inequality cannot rule out. How many files that saves depends on the data: in many dimensions without
    clusters, none. Questions without a finite vector (cosine: of length zero) search all lists.
    """
    return _searched(questions, lists, k, probes, True, question_key, index_key, vector, broadcast_bytes)
