"""Exact nearest-chunk search for a whole table of questions."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.functions.vectors import METRICS
from askloom.operators.index import content_hash
from askloom.session import materialize

BLOCK_BYTES = 8 * 1024 * 1024  # vectors that a task compares at once
QUESTION_TILE, COLUMN_TILE = 256, 4096
PAIR_VALUES = 1_000_000  # numbers of the pairs that are measured at once
_SINGLE = 1.2e-7  # rounding of a product or sum in single precision
GRID_BYTES = 32 * 1024 * 1024  # question vectors that a cell of the grid holds
BROADCAST_BYTES = 64 * 1024 * 1024
PRUNING_VALUES = 1000  # values that are pushed to the scan as a filter, at most
_WANT, _TAG, _CELL, _LAST = "__want", "__tag", "__cell", "__last"


def topk(
    distances: DataFrame,
    k: int,
    by: str = "question_id",
    keys: Sequence[str] = ("distance", "chunk_id"),
) -> DataFrame:
    """The k nearest rows per question with their ``rank`` from 1.

    Written as ``row_number() <= k`` so that Spark cuts each map-side group to k
    rows before the shuffle.
    """
    order = Window.partitionBy(by).orderBy(*keys)
    return distances.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column as a float64 matrix; all must have one length."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.asarray(vectors.value_lengths())
    if len(lengths) and lengths.min() != lengths.max():
        raise ValueError("vectors differ in length")
    dim = int(lengths[0]) if len(lengths) else 0
    return np.asarray(vectors.flatten(), dtype=np.float64).reshape(len(lengths), dim)


def _sum_dims(parts: np.ndarray) -> np.ndarray:
    """Row sums added strictly from the first column to the last, as the column functions do."""
    total = np.zeros(len(parts))
    for d in range(parts.shape[1]):
        total += parts[:, d]
    return total


def _pair_distance(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of row pairs, bit for bit those of ``functions.vectors.vector_distance``."""
    if metric == "l2sq":
        return _sum_dims((a - b) ** 2)
    dot = _sum_dims(a * b)
    if metric == "ip":
        return -dot
    norms = np.sqrt(_sum_dims(a * a)) * np.sqrt(_sum_dims(b * b))
    return 1 - np.divide(dot, norms, out=np.zeros_like(dot), where=norms != 0)


def _slow_candidates(asked: np.ndarray, block: np.ndarray, fresh: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(asked row, block row) of all pairs within rounding error of the k-th key, in doubles, for vectors of any size."""
    if metric == "cosine":
        unit_a = asked / np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), 1e-300)
        unit_b = block / np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-300)
        rough, scale = -(unit_a @ unit_b.T), np.ones(len(asked))
    else:
        sq_a, sq_b = (asked**2).sum(axis=1), (block**2).sum(axis=1)
        dots = asked @ block.T
        rough = -dots if metric == "ip" else sq_b[None, :] - 2 * dots
        # Rows that are not finite have no rounding error to allow for, and must not hide that of others.
        scale = sq_a + sq_b[np.isfinite(sq_b)].max(initial=0.0)
    rough[np.isnan(rough)] = np.inf  # last, as in Spark's order
    scale = np.nan_to_num(scale, nan=0.0, posinf=0.0)
    if k >= fresh.sum():
        return tuple(g.ravel() for g in np.indices(rough.shape))
    kth = np.partition(rough[:, fresh], k - 1, axis=1)[:, k - 1]
    return np.nonzero(rough <= (kth + 1e-9 * scale)[:, None])


def _plain(vectors: np.ndarray) -> bool:
    """Whether all components are of a size that single precision can square and add up."""
    most = np.abs(vectors).max(axis=1, initial=0.0)
    return bool(((most == 0) | ((most > 1e-12) & (most < 1e12))).all())


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0, 1, norms)


class _Block:
    """Index rows of a block in single precision, to tell which pairs with a question are worth measuring."""

    def __init__(self, block: np.ndarray, fresh: np.ndarray, metric: str):
        self.block, self.fresh, self.metric = block, fresh, metric
        self.fine = _plain(block)
        if self.fine:
            sq = (block**2).sum(axis=1)
            self.most = 1.0 if metric == "cosine" else float(sq.max(initial=0.0))
            rows = _unit(block) if metric == "cosine" else block
            rows = np.column_stack([rows, sq]) if metric == "l2sq" else rows
            self.rows = rows.astype(np.float32)

    def candidates(self, asked: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asked row, block row) of all pairs that can be among an asked row's k nearest keys and within ``bound``.

        One row of each key (``fresh``) comes first in the block, so the k-th of these is no nearer than the
        k-th key. What lies within rounding error of that, or of ``bound``, is kept.
        """
        if not (self.fine and _plain(asked)):
            return _slow_candidates(asked, self.block, self.fresh, k, self.metric)
        sq = (asked**2).sum(axis=1)
        if self.metric == "l2sq":
            left, shift = np.column_stack([-2 * asked, np.ones(len(asked))]), -sq
        elif self.metric == "ip":
            left, shift = -asked, 0.0
        else:
            left, shift, sq = -_unit(asked), -1.0, 1.0
        room = _SINGLE * (asked.shape[1] + 12) * (sq + self.most)
        limit, left = bound + shift + room, left.astype(np.float32)
        n_fresh, rows, cols = int(self.fresh.sum()), [], []
        for at in range(0, len(self.rows), COLUMN_TILE):
            rough = left @ self.rows[at : at + COLUMN_TILE].T
            own = min(n_fresh - at, rough.shape[1])
            if own >= k and not np.isfinite(limit).all():
                kth = np.partition(rough[:, :own], k - 1, axis=1)[:, k - 1]
                limit = np.minimum(limit, kth + 2 * room)
            found = np.flatnonzero(rough <= limit.astype(np.float32)[:, None])
            rows.append(found // rough.shape[1])
            cols.append(found % rough.shape[1] + at)
        rows, cols = np.concatenate(rows), np.concatenate(cols)
        if len(rows) > 1000 + len(asked) * len(self.rows) // 20:
            # Distances that differ by less than single precision tells.
            return _slow_candidates(asked, self.block, self.fresh, k, self.metric)
        return rows, cols


def _nearest_ranks(rows: np.ndarray, rank: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k nearest distinct ranks, ties to the smaller rank, in order."""
    first = np.lexsort((dist, rank, rows))
    fresh = np.r_[True, (np.diff(rows[first]) != 0) | (np.diff(rank[first]) != 0)][: len(first)]
    first = first[fresh]
    order = first[np.lexsort((rank[first], dist[first], rows[first]))]
    ordered = rows[order]
    begin = np.searchsorted(ordered, ordered)
    return order[np.arange(len(order)) - begin < k]


def _without_spare_copies(block: np.ndarray, id_rank: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the k nearest keys of any vector: of each set of copies the k smallest ids.

    Copies are equally far from everything and ties go to the smaller id, so the
    result stays exact however many copies a block holds. A key that repeats a
    vector counts once.
    """
    weights = np.sqrt(np.arange(2.0, 2.0 + block.shape[1]))
    order = np.lexsort((id_rank, _sum_dims(block * weights)))
    ordered, ranks = block[order], id_rank[order]
    starts = np.r_[True, (ordered[1:] != ordered[:-1]).any(axis=1)]
    fresh = starts | np.r_[True, ranks[1:] != ranks[:-1]]
    order, starts = order[fresh], starts[fresh]
    place = np.arange(len(order)) - np.flatnonzero(starts)[np.cumsum(starts) - 1]
    return order[place < k]


def _id_ranks(ids: pa.Array) -> np.ndarray:
    """The place of each id in the order of all."""
    places = pc.dictionary_encode(ids)
    order = np.asarray(pc.sort_indices(places.dictionary))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank[np.asarray(places.indices)]


def _search_block(
    asked: np.ndarray, ids: pa.Array, block: np.ndarray, k: int, metric: str, bound: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """(asked row, id, distance) of each asked vector's k nearest keys in the block, without those past its ``bound``.

    A matrix product finds everything within rounding error of the k-th distance; only those few pairs
    are measured exactly. Ties go to the smaller id.
    """
    if asked.shape[1] != block.shape[1]:
        raise ValueError("vectors differ in length")
    rank = _id_ranks(ids)
    kept = _without_spare_copies(block, rank, k)
    kept = kept[np.argsort(rank[kept], kind="stable")]
    fresh = np.r_[True, np.diff(rank[kept]) != 0][: len(kept)]
    order = np.argsort(~fresh, kind="stable")
    kept, fresh = kept[order], fresh[order]
    block, rank = block[kept], rank[kept]
    held = _Block(block, fresh, metric)
    bound = np.full(len(asked), np.inf) if bound is None else bound
    step = max(1, PAIR_VALUES // max(1, asked.shape[1]))
    for start in range(0, len(asked), QUESTION_TILE):
        part = asked[start : start + QUESTION_TILE]
        rows, cols = held.candidates(part, k, bound[start : start + QUESTION_TILE])
        if len(rows):
            exact = [_pair_distance(part[rows[i : i + step]], block[cols[i : i + step]], metric) for i in range(0, len(rows), step)]
            dist = np.concatenate(exact)
            best = _nearest_ranks(rows, rank[cols], dist, k)
            yield rows[best] + start, ids.take(pa.array(kept[cols[best]])), dist[best]


def _nearest_keys(rows: np.ndarray, ids: pa.Array, dist: np.ndarray, k: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of (asked row, id, distance): each row's k nearest distinct ids, ties to the smaller id."""
    order = _nearest_ranks(rows, _id_ranks(ids), dist, k)
    return rows[order], ids.take(pa.array(order)), dist[order]


class _Best:
    """The k nearest keys of every question so far."""

    def __init__(self, n_asked: int, k: int):
        self.k, self.hits = k, None
        self.bound = np.full(n_asked, np.inf)  # the distance of the k-th key

    def add(self, hits: list[tuple[np.ndarray, pa.Array, np.ndarray]]) -> None:
        if not hits:
            return
        rows, ids, dist = zip(*hits, *([] if self.hits is None else [self.hits]))
        self.hits = rows, _, dist = _nearest_keys(np.concatenate(rows), pa.concat_arrays(ids), np.concatenate(dist), self.k)
        count = np.bincount(rows, minlength=len(self.bound))
        full = np.flatnonzero(count == self.k)
        last = dist[np.cumsum(count)[full] - 1]
        self.bound[full] = np.where(np.isnan(last), np.inf, last)

    def batches(self, asked_ids: pa.Array, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.hits is not None:
            columns = [asked_ids.take(pa.array(self.hits[0])), self.hits[1], pa.array(self.hits[2])]
            yield from pa.Table.from_arrays(columns, schema=schema).to_batches(max_chunksize=10_000)


def _in_blocks(batches: Iterable[pa.RecordBatch], vector: str) -> Iterator[pa.Table]:
    """Arrow batches put together, or cut, to blocks of about ``BLOCK_BYTES`` of doubles."""
    held: list[pa.RecordBatch] = []
    room = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            if not room:
                dim = len(batch.column(vector)[at])
                room = max(1, BLOCK_BYTES // (8 * max(dim, 1)))
            part = batch.slice(at, room)
            held.append(part)
            at, room = at + part.num_rows, room - part.num_rows
            if not room:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _ids(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _filtered(index: DataFrame, where: Mapping[str, object] | None) -> DataFrame:
    for column, value in (where or {}).items():
        index = index.filter(F.col(column) == F.lit(value))
    return index


def nearest(
    questions: DataFrame,
    index: DataFrame,
    k: int,
    metric: str = "l2sq",
    *,
    where: Mapping[str, object] | None = None,
    match: tuple[str, str] | None = None,
    question_key: str = "question_id",
    index_key: str = "chunk_id",
    vector: str = "embedding",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Exact k nearest ``(question_key, index_key, distance, rank)``.

    A key counts once per question, by its nearest row, however often the index holds it; so a question
    gets k keys if there are so many. Nothing is paired up row by row: the index is scanned where it
    lies, unshuffled, if the questions fit ``broadcast_bytes``; more questions than that meet the index in
    a grid of tasks (``_search_grid``) and none of them passes through the driver. Each task compares
    matrices block by block, keeps a running best k, and sends these on once; a grouped top-k merges them.

    The questions are looked at more than once, so computed vectors should be stored before (``retrieve``
    does). Rows without a vector can be nobody's neighbour and are left out; vectors that are not finite
    come last. ``where`` filters the index before ranking, for all questions alike. ``match`` names a column
    of the questions and one of the index: a question sees only index rows that hold its value, and all
    rows if its value is null. Each block of the index is compared with the questions of the values that
    it holds, where it lies, so a value with much of the index is shared by as many tasks as any.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if k < 1:
        raise ValueError("k must be at least 1")
    if index_key == question_key:
        raise ValueError("question and index keys need different names")
    wants, tags = ([F.col(c).alias(name)] for c, name in zip(match, (_WANT, _TAG))) if match else ([], [])
    asked = questions.select(question_key, vector, *wants).filter(F.col(vector).isNotNull())
    found = _filtered(index, where).select(index_key, vector, *tags).filter(F.col(vector).isNotNull())
    schema = T.StructType(
        [asked.schema[question_key], found.schema[index_key], T.StructField("distance", T.DoubleType())]
    )
    count, dim = asked.agg(F.count("*"), F.max(F.size(vector))).first()
    if not count:
        empty = questions.sparkSession.createDataFrame([], schema)
        return topk(empty, k, question_key, ("distance", index_key))
    row_bytes = 8 * ((dim or 0) + 8)
    if count <= max(1, broadcast_bytes // row_bytes):
        pairs = _search_group(asked.toArrow(), found, schema, k, metric, vector)
    else:
        pairs = _search_grid(asked, found, schema, k, metric, vector, -(-count * row_bytes // GRID_BYTES))
    # Tasks saw other rows of a key: its nearest counts.
    pairs = pairs.groupBy(question_key, index_key).agg(F.min("distance").alias("distance"))
    return topk(pairs, k, question_key, ("distance", index_key))


def _search_group(
    taken: pa.Table, found: DataFrame, schema: T.StructType, k: int, metric: str, vector: str
) -> DataFrame:
    question_key, index_key = schema[0].name, schema[1].name
    wants = None
    if _TAG in found.columns:
        kind = _arrow_schema(found.select(_TAG).schema)[0].type
        wants = _ids(taken[_WANT].cast(kind))
        values = wants.unique().drop_null()
        if not wants.null_count and len(values) <= PRUNING_VALUES:
            found = found.filter(F.col(_TAG).isin(values.to_pylist()))
    shipped = found.sparkSession.sparkContext.broadcast(
        (_ids(taken[question_key]), _matrix(taken[vector]), wants)
    )
    arrow_schema = _arrow_schema(schema)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _search_batches(*shipped.value, batches, vector, index_key, k, metric, arrow_schema)

    return found.mapInArrow(search, schema)


def _search_batches(
    asked_ids: pa.Array,
    asked: np.ndarray,
    wants: pa.Array | None,
    batches: Iterable[pa.RecordBatch],
    vector: str,
    index_key: str,
    k: int,
    metric: str,
    schema: pa.Schema,
) -> Iterator[pa.RecordBatch]:
    """The k nearest keys of each question among the index rows of some batches."""
    chosen = None if wants is None else _Wants(wants)
    best = _Best(len(asked), k)
    for table in _in_blocks(batches, vector):
        hits = []
        for own, part in [(slice(None), table)] if chosen is None else chosen.pairs(table):
            places = np.arange(len(asked))[own]
            found = _search_block(asked[own], _ids(part[index_key]), _matrix(part[vector]), k, metric, best.bound[own])
            hits += [(places[q], ids, dist) for q, ids, dist in found]
        best.add(hits)
    yield from best.batches(asked_ids, schema)


def _search_grid(
    asked: DataFrame, found: DataFrame, schema: T.StructType, k: int, metric: str, vector: str, groups: int
) -> DataFrame:
    """Questions and index rows in ``groups`` or more groups each; each pair of groups meets in a task of its own.

    A task holds one group of questions and goes through the index rows block by block. Repeated
    (key, vector) rows of the index are dropped first. Each side is shuffled as often as there are groups.
    """
    question_key, index_key = schema[0].name, schema[1].name
    spark = found.sparkSession
    # Two tasks for each core at least.
    groups = max(groups, math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism)))
    filters = _TAG in found.columns
    if filters:
        values = asked.select(F.col(_WANT).cast(found.schema[_TAG].dataType)).distinct().limit(PRUNING_VALUES + 1).collect()
        if len(values) <= PRUNING_VALUES and all(v[0] is not None for v in values):
            found = found.filter(F.col(_TAG).isin([v[0] for v in values]))
    found = found.distinct()
    group = F.sequence(F.lit(0), F.lit(groups - 1))
    row, column = F.pmod(F.xxhash64(question_key, vector), F.lit(groups)), F.pmod(F.xxhash64(index_key, vector), F.lit(groups))

    def placed(side: DataFrame, cell, last: int) -> DataFrame:
        made = [F.col(n) if n in side.columns else F.lit(None).cast(kind).alias(n) for n, kind in columns.items()]
        return side.select(F.explode(F.transform(group, cell)).alias(_CELL), F.lit(last).cast("int").alias(_LAST), *made)

    columns = {question_key: schema[0].dataType, index_key: schema[1].dataType, vector: asked.schema[vector].dataType}
    if filters:
        columns |= {_WANT: found.schema[_TAG].dataType, _TAG: found.schema[_TAG].dataType}
        asked = asked.withColumn(_WANT, F.col(_WANT).cast(found.schema[_TAG].dataType))
    both = placed(asked, lambda i: (row * groups + i).cast("int"), 0).union(placed(found, lambda i: (i * groups + column).cast("int"), 1))
    # A task has one cell, its questions first.
    cells = both.repartitionById(groups * groups, F.col(_CELL)).sortWithinPartitions(_LAST)
    arrow_schema = _arrow_schema(schema)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches, taken = iter(batches), []
        for batch in batches:
            cut = batch.num_rows - (pc.sum(batch[_LAST]).as_py() or 0)
            taken.append(batch.slice(0, cut))
            if cut < batch.num_rows:
                own = pa.Table.from_batches(taken)
                if own.num_rows:
                    questions = _ids(own[question_key]), _matrix(own[vector]), _ids(own[_WANT]) if filters else None
                    rest = itertools.chain([batch.slice(cut)], batches)
                    yield from _search_batches(*questions, rest, vector, index_key, k, metric, arrow_schema)
                return

    return cells.mapInArrow(search, schema)


class _Wants:
    """The questions of each wanted value."""

    def __init__(self, wants: pa.Array):
        coded = wants.dictionary_encode()
        codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
        self.values = coded.dictionary
        order = np.argsort(codes, kind="stable")
        cuts = np.searchsorted(codes[order], np.arange(len(self.values) + 1))
        self.free = order[: cuts[0]]
        self.own = [order[a:b] for a, b in zip(cuts, cuts[1:])]

    def pairs(self, table: pa.Table) -> Iterator[tuple[np.ndarray, pa.Table]]:
        """Questions, and the rows of a block that these see."""
        if len(self.free):
            yield self.free, table
        found = pc.index_in(_ids(table[_TAG]), value_set=self.values, skip_nulls=True)
        found = pc.fill_null(found, -1).to_numpy(zero_copy_only=False)
        order = np.argsort(found, kind="stable")
        codes, cuts = np.unique(found[order], return_index=True)
        for code, a, b in zip(codes.tolist(), cuts, [*cuts[1:], len(order)]):
            if code >= 0:
                yield self.own[code], table.take(pa.array(order[a:b]))


def knn(
    questions: DataFrame,
    index: DataFrame,
    k: int = 5,
    metric: str = "l2sq",
    *,
    where: Mapping[str, object] | None = None,
    match: tuple[str, str] | None = None,
    question_key: str = "question_id",
    index_key: str = "chunk_id",
    vector: str = "embedding",
    payload: Sequence[str] | None = None,
    exclude_same_id: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The k nearest index rows per question: keys, ``distance``, ``rank`` and the index's payload.

    The search itself reads keys and vectors only; the payload (default: all
    other index columns) is looked up for the winners. A key that the index holds
    more than once is one neighbour, with the payload of one of its rows: the one
    with the smallest content hash. ``exclude_same_id`` keeps an index row from
    being its own neighbour when a table searches itself.
    """
    want = k + 1 if exclude_same_id else k
    hits = nearest(
        questions,
        index,
        want,
        metric,
        where=where,
        match=match,
        question_key=question_key,
        index_key=index_key,
        vector=vector,
        broadcast_bytes=broadcast_bytes,
    )
    if exclude_same_id:
        others = hits.filter(F.col(question_key) != F.col(index_key)).drop("rank")
        hits = topk(others, k, question_key, ("distance", index_key))
    if payload is None:
        payload = [c for c in index.columns if c not in (index_key, vector)]
    if not payload:
        return hits
    # Stored, so that Spark knows how few they are: next to them the index is not shuffled for its payload.
    hits = materialize(hits, "hits")
    lookup = _filtered(index, where).filter(F.col(vector).isNotNull()).select(index_key, *payload)
    found = lookup.join(hits, index_key).withColumn("_hash", content_hash(lookup))
    one = Window.partitionBy(*hits.columns).orderBy("_hash")
    return found.withColumn("_row", F.row_number().over(one)).filter("_row = 1").drop("_row", "_hash")


def retrieve(
    questions: DataFrame, index: DataFrame, embedder, k: int = 5, text: str = "question", **options
) -> DataFrame:
    """Embed a question table and search for it.

    The vectors are stored first: the search looks at them more than once, and
    an embedding model should be asked only once.
    """
    key = options.get("question_key", "question_id")
    vector = options.get("vector", "embedding")
    wants = [options["match"][0]] if options.get("match") else []
    asked = questions.select(key, embedder(text).alias(vector), *wants)
    return knn(materialize(asked, "questions"), index, k, **options)


def to_documents(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Positional result rows to documents.

    After the ``keep`` columns, the first column is the content, the last one the
    score, and those between become metadata under their own names. The score
    stays as a column instead of being lost.
    """
    cols = [c for c in df.columns if c not in keep]
    if len(cols) < 2:
        raise ValueError("need a content and a score column")
    between = [part for c in cols[1:-1] for part in (F.lit(c), F.col(c).cast("string"))]
    metadata = F.create_map(*between) if between else F.create_map().cast("map<string,string>")
    return df.select(
        *keep,
        F.col(cols[0]).alias("page_content"),
        metadata.alias("metadata"),
        F.col(cols[-1]).alias("score"),
    )


RESPONSE_SCHEMA = (
    "manifest struct<columns:array<struct<name:string>>>, result struct<data_array:array<array<string>>>"
)


def documents_from_responses(df: DataFrame, response: str, keep: Sequence[str] = ()) -> DataFrame:
    """The same for search responses held as JSON text, one response per row.

    Names come from each response's manifest; ``rank`` is the place in the response.
    """
    parsed = df.select(*keep, F.from_json(response, RESPONSE_SCHEMA).alias("_r"))
    rows = parsed.select(
        *keep,
        F.col("_r.manifest.columns.name").alias("_names"),
        F.posexplode("_r.result.data_array").alias("_at", "_row"),
    )
    middle = F.size("_row") - 2
    return rows.select(
        *keep,
        (F.col("_at") + 1).alias("rank"),
        F.element_at("_row", 1).alias("page_content"),
        F.map_from_arrays(F.slice("_names", F.lit(2), middle), F.slice("_row", F.lit(2), middle)).alias(
            "metadata"
        ),
        F.element_at("_row", -1).cast("double").alias("score"),
    )


def content_only(documents: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Documents reduced to their content."""
    return documents.select(*keep, "page_content")
