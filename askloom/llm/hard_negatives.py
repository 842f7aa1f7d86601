"""Hard negatives by exact inner products of Kronecker-packed vectors.

Components are whole numbers. A block of candidates is biased so that no component is negative, and the
same component of several candidates goes into separated fields of one wide integer, wide enough for a
whole inner product. One multiplication per component of a (biased) anchor then adds to all fields at
once; unpacking the fields and taking the biases off again gives every candidate's exact score. Wide
integers lie in doubles while 53 bits hold a field, so that the products run as a matrix product, and in
Python's unbounded integers beyond.

Anchors are a stated query set: they are cut into groups of bounded size, broadcast one by one, over
candidates that stay where they are. A task keeps each anchor's best few of all its blocks; the short
lists of the tasks merge in a tree. A first pass finds the positives, a second the negatives below them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askloom.session import materialize

SCALE = 256.0
POSITIVES, NEGATIVES = 5, 5
LEAST = (80, 100)  # a negative's least score, as a fraction of its positive's
GROUP_BYTES = 16 << 20  # anchors, and what is kept for them, that are broadcast at once
TILE_ANCHORS = 1024
TILE_BYTES = 8 << 20
FAN = 32
DOUBLE_BITS = 53
WIDE_FIELDS = 16  # candidates in one of Python's integers
_LIMITS = np.iinfo(np.int64)
_LISTS = "no long, place int, vec_id long, score long, shard long"


def whole_vectors(ids: pa.Array, labels: pa.Array, vectors: pa.Array, scale: float = SCALE) -> dict[int, tuple]:
    """By length: ids, labels and floor(scale * x) as doubles of the rows that are usable."""
    vectors = pc.cast(vectors, pa.large_list(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    named = pc.and_(pc.is_valid(ids), pc.is_valid(labels)).to_numpy(zero_copy_only=False)
    out = {}
    for size in np.unique(sizes[(sizes >= 0) & named]).tolist():
        rows = np.flatnonzero((sizes == size) & named)
        flat = pc.list_flatten(vectors.take(pa.array(rows)))
        matrix = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), size)
        with np.errstate(over="ignore", invalid="ignore"):
            matrix = np.floor(scale * matrix)
        rows, matrix = rows[np.isfinite(matrix).all(1)], matrix[np.isfinite(matrix).all(1)]
        own, label = (x.take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64) for x in (ids, labels))
        out[size] = own, label, matrix
    return out


@dataclass
class Packed:
    """Candidates of one block, several to a wide integer."""

    words: np.ndarray  # one row per component, one wide integer per ``fields`` candidates
    sums: np.ndarray  # of each candidate's biased components
    bias: int
    width: int
    fields: int
    count: int


def pack(vectors: np.ndarray, low: int, high: int) -> Packed:
    """Candidates for anchors whose components lie in ``low`` to ``high``."""
    count, size = vectors.shape
    kind = object if max(abs(vectors).max(initial=0), -low, high) >= 2.0**31 else np.int64
    whole = np.frompyfunc(int, 1, 1)(vectors) if kind is object else vectors.astype(np.int64)
    bias = max(0, -int(whole.min(initial=0)))
    biased = whole + bias
    most = max(size, 1) * (int(biased.max(initial=0)) + 1) * (high - min(low, 0) + 1)
    width = most.bit_length()
    narrow = width <= DOUBLE_BITS and kind is np.int64
    fields = DOUBLE_BITS // width if narrow else WIDE_FIELDS
    groups = -(-count // fields)
    room = np.zeros((groups * fields, size), np.int64 if narrow else object)
    room[:count] = biased
    room = room.reshape(groups, fields, size)
    words = np.zeros((groups, size), room.dtype)
    for f in range(fields):
        words += room[:, f] * (1 << f * width)
    sums = biased.sum(1)
    words, sums = (words.astype(np.float64), sums) if narrow else (words, sums.astype(object))
    return Packed(np.ascontiguousarray(words.T), sums, bias, width, fields, count)


def packed_scores(anchors: np.ndarray, low: int, packed: Packed) -> np.ndarray:
    """Every anchor's exact inner product with every candidate, held within 64 bits.

    ``low`` is the least component that any anchor of the pack's range has.
    """
    shift = max(0, -low)
    if packed.words.dtype == object:
        whole = np.frompyfunc(int, 1, 1)(anchors).astype(object).reshape(anchors.shape)
        products = (whole + shift) @ packed.words if anchors.shape[1] else np.zeros((len(anchors), packed.words.shape[1]), object)
    else:
        whole = anchors.astype(np.int64)
        products = ((anchors + shift) @ packed.words).astype(np.int64)
    mask = (1 << packed.width) - 1
    fields = [products >> f * packed.width & mask for f in range(packed.fields)]
    raw = np.stack(fields, axis=2).reshape(len(anchors), -1)[:, : packed.count]
    scores = raw - shift * packed.sums[None, :] - packed.bias * whole.sum(1)[:, None]
    if scores.dtype == object:
        held = np.frompyfunc(lambda s: min(max(int(s), _LIMITS.min), _LIMITS.max), 1, 1)
        scores = held(scores).astype(np.int64)
    return scores


def _least(top: np.ndarray) -> np.ndarray:
    """The least whole score that is ``LEAST`` of ``top``, without leaving 64 bits."""
    hundreds, rest = np.divmod(top, LEAST[1])
    return hundreds * LEAST[0] - (-rest * LEAST[0] // LEAST[1])


class _Lists:
    """Each slot's best ``k`` (score, id) so far, ties to the smaller id."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(slots, _LIMITS.min)  # the last kept score and id of a full list
        self.last = np.full(slots, _LIMITS.max)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        better = (score > self.least[slot]) | (ids < self.last[slot])
        slot, score, ids = (np.r_[x, y[better]] for x, y in zip((self.slot, self.score, self.id), (slot, score, ids)))
        order = np.lexsort((ids, ~score, slot))  # ~ turns the order round and cannot overflow
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        full = place == self.k - 1
        self.least[slot[full]], self.last[slot[full]] = score[full], ids[full]
        kept = place < self.k
        self.slot, self.score, self.id = slot[kept], score[kept], ids[kept]


class _Search:
    """The anchors of one length against candidates: their positives, or negatives below ``tops``."""

    def __init__(self, ids, labels, matrix, numbers, tops: np.ndarray | None, k: int):
        self.ids, self.labels, self.matrix, self.numbers, self.tops = ids, labels, matrix, numbers, tops
        self.low, self.high = (int(f(initial=0)) for f in (matrix.min, matrix.max))
        self.places = 1 if tops is None else tops.shape[1]
        self.lists = _Lists(len(ids) * self.places, k)

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        rows = max(1, TILE_BYTES // (8 * max(vectors.shape[1], TILE_ANCHORS)))
        for v in range(0, len(ids), rows):
            packed = pack(vectors[v : v + rows], self.low, self.high)
            for a in range(0, len(self.ids), TILE_ANCHORS):
                scores = packed_scores(self.matrix[a : a + TILE_ANCHORS], self.low, packed)
                for place in range(self.places):
                    self._tile(a, place, scores, ids[v : v + rows], labels[v : v + rows])

    def _tile(self, start: int, place: int, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        anchors = np.arange(start, start + len(scores))
        slots = anchors * self.places + place
        least = self.lists.least[slots]
        if self.tops is not None:
            top = self.tops[anchors, place]
            least = np.maximum(least, _least(top))
        row, column = np.nonzero(scores >= least[:, None])
        own, found = anchors[row], scores[row, column]
        same = self.labels[own] == labels[column]
        if self.tops is None:
            fine = same & (self.ids[own] != ids[column])
        else:
            fine = ~same & (found <= top[row]) & (self.ids[own] != ids[column])
        self.lists.add(slots[row[fine]], found[fine], ids[column[fine]])


def _pass(shared, k: int):
    """A task's best lists; ``shared`` holds by length what a ``_Search`` needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {size: _Search(*held, k) for size, held in shared.value.items()}
        for batch in batches:
            for size, (ids, labels, vectors) in whole_vectors(*batch.columns).items():
                if size in searches and len(ids):
                    searches[size].add(ids, labels, vectors)
        task = TaskContext.get().partitionId()
        for search in searches.values():
            lists = search.lists
            columns = [
                search.numbers[lists.slot // search.places],
                (lists.slot % search.places).astype(np.int32),
                lists.id,
                lists.score,
                np.full(len(lists.id), task, np.int64),
            ]
            names = ["no", "place", "vec_id", "score", "shard"]
            whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
            for at in range(0, whole.num_rows, 10_000):
                yield whole.slice(at, 10_000)

    return run


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each (no, place) with their rank, ``FAN`` tasks' lists at a time."""
    shards = (lists.agg(F.max("shard")).first()[0] or 0) + 1
    while True:
        shards = -(-shards // FAN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN))
        order = Window.partitionBy("no", "place", "shard").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if shards <= 1:
            return lists.drop("shard")
        lists = lists.drop("rank")


def _found(vectors: DataFrame, held: dict, k: int, name: str) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(held)
    lists = materialize(vectors.mapInArrow(_pass(shared, k), _LISTS), name)
    shared.unpersist()
    return materialize(_merged(lists, k), f"merged-{name}")


def _first_three(df: DataFrame) -> DataFrame:
    named = df.toDF(*["vec_id", "label", "vector", *(f"_{i}" for i in range(3, len(df.columns)))])
    return named.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "vector")


def mine_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    The first three columns of both inputs are a long id, a label (whole number) and a list of numbers,
    whatever their names; further columns are not looked at. Components become floor(256 * x), scores are inner products, ties go to the smaller id.
    An anchor's positives are its ``positives`` best rows of its label, of another id; each positive's
    negatives are the ``negatives`` best rows of other labels and ids whose score is at most the
    positive's and at least ``LEAST`` of it, so a positive below zero has none. Rows whose id, label or
    vector is null, or that hold a null or non-finite component, take no part; vectors of another length
    than the anchor are no candidates. Repeated rows count as often as they are there; repeated anchors
    count once, and different anchors of one id are searched for each. Scores beyond 64 bits count as
    the nearest long. Empty inputs give no rows.
    """
    vectors, anchors = _first_three(vectors), _first_three(anchors).dropna().distinct()
    kept = 8 * (F.size("vector") + 3 * positives * negatives + 8)
    size = anchors.agg(F.sum(kept)).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    out = None
    for group in range(groups):
        own = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == group).toArrow().combine_chunks()
        columns = [pa.chunked_array(own.column(c)).combine_chunks() for c in range(3)]
        held, number = {}, 0
        for length, (ids, labels, matrix) in whole_vectors(*columns).items():
            held[length] = ids, labels, matrix, np.arange(number, number + len(ids)), None
            number += len(ids)
        # At most ``positives`` rows for each anchor of the group come back.
        taken = _found(vectors, held, positives, "positives").toArrow()
        no, rank, vec_id, score = (taken.column(c).to_numpy() for c in ("no", "rank", "vec_id", "score"))
        tops = np.full((number, positives), -1)  # nothing lies between -0.8 and -1
        tops[no, rank - 1] = score
        held = {n: (i, l, m, at, tops[at]) for n, (i, l, m, at, _) in held.items()}
        found = _found(vectors, held, negatives, "negatives")
        ids = np.zeros(number, np.int64)
        for own_ids, _, _, at, _ in held.values():
            ids[at] = own_ids
        pairs = pa.table(
            {
                "no": no.astype(np.int64),
                "place": (rank - 1).astype(np.int32),
                "anchor_id": ids[no],
                "positive_id": vec_id,
                "positive_score": score,
            }
        )
        # As many rows as there are positives of the group, so the broadcast has the group's bound.
        pairs = F.broadcast(vectors.sparkSession.createDataFrame(pairs))
        part = found.join(pairs, ["no", "place"]).select(
            "anchor_id",
            "positive_id",
            "rank",
            F.col("vec_id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
        out = part if out is None else out.union(part)
    return out
