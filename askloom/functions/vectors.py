"""Dense vector columns: distances, and the built-in hashed term-count embedding."""

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.functions.retry import call_with_retry, no_rate_limit
from askloom.functions.text import _col, words

METRICS = ("l2sq", "cosine", "ip")


def _same_length(a: Column, b: Column) -> Column:
    return F.when(
        F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")
    )


def _fold(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def _dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def inner_product(a: Column | str, b: Column | str) -> Column:
    """Sum of products, in double, from the first dimension to the last."""
    a, b = _col(a), _col(b)
    return _same_length(a, b).otherwise(_dot(a, b))


def l2sq(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance."""
    a, b = _col(a), _col(b)

    def squared(x: Column, y: Column) -> Column:
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return _same_length(a, b).otherwise(_fold(F.zip_with(a, b, squared)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 when either vector is all zeros."""
    a, b = _col(a), _col(b)
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    ratio = F.coalesce(F.try_divide(_dot(a, b), norms), F.lit(0.0))
    return _same_length(a, b).when(a.isNotNull() & b.isNotNull(), ratio)


def vector_distance(a: Column | str, b: Column | str, metric: str = "l2sq") -> Column:
    """Smaller is nearer: squared L2, 1 - cosine, or the negated inner product."""
    if metric == "l2sq":
        return l2sq(a, b)
    if metric == "cosine":
        return 1 - cosine(a, b)
    if metric == "ip":
        return -inner_product(a, b)
    raise ValueError(f"metric must be one of {METRICS}")


def word_bucket(word: str, dim: int) -> int:
    """The first 32 bits of a word's md5, modulo ``dim``."""
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % dim


def _unit_counts(joined: pa.Array, dim: int, words_per_step: int = 4_000_000) -> pa.Array:
    """Unit-length word-count vectors of one Arrow batch of space-joined words.

    Each distinct word of the batch is hashed once. Counting goes through a bounded
    number of words at a time.
    """
    lists = pc.split_pattern(joined, " ")
    coded = lists.flatten().dictionary_encode()
    # a text without words is one empty string, which belongs to no bucket
    buckets = np.array(
        [word_bucket(w, dim) if w else -1 for w in coded.dictionary.to_pylist()], dtype=np.int64
    )
    flat = buckets[np.asarray(coded.indices)]
    lengths = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
    ends = np.cumsum(lengths)
    vectors = np.zeros((len(lengths), dim), dtype=np.float32)
    row = 0
    while row < len(lengths):
        first = ends[row] - lengths[row]
        stop = max(row + 1, int(np.searchsorted(ends, first + words_per_step, side="right")))
        n = stop - row
        owner = np.repeat(np.arange(n), lengths[row:stop])
        bucket = flat[first : ends[stop - 1]]
        used = bucket >= 0
        counts = np.bincount(owner[used] * dim + bucket[used], minlength=n * dim).reshape(n, dim)
        norm = np.sqrt((counts * counts).sum(axis=1))
        vectors[row:stop] = counts / np.where(norm == 0, 1, norm)[:, None]
        row = stop
    return _as_lists(vectors, np.asarray(joined.is_null()))


def _as_lists(vectors: np.ndarray, missing: np.ndarray) -> pa.Array:
    n, dim = vectors.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
    values = pa.array(vectors.astype(np.float32, copy=False).ravel())
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array(missing))


def hashed_embedding(dim: int = 64) -> Callable[[Column | str], Column]:
    """Default embedding: hashed word counts scaled to unit length, ``array<float>``.

    Words are cut JVM-side and go through Arrow as one string per row; hashing and
    counting are vectorized per batch. Null text gives null, wordless text all zeros.
    Like a model it is marked non-deterministic: a filter on the vector would
    otherwise be pushed below the embedding step and compute it a second time.
    """

    def count_words(joined: pa.Array) -> pa.Array:
        return _unit_counts(joined, dim)

    call = F.arrow_udf(count_words, T.ArrayType(T.FloatType())).asNondeterministic()
    return lambda text: call(F.array_join(words(text), " "))


def model_embedding(
    encode: Callable[[Sequence[str]], np.ndarray],
    dim: int,
    batch_rows: int = 500,
    is_rate_limit: Callable[[Exception], bool] = no_rate_limit,
    timeout_sec: float = 600,
    wait_sec: float = 2,
) -> Callable[[Column | str], Column]:
    """Wrap a user's batch encoder (texts in, ``n x dim`` numbers out) as a column function.

    A batch that meets a rate limit is sent again until ``timeout_sec`` is up; then the task fails,
    because an index must not lack rows in silence.

    Marked non-deterministic so that Spark never evaluates the model twice for a row.
    """

    def encode_column(texts: pa.Array) -> pa.Array:
        missing = np.asarray(texts.is_null())
        out = np.zeros((len(texts), dim), dtype=np.float32)
        present = np.flatnonzero(~missing)
        for start in range(0, len(present), batch_rows):
            rows = present[start : start + batch_rows]
            batch = texts.take(pa.array(rows)).to_pylist()
            got, error = call_with_retry(lambda batch=batch: encode(batch), is_rate_limit, timeout_sec, wait_sec)
            if error is not None:
                raise TimeoutError(error)
            got = np.asarray(got)
            if got.shape != (len(rows), dim):
                raise ValueError(f"encoder returned shape {got.shape}, expected {(len(rows), dim)}")
            out[rows] = got
        return _as_lists(out, missing)

    call = F.arrow_udf(encode_column, T.ArrayType(T.FloatType())).asNondeterministic()
    return lambda text: call(_col(text))
