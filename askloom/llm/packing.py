"""Best-fit packing by length patterns: non-negative least squares on the histogram of lengths.

All that packing needs to know is how many pieces of each length there are, and lengths are bounded
by a sequence. So Spark counts lengths, the driver plans on the histogram alone, and Spark hands every
piece its place. The plan fits repeat counts of patterns of up to three pieces that fill a sequence
exactly, rounds them down, and packs what is left best fit first, longest pieces first. A plan is a
table of (length, from which piece of that length on, how many, first sequence, offset).
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm import words as W
from askloom.llm.sharding import number_within
from askloom.session import materialize

END_ID = 2
ROUNDS = 400
_loaded: dict[str, object] = {}


def encoder(ranks: str, model: str):
    """A function from a text to its ids, made once per process.

    The ids are those of the tokenizers file ``model``. tiktoken merges by the same vocabulary, in the
    file of ``ranks``, several times faster; texts that its pattern cannot split (runs of a great many
    spaces) go to tokenizers itself.
    """
    if model not in _loaded:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        slow = Tokenizer.from_file(model)
        special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
        fast = tiktoken.Encoding(
            "byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special
        )

        def encode(text: str) -> list[int]:
            try:
                return fast.encode(text, allowed_special="all")
            except ValueError:
                return slow.encode(text, add_special_tokens=False).ids

        _loaded[model] = encode
    return _loaded[model]


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens; only the first may be shorter than ``size``."""
    first = n if n <= size else (n - 1) % size + 1
    return [(0, first)] + [(at, size) for at in range(first, n, size)]


def _pieces(ranks: str, model: str, size: int, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, model)
        for batch in batches:
            for part in W.slices(batch, "text"):
                rows: dict[str, list] = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    tokens = np.array([*encode(text or ""), END_ID], "<u4")
                    for k, (start, length) in enumerate(cuts(len(tokens), size)):
                        piece = tokens[start : start + length]
                        for name, value in zip(rows, (doc_id, k, start, length, zlib.crc32(piece.tobytes()))):
                            rows[name].append(value)
                        if ids:
                            rows["ids"].append(piece.astype(np.int32))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = list(rows) if ids else list(rows)[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(rows[n], t) for n, t in zip(names, types)], names)

    return run


def _patterns(size: int) -> np.ndarray:
    """All ways to fill ``size`` with two or three lengths; rows of three, zero for none."""
    a, b = np.meshgrid(np.arange(0, size), np.arange(1, size), indexing="ij")
    c = size - a - b
    fine = (a <= b) & (b <= c)
    return np.stack([a[fine], b[fine], c[fine]], 1)


def fit(histogram: np.ndarray, patterns: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts >= 0 of the patterns: least squares, weighted by length, by accelerated projection.

    Longer pieces weigh more, so what rounding leaves over is short and packs well.
    """
    size = len(histogram) - 1
    weight = np.arange(size + 1) / size
    scale = max(histogram.max(), 1)
    target = histogram / scale
    flat = patterns.ravel()

    def made(x: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, np.repeat(x, 3), size + 1)
        out[0] = 0
        return out

    # The largest eigenvalue of the normal matrix, by power iteration, bounds the step.
    v = np.ones(len(patterns))
    for _ in range(20):
        w = (weight**2 * made(v))[patterns].sum(1)
        v = w / np.linalg.norm(w)
    step = 0.95 / np.linalg.norm(w)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        gradient = (weight**2 * (made(y) - target))[patterns].sum(1)
        new = np.maximum(y - step * gradient, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


def best_fit(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit-decreasing on counts: (pattern, repeats), equal sequences kept together."""
    size = len(histogram) - 1
    open_bins: dict[int, list[list]] = {}
    room = np.zeros(size + 1, bool)

    def put(left: int, pattern: tuple[int, ...], n: int) -> None:
        open_bins.setdefault(left, []).append([pattern, n])
        room[left] = True

    for length in range(size, 0, -1):
        count = int(histogram[length])
        while count:
            fits = np.flatnonzero(room[length:])
            if not len(fits):
                each = size // length
                if whole := count // each:
                    put(size - each * length, (length,) * each, whole)
                if rest := count % each:
                    put(size - rest * length, (length,) * rest, 1)
                break
            left = length + int(fits[0])
            pattern, n = open_bins[left].pop()
            used = min(n, count)
            if used < n:
                open_bins[left].append([pattern, n - used])
            room[left] = bool(open_bins[left])
            put(left - length, pattern + (length,), used)
            count -= used
    return [(p, n) for bins in open_bins.values() for p, n in bins]


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and repeats that use up the histogram (by length, from 0) exactly."""
    left = histogram.astype(np.int64).copy()
    size = len(left) - 1
    chosen = [((size,), int(left[size]))] if left[size] else []
    left[size] = 0
    patterns = _patterns(size)
    repeats = np.floor(fit(left, patterns) + 1e-9).astype(np.int64)
    for i in np.argsort(-repeats, kind="stable"):
        if not repeats[i]:
            break
        lengths, times = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
        n = int(min(repeats[i], (left[lengths] // times).min()))
        if n:
            left[lengths] -= n * times
            chosen.append((tuple(sorted(map(int, patterns[i][patterns[i] > 0]), reverse=True)), n))
    return chosen + best_fit(left)


def _slots(chosen: list[tuple[tuple[int, ...], int]], size: int) -> np.ndarray:
    """Rows (length, first piece of that length, first sequence, offset), in this order."""
    rows, used, sequence = [], np.zeros(size + 1, np.int64), 0
    for pattern, n in chosen:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _placed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        key = (slots[:, 0] << 48) + slots[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(key, (length << 48) + rank, "right") - 1
            own = batch.drop_columns(["_rank"])
            own = own.append_column("sequence_id", pa.array(slots[at, 2] + rank - slots[at, 1]))
            yield own.append_column("offset", pa.array(slots[at, 3]))

    return run


def pack_documents(docs: DataFrame, ranks: str, model: str, size: int = 1024, ids: bool = True) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), one per piece.

    A document is its ids and then ``END_ID``; a null text is the end id alone. Documents of up to
    ``size`` tokens stay whole. Sequences hold pieces without gaps and never more than ``size`` tokens.
    Repeated rows are packed as often as they occur. An empty table gives no rows.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    pieces = docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(
        _pieces(ranks, model, size, ids), schema
    )
    pieces = materialize(pieces, "pieces")
    histogram = np.zeros(size + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``size`` rows
        histogram[row["length"]] = row["count"]
    slots = _slots(plan(histogram), size)
    spread = F.xxhash64("doc_id", "piece", "ids_crc32")
    ranked = number_within(pieces, "length", "_rank", spread)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    shared = docs.sparkSession.sparkContext.broadcast(slots)
    ranked = ranked.select(*pieces.columns, "_rank")
    return ranked.mapInArrow(_placed(shared), schema + ", sequence_id long, offset long")
