"""Words of whole texts as numpy arrays: the common ground of the operators on word sequences.

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``. All work is on the UTF-8 bytes of an
Arrow string array, in pieces of bounded size that end at white space, so that no array grows with
a batch. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 21  # bytes hashed at once
BATCH_BYTES = 1 << 22  # text of the documents that are handled together

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts together stay under ``limit`` bytes, or single rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def raw(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins (one offset more than texts)."""
    if not pa.types.is_large_string(texts.type):
        texts = pc.cast(texts, pa.large_string())
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body else np.zeros(0, np.uint8)
    return (_LOWER[data] if lower else data), offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in ``data``, and the first word of each text (one more than texts)."""
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside & (~after | first[1:])
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, in bounded pieces."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE_BYTES, "right")))
            begin, s, e = starts[at], starts[at:to] - starts[at], ends[at:to] - starts[at]
            piece = data[begin : begin + e[-1]]
            length = e - s
            owner = np.zeros(len(piece), np.int64)
            owner[s[1:]] = np.diff(s)  # the index within the word is the place less the word's start
            place = np.arange(len(piece)) - np.cumsum(owner)
            terms = (piece.astype(np.uint64) + np.uint64(1)) * powers(_PRIME, int(place.max()) + 1)[place]
            terms[_SPACE[piece]] = 0
            # Bytes between two words are zero terms, or belong to the next text's word at once.
            out[at:to] = mix(np.add.reduceat(terms, s) + length.astype(np.uint64))
            at = to
    return out


def windows(words: np.ndarray, width: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """A hash of each run of ``width`` word hashes; shorter input gives none. Runs cross texts."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = out * np.uint64(base) + words[i : i + n]
    return mix(out)


def inside(firsts: np.ndarray, width: int) -> np.ndarray:
    """Which runs of ``width`` words, by their first word, lie within one text."""
    total = int(firsts[-1])
    n = max(total - width + 1, 0)
    owner = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    return owner[:n] == owner[width - 1 :][:n]
