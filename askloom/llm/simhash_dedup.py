"""SimHash near-duplicates, compared bit-sliced.

A document's fingerprint takes each bit from the majority of its shingles' XXH64 values. Documents
link when their fingerprints differ in at most ``radius`` bits, and linked documents form components.

Two fingerprints within the radius agree in all but ``radius`` of the blocks that 64 bits are cut
into, so each distinct fingerprint goes into one bucket per choice of agreeing blocks. Within buckets
all pairs are compared without being listed: the fingerprints lie there as 64 vertical bit planes; a
plane against itself moved by ``s`` places compares every member with the one ``s`` places on, 64 at
a time. Differences go into carry-save counters that start so high that they overflow just past the
radius, and blocks of pairs are abandoned once all have overflowed. Only a forest of links leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askloom.llm import words as W
from askloom.llm.components import components
from askloom.session import materialize

SEED = 42
CELL = 8192  # distinct fingerprints of a bucket that are compared in one place
_CHUNK = 1 << 15
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _shingle_hashes(text: bytes, size: int) -> list[int]:
    words = text.split()
    if not words:
        return []
    flat = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(flat, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-size]].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(flat[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())]


def fingerprints(texts: list[str | None], size: int, words: int = 1, distinct: bool = False) -> np.ndarray:
    """The SimHash of each text, a row of ``words`` unsigned 64-bit numbers; zero without words.

    A shingle votes as often as it occurs, or once if ``distinct``. The first number takes its bits from the shingles' XXH64, each further one from a scramble of it.
    """
    out = np.zeros((len(texts), words), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, text in enumerate(texts):
        hashes = np.array(_shingle_hashes((text or "").encode().lower(), size), "<u8")
        hashes = np.unique(hashes) if distinct else hashes
        for k in range(words if len(hashes) else 0):
            own = hashes if not k else W.mix(hashes ^ np.uint64(k))
            set_bits = np.zeros(64, np.int64)
            for at in range(0, len(own), 1 << 16):
                values = own[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
                set_bits += np.unpackbits(values, axis=1, bitorder="little").sum(0, dtype=np.int32)
            out[i, k] = weights[2 * set_bits > len(own)].sum(dtype=np.uint64)
    return out


def fingerprint_column(text, size: int):
    """Column of the signed 64-bit fingerprint of ``text``, by shingles of ``size`` words.

    Only A-Z is lower-cased. A text of fewer words is one shingle; one without words gets zero.
    """

    def run(texts: pa.Array) -> pa.Array:
        found = []
        for part in W.slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
            found.append(fingerprints(part.column(0).to_pylist(), size)[:, 0])
        return pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())

    return F.arrow_udf(run, "long")(text)


def _blocks(radius: int) -> list[tuple[int, int]]:
    """Bit ranges (from, width): twice the radius of them, three at least."""
    n = max(2 * radius, 3)
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _bucket_keys(fingerprint, radius: int) -> list:
    """One key per choice of blocks that must agree."""
    blocks = _blocks(radius)
    keys = []
    for chosen in combinations(blocks, len(blocks) - radius):
        mask = sum(((1 << width) - 1) << start for start, width in chosen)
        keys.append(F.col(fingerprint).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
    return keys


def _planes(values: np.ndarray) -> np.ndarray:
    """A row of bits per bit of a fingerprint, packed into 64-bit words, one word to spare."""
    lanes = -(-len(values) // 64) * 64 + 64
    padded = np.zeros((lanes, values.shape[1]), "<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _near(planes: np.ndarray, shift: int, wanted: np.ndarray, radius: int) -> np.ndarray:
    """Places i with ``wanted`` set whose fingerprint is within ``radius`` of that at i + shift."""
    word, bit = divmod(shift, 64)
    packed = np.packbits(wanted, bitorder="little")
    packed = np.r_[packed, np.zeros(-len(packed) % 8, np.uint8)].view("<u8")
    at = np.flatnonzero(packed)
    over = ~packed[at]
    size = radius.bit_length()
    start = (1 << size) - 1 - radius
    counter = [np.full(len(at), _FULL if start >> j & 1 else 0, np.uint64) for j in range(size)]
    for p, plane in enumerate(planes):
        if bit:
            moved = plane[at + word] >> np.uint64(bit) | plane[at + word + 1] << np.uint64(64 - bit)
        else:
            moved = plane[at + word]
        carry = plane[at] ^ moved
        for j in range(size):
            counter[j], carry = counter[j] ^ carry, counter[j] & carry
        over |= carry
        if p % 4 == 3:
            live = over != _FULL
            if not live.any():
                return np.zeros(0, np.int64)
            if not live.all():
                at, over, counter = at[live], over[live], [c[live] for c in counter]
    bits = np.unpackbits(np.ascontiguousarray(~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    block, lane = np.nonzero(bits.reshape(len(at), 64))
    return at[block] * 64 + lane


def _near_pairs(bucket: np.ndarray, values: np.ndarray, radius: int, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of the same bucket within the radius, some at a time, whose ``root`` differs by then.

    ``bucket`` is sorted, ``values`` has a row of 64-bit numbers per fingerprint. Who takes the pairs may
    change ``root`` in place.
    """
    values = values.reshape(len(values), -1)
    n = len(values)
    ends = np.searchsorted(bucket, bucket, "right")
    inside = np.arange(n)  # the places whose buckets reach further than the present shift
    shift, limit, planes = 1, 0, None
    while True:
        if shift > limit:
            sizes = ends[inside] - np.searchsorted(bucket, bucket[inside], "left")
            inside = inside[sizes > shift]
            if not len(inside):
                return
            planes, limit = _planes(values[inside]), 2 * shift - 1 if shift > 1 else 1
            last = np.searchsorted(bucket[inside], bucket[inside], "right")
        # planes hold one spare word, so a shift past the end meets zeros that are not wanted
        if shift >= len(inside):
            return
        wanted = np.arange(len(inside)) + shift < last
        wanted[:-shift] &= root[inside[:-shift]] != root[inside[shift:]]
        wanted[-shift:] = False
        if wanted.any():
            room = planes if not shift // 64 else np.pad(planes, ((0, 0), (0, shift // 64 + 1)))
            left = _near(room, shift, wanted, radius)
            if len(left):
                yield inside[left], inside[left + shift]
        shift += 1


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Link places in ``root``, which holds the least place of what is linked; the pairs that did it."""
    used = [(a[:0], b[:0])]
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        won = np.flatnonzero((root[high] == low) & (low != high))
        won = won[np.unique(high[won], return_index=True)[1]]
        used.append((a[won], b[won]))
        while (root[root] != root).any():
            root[:] = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return tuple(np.concatenate(c) for c in zip(*used))


def links(bucket: np.ndarray, values: np.ndarray, radius: int) -> np.ndarray:
    """Root of each fingerprint after linking those of the same bucket within the radius.

    ``bucket`` is sorted, ``values`` has a row of 64-bit numbers per fingerprint. The result holds
    places; it is the least place of what was linked.
    """
    root = np.arange(len(values))
    for a, b in _near_pairs(bucket, values, radius, root):
        _join(root, a, b)
    return root


def _by_bucket(flush):
    """Over rows in bucket order: what ``flush`` makes of some whole buckets at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            if held >= _CHUNK and batch.num_rows:
                # A bucket that goes on stays whole: only what is before it is compared now.
                bucket = batch.column("bucket").to_numpy()
                same = int(np.searchsorted(bucket, rows[-1].column("bucket")[-1].as_py(), "right"))
                if same < batch.num_rows:
                    yield from flush([*rows, batch.slice(0, same)] if same else rows)
                    rows, held, batch = [], 0, batch.slice(same)
            if batch.num_rows:
                rows.append(batch)
                held += batch.num_rows
        if rows:
            yield from flush(rows)

    return run


def _forest(radius: int):
    """Of rows (bucket, fingerprint, node) in bucket order: links between nodes that join what is near."""

    def flush(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        bucket, node = (table.column(c).to_numpy() for c in ("bucket", "node"))
        root = links(bucket, table.column("fingerprint").to_numpy().view(np.uint64), radius)
        joined = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(node[joined]), pa.array(node[root[joined]])], ["u", "v"])

    return _by_bucket(flush)


def _dealt(rows: DataFrame, cell: int, *columns: str) -> DataFrame:
    """``rows`` (choice, agreed, size, fingerprint) in bucket order, buckets of over ``cell`` rows in pairs of groups."""
    rows = rows.withColumn("groups", F.ceil(F.col("size") / F.lit(cell)).cast("long")).where("size > 1")
    own = F.pmod(F.xxhash64("fingerprint", "agreed"), F.col("groups"))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    rows = rows.withColumn(
        "bucket", F.xxhash64("choice", "agreed", F.least("own", "other"), F.greatest("own", "other"))
    )
    return rows.select("bucket", "fingerprint", *columns).repartition("bucket").sortWithinPartitions("bucket", "fingerprint")


def near_links(nodes: DataFrame, keys, radius: int, cell: int = CELL) -> DataFrame:
    """Links (u, v) that join all nodes of a bucket whose fingerprints are within ``radius``.

    ``nodes`` has a fingerprint, distinct by row, and node (long); ``keys`` is a column of an array
    whose i-th value names the row's bucket of the i-th kind. A bucket of more than ``cell`` rows is cut
    into groups, and each pair of groups is compared in a place of its own, so no task holds more than
    two at once.
    """
    rows = nodes.select("fingerprint", "node", F.posexplode(keys).alias("choice", "agreed"))
    whole = Window.partitionBy("choice", "agreed")
    dealt = _dealt(rows.withColumn("size", F.count("*").over(whole)), cell, "node")
    return dealt.mapInArrow(_forest(radius), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id) of ``docs`` with doc_id (long) and text.

    The component is the least id reachable over links; copies share a fingerprint and so a
    component. Null and empty texts have fingerprint zero and link like any other. Repeated rows give
    repeated results. Rows without an id form components by the ids around them, null if there are none.
    """
    found = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(F.col("text"), shingle).alias("fingerprint")),
        "fingerprints",
    )
    nodes = found.where("doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("node"))
    nodes = materialize(nodes, "nodes")
    joined = components(near_links(nodes, F.array(*_bucket_keys("fingerprint", radius)), radius))
    classes = nodes.join(joined, "node", "left").select(
        "fingerprint", F.coalesce("component", "node").alias("component_id")
    )
    return found.join(classes, "fingerprint", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
