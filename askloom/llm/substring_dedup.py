"""Substring deduplication on a De Bruijn graph of words.

Every run of ``width`` words is an edge between its first and its last ``width - 1`` words. An edge
found in two documents is repeated; its source is its place in the document with the smallest id.
Spark brings equal edges of all documents together and gives each its source; joined back by document,
consecutive edges whose sources are consecutive too compact to one nonbranching path, a long repeated
span. An edge counts as repeated only if a second, independent hash at the source's coordinates agrees.

Most edges of a corpus occur once. A screen keeps them out of the shuffles and loses none: equal runs
of ``width`` words hold equal minimizers (the smallest hash of their ``seed``-word runs), so only
edges whose minimizer occurs in two documents go on. The screen is a bit set of fixed size; when a
corpus has more repeated minimizers than it can tell apart, more edges go on and the result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askloom.llm import words as W

WIDTH = 13
SCREEN_BITS = 1 << 27
_CHECK = 0xA0761D6478BD642F
_KEPT = 6  # bytes of a minimizer's quotient that travel
RUN = 32  # edges of a run that travel together


def _edges(words: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the edges within one text, the text of each, and each edge's minimizer."""
    seed = width // 2 + 1
    found = np.flatnonzero(W.inside(firsts, width))
    small = W.windows(words, seed, 0x2545F4914F6CDD1D)
    least = small[found]
    for i in range(1, width - seed + 1):
        np.minimum(least, small[found + i], out=least)
    return found, np.searchsorted(firsts, found, "right") - 1, least


def _hashed(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = W.raw(part.column("text"))
    starts, ends, firsts = W.spans(data, offsets)
    return W.hashes(data, starts, ends), firsts


def _packed_minimizers(width: int, segments: int):
    """Rows (segment, the minimizers of some documents there; those of two or more of them twice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                words, firsts = _hashed(part)
                _, owner, least = _edges(words, firsts, width)
                if not len(least):
                    continue
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)[owner]
                change = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (ids[1:] != ids[:-1])])
                least, ids = least[change], ids[change]
                order = np.lexsort((ids, least))
                least, ids = least[order], ids[order]
                same = least[1:] == least[:-1]
                fresh = np.r_[True, ~same]
                first = ids[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
                # The first of each, and the first row of another document: two are enough to tell.
                other = np.flatnonzero(ids != first)
                other = other[np.r_[True, least[other][1:] != least[other][:-1]]] if len(other) else other
                least = least[np.r_[np.flatnonzero(fresh), other]]
                segment = least % np.uint64(segments)
                order = np.argsort(segment, kind="stable")
                segment, body = segment[order].astype(np.int64), least[order] // np.uint64(segments)
                body = body.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEPT]
                cuts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
                to = np.r_[cuts[1:], len(segment)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(segment[cuts]),
                        pa.array([body[a:b].tobytes() for a, b in zip(cuts, to)], pa.binary()),
                    ],
                    ["segment", "body"],
                )

    return run


def _screen_rows(bits: int):
    """Of the minimizers of one partition's segments: a bit set of the repeated ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[bytes]] = {}
        for batch in batches:
            for segment, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts.setdefault(segment, []).append(body)
        for segment, bodies in parts.items():
            flat = np.frombuffer(b"".join(bodies), np.uint8).reshape(-1, _KEPT)
            wide = np.zeros((len(flat), 8), np.uint8)
            wide[:, :_KEPT] = flat
            values = np.sort(wide.view("<u8").ravel())
            twice = values[1:][values[1:] == values[:-1]]
            if not len(twice):
                continue
            field = np.zeros(bits, np.uint8)
            field[(twice % np.uint64(bits)).astype(np.int64)] = 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment]), pa.array([np.packbits(field).tobytes()], pa.binary())],
                ["segment", "body"],
            )

    return run


def _screen(docs: DataFrame, width: int, screen_bits: int):
    """Broadcast of the bit set, at most ``screen_bits`` in all, and its shape."""
    spark = docs.sparkSession
    segments = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(8, screen_bits // segments // 8 * 8)
    packed = docs.mapInArrow(_packed_minimizers(width, segments), "segment long, body binary")
    rows = packed.repartition("segment").mapInArrow(_screen_rows(bits), "segment long, body binary")
    field = np.zeros((segments, bits // 8), np.uint8)
    for segment, body in rows.toLocalIterator():
        field[segment] = np.frombuffer(body, np.uint8)
    return spark.sparkContext.broadcast(field), segments, bits


def _cut_runs(cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs that ``cut`` begins, none longer than ``RUN``."""
    begin = np.flatnonzero(cut)
    end = np.r_[begin[1:], len(cut)]
    pieces = -(-(end - begin) // RUN)
    within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(begin, pieces) + within * RUN
    return begin, np.minimum(begin + RUN, np.repeat(end, pieces))


def _edge_runs(screen, segments: int, bits: int, width: int):
    """Runs of neighbouring edges that pass the screen and share a minimizer.

    An edge that a smaller document of the same slice holds is settled at once: runs of these carry
    their source and no hashes, and go to a random place. So a run that a great many documents hold
    meets in one place only once per slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = screen.value
        for batch in batches:
            for part in W.slices(batch, "text"):
                words, firsts = _hashed(part)
                found, owner, least = _edges(words, firsts, width)
                at = (least // np.uint64(segments)) & np.uint64((1 << 8 * _KEPT) - 1)
                at = (at % np.uint64(bits)).astype(np.int64)
                byte = field[(least % np.uint64(segments)).astype(np.int64), at >> 3]
                passed = (byte >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                found, owner, least = found[passed], owner[passed], least[passed]
                if not len(found):
                    continue
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)[owner]
                place = found - firsts[owner]
                edge, check = W.windows(words, width)[found], W.windows(words, width, _CHECK)[found].astype(np.uint32)
                order = np.lexsort((place, ids, check, edge))
                fresh = np.r_[True, (np.diff(edge[order]) != 0) | (np.diff(check[order]) != 0)]
                source = np.empty(len(order), np.int64)
                source[order] = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
                settled = ids[source] < ids
                follows = (np.diff(found) == 1) & (np.diff(owner) == 0) & (np.diff(settled.view(np.int8)) == 0)
                goes_on = np.where(
                    settled[1:], (np.diff(place[source]) == 1) & (np.diff(ids[source]) == 0), np.diff(least) == 0
                )
                begin, end = _cut_runs(np.r_[True, ~(follows & goes_on)])
                known = settled[begin]
                size = np.where(known, 0, end - begin)
                where = np.where(known, W.mix(ids[begin].astype(np.uint64) + W.mix(place[begin])), least[begin])
                offsets = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
                flat = ~np.repeat(known, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(where.view(np.int64)),
                        pa.array(ids[begin]),
                        pa.array(place[begin].astype(np.int32)),
                        pa.array(np.where(known, end - begin, 0).astype(np.int32)),
                        pa.array(ids[source[begin]], mask=~known),
                        pa.array(place[source[begin]].astype(np.int32), mask=~known),
                        pa.ListArray.from_arrays(offsets, pa.array(edge[flat].view(np.int64))),
                        pa.ListArray.from_arrays(offsets, pa.array(check[flat].view(np.int32))),
                    ],
                    ["where", "doc_id", "place", "settled", "source_id", "source_place", "edges", "checks"],
                )

    return run


_RUNS = (
    "where long, doc_id long, place int, settled int, source_id long, source_place int,"
    " edges array<long>, checks array<int>"
)


def repeated_runs(docs: DataFrame, width: int = WIDTH, screen_bits: int = SCREEN_BITS) -> DataFrame:
    """Every edge of a document that also starts in a document of smaller id, with its source.

    ``docs`` has ``doc_id`` (long) and ``text``. Returns doc_id, place (a word, from 0) and ``edges``:
    an array of structs i, source_id, source_place for the edges that begin at place + i. A settled
    run of n edges is one struct with i = 0 and ``run`` = n. Rows without an id take no part.
    """
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    screen, segments, bits = _screen(docs, width, screen_bits)
    # Edges travel once, in runs by minimizer; all edges of one hash have one minimizer and so meet.
    runs = docs.mapInArrow(_edge_runs(screen, segments, bits, width), _RUNS).repartition("where")
    each = runs.select(
        "where",
        "doc_id",
        "place",
        F.when(F.col("settled") > 0, F.struct("settled", "source_id", "source_place")).alias("known"),
        F.posexplode_outer(F.arrays_zip("edges", "checks")).alias("i", "e"),
    )
    alike = Window.partitionBy("where", "e.edges")
    each = each.withColumn("first_id", F.min("doc_id").over(alike)).withColumn(
        "first", F.min_by(F.struct(F.col("place") + F.col("i"), F.col("e.checks")), "doc_id").over(alike)
    )
    hit = F.when(
        F.col("known").isNotNull(),
        F.struct(F.lit(0).alias("i"), F.col("known.settled").alias("run"), F.col("known.source_id"), F.col("known.source_place")),
    ).when(
        (F.col("first_id") < F.col("doc_id")) & (F.col("first.checks") == F.col("e.checks")),
        F.struct(F.col("i"), F.lit(1).alias("run"), F.col("first_id").alias("source_id"), F.col("first.col1").alias("source_place")),
    )
    return (
        each.withColumn("hit", hit)
        .where("hit IS NOT NULL")
        .groupBy("where", "doc_id", "place")
        .agg(F.collect_list("hit").alias("edges"))
        .select("doc_id", "place", "edges")
    )


_SPAN = pa.struct([(n, pa.int64()) for n in ("start", "end", "source_id", "source_start")])
_RESULT = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept_sha256", pa.string()),
        ("kept_text", pa.string()),
        ("spans", pa.list_(_SPAN)),
    ]
)


def _marks(hits: list[dict], n_edges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, source and source's place of each repeated edge of one document, by place, each once."""
    by_place = {}
    for run in hits:
        for e in run["edges"]:
            for j in range(e["run"]):
                place = run["place"] + e["i"] + j
                if place < n_edges:
                    by_place[place] = e["source_id"], e["source_place"] + j
    rows = np.array([(p, *by_place[p]) for p in sorted(by_place)], np.int64).reshape(-1, 3)
    return rows[:, 0], rows[:, 1], rows[:, 2]


def _paths(place: np.ndarray, source: np.ndarray, source_place: np.ndarray, width: int) -> list[dict]:
    """Neighbouring edges with neighbouring sources, compacted to spans of words."""
    on = (np.diff(place) == 1) & (np.diff(source) == 0) & (np.diff(source_place) == 1)
    begin = np.flatnonzero(np.r_[True, ~on]) if len(place) else np.zeros(0, np.int64)
    end = np.r_[begin[1:], len(place)].astype(np.int64) - 1
    rows = zip(place[begin], place[end] + width, source[begin], source_place[begin])
    return [dict(zip(_SPAN.names, map(int, row))) for row in rows]


def _cut(width: int):
    """Per document: words, words removed, the rest joined by one space, its repeated spans."""

    def one(text: str | None, hits: list[dict] | None) -> tuple:
        words = (text or "").encode().split()
        found: list[dict] = []
        left = words
        if hits:
            found = _paths(*_marks(hits, len(words) - width + 1), width)
            gone = bytearray(len(words))
            for span in found:
                gone[span["start"] : span["end"]] = b"\1" * (span["end"] - span["start"])
            left = [w for w, g in zip(words, gone) if not g]
        kept = b" ".join(left)
        return len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), kept.decode(), found

    def run(texts: pa.Array, hits: pa.Array) -> pa.Array:
        rows = [one(t.as_py(), h.as_py()) for t, h in zip(texts, hits)]
        return pa.array([dict(zip(_RESULT.names, row)) for row in rows], _RESULT)

    return F.arrow_udf(
        run,
        "n_words long, n_removed long, kept_sha256 string, kept_text string,"
        " spans array<struct<start: long, end: long, source_id: long, source_start: long>>",
    )


def remove_repeated_spans(docs: DataFrame, width: int = WIDTH, screen_bits: int = SCREEN_BITS) -> DataFrame:
    """``docs`` with a struct ``cut``: n_words, n_removed, kept_sha256, kept_text and spans.

    A word goes if an edge of ``width`` words covers it that also starts in a document of smaller id;
    edges are judged on the input texts. ``kept_text`` joins what is left by single spaces. ``spans``
    are the compacted paths: start and end in words, and the id and place of a source.

    A null text has no words. A text of fewer than ``width`` words, and a row without ``doc_id``,
    stays whole. ``doc_id`` names a document: repeated rows get the same result and are no source of
    each other; if rows of one id differ in text, places found in one count for all that reach as far.
    All other columns stay as they are.
    """
    hits = (
        repeated_runs(docs, width, screen_bits)
        .groupBy(F.col("doc_id").alias("__cut_id"))
        .agg(F.collect_list(F.struct("place", "edges")).alias("__hits"))
    )
    joined = docs.join(hits, docs["doc_id"] == hits["__cut_id"], "left")
    return joined.withColumn("cut", _cut(width)(F.col("text"), F.col("__hits"))).drop("__cut_id", "__hits")
