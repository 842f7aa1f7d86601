"""Brown class-based bigrams: perplexity from class transitions and word emissions.

Exchange clustering gives each word type a class. A round counts, on Spark, which classes stand before
and after each type, and then moves every type to the class in which its own occurrences are likeliest;
rounds start from the most frequent words as classes of their own. A token's probability is that of its
class after the class before, times that of the word within its class.

Types are bounded: the ``HEAD`` most frequent words, and ``FORMS`` word forms (hashes of first and last
letters and length) that stand for all other words, so these get classes too. Within its form, a rarer
word has its exact count, for which Spark joins the rare words of all documents with the full table of
counts; a rare word cannot be frequent, so no key of that join is hot. Words are told apart by 64-bit
hashes of their bytes, A-Z in lower case.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.llm import words as W
from askloom.session import materialize

HEAD = 49151
FORMS = 16384
TYPES = 1 + HEAD + FORMS  # type 0 ends a text; all fit 16 bits
CLASSES = 32
ROUNDS = 4
BLOCK = 4096  # types whose counts travel together
HELD = 1_000_000  # distinct words that a task counts before it hands them on
KEPT = 0.98  # weight of the transitions against the frequencies of classes


def _tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and form of each word, and the first word of each text (one more)."""
    data, offsets = W.raw(text, lower=True)
    starts, ends, firsts = W.spans(data, offsets)
    form = data[starts].astype(np.uint64) << np.uint64(24)
    form |= data[np.maximum(ends - 2, starts)].astype(np.uint64) << np.uint64(16)
    form |= data[ends - 1].astype(np.uint64) << np.uint64(8)
    form |= np.minimum((ends - starts) // 4, 8).astype(np.uint64)
    return W.hashes(data, starts, ends), (W.mix(form) % np.uint64(FORMS)).astype(np.int64), firsts


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, ...]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word, form, n = (np.concatenate(c) for c in zip(*parts))
        own, first, back = np.unique(word, return_index=True, return_inverse=True)
        return own, form[first], np.bincount(back, n, len(own)).astype(np.int64)

    def batch_of(word: np.ndarray, form: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(form), pa.array(n)], ["word", "form", "n"])

    for batch in batches:
        for part in W.slices(batch, "text"):
            word, form, _ = _tokens(part.column("text"))
            own, first, n = np.unique(word, return_index=True, return_counts=True)
            parts.append((own, form[first], n))
            if sum(len(p[0]) for p in parts) > HELD:
                parts = [merged()]
                if len(parts[0][0]) > HELD // 2:
                    yield batch_of(*parts.pop())
    if parts:
        yield batch_of(*merged())


@dataclass
class Vocabulary:
    """What tasks need to turn words into types: the head in hash order, and the totals."""

    words: np.ndarray
    types: np.ndarray
    counts: np.ndarray  # by type; forms hold their words' sum
    distinct: np.ndarray  # by type; how many words a form has
    n_tokens: int
    n_distinct: int

    def look_up(self, word: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The type of each word, and whether it is in the head."""
        if not len(self.words):
            return form + 1 + HEAD, np.zeros(len(word), bool)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        head = self.words[at] == word
        return np.where(head, self.types[at], form + 1 + HEAD), head


def _encode(shared):
    """Per document: its types with the end, and what its frequent words add to the base score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        log_count = np.log10(vocabulary.counts + 1.0)
        for batch in batches:
            for part in W.slices(batch, "text"):
                word, form, firsts = _tokens(part.column("text"))
                types, head = vocabulary.look_up(word, form)
                ends = firsts[1:] + np.arange(1, len(firsts))
                sequence = np.zeros(ends[-1], np.uint16)
                inner = np.ones(len(sequence), bool)
                inner[ends - 1] = False
                sequence[inner] = types
                sums = np.r_[0, np.cumsum(np.where(head, log_count[types], 0.0))][firsts]
                known = np.r_[0, np.cumsum(head)][firsts]
                flat = sequence.tobytes()
                begins = np.r_[0, ends[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        part.column("doc_id"),
                        part.column("held_out"),
                        pa.array([flat[2 * a : 2 * b] for a, b in zip(begins, ends)], pa.binary()),
                        pa.array(ends - begins),
                        pa.array(np.diff(known) + (vocabulary.counts[0] > 0)),
                        pa.array(np.diff(sums) + log_count[0]),
                    ],
                    ["key", "doc_id", "held_out", "types", "n_tokens", "head_known", "head_log"],
                )

    return run


def _rare_words(shared):
    """Rows (key, word, n) of the words of each document that are not in the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                word, form, firsts = _tokens(part.column("text"))
                rare = np.flatnonzero(~shared.value.look_up(word, form)[1])
                owner, word = np.searchsorted(firsts, rare, "right") - 1, word[rare]
                order = np.lexsort((word, owner))
                owner, word = owner[order], word[order]
                begin = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (word[1:] != word[:-1])][: len(word)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key").take(pa.array(owner[begin])),
                        pa.array(word[begin].view(np.int64)),
                        pa.array(np.diff(np.r_[begin, len(word)]).astype(np.int32)),
                    ],
                    ["key", "word", "n"],
                )

    return run


def _sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All types of some documents, and the type before each; texts begin after an end."""
    flat = np.frombuffer(b"".join(batch.column("types").to_pylist()), np.uint16)
    return flat, np.r_[np.uint16(0), flat[:-1]]


def _neighbours(shared):
    """Rows (part, counts): by blocks of types, the classes after and before each type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value.astype(np.int64)
        counts = np.zeros((2, TYPES * CLASSES), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                here, before = _sequences(batch.slice(at, 256))
                counts[0] += np.bincount(before * np.int64(CLASSES) + classes[here], minlength=TYPES * CLASSES)
                counts[1] += np.bincount(here * np.int64(CLASSES) + classes[before], minlength=TYPES * CLASSES)
        blocks = counts.reshape(-1, BLOCK * CLASSES)
        for part in np.flatnonzero(blocks.any(1)).tolist():
            body = zlib.compress(blocks[part].astype("<i8").tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([body], pa.binary())], ["part", "counts"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(zlib.decompress(body), "<i8")
            sums[part] = sums[part] + own if part in sums else own
    for part, own in sums.items():
        body = zlib.compress(own.tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([body], pa.binary())], ["part", "counts"])


def _count_neighbours(encoded: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Counts of classes after [0] and before [1] each type; their size depends on parameters alone."""
    shared = encoded.sparkSession.sparkContext.broadcast(classes)
    parts = encoded.select("types").mapInArrow(_neighbours(shared), "part long, counts binary")
    parts = parts.repartition("part").mapInArrow(_add_up, "part long, counts binary")
    out = np.zeros((2 * TYPES // BLOCK, BLOCK * CLASSES), np.int64)
    for part, body in parts.toLocalIterator():
        out[part] = np.frombuffer(zlib.decompress(bytes(body)), "<i8")
    return out.reshape(2, TYPES, CLASSES)


def _transitions(after: np.ndarray, classes: np.ndarray) -> np.ndarray:
    out = np.zeros((CLASSES, CLASSES))
    np.add.at(out, classes, after)
    return out


def exchange(after: np.ndarray, before: np.ndarray, classes: np.ndarray, barred: tuple[int, ...]) -> np.ndarray:
    """Each type's best class, given the classes around its occurrences; the end keeps class 0.

    Empty and ``barred`` classes take nothing in.

    The score of a class is the log-likelihood of the type's occurrences in it: the transitions into
    and out of it, and the share of the class that the type would be.
    """
    moves = _transitions(after, classes)
    size = moves.sum(1)
    out = np.log((moves + 0.5) / (size + 0.5 * CLASSES)[:, None])
    score = before @ np.log(moves + 0.5) + after @ out.T - after.sum(1)[:, None] * np.log(size + 1.0)[None, :]
    open_ = size > 0
    open_[[0, *barred]] = False
    if not open_.any():
        return classes
    score[:, ~open_] = -np.inf
    chosen = np.argmax(score, axis=1)
    chosen[0] = 0
    return chosen.astype(np.uint8)


def _cluster(encoded: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all types after ``ROUNDS`` rounds, and the counts of transitions between classes."""
    classes = np.full(TYPES, CLASSES - 1, np.uint8)
    classes[: CLASSES - 1] = np.arange(CLASSES - 1)  # the end, and the most frequent words
    for round_ in range(ROUNDS):
        after, before = _count_neighbours(encoded, classes)
        # The last class holds all the rest at first, so nothing is to stay there for its size.
        classes = exchange(after, before, classes, () if round_ else (CLASSES - 1,))
    after, _ = _count_neighbours(encoded, classes)
    return classes, _transitions(after, classes)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, transition, emission = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                here, before = _sequences(part)
                each = transition[classes[before], classes[here]] + emission[here]
                ends = np.cumsum(part.column("n_tokens").to_numpy())
                own = part.drop_columns(["types"])
                sums = np.add.reduceat(each, np.r_[0, ends[:-1]])
                yield own.append_column("head_score", pa.array(sums))

    return run


def score_texts(docs: DataFrame, training: Column) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of ``docs`` (doc_id, text).

    Scores are log10 probabilities of whole texts with their end. The model learns from the rows for
    which ``training`` holds; held_out marks the others. ``base_score`` is that of add-one unigrams. A
    null text counts as empty: its only token is the end. Repeated rows get the same scores and count
    as often as they occur.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        (~training).alias("held_out"),
        F.xxhash64("doc_id", "text").alias("key"),
    )
    counts = rows.where("NOT held_out").select("text").mapInArrow(_count_words, "word long, form long, n long")
    counts = materialize(counts.groupBy("word").agg(F.min("form").alias("form"), F.sum("n").alias("n")), "counts")
    totals = counts.agg(F.count("*"), F.sum("n")).first()
    n_texts = rows.where("NOT held_out").count()
    order = [F.desc("n"), F.asc("word")]
    head = counts.orderBy(*order).limit(HEAD).select("word", "n").toArrow()
    words, n = head.column("word").to_numpy().view(np.uint64), head.column("n").to_numpy()
    by_hash = np.argsort(words)
    by_type, distinct = np.zeros(TYPES, np.int64), np.ones(TYPES, np.int64)
    by_type[0], by_type[1 : len(n) + 1] = n_texts, n
    if len(n):
        last_n, last_word = int(n[-1]), int(words.view(np.int64)[-1])
        rare = counts.where((F.col("n") < last_n) | ((F.col("n") == last_n) & (F.col("word") > last_word)))
        for form, total, many in rare.groupBy("form").agg(F.sum("n"), F.count("*")).collect():  # FORMS rows at most
            by_type[1 + HEAD + form], distinct[1 + HEAD + form] = total, many
    vocabulary = Vocabulary(
        words[by_hash],
        (by_hash + 1).astype(np.int64),
        by_type,
        distinct,
        int(totals[1] or 0) + n_texts,
        int(totals[0]) + (n_texts > 0),
    )
    shared = spark.sparkContext.broadcast(vocabulary)
    schema = "key long, doc_id long, held_out boolean, types binary, n_tokens long, head_known long, head_log double"
    encoded = materialize(rows.mapInArrow(_encode(shared), schema), "types")
    classes, moves = _cluster(encoded.where("NOT held_out"))
    size = np.bincount(classes, by_type, CLASSES)
    within = np.bincount(classes, minlength=CLASSES)
    chance = (size + 1) / (size.sum() + CLASSES)
    transition = KEPT * (moves + chance) / (moves.sum(1) + 1)[:, None] + (1 - KEPT) * chance
    emission = np.log10((by_type + 0.1) / (size + 0.1 * within)[classes])
    emission[1 + HEAD :] -= np.log10((by_type + distinct + 1.0)[1 + HEAD :])
    model = spark.sparkContext.broadcast((classes, np.log10(transition), emission))
    scored = encoded.mapInArrow(_score(model), schema.replace(" types binary,", "") + ", head_score double")
    rare = rows.select("key", "text").mapInArrow(_rare_words(shared), "key long, word long, n int")
    # Words that training has not seen add log10(0 + 1) to either score, so an inner join is enough.
    rare = rare.join(counts.select("word", F.col("n").alias("c")), "word").groupBy("key")
    rare = rare.agg(F.sum("n").alias("tail_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("tail_log"))
    times = scored.groupBy("key").agg(F.count("*").alias("times"))
    rare = rare.join(times, "key")
    rare = rare.select("key", (F.col("tail_known") / F.col("times")).cast("long").alias("tail_known"), (F.col("tail_log") / F.col("times")).alias("tail_log"))
    whole = scored.join(rare, "key", "left").fillna({"tail_known": 0, "tail_log": 0.0})
    floor = float(np.log10(vocabulary.n_tokens + vocabulary.n_distinct + 1))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.col("tail_known")).alias("n_known"),
        F.lit(vocabulary.n_tokens).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.col("tail_log") - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (F.col("head_score") + F.col("tail_log")).alias("score"),
    )
