"""Quality classifier: supervised subword embeddings.

Every word and every character n-gram of it has a vector in a hashed table, and so has, for each word,
the share of its document that is this word (in powers of two). A document is the average of the
vectors of all its features, and a softmax over two linear outputs gives its score. Training is
numpy stochastic gradient descent on a bounded sample of labelled documents; the model is a small
table of fixed size, broadcast to score all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.llm import words as W

BUCKETS = 1 << 17
DIM = 8
NGRAMS = (2, 3, 4)
TRAIN_ROWS = 3000  # labelled documents that are learned from, at most
EPOCHS = 6
BATCH = 32
RATE = 0.5
GAIN = 30.0  # times the rate, for the vectors


def _features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: each distinct word's feature buckets, flat, and where they begin (one more);
    the distinct word at each place; the first place of each text (one more)."""
    data, offsets = W.raw(text)
    starts, ends, firsts = W.spans(data, offsets)
    hashed = W.hashes(data, starts, ends)
    _, chosen, back = np.unique(hashed, return_index=True, return_inverse=True)
    size = ends[chosen] - starts[chosen] + 2
    begin = np.cumsum(size) - size
    within = np.arange(size.sum()) - np.repeat(begin, size)
    flat = np.ones(size.sum(), np.uint64)  # a mark before and after each word
    inner = (within > 0) & (within < np.repeat(size, size) - 1)
    flat[inner] = data[(np.repeat(starts[chosen] - 1, size) + within)[inner]]
    found, owners = [hashed[chosen]], [np.arange(len(chosen))]
    owner = np.repeat(np.arange(len(chosen)), size)
    for n in NGRAMS:
        gram = W.windows(flat, n, 0x9E3779B1 + 2 * n)
        whole = owner[: len(gram)] == owner[n - 1 :][: len(gram)]
        found.append(gram[whole])
        owners.append(owner[: len(gram)][whole])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    bucket = (np.concatenate(found)[order] % np.uint64(BUCKETS)).astype(np.int32)
    return bucket, np.r_[0, np.cumsum(np.bincount(owners, minlength=len(chosen)))], back, firsts


def _shares(back: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The bucket of each word's share of its text."""
    sizes = np.diff(firsts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, place, times = np.unique(owner * (back.max(initial=0) + 1) + back, return_inverse=True, return_counts=True)
    times = times[place]
    # A word that occurs once says nothing about repetition, however short its text.
    halvings = np.where(times == 1, 63, np.log2(sizes[owner] / times)).astype(np.uint64)
    return (W.mix(halvings + np.uint64(1 << 32)) % np.uint64(BUCKETS)).astype(np.int32)


@dataclass
class Model:
    vectors: np.ndarray  # one row per bucket
    output: np.ndarray  # one column per label
    bias: np.ndarray

    def scores(self, text: pa.Array) -> np.ndarray:
        """The probability of label 1 for each text; one without words has the average of none, zero."""
        bucket, begins, back, firsts = _features(text)
        total = np.zeros((len(begins), self.vectors.shape[1]))
        for at in range(0, len(begins) - 1, 1 << 15):
            to = min(at + (1 << 15), len(begins) - 1)
            rows = self.vectors[bucket[begins[at] : begins[to]]]
            total[at:to] = np.add.reduceat(rows, begins[at:to] - begins[at], axis=0) if len(rows) else 0
        count = np.diff(begins) + 1
        # Sums up to each place; a text is the difference of two.
        sums = np.zeros((len(back) + 1, total.shape[1]))
        np.cumsum(total[:-1][back] + self.vectors[_shares(back, firsts)], axis=0, out=sums[1:])
        counts = np.r_[0, np.cumsum(count[back])]
        mean = (sums[firsts[1:]] - sums[firsts[:-1]]) / np.maximum(counts[firsts[1:]] - counts[firsts[:-1]], 1)[:, None]
        logits = mean @ self.output + self.bias
        return 1 / (1 + np.exp(np.clip(logits[:, 0] - logits[:, 1], -700, 700)))


def train(texts: pa.Array, labels: np.ndarray, seed: int = 0) -> Model:
    """Fit on whole texts by stochastic gradient descent with a falling rate; the same seed, the same model."""
    random = np.random.default_rng(seed)
    model = Model(
        random.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32),
        np.zeros((DIM, 2), np.float32),
        np.zeros(2, np.float32),
    )
    bags = []
    for i in range(len(texts)):
        bucket, begins, back, firsts = _features(texts.slice(i, 1))
        times = np.repeat(np.bincount(back, minlength=len(begins) - 1), np.diff(begins))
        share = _shares(back, firsts)
        seen = np.bincount(np.r_[bucket, share], np.r_[times, np.ones(len(share))], BUCKETS)
        own = np.flatnonzero(seen).astype(np.int32)
        bags.append((own, (seen[own] / max(seen.sum(), 1)).astype(np.float32)))
    steps, step = EPOCHS * -(-len(bags) // BATCH), 0
    for _ in range(EPOCHS):
        order = random.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            own, place = np.unique(np.concatenate([bags[i][0] for i in rows]), return_inverse=True)
            share = np.zeros((len(rows), len(own)), np.float32)
            owner = np.repeat(np.arange(len(rows)), [len(bags[i][0]) for i in rows])
            share[owner, place] = np.concatenate([bags[i][1] for i in rows])
            mean = share @ model.vectors[own]
            logits = mean @ model.output + model.bias
            chance = np.exp(logits - logits.max(1, keepdims=True))
            chance /= chance.sum(1, keepdims=True)
            chance[np.arange(len(rows)), labels[rows]] -= 1
            rate = RATE * (1 - step / steps)
            inner = chance @ model.output.T
            model.output -= rate * mean.T @ chance
            model.bias -= rate * chance.mean(0)
            # A bucket's share of a document is small, and so is its gradient; the gain makes up for it.
            model.vectors[own] -= rate * GAIN * (share.T @ inner)
            step += 1
    return model


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``part``; a null id counts as empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(parts)) == part


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [batch for batch in batches if batch.num_rows]
    if rows:
        table = pa.Table.from_batches(rows).sort_by("doc_id").combine_chunks()
        texts = pa.chunked_array(table.column("text")).combine_chunks()
        model = train(texts, table.column("quality").to_numpy().astype(np.int64))
        parts = [x.astype("<f4").tobytes() for x in (model.vectors, model.output, model.bias)]
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], ["vectors", "output", "bias"])


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, parts: int = 5) -> Model:
    """A model learned from at most ``rows`` labelled documents outside the held-out part.

    The sample is the labelled ids of least hash, as long as there is a label 0 or 1. ``docs`` has
    doc_id and text, ``labels`` doc_id and quality. Without labels every score is one half. One task
    trains on the sample; only the model, a few MB, comes to the driver.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", parts, 0))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(rows)
    # At most ``rows`` ids and labels are broadcast, and as many documents meet in one task.
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])
    trained = found.repartition(1).mapInArrow(_train_task, "vectors binary, output binary, bias binary").first()
    if trained is None:
        return Model(np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32))
    arrays = [np.frombuffer(bytes(x), "<f4") for x in trained]
    return Model(arrays[0].reshape(BUCKETS, DIM), arrays[1].reshape(DIM, 2), arrays[2])


def score_column(spark, model: Model, text: Column) -> Column:
    """Column of the probability of label 1; null texts count as empty."""
    shared = spark.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        parts = W.slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", 1 << 20)
        found = [shared.value.scores(part.column(0)) for part in parts]
        return pa.array(np.concatenate(found) if found else [], pa.float64())

    return F.arrow_udf(run, "double")(text)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with held_out, score and predicted (1 if the score reaches ``threshold``)."""
    model = fit_quality(docs, labels, rows)
    scored = docs.withColumn("held_out", held_out("doc_id", 5, 0))
    scored = scored.withColumn("score", score_column(docs.sparkSession, model, F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
