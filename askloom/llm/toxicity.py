"""Toxicity by weak supervision: voters, a generative model of their votes, a linear classifier on its posteriors.

A term is a run of letters, or the first few letters of a longer one. A voter fires on a document by one
term, from a lexicon (whole words) or a pattern (beginnings of words), at one of a few strengths of use.
Which terms have voters is learned from labelled documents; there are many, and many see the same thing.

The generative model therefore knows both how each voter behaves on toxic and on other documents and how
it depends on another voter: votes form a tree, of the strongest dependencies given the class, that is
found anew in every round of expectation maximisation, over labelled and unlabelled documents alike. A
label is one more vote, of very good but not perfect accuracy. The posteriors it arrives at, not the
labels, train a logistic regression over terms, which scores all documents, those without any voter too.

Training sees a bounded sample; the model is a table of at most ``FEATURES`` rows and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.llm import words as W

LABELLED, UNLABELLED = 6000, 3000  # documents that are learned from, at most
TRAIN_BYTES = 32 << 20  # of their texts together; a text of over a sixteenth of it is not learned from
BEGINNINGS = (3, 4, 5, 6, 7)  # letters of a pattern
OFTEN = 128  # used often: once in so many words
LEVELS = 3  # used at all; often; often and twice
VOTERS = 96
FEATURES = 1024
SURE = 0.8  # of the documents that a voter's term marks, the least share that is toxic
ROUNDS = 10
LABEL_RIGHT = 0.98  # accuracy of the label's vote
RIDGE = 0.2  # of the classifier's weights
STEPS, INNER = 15, 40  # of the regression, at most
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_POWERS = W.powers(np.uint64(0x9E3779B97F4A7C15), 64)


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of each term of each place, flat, and how many words each text has."""
    data, offsets = W.raw(texts, lower=True)
    letters = _LETTER[data]
    starts, ends, firsts = W.spans(np.where(letters, data, np.uint8(32)), offsets)
    owner = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    before = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        begin = np.zeros(len(data), np.int64)
        begin[starts] = np.diff(starts, prepend=0)
        place = np.arange(len(data)) - np.cumsum(begin)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63], out=before[1:])
        found = [W.mix(before[ends] - before[starts] + (ends - starts).astype(np.uint64))]
        owners = [owner]
        letter = np.flatnonzero((data & 0xC0) != 0x80)  # where a character begins
        first = np.searchsorted(letter, starts)
        for n in BEGINNINGS:
            after = letter[np.minimum(first + n, max(len(letter) - 1, 0))] if len(letter) else starts
            longer = (first + n < len(letter)) & (after < ends)
            s, e = starts[longer], after[longer]
            found.append(W.mix(W.mix(before[e] - before[s] + (e - s).astype(np.uint64)) ^ np.uint64(n)))
            owners.append(owner[longer])
    return np.concatenate(owners), np.concatenate(found), np.diff(firsts)


def _levels(owner: np.ndarray, term: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature (term and strength of use, as one hash) of everything a text's terms show."""
    order = np.lexsort((term, owner))
    owner, term = owner[order], term[order]
    new = np.flatnonzero(np.r_[True, (np.diff(owner) != 0) | (np.diff(term) != 0)][: len(owner)])
    owner, term, count = owner[new], term[new], np.diff(np.r_[new, len(owner)])
    often = count * OFTEN >= n_words[owner]
    shown = [np.ones(len(owner), bool), often, often & (count > 1)]
    owners, features = zip(*((owner[s], W.mix(term[s] + np.uint64(level))) for level, s in enumerate(shown)))
    return np.concatenate(owners), np.concatenate(features)


def _deviance(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """How much better two rates than one explain ``a`` of ``n1`` and ``b`` of ``n0``."""

    def part(seen, of, rate):
        rate = np.clip(rate, 1e-12, 1 - 1e-12)
        return seen * np.log(rate) + (of - seen) * np.log1p(-rate)

    joint = (a + b) / max(n1 + n0, 1)
    apart = part(a, n1, a / max(n1, 1)) + part(b, n0, b / max(n0, 1))
    return 2 * (apart - part(a, n1, joint) - part(b, n0, joint))


def _chance(size: int) -> float:
    """The deviance that the luckiest of ``size`` features without a meaning reaches about."""
    return 2 * float(np.log(max(size, 2)))


@dataclass
class LabelModel:
    """How votes come about: by class, and by the vote of another voter.

    A voter that does not fire abstains, which says nothing by itself: toxic documents are of many kinds,
    and most voters know one. Only that no voter at all fires tells against a document; a vote never does.
    """

    prior: float
    parent: np.ndarray  # of each voter another voter, or -1
    fires: np.ndarray  # chance by class, the parent's vote, voter
    silent: np.ndarray  # chance by class that none fires

    def posterior(self, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Chance that each row is toxic; ``labels`` are 0, 1, or -1 where there is none."""
        odds = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        odds += np.where(votes.any(1), 0.0, np.log(self.silent[1] / self.silent[0]))
        above = np.where(self.parent >= 0, votes[:, self.parent], 0).astype(np.int64)
        ratio = np.maximum(np.log(self.fires[1] / self.fires[0]), 0)
        odds += (votes * ratio[above, np.arange(votes.shape[1])]).sum(1)
        odds += np.log(LABEL_RIGHT / (1 - LABEL_RIGHT)) * np.array([-1.0, 1.0, 0.0])[labels]
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))

    def correlations(self, votes: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        """Each voter's correlation with its parent within the classes, zero for the root."""
        out = np.zeros(votes.shape[1])
        for j, p in enumerate(self.parent):
            if p >= 0:
                centred = [votes[:, i] - self._rate(votes[:, i], posterior) for i in (j, p)]
                norm = np.sqrt((centred[0] ** 2).mean() * (centred[1] ** 2).mean())
                out[j] = (centred[0] * centred[1]).mean() / norm if norm else 0.0
        return out

    @staticmethod
    def _rate(vote: np.ndarray, q: np.ndarray) -> np.ndarray:
        return q * (vote @ q / max(q.sum(), 1e-9)) + (1 - q) * (vote @ (1 - q) / max((1 - q).sum(), 1e-9))


def _tree(votes: np.ndarray, *weights: np.ndarray) -> np.ndarray:
    """Parents in the spanning tree of the largest mutual information given the class, by rows' weights in each."""
    size = votes.shape[1]
    shared = np.zeros((size, size))
    for weight in weights:
        total = weight.sum() + 1.0
        one = (weight @ votes + 0.5) / total
        both = ((votes * weight[:, None]).T @ votes + 0.25) / total
        cells = [both, one[:, None] - both, one[None, :] - both, 1 - one[:, None] - one[None, :] + both]
        alone = [np.outer(x, y) for x, y in ((one, one), (one, 1 - one), (1 - one, one), (1 - one, 1 - one))]
        for cell, apart in zip(cells, alone):
            cell = np.maximum(cell, 1e-12)
            shared += weight.sum() / len(votes) * cell * np.log(cell / apart)
    parent = np.full(size, -1)
    strength, nearest = shared[0].copy(), np.zeros(size, np.int64)
    inside = np.zeros(size, bool)
    inside[0] = True
    for _ in range(size - 1):
        j = int(np.where(inside, -np.inf, strength).argmax())
        inside[j], parent[j] = True, nearest[j]
        closer = shared[j] > strength
        strength[closer], nearest[closer] = shared[j][closer], j
    return parent


def fit_label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> tuple[LabelModel, np.ndarray]:
    """The model of ``votes`` (a row per document, 0 or 1) and ``labels`` (0, 1, -1), and the posteriors.

    Labelled rows give the balance of the classes and the first estimates, all rows the further ones, in
    which a labelled row counts by its label. Where a voter's parent hardly ever fires in a class, the voter
    is taken not to depend on it there.
    """
    votes = votes.astype(np.float64)
    none = ~votes.any(1)
    known = labels >= 0
    told = np.where(labels == 1, LABEL_RIGHT, 1 - LABEL_RIGHT)
    q = np.full(len(votes), 0.5)
    prior = float((told[known].sum() + 0.5) / (known.sum() + 1))
    for i in range(rounds):
        counted = known.astype(float) if i == 0 and known.any() else np.ones(len(votes))
        share = np.where(known, told, q)
        weights = (1 - share) * counted, share * counted
        parent = _tree(votes, *weights) if votes.shape[1] else np.zeros(0, np.int64)
        above = np.where(parent >= 0, votes[:, parent], 0)
        fires = np.zeros((2, 2, votes.shape[1]))
        for a in (0, 1):
            reached = above == a
            for y, weight in enumerate(weights):
                alone = (weight @ votes + 0.5) / (weight.sum() + 1)
                fires[y, a] = (weight @ (votes * reached) + alone) / (weight @ reached + 1)
        silent = np.array([(w @ none + 0.5) / (w.sum() + 1) for w in weights])
        model = LabelModel(prior, parent, np.clip(fires, 1e-6, 1 - 1e-6), silent)
        q = model.posterior(votes, labels)
    return model, q


@dataclass
class Model:
    """Weights of features by their hash, sorted, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    terms: np.ndarray  # hashes of the features' terms, sorted: nothing else needs counting

    def scores(self, texts: pa.Array) -> np.ndarray:
        owner, term, n_words = terms(texts)
        listed = np.zeros(1 << 16, bool)
        listed[(self.terms & np.uint64(0xFFFF)).astype(np.int64)] = True
        maybe = listed[(term & np.uint64(0xFFFF)).astype(np.int64)]
        owner, term = owner[maybe], term[maybe]
        sure = _places(self.terms, term) >= 0
        owner, shown = _levels(owner[sure], term[sure], n_words)
        place = _places(self.features, shown)
        held = place >= 0
        odds = self.bias + np.bincount(owner[held], self.weights[place[held]], len(n_words))
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def _places(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each value stands in a sorted table, or -1."""
    if not len(table):
        return np.full(len(values), -1)
    place = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[place] == values, place, -1)


def _voters(rows: np.ndarray, feature: np.ndarray, size: int, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features that have a voter, the strongest first, and the votes of every row.

    A voter is right ``SURE`` of the times, beyond what chance gives the luckiest feature; of terms that
    mark almost the same documents one is enough.
    """
    toxic, clean = (np.bincount(feature[labels[rows] == y], minlength=size).astype(float) for y in (1, 0))
    n1, n0 = (float((labels == y).sum()) for y in (1, 0))
    strength = np.where(toxic >= SURE * (toxic + clean), _deviance(toxic, clean, n1, n0), 0)
    strongest = np.argsort(-strength, kind="stable")[: 8 * VOTERS]
    strongest = strongest[strength[strongest] > _chance(size)]
    place = np.full(size, -1)
    place[strongest] = np.arange(len(strongest))
    seen = place[feature] >= 0
    votes = np.zeros((len(labels), len(strongest)), bool)
    votes[rows[seen], place[feature[seen]]] = True
    together = votes.T.astype(np.float32) @ votes.astype(np.float32)
    fired = np.diag(together)
    chosen: list[int] = []
    for j in range(len(strongest)):
        either = fired[chosen] + fired[j] - together[chosen, j]
        if len(chosen) < VOTERS and not (together[chosen, j] > 0.95 * either).any():
            chosen.append(j)
    return strongest[chosen], votes[:, chosen]


def _regress(rows: np.ndarray, column: np.ndarray, size: int, q: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression of ``q`` on 0-1 columns, by Newton steps that conjugate gradients solve."""
    n = len(q)
    # The bias is one more column, hardly held.
    rows, column = np.r_[rows, np.arange(n)], np.r_[column, np.full(n, size)]
    ridge = np.full(size + 1, RIDGE)
    ridge[size] = RIDGE / 1000
    weights = np.zeros(size + 1)
    weights[size] = np.log(q.mean() / (1 - q.mean()))

    def times(v: np.ndarray) -> np.ndarray:
        return np.bincount(rows, v[column], n)

    def loss(w: np.ndarray) -> float:
        odds = times(w)
        return float((np.logaddexp(0, odds) - q * odds).sum() + (ridge * w * w).sum() / 2)

    for _ in range(STEPS):
        chance = 1 / (1 + np.exp(-np.clip(times(weights), -60, 60)))
        slope = np.bincount(column, (chance - q)[rows], size + 1) + ridge * weights
        curve = np.maximum(chance * (1 - chance), 1e-6)
        scale = np.bincount(column, curve[rows], size + 1) + ridge
        step, rest = np.zeros(size + 1), -slope
        along, square = rest / scale, float(rest @ (rest / scale))
        first = square
        for _ in range(INNER):
            if square <= 1e-8 * first or not square:
                break
            bent = np.bincount(column, (curve * times(along))[rows], size + 1) + ridge * along
            length = square / float(along @ bent)
            step, rest = step + length * along, rest - length * bent
            after = float(rest @ (rest / scale))
            along, square = rest / scale + after / square * along, after
        now, part = loss(weights), 1.0
        while part > 1e-4 and loss(weights + part * step) > now:
            part /= 2
        weights = weights + part * step
        if now - loss(weights) < 1e-6 * now:
            break
    return weights[:size], float(weights[size])


@dataclass
class Training:
    model: Model
    label_model: LabelModel
    votes: np.ndarray
    posterior: np.ndarray


def train(texts: pa.Array, labels: np.ndarray) -> Training:
    """Fit on whole texts; ``labels`` are 0, 1, or -1 where there is none. Equal input, equal model."""
    owners, shown, used = [], [], []
    at = 0
    for part in W.slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
        owner, term, n_words = terms(part.column(0))
        own, feature = _levels(owner, term, n_words)
        owners.append(own + at)
        shown.append(feature)
        used.append(np.unique(term))
        at += part.num_rows
    rows = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    features, feature = np.unique(np.concatenate(shown) if shown else np.zeros(0, np.uint64), return_inverse=True)
    used = np.unique(np.concatenate(used)) if used else np.zeros(0, np.uint64)
    del owners, shown
    _, votes = _voters(rows, feature, len(features), labels)
    label_model, q = fit_label_model(votes, labels)
    # Posteriors choose what the classifier sees, too.
    total = np.bincount(feature, minlength=len(features)).astype(float)
    toxic = np.bincount(feature, q[rows], len(features))
    strength = np.where(toxic >= SURE * total, _deviance(toxic, total - toxic, q.sum(), len(q) - q.sum()), 0)
    kept = np.argsort(-strength, kind="stable")[:FEATURES]
    kept = np.sort(kept[strength[kept] > _chance(len(features))])
    place = np.full(len(features), -1)
    place[kept] = np.arange(len(kept))
    seen = place[feature] >= 0
    weights, bias = _regress(rows[seen], place[feature[seen]], len(kept), np.clip(q, 1e-4, 1 - 1e-4))
    levels = np.concatenate([W.mix(used + np.uint64(level)) for level in range(LEVELS)])
    mine = np.tile(used, LEVELS)[_places(features[kept], levels) >= 0]
    return Training(Model(features[kept], weights, bias, np.unique(mine)), label_model, votes, q)


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``part``; a null id counts as empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(parts)) == part


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [batch for batch in batches if batch.num_rows]
    if rows:
        table = pa.Table.from_batches(rows).sort_by([("doc_id", "ascending"), ("digest", "ascending")]).combine_chunks()
        texts = pa.chunked_array(table.column("text")).combine_chunks()
        model = train(texts, table.column("toxic").to_numpy().astype(np.int64)).model
        arrays = model.features, model.weights, np.array([model.bias]), model.terms
        parts = [a.astype(a.dtype.newbyteorder("<")).tobytes() for a in arrays]
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], ["features", "weights", "bias", "terms"])


def _sample(docs: DataFrame, labels: DataFrame, labelled: int, unlabelled: int, limit: int) -> DataFrame:
    """Rows (doc_id, digest, text, toxic) to learn from: -1 stands for no label."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fit = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL").where(~held_out("doc_id", 3, 1))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    light = fit.select("doc_id", F.xxhash64("text").alias("digest"), size.alias("size")).where(F.col("size") <= limit // 16)
    light = light.join(known, "doc_id", "left").withColumn("order", F.xxhash64("doc_id", F.lit(12)))
    kinds = ((labelled, "toxic IS NOT NULL", limit * 2 // 3), (unlabelled, "toxic IS NULL", limit // 3))
    sample = None
    for rows, kind, most in kinds:
        first = light.where(kind).orderBy("order", "doc_id", "digest").limit(rows)
        # Over at most ``rows`` ids and sizes, in one task.
        so_far = F.sum("size").over(Window.orderBy("order", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, 0))
        part = first.withColumn("so_far", so_far).where(F.col("so_far") <= most)
        sample = part if sample is None else sample.union(part)
    chosen = sample.groupBy("doc_id").agg(F.min(F.struct("digest", F.coalesce("toxic", F.lit(-1)).alias("toxic"))).alias("c"))
    chosen = chosen.select("doc_id", "c.digest", "c.toxic")
    texts = fit.withColumn("digest", F.xxhash64("text"))
    # At most ``labelled`` and ``unlabelled`` ids are broadcast.
    found = texts.join(F.broadcast(chosen), ["doc_id", "digest"])
    return found.groupBy("doc_id", "digest").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    labelled: int = LABELLED,
    unlabelled: int = UNLABELLED,
    limit: int = TRAIN_BYTES,
) -> Model:
    """A model learned from a bounded sample outside the held-out third.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic. The sample is at most ``labelled`` documents
    with a label 0 or 1 (1, if an id has both) and ``unlabelled`` without, those of least hash, with
    ``limit`` bytes of text together; texts of over a sixteenth of that are scored but not learned from,
    and of rows that share an id the one of least content hash is learned from. One task trains; only the
    model, 100 KB, comes to the driver. Without labels every score is one half.
    """
    sample = _sample(docs, labels, labelled, unlabelled, limit)
    schema = "features binary, weights binary, bias binary, terms binary"
    trained = sample.repartition(1).mapInArrow(_train_task, schema).first()
    nothing = np.zeros(0, np.uint64)
    if trained is None:
        return Model(nothing, np.zeros(0), 0.0, nothing)
    kinds = ("<u8", "<f8", "<f8", "<u8")
    features, weights, bias, own = (np.frombuffer(bytes(x), k) for x, k in zip(trained, kinds))
    return Model(features, weights, float(bias[0]), own)


def score_column(spark, model: Model, text: Column) -> Column:
    """Column of the chance that ``text`` is toxic; null texts count as empty."""
    shared = spark.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        parts = W.slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", 1 << 20)
        found = [shared.value.scores(part.column(0)) for part in parts]
        return pa.array(np.concatenate(found) if found else [], pa.float64())

    return F.arrow_udf(run, "double")(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """``docs`` with held_out, score and predicted (1 if the score reaches ``threshold``).

    ``docs`` has doc_id and text; its other columns stay, but for columns of these three names, which are
    replaced. Null and empty texts have no terms and score by the bias. Repeated rows score alike; rows
    without an id are scored and not learned from. An empty table gives an empty one.
    """
    model = fit_toxicity(docs, labels, **options)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("held_out", "score", "predicted")]
    scored = docs.select(
        *kept,
        held_out("doc_id", 3, 1).alias("held_out"),
        score_column(docs.sparkSession, model, F.col("text")).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
