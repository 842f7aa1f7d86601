"""Quality rules with robust multivariate outliers.

A document's statistics, transformed so that they are roughly normal, are compared with those of its
language and source: location and scatter come from the minimum covariance determinant, and a document
far from them by Mahalanobis distance is rejected. Estimates are over distinct vectors of statistics, so
that copies of a text have one voice.

The estimate concentrates step by step: from each of several starts, each step keeps the share ``SUPPORT``
of a group's documents that is nearest and takes their mean and covariance; the start that ends at the
lowest determinant counts. Every step is one Spark aggregate for all starts. It sums counts, vectors and
products by group and by bin of the distance, so that no group ever meets in one task; what a group's own
task sees is one row per bin.

Groups are of any size. A source's estimate is drawn towards that of its language, and that towards the
one of all documents, by how many vectors it rests on: ``PRIOR`` vectors' worth comes from above. A
source of two documents is judged almost as its language is, one of a million on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.llm import words as W
from askloom.session import materialize

SUPPORT = 0.75
STEPS = 5
BROADCAST_GROUPS = 10_000  # estimates of so many groups, 200 bytes each, go to every task
STARTS = 3  # medians, and the means of two halves
PRIOR = 50  # vectors that the estimate above a group's own counts as
CUT = 120.0  # squared distance, scaled so that its median is that of a normal distribution
_MEDIAN = 4.351  # of chi-squared with five degrees of freedom
_LEAST_MEDIAN = 0.455  # with one: where most statistics are alike in a group, the others are not blown up
BINS_PER_E = 16
_FLOOR = (0.5, 0.5, 0.05, 0.2, 0.2)  # least standard deviation of each statistic
_N = len(_FLOOR)
_PAIRS = [(i, j) for i in range(_N) for j in range(i, _N)]
_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1


def _repeated_words(words: np.ndarray, firsts: np.ndarray, width: int = 3) -> np.ndarray:
    """Which words lie in a run of ``width`` words that occurs twice or more in the same text."""
    covered = np.zeros(len(words) + 1, np.int64)
    place = np.flatnonzero(W.inside(firsts, width))
    run = W.windows(words, width)[place] if len(place) else np.zeros(0, np.uint64)
    owner = np.searchsorted(firsts, place, "right") - 1
    order = np.lexsort((run, owner))
    same = (run[order][1:] == run[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(place), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    np.add.at(covered, place[twice], 1)
    np.add.at(covered, place[twice] + width, -1)
    return np.cumsum(covered[:-1]) > 0


def _statistics(text: pa.Array) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    data, offsets = W.raw(text)
    starts, ends, firsts = W.spans(data, offsets)

    def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(values)][at])

    chars = ((data & 0xC0) != 0x80) & ~W._SPACE[data]
    doubled = []
    flat = data.tobytes()
    for a, b in zip(offsets, offsets[1:]):
        lines = [x for x in flat[a:b].split(b"\n") if x.split()]
        doubled.append(len(lines) - len(set(lines)))
    repeated = _repeated_words(W.hashes(data, starts, ends), firsts)
    return [
        np.diff(firsts),
        per_text(chars, offsets),
        per_text(_SYMBOLS[data], offsets),
        np.array(doubled, np.int64),
        per_text(repeated, firsts),
    ]


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = ", ".join(f"{n}: long" for n in NAMES)


def statistics_column(text: Column) -> Column:
    """Struct of the base statistics of a text; null and empty texts have zeros."""

    def run(texts: pa.Array) -> pa.Array:
        parts = W.slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text")
        found = [_statistics(part.column(0)) for part in parts]
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * len(NAMES)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)

    return F.arrow_udf(run, f"struct<{_SCHEMA}>")(text)


def _vector() -> list[Column]:
    words, chars = F.col("_s.n_words"), F.greatest(F.col("_s.word_chars"), F.lit(1))
    return [
        F.log1p(words),
        chars / F.greatest(words, F.lit(1)),
        F.sqrt(F.col("_s.n_symbols") / chars),
        F.log1p("_s.n_dup_lines") / F.log1p(F.greatest(words, F.lit(1))),
        F.col("_s.n_repeat_words") / F.greatest(words, F.lit(1)),
    ]


def _distance() -> Column:
    """The squared Mahalanobis distance, from location m0.. and inverse scatter w00.."""
    centred = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(_N)]
    terms = [centred[i] * centred[j] * F.col(f"w{i}{j}") * (1 if i == j else 2) for i, j in _PAIRS]
    return sum(terms[1:], terms[0])


_LEVELS = ("source", "language", "all")
_FIELDS = [f"m{i}" for i in range(_N)] + [f"w{i}{j}" for i, j in _PAIRS]
_PARAMS = ", ".join(["_group long", "_of long", *(f"{c} double" for c in _FIELDS)])


def _params(mean: np.ndarray, scatter: np.ndarray) -> dict:
    inverse = np.linalg.inv(scatter)
    return {f"m{i}": mean[i] for i in range(_N)} | {f"w{i}{j}": inverse[i, j] for i, j in _PAIRS}


def _mean_and_scatter(row) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.zeros((_N, _N))
    for i, j in _PAIRS:
        inverse[i, j] = inverse[j, i] = row[f"w{i}{j}"]
    return np.array([row[f"m{i}"] for i in range(_N)]), np.linalg.inv(inverse)


def _concentrate(bins: pd.DataFrame) -> pd.DataFrame:
    """Location, scatter and its log determinant of the nearest ``SUPPORT`` of a group, from sums by distance bin."""
    bins = bins.sort_values("_bin")
    counts = bins["n"].to_numpy().cumsum()
    near = bins.iloc[: int(np.searchsorted(counts, SUPPORT * counts[-1])) + 1]
    n = near["n"].sum()
    mean = np.array([near[f"s{i}"].sum() for i in range(_N)]) / n
    scatter = np.zeros((_N, _N))
    for i, j in _PAIRS:
        scatter[i, j] = scatter[j, i] = near[f"p{i}{j}"].sum() / n - mean[i] * mean[j]
    scatter += np.diag(np.square(_FLOOR))
    values = {"_group": int(bins["_group"].iloc[0]), "_of": int(bins["_of"].iloc[0])} | _params(mean, scatter)
    return pd.DataFrame([values | {"det": np.linalg.slogdet(scatter)[1], "n": int(counts[-1])}])


def _with_groups(rows: DataFrame, table: DataFrame, n_groups: int, key: str = "_group") -> DataFrame:
    """Join a table of one row per group. Counted to be small it is broadcast, so that the rows of a hot
    group stay spread; beyond that both sides meet by group."""
    return rows.join(F.broadcast(table) if n_groups <= BROADCAST_GROUPS else table, key)


def _binned(rows: DataFrame) -> DataFrame:
    near = rows.withColumn("_d", _distance())
    return near.withColumn("_bin", F.floor(BINS_PER_E * F.log(F.greatest("_d", F.lit(1e-6)))))


def robust_estimates(rows: DataFrame, n_groups: int) -> DataFrame:
    """Per ``_group`` of ``rows`` (with x0..): location m0.., inverse scatter w00.. and number of rows n."""
    n_groups *= STARTS
    starts = F.explode(F.array(*[F.lit(s) for s in range(STARTS)]))
    rows = rows.withColumnRenamed("_group", "_of").withColumn("_start", starts)
    rows = rows.withColumn("_group", F.xxhash64("_of", "_start"))
    xs = [f"x{i}" for i in range(_N)]
    sums = [F.count("*").alias("n")] + [F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in _PAIRS]
    estimate = _PARAMS + ", det double, n long"
    # The first start: medians and median deviations. The others: means and covariances of two halves by hash.
    first = rows.where("_start = 0")
    middles = first.groupBy("_group").agg(*[F.percentile_approx(f"x{i}", 0.5, 1000).alias(f"m{i}") for i in range(_N)])
    middles = materialize(middles, "middles")
    spread = _with_groups(first, middles, n_groups).groupBy("_group", "_of", *[f"m{i}" for i in range(_N)])
    spread = spread.agg(*[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 1000).alias(f"d{i}") for i in range(_N)])
    diagonal = [
        (F.lit(1.0) / (F.pow(1.4826 * F.col(f"d{i}"), 2) + floor**2) if i == j else F.lit(0.0)).alias(f"w{i}{j}")
        for i, j in _PAIRS
        for floor in [_FLOOR[i]]
    ]
    medians = spread.select("_group", "_of", *[f"m{i}" for i in range(_N)], *diagonal)
    half = rows.where(F.col("_start") > 0).where(F.pmod(F.xxhash64(*xs), F.lit(STARTS - 1)) == F.col("_start") - 1)
    halves = half.groupBy("_group", "_of", F.lit(0).cast("long").alias("_bin")).agg(*sums)
    means = halves.groupBy("_group").applyInPandas(_concentrate, estimate).drop("det", "n")
    params = materialize(medians.unionByName(means), "estimates")
    for _ in range(STEPS):
        bins = _binned(_with_groups(rows.drop("_of"), params, n_groups)).groupBy("_group", "_of", "_bin").agg(*sums)
        params = materialize(bins.groupBy("_group").applyInPandas(_concentrate, estimate), "estimates")
    best = F.min(F.struct("det", F.col("_group").alias("_tie"), "n", *_FIELDS)).alias("e")
    return params.groupBy(F.col("_of").alias("_group")).agg(best).select("_group", "e.n", *[f"e.{c}" for c in _FIELDS])


def _drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sources' estimates (their own and those above beside it) drawn together, all first."""
    for rows in batches:
        out = []
        for row in rows.to_dict("records"):
            mean, scatter = _mean_and_scatter({k: row[f"all_{k}"] for k in _FIELDS})
            for level in ("language", "source"):
                own = _mean_and_scatter({k: row[f"{level}_{k}"] for k in _FIELDS})
                share = row[f"{level}_n"] / (row[f"{level}_n"] + PRIOR)
                mean, scatter = share * own[0] + (1 - share) * mean, share * own[1] + (1 - share) * scatter
            out.append({"_source": row["_source"]} | _params(mean, scatter))
        yield pd.DataFrame(out, columns=["_source", *_FIELDS])


def _medians(bins: pd.DataFrame) -> pd.DataFrame:
    bins = bins.sort_values("_bin")
    counts = bins["n"].to_numpy().cumsum()
    middle = bins["_bin"].iloc[int(np.searchsorted(counts, 0.5 * counts[-1]))]
    return pd.DataFrame([{"_group": int(bins["_group"].iloc[0]), "typical": (middle + 0.5) / BINS_PER_E, "n": int(counts[-1])}])


def _above(groups: DataFrame, table: DataFrame, fields: list[str]) -> DataFrame:
    """Each source with the rows of ``table`` of itself, its language and all, under prefixed names."""
    for level in _LEVELS:
        own = table.select(F.col("_group").alias(f"_{level}"), *[F.col(c).alias(f"{level}_{c}") for c in (*fields, "n")])
        groups = groups.join(own, f"_{level}")
    return groups


def group_estimates(vectors: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """Per ``_source``: location, inverse scatter, and the typical squared distance, each drawn towards what
    is above. ``vectors`` has distinct rows of ``_source``, ``_language``, ``_all`` and x0..; ``groups``
    the distinct first three."""
    xs = [f"x{i}" for i in range(_N)]
    levels = F.explode(F.array(*[f"_{level}" for level in _LEVELS])).alias("_group")
    rows = materialize(vectors.select(levels, *xs).distinct(), "levels")
    own = robust_estimates(rows, 3 * n_groups)
    fields = ", ".join(f"{c} double" for c in _FIELDS)
    drawn = _above(groups, own, _FIELDS).mapInPandas(_drawn, f"_source long, {fields}")
    drawn = materialize(drawn, "drawn")
    # The median of the distances brings the scatter to scale.
    binned = _binned(_with_groups(vectors, drawn, n_groups, "_source")).select(levels, "_bin")
    bins = binned.groupBy("_group", "_bin").agg(F.count("*").alias("n"))
    typical = materialize(bins.groupBy("_group").applyInPandas(_medians, "_group long, typical double, n long"), "typical")
    scale = F.col("all_typical")
    above = _above(groups, typical, ["typical"])
    for level in ("language", "source"):
        share = F.col(f"{level}_n") / (F.col(f"{level}_n") + PRIOR)
        scale = share * F.col(f"{level}_typical") + (1 - share) * scale
    scale = F.greatest(F.exp(scale), F.lit(_LEAST_MEDIAN))
    return drawn.join(above.select("_source", scale.alias("typical")), "_source")


def judge_documents(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """``docs`` (doc_id, text, lang, source) without the text, with the base statistics, base_failed, distance and kept.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word runs. All others are
    compared with those of their language and source, whatever their number; small groups lean on what is
    above them. ``kept`` is false beyond ``cut`` times the scaled squared distance. Estimates take each
    vector of statistics of a group once. Null languages and sources are values of their own; a null text
    has no words, so it fails. Repeated rows are judged alike. Columns of the names that are added are
    replaced; all others stay.
    """
    made = [*NAMES, "base_failed", "distance", "kept"]
    own = [c for c in docs.columns if c != "text" and c not in made]
    failed = (F.col("_s.n_words") < 50) | (100 * F.col("_s.n_repeat_words") > 50 * F.col("_s.n_words"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"),
        F.xxhash64(F.coalesce("lang", F.lit("")), F.col("lang").isNull(), F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("_source"),
        F.xxhash64(F.coalesce("lang", F.lit("")), F.col("lang").isNull()).alias("_language"),
        statistics_column(F.col("text")).alias("_s"),
    )
    rows = materialize(rows, "statistics").withColumn("base_failed", failed).withColumn("_all", F.lit(0).cast("long"))
    xs = [x.alias(f"x{i}") for i, x in enumerate(_vector())]
    judged = rows.where("NOT base_failed").select("_row", "_s", "base_failed", "_source", "_language", "_all", *xs)
    judged = materialize(judged, "vectors")
    vectors = materialize(judged.drop("_row", "_s", "base_failed").distinct(), "distinct-vectors")
    groups = materialize(vectors.select("_source", "_language", "_all").distinct(), "groups")
    n_groups = groups.count()
    estimates = group_estimates(vectors, groups, n_groups)
    judged = _with_groups(judged, materialize(estimates, "group-estimates"), n_groups, "_source")
    judged = judged.withColumn("distance", _distance() * _MEDIAN / F.col("typical")).withColumn("kept", F.col("distance") <= cut)
    failed = rows.where("base_failed").withColumn("distance", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    columns = [F.col(f"_row.`{c}`") for c in own] + [F.col(f"_s.{n}") for n in NAMES] + ["base_failed", "distance", "kept"]
    return judged.select(*columns).union(failed.select(*columns))
