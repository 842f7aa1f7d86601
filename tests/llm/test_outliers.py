"""Quality rules: every group is judged, whatever its size, and the estimate is a least determinant."""

import random

import numpy as np
from pyspark.sql import functions as F

from askloom.llm import outliers

SCHEMA = "doc_id long, text string, lang string, source string"


def prose(rng, junk=False):
    words = [f"word{rng.randrange(900)}" for _ in range(rng.randint(60, 300))]
    return " ".join(w + "###$$$%%%" if junk else w for w in words)


def test_small_groups_are_judged_too(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng), "en", f"s{i % 3}") for i in range(300)]
    bad = {}
    for i, (lang, source, n) in enumerate([("en", "of three", 3), ("xx", "rare", 6), (None, None, 5), ("en", None, 2), ("alone", "alone", 1)]):
        for k in range(n):
            key = 1000 + 10 * i + k
            rows.append((key, prose(rng, junk=k == 0), lang, source))
            if k == 0:
                bad[key] = lang
    got = outliers.judge_documents(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if not r.kept} == set(bad)
    # The same rows, however they lie, have the same distances.
    again = outliers.judge_documents(spark.createDataFrame(rows[::-1], SCHEMA).repartition(2)).collect()
    near = {r.doc_id: r.distance for r in again}
    assert all(abs(near[r.doc_id] - r.distance) <= 1e-6 * (1 + r.distance) for r in got)


def brute_determinant(points, rounds=200):
    """The least log determinant that concentration reaches from many random starts, floors added."""
    rng = np.random.default_rng(0)
    floor = np.diag(np.square(outliers._FLOOR))
    n = int(np.ceil(outliers.SUPPORT * len(points)))
    best = np.inf
    for _ in range(rounds):
        own = points[rng.choice(len(points), 8, replace=False)]
        for _ in range(30):
            mean, scatter = own.mean(0), np.cov(own.T, bias=True) + floor
            away = ((points - mean) @ np.linalg.inv(scatter) * (points - mean)).sum(1)
            own = points[np.argsort(away, kind="stable")[:n]]
        best = min(best, np.linalg.slogdet(np.cov(own.T, bias=True) + floor)[1])
    return best


def test_estimates_reach_the_least_determinant(spark):
    rng = np.random.default_rng(4)
    groups = {}
    for g, share in enumerate((0.0, 0.1, 0.22)):
        points = rng.normal(size=(160, 5)) * [2.0, 1.0, 0.5, 1.0, 3.0]
        far = int(160 * share)
        points[:far] += np.array([30.0, -8.0, 4.0, 9.0, 0.0]) + rng.normal(size=(far, 5))
        groups[g] = points
    rows = [(g, *map(float, p)) for g, points in groups.items() for p in points] + [(9, 1.0, 2.0, 3.0, 4.0, 5.0)]
    df = spark.createDataFrame(rows, "_group long, " + ", ".join(f"x{i} double" for i in range(5))).repartition(3)
    found = {r["_group"]: r for r in outliers.robust_estimates(df, 4).collect()}
    assert set(found) == {0, 1, 2, 9} and found[9].n == 1
    for g, points in groups.items():
        mean, scatter = outliers._mean_and_scatter(found[g].asDict())
        # A bin of distances is kept whole, so a little more than the support is.
        assert np.linalg.slogdet(scatter)[1] <= brute_determinant(points) + 0.4
        clean = points[int(160 * (0.0, 0.1, 0.22)[g]) :]
        assert (abs(mean - clean.mean(0)) < 0.5 * clean.std(0)).all()


def test_clashing_columns_and_empty_tables(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng), "en", "s", i, 2.0, "k", i) for i in range(60)] + [(None, None, None, None, 1, 1.0, "k", 1)]
    df = spark.createDataFrame(rows, SCHEMA + ", n_words int, x0 double, kept string, _group int")
    got = outliers.judge_documents(df)
    assert got.columns == ["doc_id", "lang", "source", "x0", "_group", *outliers.NAMES, "base_failed", "distance", "kept"]
    assert {(r.x0, r.base_failed) for r in got.collect()} == {(2.0, False), (1.0, True)}
    assert outliers.judge_documents(df.limit(0)).collect() == []
    assert outliers.judge_documents(df.where(F.col("doc_id").isNull())).collect()[0].kept is False
