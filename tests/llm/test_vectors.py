"""Hard negatives and centroid clustering against brute force in whole numbers of any size."""

import hashlib
import math
import random

import numpy as np
import pytest

from askloom.llm import hard_negatives, orchard

WIDE = "vec_id long, label int, embedding array<float>"


def made_vectors(seed=0, n=150, size=6, labels=3):
    random_ = random.Random(seed)
    rows = []
    for i in range(n):
        vector = [random_.uniform(-1, 1) + (0.8 if d == i % labels else 0) for d in range(size)]
        rows.append((i, random_.randrange(labels), vector))
    copies = [(n + i, i % 2, rows[7][2]) for i in range(40)]  # a fifth of all rows are one vector
    odd = [(900, 1, None), (901, None, rows[0][2]), (902, 1, [1.0, None] + [0.0] * (size - 2)), (None, 1, rows[1][2])]
    odd += [(903, 1, [math.nan] * size), (904, 2, [math.inf] * size), (905, 1, []), (906, 0, [0.5])]
    return rows + copies + odd + rows[:2]


def whole(vector, scale=256):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(scale * float(np.float32(x))) for x in vector]


def brute_negatives(rows, anchors, k=5):
    usable = [(i, label, whole(v)) for i, label, v in rows if i is not None and label is not None and whole(v) is not None]
    out = set()
    for a, la, va in {(i, la, tuple(v)) for i, la, v in usable if i in anchors}:
        scored = [(-sum(x * y for x, y in zip(va, v)), i, lb == la) for i, lb, v in usable if i != a and len(v) == len(va)]
        scored.sort()
        for s, p, _ in [x for x in scored if x[2]][:k]:
            below = [(t, n) for t, n, same in scored if not same and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out |= {(a, p, rank + 1, n, -s, -t) for rank, (t, n) in enumerate(below)}
    return out


@pytest.mark.parametrize("group,anchors_a_tile,tile", [(16 << 20, 1024, 8 << 20), (2000, 3, 8 * 3 * 7)])
def test_hard_negatives(spark, monkeypatch, group, anchors_a_tile, tile):
    for name, value in (("GROUP_BYTES", group), ("TILE_ANCHORS", anchors_a_tile), ("TILE_BYTES", tile), ("FAN", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = made_vectors()
    vectors = spark.createDataFrame(rows, WIDE).repartition(5)
    asked = {0, 1, 5, 7, 50, 100, 150, 155, 900, 903, 905, 906}
    found = hard_negatives.mine_negatives(vectors, vectors.where(vectors.vec_id.isin(*asked)))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in found.collect()]
    want = brute_negatives(rows, asked)
    assert set(got) == want and len(want) > 100
    # Rows 0 and 1 are there twice: as positives of others they count twice, with the same negatives.
    assert len(got) >= len(want)


def test_further_and_clashing_columns(spark):
    rows = [(i, i % 2, [float(i % 5), 1.0]) for i in range(12)]
    plain = spark.createDataFrame(rows, WIDE)
    wide = plain.selectExpr("vec_id", "label", "embedding", "label AS no", "vec_id AS shard", "label AS label", "0 AS place")
    got, want = (hard_negatives.mine_negatives(df, df.where("vec_id < 3")) for df in (wide, plain))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    wide = plain.selectExpr("vec_id", "embedding", "label AS cluster", "label AS vec_id", "0 AS distance")
    got, want = (orchard.cluster_vectors(df, 3, 1, 2) for df in (wide, plain.select("vec_id", "embedding")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_hard_negatives_without_rows(spark):
    empty = spark.createDataFrame([], WIDE)
    assert hard_negatives.mine_negatives(empty, empty).collect() == []
    alone = spark.createDataFrame([(1, 1, [1.0]), (1, 2, [1.0]), (2, 1, [-1.0]), (3, 2, [-0.9])], WIDE)
    assert hard_negatives.mine_negatives(alone, alone.where("vec_id = 2")).collect() == []  # a positive below zero


@pytest.mark.parametrize("top", [255, 3000, 1 << 22, 1 << 30, 1 << 40])
def test_packed_scores_are_exact(top):
    random_ = np.random.default_rng(top)
    anchors, vectors = (random_.integers(-top, top + 1, (n, 9)).astype(float) for n in (5, 23))
    vectors[3] = 0
    anchors[1], vectors[4] = -top, -top
    low, high = int(anchors.min()), int(anchors.max())
    packed = hard_negatives.pack(vectors, low, high)
    want = [[max(min(sum(int(x) * int(y) for x, y in zip(a, v)), 2**63 - 1), -(2**63)) for v in vectors] for a in anchors]
    assert hard_negatives.packed_scores(anchors, low, packed).tolist() == want
    assert packed.fields > 1 or packed.width > 26
    assert hard_negatives.packed_scores(abs(anchors), 0, hard_negatives.pack(abs(vectors), 0, high)).shape == (5, 23)


def test_least_score():
    tops = [-1000, -101, -100, -99, -1, 0, 1, 2, 99, 100, 101, 12345, 2**62]
    assert hard_negatives._least(np.array(tops)).tolist() == [-(-80 * t // 100) for t in tops]


def brute_clusters(rows, k, rounds, size):
    usable = [(i, v) for i, v in ((i, whole(v)) for i, _, v in rows) if i is not None and v is not None and len(v) == size]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in usable)
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = [[v for _, v in usable if nearest(v)[1] == n] for n in range(len(centroids))]
        centroids = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(members, centroids)]
    placed = [(i, nearest(v)) for i, v in usable]
    inertia = [sum(d for _, (d, c) in placed if c == n) for n in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, c, d, inertia[c], sum(inertia), digest[c]) for i, (d, c) in placed)


@pytest.mark.parametrize("k", [1, 7, 40, 500])
def test_clusters(spark, k):
    rows = made_vectors(seed=k)
    vectors = spark.createDataFrame([(i, v) for i, _, v in rows], "label long, text array<float>").repartition(4)
    found = orchard.cluster_vectors(vectors, k=k, rounds=3, length=6)
    assert sorted(tuple(r) for r in found.collect()) == brute_clusters(rows, k, 3, 6)


def test_clusters_of_nothing_and_of_huge_numbers(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert orchard.cluster_vectors(empty).collect() == []
    huge = spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64), (3, [3e38] * 64)], "vec_id long, embedding array<float>")
    found = {r.vec_id: r for r in orchard.cluster_vectors(huge, k=1, rounds=0).collect()}
    assert found[1].distance != found[2].distance and {found[1].distance, found[2].distance} == {0, 1 << 62}
    assert found[1].inertia == found[3].inertia


def test_orchard_walk_equals_full_search():
    random_ = np.random.default_rng(5)
    for size in (1, 2, 64):
        # Few values make ties and equal centroids.
        centroids, vectors = random_.integers(-3, 4, (40, size)), random_.integers(-3, 4, (500, size))
        number, distance = orchard.Centroids(centroids).nearest(vectors)
        full = ((vectors[:, None, :] - centroids[None]) ** 2).sum(2)
        assert (distance == full.min(1)).all() and (number == full.argmin(1)).all()
