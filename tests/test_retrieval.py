import json
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from askloom.functions.vectors import (
    cosine,
    hashed_embedding,
    inner_product,
    l2sq,
    model_embedding,
    vector_distance,
)
from askloom.operators.retrieval import (
    _search_block,
    content_only,
    documents_from_responses,
    knn,
    nearest,
    retrieve,
    to_documents,
)


def table(spark, vectors, key, **more):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{key} long, embedding array<double>")


def distance(a, b, metric):
    a, b = np.array(a, dtype=float), np.array(b, dtype=float)
    if metric == "l2sq":
        return float(((a - b) ** 2).sum())
    if metric == "ip":
        return float(-(a @ b))
    norm = np.sqrt(a @ a) * np.sqrt(b @ b)
    return float(1 - (a @ b / norm if norm else 0.0))


def brute(asked, index, k, metric):
    out = []
    for q, a in enumerate(asked):
        near = sorted((round(distance(a, b, metric), 9), i) for i, b in enumerate(index))[:k]
        out += [(q, rank + 1, i) for rank, (_, i) in enumerate(near)]
    return out


def found(df):
    return sorted((r.question_id, r["rank"], r.chunk_id) for r in df.collect())


vectors = st.lists(
    st.lists(st.integers(-2, 2), min_size=3, max_size=3), min_size=1, max_size=40
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(vectors, vectors, st.integers(1, 6), st.sampled_from(["l2sq", "ip"]))
def test_equals_brute_force_with_many_ties(spark, asked, index, k, metric):
    q, i = table(spark, asked, "question_id"), table(spark, index, "chunk_id")
    assert found(knn(q, i, k, metric, payload=())) == brute(asked, index, k, metric)


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 1200])
def test_both_ways_equal_brute_force(spark, metric, broadcast_bytes, monkeypatch):
    import askloom.operators.retrieval as retrieval

    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 50 * 8 * 5)
    rng = np.random.default_rng(3)
    asked, index = rng.normal(size=(23, 5)), rng.normal(size=(211, 5))
    q, i = table(spark, asked, "question_id"), table(spark, index, "chunk_id").repartition(5)
    hits = nearest(q, i, 4, metric, broadcast_bytes=broadcast_bytes)
    assert found(hits) == brute(asked, index, 4, metric)


def test_no_index_vector_is_shuffled(spark):
    rng = np.random.default_rng(5)
    q, i = table(spark, rng.normal(size=(40, 4)), "question_id"), table(spark, rng.normal(size=(90, 4)), "chunk_id")
    plan = nearest(q, i, 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "CoGroup" not in plan
    below = plan[plan.index("MapInArrow") :]
    assert "Exchange" not in below


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 500])
def test_a_repeated_key_is_one_neighbour(spark, broadcast_bytes, monkeypatch):
    import askloom.operators.retrieval as retrieval

    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 7 * 8 * 2)
    rng = np.random.default_rng(6)
    asked, index = rng.integers(-4, 4, (9, 2)), rng.integers(-4, 4, (40, 2))
    q, one = table(spark, asked, "question_id"), table(spark, index, "chunk_id").withColumn("label", F.lit("old"))
    far = one.select("chunk_id", F.array(F.lit(90.0), F.lit(90.0)).alias("embedding"), F.lit("new").alias("label"))
    many = one.union(one).union(far).repartition(3)
    rows = knn(q, many, 3, broadcast_bytes=broadcast_bytes)
    assert rows.count() == 27
    assert found(rows) == brute(asked, index, 3, "l2sq")


@pytest.mark.parametrize("odd", [float("nan"), float("inf")])
def test_a_vector_that_is_not_finite_comes_last_and_harms_no_other(spark, odd):
    rng = np.random.default_rng(7)
    index = 1e8 + rng.normal(size=(120, 3)) * 1e-3
    asked = 1e8 + rng.normal(size=(8, 3)) * 1e-3
    q, i = table(spark, asked, "question_id"), table(spark, [*index, [odd, 0, 0]], "chunk_id").coalesce(1)
    assert found(knn(q, i, 5, payload=())) == brute(asked, index, 5, "l2sq")
    assert {r.chunk_id for r in knn(q, i, 121, payload=()).where("rank = 121").collect()} == {120}


def test_more_neighbours_hold_fewer(spark):
    rng = np.random.default_rng(4)
    q = table(spark, rng.normal(size=(6, 4)), "question_id")
    i = table(spark, rng.normal(size=(60, 4)), "chunk_id")
    five, six = set(found(knn(q, i, 5, payload=()))), set(found(knn(q, i, 6, payload=())))
    assert five < six


def test_a_hot_group_of_copies_stays_exact(spark):
    index = [[1.0, 1.0]] * 400 + [[3.0, 0.0], [0.9, 1.0]]
    q, i = table(spark, [[1.0, 1.0]], "question_id"), table(spark, index, "chunk_id").repartition(3)
    assert found(knn(q, i, 3, payload=())) == [(0, 1, 0), (0, 2, 1), (0, 3, 2)]


def test_edges(spark):
    q = table(spark, [[1, 0]], "question_id")
    i = table(spark, [[1, 0], [0, 1]], "chunk_id")
    assert len(found(knn(q, i, 9, payload=()))) == 2
    assert found(knn(q, i.filter("chunk_id < 0"), 2, payload=())) == []
    assert found(knn(q.filter("question_id < 0"), i, 2, payload=())) == []
    missing = i.withColumn("embedding", F.when(F.col("chunk_id") == 1, F.col("embedding")))
    assert found(knn(q, missing, 5, payload=())) == [(0, 1, 1)]
    with pytest.raises(Exception, match="differ in length"):
        knn(table(spark, [[1, 2, 3]], "question_id"), i, 1, payload=()).collect()
    with pytest.raises(ValueError):
        knn(q, i, 0)
    with pytest.raises(ValueError):
        knn(q, i, 1, "manhattan")


def test_filter_comes_before_ranking_and_payload_follows(spark):
    i = table(spark, [[1, 0], [1, 1], [5, 5]], "chunk_id").withColumn(
        "client", F.when(F.col("chunk_id") == 0, "a").otherwise("b")
    )
    rows = knn(table(spark, [[1, 0]], "question_id"), i, 2, where={"client": "b"}).collect()
    assert sorted((r.chunk_id, r["rank"], r.client) for r in rows) == [(1, 1, "b"), (2, 2, "b")]


def test_a_table_searching_itself_skips_its_own_row(spark):
    v = table(spark, [[0, 0], [0, 0], [1, 0], [4, 0]], "chunk_id")
    q = v.withColumnRenamed("chunk_id", "question_id")
    got = found(knn(q, v, 1, exclude_same_id=True, payload=()))
    assert got == [(0, 1, 1), (1, 1, 0), (2, 1, 0), (3, 1, 2)]


def test_distance_columns(spark):
    df = spark.createDataFrame(
        [([1.0, 2.0], [3.0, 5.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>"
    )
    rows = df.select(l2sq("a", "b"), inner_product("a", "b"), cosine("a", "b")).collect()
    assert tuple(rows[0])[:2] == (13.0, 13.0)
    assert rows[0][2] == pytest.approx(13 / np.sqrt(5 * 34))
    assert tuple(rows[1]) == (1.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        vector_distance("a", "b", "nope")
    odd = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="differ in length"):
        odd.select(l2sq("a", "b")).collect()


def test_hashed_embedding(spark):
    df = spark.createDataFrame(
        [(0, "Tide tide, moon"), (1, None), (2, "..."), (3, "MOON tide TIDE")], "i int, text string"
    )
    got = {r.i: r.v for r in df.select("i", hashed_embedding(16)("text").alias("v")).collect()}
    assert got[1] is None and got[2] == [0.0] * 16
    assert got[0] == got[3] and len(got[0]) == 16
    assert sum(x * x for x in got[0]) == pytest.approx(1, abs=1e-6)


def test_model_embedding_checks_its_shape(spark):
    df = spark.createDataFrame([(0, "abc"), (1, None), (2, "de")], "i int, text string")
    good = model_embedding(lambda texts: np.array([[len(t), 1] for t in texts]), 2, batch_rows=1)
    got = {r.i: r.v for r in df.select("i", good("text").alias("v")).collect()}
    assert got == {0: [3.0, 1.0], 1: None, 2: [2.0, 1.0]}
    bad = model_embedding(lambda texts: np.zeros((len(texts), 3)), 2)
    with pytest.raises(Exception, match="expected"):
        df.select(bad("text")).collect()


def test_questions_are_embedded_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def encode(texts):
        calls.add(len(texts))
        return np.array([[len(t), 1.0] for t in texts])

    q = spark.createDataFrame([(0, "ab"), (1, "abcd")], "question_id long, question string")
    i = table(spark, [[2, 1], [4, 1]], "chunk_id")
    got = retrieve(q, i, model_embedding(encode, 2), 1, payload=())
    assert found(got) == [(0, 1, 0), (1, 1, 1)]
    assert calls.value == 2


def test_positional_documents(spark):
    df = spark.createDataFrame([(7, "body", "u", None, 0.5)], "q int, c string, url string, n int, s double")
    row = to_documents(df, keep=("q",)).first()
    assert (row.q, row.page_content, row.metadata, row.score) == (7, "body", {"url": "u", "n": None}, 0.5)
    assert content_only(to_documents(df, keep=("q",))).columns == ["page_content"]
    bare = to_documents(df.select("c", "s")).first()
    assert bare.metadata == {} and bare.score == 0.5


def test_response_documents(spark):
    body = {
        "manifest": {"columns": [{"name": "text"}, {"name": "url"}, {"name": "score"}]},
        "result": {"data_array": [["first", "u1", 0.9], ["second", None, 0.4]]},
    }
    df = spark.createDataFrame([(1, json.dumps(body))], "q int, r string")
    got = documents_from_responses(df, "r", ("q",)).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [
        (1, 1, "first", {"url": "u1"}, 0.9),
        (1, 2, "second", {"url": None}, 0.4),
    ]


def test_word_counts_do_not_depend_on_the_step():
    import pyarrow as pa

    from askloom.functions.vectors import _unit_counts, word_bucket

    texts = pa.array(["a b a", None, "", "c " * 40 + "d", "b"])
    whole, stepped = _unit_counts(texts, 8), _unit_counts(texts, 8, words_per_step=2)
    assert whole.to_pylist() == stepped.to_pylist()
    assert whole[1].as_py() is None and whole[2].as_py() == [0.0] * 8
    assert whole[4].as_py()[word_bucket("b", 8)] == 1.0


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 200])
def test_each_question_has_its_own_filter(spark, broadcast_bytes):
    rng = random.Random(5)
    tags = ["a"] * 60 + ["b", "c", "d", None] * 15
    index = [(i, rng.choice(tags), [rng.uniform(-1, 1) for _ in range(3)]) for i in range(120)]
    asked = [(i, w, [rng.uniform(-1, 1) for _ in range(3)]) for i, w in enumerate(["a", "b", None, "z", "c", "a", None, "b"])]
    got = nearest(
        spark.createDataFrame(asked, "question_id long, want string, embedding array<double>"),
        spark.createDataFrame(index, "chunk_id long, client string, embedding array<double>").repartition(4),
        4,
        match=("want", "client"),
        broadcast_bytes=broadcast_bytes,
    )
    want = {}
    for q, w, v in asked:
        seen = sorted((sum((x - y) ** 2 for x, y in zip(v, u)), i) for i, t, u in index if w is None or t == w)
        want |= {(q, rank + 1): i for rank, (_, i) in enumerate(seen[:4])}
    assert {(r.question_id, r["rank"]): r.chunk_id for r in got.collect()} == want
    assert not any(q == 3 for q, _ in want)


def test_wanted_values_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "index")
    spark.createDataFrame([(i, i % 7, [float(i)]) for i in range(70)], "chunk_id long, tag int, embedding array<double>").write.parquet(path)
    asked = spark.createDataFrame([(1, 3, [2.0]), (2, 5, [2.0])], "question_id long, want long, embedding array<double>")
    got = nearest(asked, spark.read.parquet(path), 1, match=("want", "tag"))
    assert {(r.question_id, r.chunk_id) for r in got.collect()} == {(1, 3), (2, 5)}
    assert "In(tag, [3,5])" in got._jdf.queryExecution().executedPlan().toString()


def test_questions_past_the_broadcast_size_do_not_reach_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(11)
    asked, index = rng.normal(size=(60, 4)), rng.normal(size=(90, 4))
    q, i = table(spark, asked, "question_id"), table(spark, index, "chunk_id")

    def refuse(self):
        raise AssertionError("questions came to the driver")

    monkeypatch.setattr(type(q), "toArrow", refuse)
    hits = nearest(q, i.union(i), 3, broadcast_bytes=200)
    assert found(hits) == brute(asked, index, 3, "l2sq")


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
@pytest.mark.parametrize("offset", [0, 1e4])
def test_a_bound_leaves_out_only_what_is_past_it(metric, offset):
    rng = np.random.default_rng(12)
    asked, block = offset + rng.normal(size=(300, 6)), offset + rng.normal(size=(5000, 6))
    ids = pa.array(np.arange(5000) // 2)
    free = [h for h in _search_block(asked, ids, block, 4, metric)]
    rows, dist = (np.concatenate([np.asarray(h[n]) for h in free]) for n in (0, 2))
    assert np.array_equal(rows, np.repeat(np.arange(300), 4))
    bound = dist.reshape(300, 4)[:, 2]
    near = [h for h in _search_block(asked, ids, block, 4, metric, bound)]
    held = {(int(r), i) for q, names, _ in near for r, i in zip(q, names.to_pylist())}
    first = {(int(r), i) for q, names, d in free for r, i, x in zip(q, names.to_pylist(), d) if x <= bound[r]}
    assert first <= held
    if metric == "l2sq":
        assert not list(_search_block(asked, ids, block + 100, 4, metric, np.full(300, 1.0)))


def test_a_block_of_any_length_takes_little_room():
    rng = np.random.default_rng(13)
    asked, block = rng.normal(size=(256, 16)), rng.normal(size=(60_000, 16))
    tracemalloc.start()
    hits = list(_search_block(asked, pa.array(np.arange(60_000)), block, 5, "l2sq"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(h[0]) for h in hits) == 256 * 5
    assert peak < 6 * block.nbytes  # the distances of all pairs alone are 16 times the block


def test_the_payload_of_a_few_winners_is_found_without_a_shuffle_of_the_index(spark):
    rng = np.random.default_rng(14)
    q = table(spark, rng.normal(size=(5, 4)), "question_id")
    i = table(spark, rng.normal(size=(90, 4)), "chunk_id").withColumn("text", F.lit("t"))
    found = knn(q, i, 3, payload=("text",))
    assert found.count() == 15
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
