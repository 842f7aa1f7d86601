import numpy as np
import pytest
from pyspark.sql import functions as F

from askloom.functions.vectors import hashed_embedding
from askloom.operators.lists import REST, build_lists, nearest_in_lists, open_lists, probe
from askloom.operators.retrieval import nearest

SCHEMA = "chunk_id long, text string, embedding array<double>"


def clustered(seed=0, clusters=12, each=40, dim=6, apart=10.0):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(clusters, dim)) * apart
    rows = [(c * each + i, "x", (centres[c] + random.normal(size=dim)).tolist()) for c in range(clusters) for i in range(each)]
    rows += [(10_000 + i, "copy", rows[5][2]) for i in range(200)]  # a third of the index is one vector
    return rows


def laid_out(spark, tmp_path, rows, **options):
    index = spark.createDataFrame(rows, SCHEMA).repartition(4)
    path = str(tmp_path / "lists")
    build_lists(index, path, **options)
    return index, open_lists(spark, path)


def asked(spark, vectors):
    return spark.createDataFrame(list(enumerate(vectors)), "question_id long, embedding array<double>").repartition(3)


def hits(df):
    return sorted((r.question_id, r["rank"], r.chunk_id, round(r.distance, 9)) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 2000])
def test_exact_search_skips_files_and_misses_nothing(spark, tmp_path, metric, broadcast_bytes):
    rows = clustered()
    index, lists = laid_out(spark, tmp_path, rows, lists=20, metric=metric)
    random = np.random.default_rng(1)
    vectors = [rows[i][2] for i in (0, 5, 50, 300)] + (np.array([r[2] for r in rows[:9:3]]) + random.normal(size=(3, 6))).tolist()
    found = nearest_in_lists(asked(spark, vectors), lists, 7, broadcast_bytes=broadcast_bytes)
    want = nearest(asked(spark, vectors), index, 7, metric)
    assert hits(found.hits) == hits(want)
    assert found.files_read < found.files


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e5])
def test_exact_search_without_clusters(spark, tmp_path, metric, scale):
    random = np.random.default_rng(2)
    rows = [(i, "x", v) for i, v in enumerate((random.normal(size=(300, 5)) * scale).tolist())]
    index, lists = laid_out(spark, tmp_path, rows, lists=16, metric=metric)
    vectors = (random.normal(size=(20, 5)) * scale).tolist()
    found = nearest_in_lists(asked(spark, vectors), lists, 5, probes=2)
    assert hits(found.hits) == hits(nearest(asked(spark, vectors), index, 5, metric))
    every = probe(asked(spark, vectors), lists, 5, probes=16)
    assert hits(every.hits) == hits(found.hits)


def test_rows_and_questions_without_a_place(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = clustered(each=10) + [(20_000, "null", None), (20_001, "nan", [nan] * 6), (20_002, "inf", [inf] + [0.0] * 5), (20_003, "zero", [0.0] * 6)]
    rows += [rows[3], rows[3]]  # a key that is there three times is one neighbour
    for metric in ("l2sq", "cosine"):
        (tmp_path / metric).mkdir()
        index, lists = laid_out(spark, tmp_path / metric, rows, lists=12, metric=metric)
        assert lists.rows.count() == len(rows) and REST in lists.n_files
        vectors = [rows[3][2], [0.0] * 6, [nan] * 6, rows[40][2]]
        k = 330 if metric == "l2sq" else 9  # more than any list, so that every row has its place
        found = nearest_in_lists(asked(spark, vectors), lists, k)
        want = nearest(asked(spark, vectors), index, k, metric)
        assert str(hits(found.hits)) == str(hits(want))


def test_small_and_empty_indexes(spark, tmp_path):
    for name, rows in {"empty": [], "null": [(1, "x", None)], "one": [(1, "x", [1.0, 2.0])]}.items():
        (tmp_path / name).mkdir()
        _, lists = laid_out(spark, tmp_path / name, rows, lists=8)
        found = nearest_in_lists(asked(spark, [[1.0, 2.0]]), lists, 3)
        assert [r.chunk_id for r in found.hits.collect()] == ([1] if name == "one" else [])
        assert nearest_in_lists(asked(spark, [[1.0, 2.0]]).limit(0), lists, 3).hits.collect() == []
    with pytest.raises(ValueError):
        probe(asked(spark, [[1.0]]), lists, 1)
    with pytest.raises(ValueError):
        build_lists(spark.createDataFrame([], SCHEMA), str(tmp_path / "ip"), metric="ip")


def test_recall_of_probes_on_real_texts(spark, tmp_path):
    """Against the exact search, at sf0.01: chunks of documents, asked for by passages and by chunks."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    embedder = hashed_embedding(64)
    index = docs.select(F.col("doc_id").alias("chunk_id"), "text", embedder("text").alias("embedding"))
    path = str(tmp_path / "lists")
    build_lists(index, path, lists=32)
    lists = open_lists(spark, path)
    questions = docs.where("doc_id % 7 = 0").select(F.col("doc_id").alias("question_id"), embedder("text").alias("embedding"))
    want = {(r.question_id, r.chunk_id) for r in nearest(questions, lists.rows, 5).collect()}
    found = probe(questions, lists, 5, probes=8)
    got = {(r.question_id, r.chunk_id) for r in found.hits.collect()}
    print("recall", len(got & want) / len(want), found.files_read, found.files)
    assert len(got & want) / len(want) >= 0.9
