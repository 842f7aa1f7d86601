import itertools

import pytest
from pyspark.sql import functions as F

from askloom.functions.vectors import hashed_embedding
from askloom.operators.chunking import chunk_documents
from askloom.operators.index import apply_changes
from askloom.streaming.sync import build_incremental, current_index, sync_stream

SCHEMA = "doc_id long, op string, version long, text string"
ROWS = [
    [(1, "insert", 1, "a b c d e"), (2, "insert", 1, "f g"), (3, "insert", 1, "h")],
    [(1, "update", 2, "a b"), (2, "delete", 3, None), (9, "delete", 1, None)],
    [(2, "update", 2, "late and stale"), (4, "insert", 1, "i j k l"), (3, "update", 2, "")],
]


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "changes")

    def add(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)

    return path, add


def state(spark, path):
    rows = current_index(spark.read.parquet(path)).collect()
    return sorted((r.doc_id, r.version, r.chunk_id, r.text) for r in rows)


def run(spark, source, out):
    schema = spark.createDataFrame([], SCHEMA).schema
    options = {"size": 3, "overlap": 1, "embedder": hashed_embedding(8), "max_files_per_trigger": 1}
    query = sync_stream(spark, source, schema, f"{out}/index", f"{out}/checkpoint", **options)
    query.awaitTermination()
    return query


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[::2])
def test_stream_equals_batch_in_any_order(spark, source, tmp_path, order):
    path, add = source
    for i in order:
        add(ROWS[i])
    run(spark, path, tmp_path)
    empty = spark.createDataFrame([], "doc_id long, version long, text string")
    flat = [r for rows in ROWS for r in rows]
    batch = apply_changes(empty, spark.createDataFrame(flat, SCHEMA))
    want = chunk_documents(batch, size=3, overlap=1).select("doc_id", "version", "chunk_id", "text")
    assert state(spark, f"{tmp_path}/index") == sorted(map(tuple, want.collect()))


def test_second_run_picks_up_only_new_files(spark, source, tmp_path):
    path, add = source
    add(ROWS[0])
    run(spark, path, tmp_path)
    before = spark.read.parquet(f"{tmp_path}/index").count()
    run(spark, path, tmp_path)
    assert spark.read.parquet(f"{tmp_path}/index").count() == before
    add(ROWS[1])
    query = run(spark, path, tmp_path)
    assert sum(p["numInputRows"] for p in query.recentProgress) == 3
    assert [r[:2] for r in state(spark, f"{tmp_path}/index")] == [(1, 2), (3, 1)]


def test_a_change_delivered_twice_counts_once(spark, source, tmp_path):
    path, add = source
    add(ROWS[0])
    add(ROWS[0])
    run(spark, path, tmp_path)
    assert len(state(spark, f"{tmp_path}/index")) == 5


def test_incremental_build(spark, tmp_path):
    chunks = spark.range(10).select(F.col("id").cast("string").alias("chunk_id"), F.lit("a b").alias("text"))
    folder, out = str(tmp_path / "chunks"), str(tmp_path / "index")

    def build():
        query = build_incremental(
            spark, folder, chunks.schema, out, str(tmp_path / "c"),
            embedder=hashed_embedding(8), max_files_per_trigger=1,
        )
        query.awaitTermination()
        return query

    chunks.repartition(3).write.parquet(folder)
    assert len([p for p in build().recentProgress if p["numInputRows"]]) == 3
    chunks.withColumn("chunk_id", F.concat(F.lit("n"), "chunk_id")).write.mode("append").parquet(folder)
    build()
    rows = spark.read.parquet(out)
    assert rows.count() == 20 and rows.select("chunk_id").distinct().count() == 20
    assert rows.filter(F.size("embedding") == 8).count() == 20


def test_two_changes_under_one_version_settle_as_in_batch(spark, source, tmp_path):
    path, add = source
    rows = [(1, "insert", 1, t) for t in ("a b c d", "x y", "p q r s t")]
    for row in rows:
        add([row])
    run(spark, path, tmp_path)
    empty = spark.createDataFrame([], "doc_id long, version long, text string")
    batch = apply_changes(empty, spark.createDataFrame(rows, SCHEMA))
    want = chunk_documents(batch, size=3, overlap=1).select("doc_id", "version", "chunk_id", "text")
    assert state(spark, f"{tmp_path}/index") == sorted(map(tuple, want.collect()))
