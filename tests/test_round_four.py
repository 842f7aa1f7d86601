import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from askloom.functions.vectors import hashed_embedding
from askloom.operators.chunking import chunk_documents
from askloom.operators.index import apply_changes
from askloom.plans import queries as plans
from askloom.plans.queries import QUERIES
from askloom.session import shared_dir
from askloom.streaming import sync, upsert

SCHEMA = "doc_id long, op string, version long, text string"


@pytest.fixture
def documents(spark, tmp_path):
    """A folder with sixty documents of a few words."""
    made = spark.range(60).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("text of "), "id").alias("text"),
        F.lit("en").alias("lang"),
        F.lit("src").alias("source"),
    )
    made.withColumn("n_chars", F.length("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def watch(monkeypatch, module, name) -> list:
    """The streams that ``module.name`` starts from now on."""
    started, plain = [], getattr(module, name)

    def start(*args, **options):
        started.append(plain(*args, **options))
        return started[-1]

    monkeypatch.setattr(module, name, start)
    return started


def batches(streams) -> list[int]:
    return [p["numInputRows"] for stream in streams for p in stream.recentProgress if p["numInputRows"]]


@pytest.mark.parametrize("files", [3, 16, 40])
def test_incremental_build_reads_its_input_in_two_batches(spark, documents, monkeypatch, files):
    started = watch(monkeypatch, sync, "build_incremental")
    monkeypatch.setattr(plans, "FILES", files)
    rows = QUERIES["incremental_index_build"](spark, documents).collect()
    assert sorted(r.chunk_id for r in rows) == sorted(f"{i}-0" for i in range(60))
    assert {r.source for r in rows} == {"src"} and all(r.n_used_dims > 0 for r in rows)
    assert len(batches(started)) == 2 and sum(batches(started)) == 60


def test_followed_streams_read_their_input_in_two_batches(spark, documents, monkeypatch):
    """However many files the input has: each batch writes the buckets it touches anew."""
    started = watch(monkeypatch, upsert, "upsert_stream")
    many = spark.read.parquet(f"{documents}/documents.parquet").repartition(30)
    many.write.parquet(f"{documents}/many/documents.parquet")
    monkeypatch.setattr(plans, "FILES", 4)
    rows = QUERIES["stream_index_upsert"](spark, f"{documents}/many").collect()
    assert len(batches(started)) == 2
    edited = {1: " edit two", 2: " edit three", 4: "", 5: "", 6: "", 7: "", 8: "", 9: ""}
    want = [(i, f"text of {i}{edited[i % 10]}") for i in range(60) if i % 10 in edited]
    want += [(-i, f"text of {i} new") for i in range(5, 60, 10)]
    assert sorted((r.doc_id, r.text) for r in rows) == sorted(want)


def merge(spark, rows, batch_id, table, **options):
    def rows_of(changes):
        return upsert.index_changes(changes, size=3, overlap=1, embedder=hashed_embedding(8))

    return upsert.upsert_batch(spark.createDataFrame(rows, SCHEMA), batch_id, table, rows_of, **options)


def held(spark, table):
    return sorted((r.doc_id, r.version, r.chunk_id, r.text) for r in upsert.read_upserted(spark, table).collect())


def stored_once(spark, rows):
    empty = spark.createDataFrame([], "doc_id long, version long, text string")
    known = [r for r in rows if r[0] is not None]
    docs = apply_changes(empty, spark.createDataFrame(known, SCHEMA))
    made = chunk_documents(docs, size=3, overlap=1).collect()
    return sorted((r.doc_id, r.version, r.chunk_id, r.text) for r in made)


LOTS = [
    [(i % 7, "insert", i % 5, f"text no {i} of many") for i in range(200)] + [(50 + i, "insert", 1, f"t {i}") for i in range(30)],
    [(3, "update", 9, "the same again and again")] * 40 + [(55, "delete", 3, None), (None, "insert", 1, "x"), (4, "update", 4, "tie")],
    [(i, "update", v, f"v {v} of {i}") for i in (1, 3, 55, 60, 90) for v in (None, 0, 2, 8)] + [(60, "update", 8, "another eight")],
]


@pytest.mark.parametrize(
    "limits",
    [{"CROWD": 3}, {"KEYS": 2}, {"FILES": 0}, {"CROWD": 3, "KEYS": 5, "FILES": 0, "WRITERS": 0}],
    ids=str,
)
def test_upserts_past_each_limit_equal_the_batch(spark, tmp_path, monkeypatch, limits):
    """Crowded keys, several groups of buckets, buckets of small files."""
    for name, value in limits.items():
        monkeypatch.setattr(upsert, name, value)
    table = str(tmp_path / "table")
    for i, rows in enumerate(LOTS):
        assert merge(spark, rows, i, table, buckets=6)
        assert held(spark, table) == stored_once(spark, sum(LOTS[: i + 1], []))


def test_a_batch_leaves_no_shuffle_and_no_copy_of_its_changes(spark, tmp_path):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    spark._jvm.System.gc()
    time.sleep(2)
    before, table = disk.getAllFiles().size(), str(tmp_path / "table")
    stored = set(Path(shared_dir(spark)).glob("*/newer-*"))
    conf = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    for i, rows in enumerate(LOTS):
        merge(spark, rows, i, table, buckets=6)
    until = time.time() + 10
    while disk.getAllFiles().size() > before and time.time() < until:
        time.sleep(0.2)
    assert disk.getAllFiles().size() <= before
    assert set(Path(shared_dir(spark)).glob("*/newer-*")) <= stored
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == conf


def test_small_files_of_a_bucket_are_gathered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(upsert, "FILES", 3)
    table, most = str(tmp_path / "table"), 0
    for i in range(8):
        merge(spark, [(k, "update", i, f"v {i}") for k in range(i * 5, i * 5 + 5)], i, table, buckets=1)
        folder = upsert.published(spark, table).folders[0]
        most = max(most, len(list(Path(f"{folder}/__bucket=0").glob("*.parquet"))))
    assert most <= 8 and len(held(spark, table)) == 40
