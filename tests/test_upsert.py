import itertools

import pyarrow.parquet as pq
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from askloom.functions.vectors import hashed_embedding
from askloom.operators.chunking import chunk_documents
from askloom.operators.index import apply_changes
from askloom.session import materialize
from askloom.streaming import upsert
from askloom.streaming.sync import current_index, sync_stream

SCHEMA = "doc_id long, op string, version long, text string"
ROWS = [
    [(1, "insert", 1, "a b c d e"), (2, "insert", 1, "f g"), (3, "insert", 1, "h")],
    [(1, "update", 2, "a b"), (2, "delete", 3, None), (9, "delete", 1, None), (None, "insert", 1, "no key")],
    [(2, "update", 2, "late and stale"), (4, "insert", 1, "i j k l"), (3, "update", 2, ""), (1, None, 2, "a b")],
]


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "changes")

    def add(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)

    return path, add


def counting(spark):
    """An embedder and the number of texts that it has been asked for."""
    calls = spark.sparkContext.accumulator(0)
    plain = hashed_embedding(8)

    def seen(text):
        calls.add(1)
        return text

    seen_column = F.udf(seen, "string").asNondeterministic()
    return calls, lambda text: plain(seen_column(F.col(text) if isinstance(text, str) else text))


def follow(spark, source, out, stream=upsert.upsert_stream, embedder=None, **options):
    schema = spark.createDataFrame([], SCHEMA).schema
    options = {"size": 3, "overlap": 1, "embedder": embedder or hashed_embedding(8), "max_files_per_trigger": 1} | options
    stream(spark, source, schema, f"{out}/index", f"{out}/checkpoint", **options).awaitTermination()


def state(df):
    return sorted((r.doc_id, r.version, r.chunk_id, r.text) for r in df.collect())


def batch_state(spark, rows):
    empty = spark.createDataFrame([], "doc_id long, version long, text string")
    known = [r for r in rows if r[0] is not None]
    batch = apply_changes(empty, spark.createDataFrame(known, SCHEMA))
    return state(chunk_documents(batch, size=3, overlap=1))


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[::2])
def test_upserts_equal_the_batch_in_any_order(spark, source, tmp_path, order):
    path, add = source
    for i in order:
        add(ROWS[i])
    follow(spark, path, tmp_path, buckets=4)
    table = f"{tmp_path}/index"
    assert state(upsert.read_upserted(spark, table)) == batch_state(spark, sum(ROWS, []))
    assert upsert.published(spark, table).batches == {f"{tmp_path}/checkpoint": 2}
    follow(spark, path, tmp_path, buckets=4)  # nothing new
    assert upsert.published(spark, table).sequence == 2


@pytest.mark.parametrize("late", [False, True])
def test_a_batch_that_fails_and_is_repeated_counts_once(spark, source, tmp_path, monkeypatch, late):
    """The failure comes before the batch is published, or after that and before the stream knows."""
    path, add = source
    add(ROWS[0])
    follow(spark, path, tmp_path, buckets=4)
    table, plain = f"{tmp_path}/index", upsert.publish
    before = state(upsert.read_upserted(spark, table))

    def failing(*args):
        if late:
            plain(*args)
        raise OSError("lost")

    add(ROWS[1])
    with monkeypatch.context() as patch:
        patch.setattr(upsert, "publish", failing)
        with pytest.raises(StreamingQueryException):
            follow(spark, path, tmp_path, buckets=4)
    after = batch_state(spark, ROWS[0] + ROWS[1])
    assert state(upsert.read_upserted(spark, table)) == (after if late else before)
    follow(spark, path, tmp_path, buckets=4)
    assert state(upsert.read_upserted(spark, table)) == after
    assert upsert.published(spark, table).sequence == 1


def test_only_touched_buckets_are_written_and_only_newer_changes_embedded(spark, tmp_path):
    calls, embedder = counting(spark)
    table = str(tmp_path / "table")

    def merge(rows, batch_id, stream="s"):
        def rows_of(changes):
            return upsert.index_changes(changes, size=3, overlap=1, embedder=embedder)

        return upsert.upsert_batch(spark.createDataFrame(rows, SCHEMA), batch_id, table, rows_of, stream=stream, buckets=8)

    first = [(i, "insert", 1, f"text of {i}") for i in range(40)]
    assert merge(first, 0)
    assert calls.value == 80  # two chunks each
    folders = upsert.published(spark, table).folders
    assert merge([(5, "update", 2, "new text"), *first[6:20]], 1)
    assert calls.value == 81  # redelivered changes are not newer
    now = upsert.published(spark, table).folders
    assert sum(now[b] != folders[b] for b in now) == 1
    assert not merge(first, 1) and merge(first, 0, "another stream")
    assert calls.value == 81
    assert state(upsert.read_upserted(spark, table)) == batch_state(spark, [*first, (5, "update", 2, "new text")])
    assert merge([(7, "delete", 9, None)], 2) and merge([(7, "update", 8, "too late")], 3)
    assert 7 not in {r.doc_id for r in upsert.read_upserted(spark, table).collect()}


def test_nothing_but_empty_batches(spark, tmp_path):
    table = str(tmp_path / "table")
    none = spark.createDataFrame([], SCHEMA)
    assert upsert.upsert_batch(none, 0, table, upsert.index_changes)
    with pytest.raises(ValueError):
        upsert.read_upserted(spark, table)
    assert upsert.upsert_batch(spark.createDataFrame(ROWS[0], SCHEMA), 1, table, upsert.index_changes)
    assert upsert.upsert_batch(none, 2, table, upsert.index_changes)
    assert upsert.read_upserted(spark, table).count() == 3


def fresh(spark, path, out, embedder=None):
    follow(spark, path, out, sync_stream, embedder, fresh_only=True)
    log = current_index(spark.read.parquet(f"{out}/index"))
    return sorted((r.doc_id, r.chunk_id, r.text) for r in log.collect())


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[1::2])
def test_fresh_changes_equal_the_batch_in_any_order(spark, source, tmp_path, order):
    path, add = source
    for i in order:
        add(ROWS[i])
    want = [(r[0], *r[2:]) for r in batch_state(spark, sum(ROWS, []))]
    assert fresh(spark, path, tmp_path) == want


def test_each_content_is_embedded_once_and_a_restart_keeps_the_state(spark, source, tmp_path):
    calls, embedder = counting(spark)
    path, add = source
    add(ROWS[0])
    fresh(spark, path, tmp_path, embedder)
    assert calls.value == 5  # chunks of three documents
    add(ROWS[0])  # redelivered
    add([(1, "update", 5, "a b c d e"), (2, None, 5, "f g"), (3, "insert", 0, "stale")])  # unchanged, unchanged, stale
    fresh(spark, path, tmp_path, embedder)
    assert calls.value == 5
    add([(1, "update", 4, "older than what is known"), (2, "update", 6, "changed"), (3, "delete", 2, None), (3, "delete", 3, "x")])
    got = fresh(spark, path, tmp_path, embedder)
    assert calls.value == 5 + 2  # one text and one marker row
    assert got == [(1, "1-0", "a b c"), (1, "1-1", "c d e"), (1, "1-2", "e"), (2, "2-0", "changed")]


def test_fresh_changes_of_one_batch_and_without_keys(spark, source, tmp_path):
    path, add = source
    add([(1, "insert", v, f"t{v}") for v in range(50)] + [(None, "insert", 1, "x"), (2, "insert", None, "y"), (3, "delete", 1, None)])
    assert fresh(spark, path, tmp_path) == [(1, "1-0", "t49")]
    log = spark.read.parquet(f"{tmp_path}/index").collect()
    assert sorted((r.doc_id, r.op, r.version) for r in log) == [(1, "insert", 49), (3, "delete", 1)]


def test_fresh_changes_hold_their_state_by_bucket(spark, tmp_path):
    path, schema = str(tmp_path / "many"), spark.createDataFrame([], SCHEMA).schema
    made = spark.range(1500).select(F.col("id").alias("doc_id"), F.lit("insert").alias("op"), F.lit(1).cast("long").alias("version"))
    made.withColumn("text", F.concat(F.lit("t"), "doc_id")).coalesce(1).write.parquet(path)
    options = {"size": 3, "overlap": 1, "embedder": hashed_embedding(8), "fresh_only": True}
    stream = sync_stream(spark, path, schema, str(tmp_path / "index"), str(tmp_path / "checkpoint"), **options)
    stream.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "index")).select("doc_id").distinct().count() == 1500
    # One call of Python and one state for a bucket, not for a key.
    assert stream.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1024


def test_a_batch_stores_its_changes_once_and_the_log_is_packed(spark, source, tmp_path, monkeypatch):
    path, add = source
    stored = []

    def counted(df, name="table"):
        stored.append(name)
        return materialize(df, name)

    monkeypatch.setattr(upsert, "materialize", counted)
    for rows in ROWS:
        add(rows)
    follow(spark, path, tmp_path / "table")
    assert len(stored) == len(ROWS)
    follow(spark, path, tmp_path / "log", sync_stream)
    files = list((tmp_path / "log" / "index").glob("*.parquet"))
    assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files if pq.ParquetFile(f).num_row_groups} == {"ZSTD"}
