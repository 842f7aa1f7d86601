import datetime as dt

import pytest
from pyspark.sql import functions as F

from askloom.operators import tables
from askloom.operators.index import append_index, apply_changes, latest_per_key, merge_index
from askloom.operators.retrieval import knn
from askloom.operators.tables import (
    batches,
    count_rows,
    date_window,
    head,
    longest,
    number_rows,
    page,
    snapshot,
    split_scripts,
)
from askloom.session import materialize, shared_dir
from askloom.sources import documents as docs
from askloom.sources import index_store


@pytest.mark.parametrize("n", [0, 499, 500, 501, 1203])
def test_batches_partition_the_rows(spark, n):
    df = spark.range(n).select((F.col("id") * 37 % 1009 * 10_000 + F.col("id")).alias("k")).repartition(7)
    keys = sorted(r.k for r in df.collect())
    got = {r.k: (r.row_no, r.batch_no) for r in batches(df, keys=("k",)).collect()}
    assert got == {k: (i + 1, i // 500) for i, k in enumerate(keys)}
    full = {r.k for r in batches(df, keys=("k",), full_only=True).collect()}
    assert full == set(keys[: n // 500 * 500])


def test_numbering_with_two_keys(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("a"), F.col("id").alias("b"))
    got = number_rows(df, ("a", "b")).orderBy("row_no").collect()
    assert [(r.a, r.b) for r in got] == sorted((i % 3, i) for i in range(300))
    assert [r.row_no for r in got] == list(range(1, 301))


def test_pages_skip_after_the_limit(spark):
    df = spark.range(100).repartition(5)
    assert sorted(r.id for r in page(df, 90, 85, ("id",)).collect()) == [85, 86, 87, 88, 89]
    assert page(df, 5, 10, ("id",)).collect() == []
    assert [r.id for r in head(df, 3, ("id",)).collect()] == [0, 1, 2]


def test_longest_and_count(spark):
    df = spark.createDataFrame([(3, "abc"), (1, "xyz"), (2, None), (4, "a")], "doc_id int, text string")
    assert longest(df).first().doc_id == 1
    assert count_rows(df).first().n_rows == 4
    assert longest(df.filter("doc_id > 9")).collect() == []


def events(spark, kind):
    days = [dt.datetime(2024, 1, d, h) for d in range(1, 12) for h in (0, 23)]
    df = spark.createDataFrame([(d.isoformat(" "),) for d in days], "t string")
    return df.select(F.col("t").cast(kind).alias("ts"))


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date"])
def test_date_windows(spark, kind):
    df = events(spark, kind)
    kept = date_window(df, "ts", "2024-01-10", lookback=2).select(F.dayofmonth("ts").alias("d"))
    assert sorted(r.d for r in kept.collect()) == [7, 7, 8, 8, 9, 9]
    day = snapshot(df, "ts", dt.date(2024, 1, 10)).select(F.dayofmonth("ts").alias("d"))
    assert [r.d for r in day.collect()] == [9, 9]


def test_date_window_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "e")
    events(spark, "timestamp_ntz").write.parquet(path)
    plan = date_window(spark.read.parquet(path), "ts", "2024-01-10")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts,2024-01-08" in plan and "LessThan(ts,2024-01-10" in plan


def test_script_rows(spark):
    df = spark.createDataFrame([(1, "a;b"), (2, " "), (3, None)], "id int, s string")
    assert [tuple(r) for r in split_scripts(df, "s", ("id",)).collect()] == [(1, 0, "a;"), (1, 1, "b;")]


INDEX = "doc_id int, version int, text string"
CHANGE = "doc_id int, version int, text string, op string"


def test_append_doubles_and_merge_does_not(spark):
    a = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], INDEX)
    assert append_index(a, a).count() == 4
    b = spark.createDataFrame([(2, 2, "B"), (1, 0, "old"), (3, 1, "c")], INDEX)
    once = merge_index(a, b, "doc_id")
    want = [(1, 1, "a"), (2, 2, "B"), (3, 1, "c")]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, merge_index(once, b, "doc_id").collect())) == want
    same = spark.createDataFrame([(1, 1, "second")], INDEX)
    assert merge_index(a, same, "doc_id").filter("doc_id = 1").first().text == "second"


def test_equal_versions_settle_the_same_way(spark):
    rows = [(1, 1, t) for t in "abcdef"]
    one = latest_per_key(spark.createDataFrame(rows, INDEX).repartition(3), "doc_id", "version").first()
    two = latest_per_key(spark.createDataFrame(rows[::-1], INDEX), "doc_id", "version").first()
    assert one == two


def test_changes(spark):
    index = spark.createDataFrame([(1, 5, "a"), (2, 1, "b"), (3, 1, "c"), (4, 9, "d")], INDEX)
    changes = spark.createDataFrame(
        [
            (1, 6, "A6", "update"),
            (1, 7, "A7", "update"),
            (2, 2, None, "delete"),
            (4, 8, "stale", "update"),
            (5, 1, "new", "insert"),
            (6, 1, None, "delete"),
            (7, 3, None, "delete"),
            (7, 2, "gone", "insert"),
        ],
        CHANGE,
    )
    want = [(1, 7, "A7"), (3, 1, "c"), (4, 9, "d"), (5, 1, "new")]
    once = apply_changes(index, changes)
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, apply_changes(once, changes).collect())) == want


def test_index_store(spark, tmp_path):
    path = str(tmp_path / "index")
    schema = "chunk_id int, embedding array<float>, kind string"
    df = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, None, "b")], schema)
    index_store.save_index(df, path, partition_by="kind")
    with pytest.raises(Exception, match="already exists"):
        index_store.save_index(df, path)
    index_store.save_index(df.limit(1), path, reset=True)
    assert index_store.load_index(spark, path, df.schema).count() == 1
    assert tuple(index_store.describe_index(df).first()) == (2, 2, 2, 1)
    assert index_store.index_size(df).first().n_rows == 2


def test_filtered_search_reads_only_its_folders(spark, tmp_path):
    path = str(tmp_path / "index")
    schema = "chunk_id long, embedding array<float>, kind string"
    rows = [(i, [float(i), 1.0], "ab"[i % 2]) for i in range(20)]
    index_store.save_index(spark.createDataFrame(rows, schema), path, partition_by="kind")
    asked = spark.createDataFrame([(0, [6.2, 1.0])], "question_id long, embedding array<float>")
    hits = knn(asked, index_store.load_index(spark, path), 2, where={"kind": "b"}, payload=())
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan
    assert "ReadSchema: struct<chunk_id:bigint,embedding:array<float>>" in plan
    assert [r.chunk_id for r in hits.orderBy("rank").collect()] == [7, 5]


def test_json_documents_keep_unreadable_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n  "text": "x",\n  "source": "u"\n}\n')
    (tmp_path / "b.json").write_text("{ broken")
    schema = spark.createDataFrame([], "text string, source string").schema
    rows = docs.load_json(spark, str(tmp_path), schema).orderBy("text").collect()
    assert rows[1][:2] == ("x", "u") and rows[1][2] is None
    assert rows[0][0] is None and "broken" in rows[0][2]


def test_saved_table_is_replaced_with_its_schema(spark, tmp_path):
    path = str(tmp_path / "sources")
    docs.save_table(spark.range(3), path)
    docs.save_table(spark.createDataFrame([("x",)], "text string"), path)
    assert docs.scan(spark, path).columns == ["text"]
    assert docs.all_columns(docs.scan(spark, path)).first().text == "x"
    docs.use_database(spark, "shelf")
    docs.save_table(spark.range(2), "things", as_table=True)
    assert docs.select_fields(docs.scan(spark, "shelf.things"), ["id + 1 AS n"]).count() == 2
    spark.catalog.setCurrentDatabase("default")


def test_eval_set_round_trip(spark, tmp_path):
    path = str(tmp_path / "eval")
    rows = [('a "b"\tc\nd', " x ", None), ("NA", "n/a here", "u")]
    docs.save_eval(spark.createDataFrame(rows, docs.EVAL_SCHEMA), path)
    got = sorted(map(tuple, docs.load_eval(spark, path).collect()), key=str)
    assert got == sorted([rows[0], (None, "n/a here", "u")], key=str)


def test_small_scans_are_spread_and_large_ones_left(spark):
    few, many = spark.range(0, 100, 1, 1), spark.range(0, 100, 1, 9)
    assert docs.spread(few, 4).rdd.getNumPartitions() == 4
    assert docs.spread(many, 4) is many


def test_scratch_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or shared_dir(spark) == configured.rstrip("/")
    stored = materialize(spark.range(5), "t")
    assert stored.count() == 5
    assert all(shared_dir(spark) in f for f in stored.inputFiles())
