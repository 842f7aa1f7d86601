import random

import pytest
from pyspark.sql import functions as F

from askloom.operators.index import apply_changes
from askloom.operators.snapshots import differing_buckets, save_snapshot, snapshot_changes

SCHEMA = "doc_id long, text string, tags map<string,string>, n int"


def feed(spark, tmp_path, before, after, schema=SCHEMA, buckets=16, **options):
    paths = [str(tmp_path / name) for name in ("before", "after")]
    for rows, path in zip((before, after), paths):
        save_snapshot(spark.createDataFrame(rows, schema).repartition(3), path, buckets=buckets)
    return paths, snapshot_changes(spark, *paths, **options)


def test_changes_lead_to_the_second_snapshot(spark, tmp_path):
    rng = random.Random(1)
    before = {i: (i, f"text {i}" if i % 9 else None, {"a": str(i)} if i % 4 else None, i if i % 5 else None) for i in range(200)}
    after = dict(before)
    for i in rng.sample(range(200), 60):
        kind = rng.randrange(4)
        if kind == 0:
            del after[i]
        else:
            after[i] = [None, (i, "edited", before[i][2], before[i][3]), (i, before[i][1], {"a": "b"}, before[i][3]), (i, before[i][1], before[i][2], -1)][kind]
    after |= {1000 + i: (1000 + i, "new", None, None) for i in range(15)}
    _, changes = feed(spark, tmp_path, list(before.values()), list(after.values()), version=7)
    rows = changes.collect()
    assert {(r.doc_id, r.op) for r in rows} == (
        {(i, "delete") for i in before if i not in after}
        | {(i, "insert") for i in after if i not in before}
        | {(i, "update") for i in after if i in before and after[i] != before[i]}
    )
    assert all(r.version == 7 and (r.op != "delete" or (r.text, r.tags, r.n) == (None, None, None)) for r in rows)
    held = spark.createDataFrame([(*r, 1) for r in before.values()], SCHEMA + ", version long")
    synced = apply_changes(held, changes).collect()
    assert {r.doc_id: (r.doc_id, r.text, r.tags, r.n) for r in synced} == after and len(synced) == len(after)


def test_equal_buckets_are_not_read_again(spark, tmp_path):
    before = [(i, f"t{i}", None, 0) for i in range(300)]
    after = [r if r[0] != 17 else (17, "other", None, 0) for r in before]
    paths, changes = feed(spark, tmp_path, before, after)
    assert [(r.doc_id, r.op) for r in changes.collect()] == [(17, "update")]
    differing = [r[0] for r in differing_buckets(spark, *paths).collect()]
    assert len(differing) == 1
    # The rows come from one bucket's folder, by partition filters.
    plan = changes._jdf.queryExecution().executedPlan().toString()
    read = spark.read.parquet(f"{paths[1]}/rows").where(F.col("__bucket").isin(differing))
    assert read.count() < 60
    scans = [line for line in plan.splitlines() if "FileScan" in line and "__bucket" in line]
    assert scans and all("PartitionFilters: [" in x and "PartitionFilters: []" not in x for x in scans)


def test_equal_snapshots_and_empty_ones(spark, tmp_path):
    rows = [(1, "a", None, 1), (2, None, {}, None)]
    for name, (before, after, ops) in {
        "same": (rows, rows[::-1], []),
        "first": ([], rows, ["insert", "insert"]),
        "last": (rows, [], ["delete", "delete"]),
        "none": ([], [], []),
    }.items():
        (tmp_path / name).mkdir()
        _, changes = feed(spark, tmp_path / name, before, after)
        assert sorted(r.op for r in changes.collect()) == ops, name


def test_repeated_keys_and_rows_without_one(spark, tmp_path):
    before = [(1, "a", None, 0), (1, "a", None, 0), (2, "b", None, 0), (2, "c", None, 0), (None, "x", None, 0)]
    after = [(1, "a", None, 0), (2, "c", None, 0), (2, "b", None, 0), (None, "y", None, 0), (3, "n", None, 0), (3, "n", None, 0)]
    _, changes = feed(spark, tmp_path, before, after)
    assert [(r.doc_id, r.op, r.text) for r in changes.collect()] == [(3, "insert", "n")]


def test_pairs_that_do_not_fit_raise(spark, tmp_path):
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    save_snapshot(one, str(tmp_path / "a"), buckets=4)
    save_snapshot(one, str(tmp_path / "b"), buckets=8)
    save_snapshot(one.withColumn("more", F.lit(1)), str(tmp_path / "c"), buckets=4)
    with pytest.raises(ValueError):
        snapshot_changes(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    with pytest.raises(ValueError):
        snapshot_changes(spark, str(tmp_path / "a"), str(tmp_path / "c"))
