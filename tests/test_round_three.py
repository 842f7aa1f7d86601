import os
import random
import re
import tracemalloc
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from askloom.functions.retry import in_lanes, paced
from askloom.functions.text import expand_abbreviations
from askloom.functions.vectors import model_embedding
from askloom.operators.abbreviations import expand_from_table
from askloom.operators.chunking import chunk_documents, chunk_table, stream_windows
from askloom.operators.embedding import embed
from askloom.operators.index import apply_changes
from askloom.sources import bucketed_index

SEVEN = {"RPM": "revolutions", "mph": "miles an hour", "A/C": "cooling", "W.H.O": "health", "ΣΟΣ": "help", "é1": "x$1", "to do": "\\t"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pairs_of(spark, pairs):
    return spark.createDataFrame(list(pairs), "short string, full string")


def test_expand_from_table_equals_the_fold(spark):
    rng = random.Random(1)
    bits = [*SEVEN, "rpm", "σος", "σοΣ", "É1", "a/C", "TO DO", "ſ", "İ", "ß", " ", " ", ".", "_", "-", "é", "́", "9", "\n", "x"]
    texts = [None, "", " ", *("".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(600))]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id int, text string, short string")
    pairs = pairs_of(spark, [*SEVEN.items(), (None, "x"), ("", "x"), ("rpm", None)])
    want = {r.doc_id: r.t for r in df.select("doc_id", expand_abbreviations("text", SEVEN).alias("t")).collect()}
    for group_bytes in (1 << 20, 100):
        got = expand_from_table(df, "text", pairs, group_bytes=group_bytes)
        assert got.columns == df.columns
        assert {r.doc_id: r.text for r in got.collect()} == want
    assert "Exchange" not in plan_of(expand_from_table(df, "text", pairs))
    none = expand_from_table(df, "text", pairs.limit(0))
    assert sorted(none.collect()) == sorted(df.collect())
    assert expand_from_table(df.limit(0), "text", pairs).collect() == []


def test_ten_thousand_abbreviations_in_one_pass(spark):
    rng = random.Random(2)
    pairs = {f"AB{i}": f"full {i}" for i in range(10_000)}
    texts = [" ".join(rng.choice(["ab%d", "xab%d", "AB%dx", "aB%d"]) % rng.randrange(11_000) for _ in range(200)) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")

    def word(match):
        key = match[0].upper()
        return f"{key} ({pairs[key]})" if key in pairs else match[0]

    got = expand_from_table(df, "text", pairs_of(spark, pairs.items())).collect()
    assert {r.doc_id: r.text for r in got} == {i: re.sub(r"\w+", word, t) for i, t in enumerate(texts)}


def test_overlaps_go_leftmost_then_longest(spark):
    pairs = [("a b", "1"), ("b c", "2"), ("a", "3"), ("A B C", "4"), ("c", "6"), ("C", "5"), ("c", "5")]
    df = spark.createDataFrame([("a b c",), ("a b d c",), ("b c",)], "text string")
    for group_bytes in (1 << 20, 70):
        got = [r.text for r in expand_from_table(df, "text", pairs_of(spark, pairs), group_bytes=group_bytes).collect()]
        assert sorted(got) == sorted(["A B C (4)", "a b (1) d C (5)", "b c (2)"])


@pytest.mark.parametrize("size,overlap", [(1, 0), (3, 1), (5, 4), (7, 0), (40, 30)])
def test_chunk_table_equals_chunk_documents(spark, size, overlap):
    rng = random.Random(size)
    gaps = [" ", "\n", "\t ", " ", " \x0b\f\r"]
    texts = [None, "", "  ", "\n", "one"]
    texts += [rng.choice(["", " "]) + "".join(rng.choice(["ä", "bb", "😀c"]) + rng.choice(gaps) for _ in range(n)) for n in range(60)]
    df = spark.createDataFrame([(i % 40, t, i) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    for tail in (False, True):
        made = chunk_table(df, size=size, overlap=overlap, drop_contained_tail=tail, batch_chars=50)
        want = chunk_documents(df, size=size, overlap=overlap, drop_contained_tail=tail)
        key = lambda r: (r.doc_id, r.chunk_no, r.text)
        assert sorted(map(key, made.collect())) == sorted(map(key, want.collect()))
        assert "Exchange" not in plan_of(made)
    by_text = chunk_table(df.select(F.col("text").alias("k"), "text"), key="k", size=size, overlap=overlap).collect()
    assert all(" ".join(re.split(r"[ \t\n\x0B\f\r]+", r.k[r.start : r.end])) == r.text for r in by_text)
    with pytest.raises(ValueError):
        chunk_table(df, key="start")


def test_a_long_text_never_has_all_its_windows_at_once():
    text = ("x" * 99 + " ") * 500_000
    tracemalloc.start()
    total = sum(len(w) for _, _, w in stream_windows(text, 2000, 300))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total > len(text) and peak < 2_000_000


def versions(spark, rows, op=False):
    return spark.createDataFrame(rows, "doc_id long, version int, text string" + (", op string" if op else ""))


@pytest.fixture
def bucketed(spark, tmp_path):
    rng = random.Random(3)
    held = versions(spark, [(i, rng.randint(1, 4), f"old {i}") for i in range(400)] + [(None, 1, "no key")])
    name = f"held_{uuid.uuid4().hex}"
    bucketed_index.save_bucketed(held, name, "doc_id", 8, str(tmp_path / name))
    return name, held


def test_bucketed_merge_equals_apply_changes(spark, tmp_path, bucketed):
    name, held = bucketed
    rng = random.Random(4)
    rows = [(rng.randrange(500), rng.randint(1, 6), f"new {i}", rng.choice(["delete", "upsert", None])) for i in range(300)]
    changes = versions(spark, [*rows, *rows[:20], (None, 3, "new, no key", None)], op=True)
    want = sorted(apply_changes(held, changes).collect(), key=str)
    for config in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", config)
        try:
            into = f"{name}_{config.strip('-')}"
            merged = bucketed_index.merge_bucketed(spark, name, into, changes, path=str(tmp_path / into))
            assert sorted(merged.collect(), key=str) == want
            assert bucketed_index.bucket_count(spark, into) == 8
            plan = plan_of(bucketed_index.merged_rows(spark, name, changes))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        # One exchange, of the changes; the table's buckets are read where they lie.
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    again = bucketed_index.merge_bucketed(spark, into, f"{into}_again", changes, path=str(tmp_path / "again"))
    keyed = [r for r in again.collect() if r.doc_id is not None]
    assert sorted(keyed, key=str) == [r for r in want if r.doc_id is not None]
    old = versions(spark, [(1, None, "no version", None), (9999, None, "only", None)], op=True)
    late = {r.doc_id: r.text for r in bucketed_index.merged_rows(spark, name, old).collect()}
    assert late[1] == "old 1" and late[9999] == "only"
    with pytest.raises(Exception):
        bucketed_index.save_bucketed(held, name, "doc_id", 8)


def test_bucketed_look_up(spark, bucketed):
    name, held = bucketed
    hits = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(600)] + [(600, None)], "hit int, doc_id long")
    found = bucketed_index.look_up(spark, name, hits, "doc_id", ["text"])
    texts = {r.doc_id: r.text for r in held.collect() if r.doc_id is not None}
    assert sorted(map(tuple, found.select("hit", "text").collect())) == [(r.hit, texts.get(r.doc_id)) for r in hits.collect()]
    table = plan_of(spark.table(name).join(spark.range(3).repartition(8, "id").hint("shuffle_merge"), F.col("id") == F.col("doc_id")))
    assert table.count("Exchange") == 1
    with pytest.raises(ValueError):
        bucketed_index.bucket_count(spark, _plain(spark, held))


def _plain(spark, df):
    name = f"plain_{uuid.uuid4().hex}"
    df.limit(1).createOrReplaceTempView(name)
    return name


@pytest.mark.parametrize("lanes,calls", [(1, 20), (4, 21), (8, 40)])
def test_all_tasks_share_one_pace(spark, tmp_path, lanes, calls):
    log = str(tmp_path / "calls")

    def encode(texts):
        import time

        with open(log, "a") as file:
            os.write(file.fileno(), f"{time.monotonic()}\n".encode())
        return np.zeros((len(texts), 1))

    embedder = model_embedding(paced(encode, calls, 1.0, lanes), 1, batch_rows=5)
    rows = spark.range(0, 5 * 2 * calls, 1, 3).select(F.col("id").cast("string").alias("text"))
    assert embed(in_lanes(rows, lanes), embedder=embedder).agg(F.sum(F.size("embedding"))).first()[0] == 10 * calls
    times = sorted(float(x) for x in open(log))
    assert len(times) >= 2 * calls
    # Time passes between the pace's own clock and the record: two hundredths of a second's grace.
    assert max(sum(t <= u < t + 0.98 for u in times) for t in times) <= calls
    for bad in ((0, 1, 1), (2, 1, 3), (2, 0, 1)):
        with pytest.raises(ValueError):
            paced(encode, *bad)
