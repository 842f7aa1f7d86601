"""Passages of any length, failing models, upkeep with odd changes, and the chain from stream to answer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from askloom.functions.vectors import hashed_embedding, model_embedding
from askloom.operators.answering import answer_cascade, answer_until_good, batch_predict, model_generator
from askloom.operators.embedding import build_index
from askloom.operators.evaluation import grade_answers, model_grader
from askloom.operators.index import apply_changes, latest_per_key, merge_index
from askloom.operators.tables import batches
from askloom.plans.fixtures import passage_sources
from askloom.session import materialize, scratch_scope, shared_dir
from askloom.streaming.sync import compact_log, current_index, index_changes


def test_passages_of_any_length_are_found(spark):
    texts = ["tide", "the tide turns", "at the tide turns now", "x the moon and the sea and stars rise y", "the the the the the the", None]
    docs = [(10 - i, t, f"s{10 - i}") for i, t in enumerate(texts)] + [(i, "the the the the the filler %d" % i, "c") for i in range(50, 80)]
    asked = ["tide", "id", "e t", "the tide turns", "tide turns", "moon and the sea and stars", "the the the the the", "absent words here now", "", " ", "q", None, "he tide turn", "the the the the the filler 77"]
    documents = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    questions = spark.createDataFrame(list(enumerate(asked)), "question_id long, question string")
    got = {r.question_id: r.correct_source for r in passage_sources(documents, questions).collect()}
    want = {}
    for i, q in enumerate(asked):
        held = [(d, s) for d, t, s in docs if q is not None and t is not None and q in t]
        if held:
            want[i] = min(held)[1]
    assert got == want
    assert passage_sources(documents, questions.limit(0)).collect() == []


class Busy(Exception):
    pass


def walk_tables(spark):
    questions = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "question_id long, question string")
    near = spark.createDataFrame(
        [(q, r, f"t{q}{r}", {"source": f"s{r}"}) for q in (1, 2, 3, 4) for r in (1, 2, 3)],
        "question_id long, rank int, text string, metadata map<string,string>",
    )
    return questions, near.coalesce(1)


def moody(chats):
    """Bad answers at rank 1 for question 1, a limit for question 2 at rank 2, good ones else."""
    texts = [c[-1]["content"] for c in chats]
    if any("t22" in t for t in texts):
        raise Busy("slow down")
    return ["I don't know" if "t11" in t or "t21" in t or "t41" in t or "t42" in t or "t43" in t else "fine " + t for t in texts]


def test_an_error_ends_the_walk_and_is_kept(spark):
    options = {"is_rate_limit": lambda e: "slow down" in str(e), "timeout_sec": 0.05, "wait_sec": 0.01, "batch_rows": 1}
    questions, near = walk_tables(spark)
    early = {r.question_id: r for r in answer_until_good(questions, near, moody, **options).collect()}
    full = {r.question_id: r for r in answer_cascade(questions, near, model_generator(moody, **options)).collect()}
    for got in (early, full):
        assert got[1].source == "s2" and got[1].error is None
        assert got[2].answer is None and got[2].source is None and "slow down" in got[2].error
        assert got[3].source == "s1"
        assert got[4].answer is None and got[4].error is None


def test_a_model_with_too_few_texts_is_refused(spark):
    questions, near = walk_tables(spark)
    with pytest.raises(Exception, match="one text per chat"):
        answer_until_good(questions, near, lambda chats: ["x"] * (len(chats) - 1)).collect()


def test_batches_stay_small(spark):
    questions, near = walk_tables(spark)
    largest = spark.sparkContext.accumulator(0)

    def model(chats):
        if len(chats) > 2:
            largest.add(1)
        return ["good"] * len(chats)

    answer_until_good(questions, near, model, batch_rows=2).collect()
    assert largest.value == 0


def test_model_grader(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(chats):
        calls.add(len(chats))
        if any("busy" in c[-1]["content"] for c in chats):
            raise Busy("slow down")
        return ["CORRECT" if "Answer to judge: yes" in c[-1]["content"] else "INCORRECT" for c in chats]

    df = spark.createDataFrame([("q", "a", "yes"), ("q", "a", "no"), ("q", "a", None)], "question string, answer string, prediction string")
    assert [r.grade for r in grade_answers(df, model_grader(model)).collect()] == ["CORRECT", "INCORRECT", "INCORRECT"]
    assert calls.value == 3
    busy = df.withColumn("question", F.lit("busy"))
    grader = model_grader(model, lambda e: "slow down" in str(e), timeout_sec=0.05, wait_sec=0.01)
    rows = grade_answers(busy, grader).collect()
    assert all(r.grade is None and "slow down" in r.grade_error for r in rows)


def test_embedding_waits_for_a_limited_model(spark, tmp_path):
    flag = str(tmp_path / "asked")

    def encode(texts):
        import os

        if not os.path.exists(flag):
            open(flag, "w").close()
            raise Busy("slow down")
        return np.ones((len(texts), 2))

    df = spark.createDataFrame([("a",)], "text string")
    waits = model_embedding(encode, 2, is_rate_limit=lambda e: "slow down" in str(e), wait_sec=0.01)
    assert df.select(waits("text").alias("v")).first().v == [1.0, 1.0]

    def never(texts):
        raise Busy("slow down")

    gives_up = model_embedding(never, 2, is_rate_limit=lambda e: True, timeout_sec=0.05, wait_sec=0.01)
    with pytest.raises(Exception, match="slow down"):
        df.select(gives_up("text")).collect()


def test_a_change_without_op_replaces(spark):
    index = spark.createDataFrame([(1, 1, "old"), (2, 1, "two")], "doc_id long, version long, text string")
    changes = spark.createDataFrame([(1, 2, "new", None), (3, 1, "three", None)], "doc_id long, version long, text string, op string")
    got = sorted(map(tuple, apply_changes(index, changes).collect()))
    assert got == [(1, 2, "new"), (2, 1, "two"), (3, 1, "three")]


def test_equal_versions_that_differ_in_a_map_settle_the_same_way(spark):
    rows = [(1, 1, {"a": "1", "b": "2"}), (1, 1, {"a": "1", "b": "3"}), (1, 1, {"a": "1", "b": "2"}), (None, 1, {}), (None, 1, {})]
    schema = "doc_id long, version long, metadata map<string,string>"
    one = latest_per_key(spark.createDataFrame(rows, schema).repartition(3), "doc_id", "version").collect()
    two = latest_per_key(spark.createDataFrame(rows[::-1], schema), "doc_id", "version").collect()
    assert len(one) == 2 and sorted(map(str, one)) == sorted(map(str, two))


def test_a_merge_cuts_each_key_before_its_only_shuffle(spark):
    a = spark.createDataFrame([(1, 1, [1.0])], "chunk_id long, version long, embedding array<double>")
    plan = merge_index(a, a)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Aggregate" not in plan
    assert plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")  # the lower one runs first


def test_a_compacted_log_stands_for_the_same_index(spark):
    rows = [(1, "insert", 1, "one two"), (1, None, 2, "three"), (2, "insert", 1, "gone"), (2, "delete", 3, None), (2, "update", 2, "late")]
    changes = spark.createDataFrame(rows, "doc_id long, op string, version long, text string")
    log = materialize(index_changes(changes, size=1, overlap=0, embedder=hashed_embedding(4)), "log")
    short = materialize(compact_log(log), "short")
    assert short.count() == 2

    def state(df):
        return sorted((r.doc_id, r.version, r.text, r.metadata["doc_id"]) for r in current_index(df).collect())

    assert state(log) == state(short) == state(short.union(log)) == [(1, 2, "three", "1")]


def test_documents_to_answers_in_one_chain(spark):
    docs = spark.createDataFrame([(1, "The tide follows the moon.", "sea"), (2, "Bread needs salt.", "bakery")], "doc_id long, text string, source string")
    index = build_index(docs, size=20, overlap=2, embedder=hashed_embedding(32))
    questions = spark.createDataFrame([(1, "what does the tide follow")], "question_id long, question string")
    got = batch_predict(questions, index, hashed_embedding(32), 2).first()
    assert got.source == "sea" and got.error is None


def test_chunking_runs_once_for_batches(spark):
    calls = spark.sparkContext.accumulator(0)

    def seen(x):
        calls.add(1)
        return x

    df = spark.range(1200).select(F.udf(seen, "long")("id").alias("k"))
    assert batches(df, keys=("k",)).count() == 1200
    assert calls.value == 1200


def test_scratch_scope_removes_what_it_stored(spark):
    import os

    app = spark.sparkContext.applicationId
    with scratch_scope(spark):
        assert materialize(spark.range(3)).count() == 3
        assert os.listdir(f"{shared_dir(spark)}/{app}")
    assert not os.path.exists(f"{shared_dir(spark)}/{app}")
