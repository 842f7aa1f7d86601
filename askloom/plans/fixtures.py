"""Inputs that the registered queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.functions.answers import NON_ANSWER_PHRASES
from askloom.functions.text import sentences, tokens, words
from askloom.functions.vectors import hashed_embedding
from askloom.operators.chunking import chunk_documents
from askloom.operators.embedding import embed
from askloom.session import materialize
from askloom.sources.documents import spread

SIZE, OVERLAP, DIM, K = 100, 10, 64, 5
ANCHOR_WORDS, ANCHOR_CHARS = 4, 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in front of costly text work."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(documents(spark, sf_dir), size=SIZE, overlap=OVERLAP)


def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saved index over all chunks: chunk_id, text, metadata map, embedding."""
    rows = chunks(spark, sf_dir).select(
        "chunk_id",
        "text",
        "lang",
        F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string"), F.lit("source"), "source").alias(
            "metadata"
        ),
    )
    return materialize(embed(rows, embedder=hashed_embedding(DIM)), "index")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question")
    )


def _token_hashes(text: str):
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def _token_runs(hashes, length: int, first, count):
    """Hashes of the ``count`` runs of ``length`` tokens, by their hashes, from place ``first`` on (from 1)."""
    places = F.when(count > 0, F.sequence(first, first + count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.get(hashes, i + (j - 1)) for j in range(length)]))


def _char_runs(text: str, length: int):
    """Hashes of all runs of ``length`` characters."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - length + 1, F.lit(1)))
    return F.transform(places, lambda i: F.xxhash64(F.substring(F.col(text), i, F.lit(length))))


def _anchored(texts: DataFrame, asked: DataFrame, text_runs, asked_runs) -> DataFrame:
    """Candidate pairs (question_id, doc_id): documents that hold each question's rarest run.

    Runs are hashes. Only those of some question leave the explode: Spark joins the stored set of wanted
    runs to them, in the same stage where it is small.
    """
    wanted = asked.select("question_id", F.explode(F.array_distinct(asked_runs)).alias("_run"))
    wanted = materialize(wanted, "wanted")
    held = texts.select("doc_id", F.explode(F.array_distinct(text_runs)).alias("_run"))
    held = materialize(held.join(wanted.select("_run").distinct(), "_run"), "held")
    often = held.groupBy("_run").agg(F.count("*").alias("_n"))
    rarest = (
        wanted.join(often, "_run", "left")
        .groupBy("question_id")
        .agg(F.min_by("_run", F.struct(F.coalesce("_n", F.lit(0)), "_run")).alias("_run"))
    )
    return rarest.join(held, "_run").select("question_id", "doc_id")


def passage_sources(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """Source of the lowest document holding each question text, for the questions that one holds.

    A document that holds a passage holds all its inner tokens in a row, so an equi-join on runs of up
    to ``ANCHOR_WORDS`` of these finds all candidates. A passage of one or two tokens has no inner ones
    and goes by runs of up to ``ANCHOR_CHARS`` characters instead. Only the candidates' texts are
    searched for the whole passage. The empty passage is in every text.
    """
    documents = documents.where("text IS NOT NULL").select("doc_id", "text", "source")
    asked = asked.where("question IS NOT NULL").withColumn("_t", _token_hashes("question"))
    inner = F.least(F.size("_t") - 2, F.lit(ANCHOR_WORDS))
    short = F.least(F.length("question"), F.lit(ANCHOR_CHARS))
    asked = asked.withColumn("_kind", F.when(inner > 0, inner).otherwise(-short))
    asked = materialize(asked, "asked")
    pairs = None
    for kind in sorted(r[0] for r in asked.select("_kind").distinct().collect()):  # few kinds at most
        of_kind = asked.where(F.col("_kind") == kind)
        if kind > 0:
            texts = spread(documents).withColumn("_t", _token_hashes("text"))
            own = _token_runs(F.col("_t"), kind, F.lit(1), F.size("_t") - (kind - 1))
            found = _anchored(texts, of_kind, own, _token_runs(F.col("_t"), kind, F.lit(2), F.size("_t") - 1 - kind))
        elif kind < 0:
            found = _anchored(spread(documents), of_kind, _char_runs("text", -kind), _char_runs("question", -kind))
        else:
            lowest = documents.agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL")
            found = of_kind.select("question_id", F.lit(0).alias("_x")).join(lowest.withColumn("_x", F.lit(0)), "_x")
            found = found.select("question_id", "doc_id")
        pairs = found if pairs is None else pairs.union(found)
    if pairs is None:
        return asked.select("question_id", F.lit(None).cast("string").alias("correct_source"))
    held = documents.join(materialize(pairs, "anchored"), "doc_id").join(asked.select("question_id", "question"), "question_id")
    held = held.filter(F.contains(F.col("text"), F.col("question")))
    return held.groupBy("question_id").agg(F.min_by("source", "doc_id").alias("correct_source"))


def eval_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark as questions; the answer is the passage's sentence with most distinct words."""
    asked = questions(spark, sf_dir)
    sources = passage_sources(table(spark, sf_dir, "documents"), asked)
    ranked = F.transform(
        sentences("question"),
        lambda s, i: F.struct(
            F.size(F.array_distinct(words(s))).alias("n"), (-i).alias("place"), s.alias("sentence")
        ),
    )
    return asked.join(sources, "question_id", "left").select(
        F.col("question_id").alias("eval_id"),
        "question",
        F.array_max(ranked)["sentence"].alias("answer"),
        "correct_source",
    )


def made_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a candidate answer; some carry a non-answer phrase, some are null."""
    phrases = F.array(*[F.lit(p) for p in NON_ANSWER_PHRASES])
    pick = F.pmod(F.col("conv_id") * 7 + F.col("turn") * 3, F.lit(40)).cast("int")
    answer = (
        F.when(pick < len(NON_ANSWER_PHRASES), F.concat("text", F.lit(" "), F.upper(F.get(phrases, pick))))
        .when(pick < 20, F.lit(None).cast("string"))
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("question_id"),
        (F.col("turn") + 1).alias("rank"),
        F.concat(F.lit("turn-"), "turn").alias("source"),
        answer.alias("answer"),
    )


def graded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evaluation set, predictions and grades over all benchmark items."""
    evals = materialize(eval_set(spark, sf_dir), "evals")
    third = F.col("eval_id") % 3
    predictions = evals.select(
        "eval_id",
        F.when(third == 0, F.col("answer")).when(third == 1, F.lit("something else")).alias("answer"),
        F.when(F.col("eval_id") % 2 == 0, F.col("correct_source")).otherwise(F.lit("src0")).alias("source"),
    )
    grades = evals.select(
        "eval_id",
        F.when(third == 0, F.lit("CORRECT"))
        .when(third == 1, F.lit("\nCORRECT "))
        .otherwise(F.lit("INCORRECT"))
        .alias("grade"),
    )
    return evals, predictions, grades


def versioned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.lit(1).cast("long").alias("version"), "text"
    )


def document_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes, updates (in and out of order, or without an op), stale updates and inserts, by the id's last digit."""

    def change(key, op, version, suffix):
        return F.struct(
            key.alias("doc_id"),
            F.lit(op).cast("string").alias("op"),
            F.lit(version).cast("long").alias("version"),
            F.concat(F.col("text"), F.lit(suffix)).alias("text"),
        )

    key = F.col("doc_id")
    digit = key % 10
    made = (
        F.when(digit == 0, F.array(change(key, "delete", 2, "")))
        .when(digit == 1, F.array(change(key, None, 2, " edit two")))
        .when(digit == 2, F.array(change(key, "update", 3, " edit three"), change(key, "update", 2, " edit two")))
        .when(digit == 3, F.array(change(key, "delete", 3, ""), change(key, "update", 2, " edit two")))
        .when(digit == 4, F.array(change(key, "update", 0, " stale")))
        .when(digit == 5, F.array(change(-key, "insert", 1, " new")))
    )
    return table(spark, sf_dir, "documents").select(F.explode(made).alias("_c")).select("_c.*")


def document_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the documents: of every 97 ids one is gone, one edited, one moved, and one has a new companion."""
    first = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rest = F.col("doc_id") % 97
    edited = F.when(rest == 1, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    moved = F.when(rest == 2, F.lit("elsewhere")).otherwise(F.col("source"))
    second = first.where(rest != 0).select("doc_id", edited.alias("text"), moved.alias("source"))
    added = first.where(rest == 3).select((-F.col("doc_id")).alias("doc_id"), "text", "source")
    return first, second.union(added)
