"""Registered queries: one per operator, over the whole given tables, with flat result columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.functions.answers import answer_present, exact_grader, is_good_answer, source_of
from askloom.functions.text import (
    build_prompt,
    expand_abbreviations,
    json_path,
    strip,
    text_length,
    validate_question,
    words,
)
from askloom.functions.vectors import hashed_embedding, inner_product, model_embedding, vector_distance
from askloom.functions.retry import in_lanes, paced
from askloom.operators import abbreviations, answering, chunking, embedding, evaluation, index, lists, retrieval, snapshots, tables
from askloom.plans import fixtures as fx
from askloom.session import materialize, scratch_path, shuffles_dropped
from askloom.sources import documents as docs
from askloom.sources import bucketed_index, index_store
from askloom.streaming import sync, upsert

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FILES = 16  # input files of the streams, at least; they are read in two batches


def query(run: Query) -> Query:
    QUERIES[run.__name__.removesuffix("_query")] = run
    return run


# Scans, sources, sinks


@query
def json_document_scan(spark, sf_dir):
    """Files that each hold one JSON array over many lines, of some hundred objects."""
    path = scratch_path(spark, "json")
    source = fx.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    one = F.to_json(F.struct(*source.columns), {"pretty": "true"})
    file = F.floor(F.col("doc_id") / 256)
    arrays = source.groupBy(file.alias("file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ",\n"), F.lit("]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return docs.load_json(spark, path, source.schema)


@query
def save_sources_table(spark, sf_dir):
    path = scratch_path(spark, "sources")
    table = fx.table(spark, sf_dir, "documents")
    docs.save_table(table.select("doc_id", "text"), path)
    docs.save_table(table.select("doc_id", "source", "n_chars"), path)
    return docs.scan(spark, path)


@query
def scan_sources(spark, sf_dir):
    return docs.scan(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")


@query
def project_all_columns(spark, sf_dir):
    return docs.all_columns(fx.table(spark, sf_dir, "documents"))


@query
def eval_set_scan(spark, sf_dir):
    path = scratch_path(spark, "eval")
    evals = fx.eval_set(spark, sf_dir)
    docs.save_eval(evals, path)
    return docs.load_eval(spark, path, evals.schema)


@query
def results_to_table(spark, sf_dir):
    path = scratch_path(spark, "results")
    docs.save_table(evaluation.to_results(evaluation.join_eval(*fx.graded(spark, sf_dir))), path)
    return docs.scan(spark, path)


def _index_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "vec_id", "label", F.round(F.sqrt(inner_product("embedding", "embedding")), 6).alias("norm")
    )


@query
def index_write_read(spark, sf_dir):
    path = scratch_path(spark, "index")
    vectors = fx.table(spark, sf_dir, "embeddings")
    index_store.save_index(vectors, path, partition_by="label")
    return _index_rows(index_store.load_index(spark, path, vectors.schema))


@query
def index_reset(spark, sf_dir):
    path = scratch_path(spark, "index")
    vectors = fx.table(spark, sf_dir, "embeddings")
    index_store.save_index(vectors.withColumn("label", F.lit(-1)), path)
    index_store.save_index(vectors, path, reset=True)
    return _index_rows(index_store.load_index(spark, path))


@query
def index_describe(spark, sf_dir):
    return index_store.describe_index(fx.table(spark, sf_dir, "embeddings"))


# Projections, filters, predicates


@query
def select_source_fields(spark, sf_dir):
    return docs.select_fields(fx.table(spark, sf_dir, "documents"), ["text", "source"])


@query
def chunk_reshape(spark, sf_dir):
    return fx.chunks(spark, sf_dir).select(
        "doc_id",
        "lang",
        "source",
        "num_chunks",
        "chunk_no",
        "chunk_id",
        text_length("text").alias("chars"),
    )


@query
def split_text_and_metadata(spark, sf_dir):
    made = chunking.with_metadata(fx.chunks(spark, sf_dir))
    return made.select("page_content", F.explode("metadata").alias("meta_key", "meta_value"))


def _self_search(spark, sf_dir, metric="l2sq", **options) -> DataFrame:
    vectors = fx.table(spark, sf_dir, "embeddings")
    asked = vectors.select(F.col("vec_id").alias("question_id"), "embedding")
    return retrieval.knn(
        asked, vectors, fx.K, metric, index_key="vec_id", exclude_same_id=True, **options
    )


def _flat_hits(hits: DataFrame) -> DataFrame:
    return hits.select(
        "question_id", "rank", "vec_id", "label", F.round("distance", 6).alias("distance")
    )


def _found_documents(spark, sf_dir) -> DataFrame:
    _, near = _near(spark, sf_dir)
    hits = near.select(
        "question_id", "rank", "text", "chunk_id", F.col("metadata")["source"].alias("source"), "distance"
    )
    return retrieval.to_documents(hits, keep=("question_id", "rank"))


@query
def results_to_documents(spark, sf_dir):
    return _found_documents(spark, sf_dir).select(
        "question_id",
        "rank",
        "page_content",
        F.col("metadata")["chunk_id"].alias("chunk_id"),
        F.col("metadata")["source"].alias("source"),
        F.size("metadata").alias("n_metadata"),
        F.round("score", 6).alias("score"),
    )


@query
def response_documents(spark, sf_dir):
    """Each question's search result as one response of k rows, and back."""
    _, near = _near(spark, sf_dir)
    names = ("chunk_id", "source", "score")
    cells = F.array(
        F.col("chunk_id"), F.col("metadata")["source"], F.round("distance", 6).cast("string")
    )
    rows = near.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", cells.alias("cells")))).alias("rows"))
    body = F.to_json(
        F.struct(
            F.struct(
                F.array(*[F.struct(F.lit(n).alias("name")) for n in names]).alias("columns")
            ).alias("manifest"),
            F.struct(F.transform("rows", lambda r: r["cells"]).alias("data_array")).alias("result"),
        )
    )
    made = retrieval.documents_from_responses(rows.select("question_id", body.alias("body")), "body", ("question_id",))
    return made.select(
        "question_id",
        "rank",
        "page_content",
        F.col("metadata")["source"].alias("source"),
        F.size("metadata").alias("n_metadata"),
        "score",
    )


@query
def content_only_documents(spark, sf_dir):
    return retrieval.content_only(_found_documents(spark, sf_dir), keep=("question_id", "rank"))


@query
def source_or_unknown(spark, sf_dir):
    third = F.col("doc_id") % 3
    metadata = (
        F.when(third == 0, F.create_map(F.lit("source"), F.col("source")))
        .when(third == 1, F.create_map(F.lit("lang"), F.col("lang")))
        .otherwise(F.create_map(F.lit("source"), F.lit(None).cast("string")))
    )
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", source_of(metadata).alias("source_label")
    )


@query
def answer_present_query(spark, sf_dir):
    made = fx.made_answers(spark, sf_dir)
    return made.filter((F.col("rank") == 1) & answer_present("answer")).select("question_id", "answer")


@query
def good_answer_filter(spark, sf_dir):
    made = fx.made_answers(spark, sf_dir)
    return made.filter(is_good_answer("answer")).select("question_id", "rank", "answer")


@query
def reject_empty_question(spark, sf_dir):
    blank = (F.col("conv_id") + F.col("turn")) % 5 == 0
    made = fx.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(blank, F.lit(" \n\t ")).otherwise(F.col("text")).alias("question")
    )
    return made.select("conv_id", "turn", validate_question("question").alias("error"))


@query
def filtered_retrieval(spark, sf_dir):
    return _flat_hits(_self_search(spark, sf_dir, where={"label": 5}))


# Joins


@query
def eval_join(spark, sf_dir):
    return evaluation.join_eval(*fx.graded(spark, sf_dir))


@query
def knn_join(spark, sf_dir):
    return _flat_hits(_self_search(spark, sf_dir))


@query
def knn_join_cosine(spark, sf_dir):
    return _flat_hits(_self_search(spark, sf_dir, "cosine"))


@query
def knn_join_inner_product(spark, sf_dir):
    return _flat_hits(_self_search(spark, sf_dir, "ip"))


@query
def knn_join_grid(spark, sf_dir):
    return _flat_hits(_self_search(spark, sf_dir, broadcast_bytes=64 * 1024))


@query
def knn_join_doubled(spark, sf_dir):
    """The same search over an index that holds every row twice: a key is one neighbour."""
    vectors = fx.table(spark, sf_dir, "embeddings")
    asked = vectors.select(F.col("vec_id").alias("question_id"), "embedding")
    doubled = index.append_index(vectors, vectors)
    return _flat_hits(retrieval.knn(asked, doubled, fx.K, index_key="vec_id", exclude_same_id=True))


@query
def knn_join_matched(spark, sf_dir):
    """Every question with a filter of its own; one value holds nearly half of the index, and some ask for all."""
    tag = F.when(F.col("label") < 4, F.lit(0)).otherwise(F.col("label"))
    vectors = fx.table(spark, sf_dir, "embeddings").withColumn("tag", tag)
    want = F.when(F.col("vec_id") % 25 > 0, F.col("label") * 3 % 10)
    asked = vectors.select(F.col("vec_id").alias("question_id"), "embedding", want.alias("want"))
    found = retrieval.knn(asked, vectors, fx.K, match=("want", "tag"), index_key="vec_id", exclude_same_id=True)
    return _flat_hits(found)


@query
def keep_unanswered(spark, sf_dir):
    made = fx.made_answers(spark, sf_dir)
    asked = made.select("question_id").distinct()
    best = answering.first_good_answer(made, fields=("answer", "source"))
    return answering.keep_unanswered(asked, best)


# Aggregations


@query
def count_sources(spark, sf_dir):
    return tables.count_rows(fx.table(spark, sf_dir, "documents"))


@query
def count_chunks(spark, sf_dir):
    return tables.count_rows(fx.chunks(spark, sf_dir))


@query
def index_size(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings")
    return index_store.index_size(index.append_index(vectors, vectors))


@query
def eval_accuracy(spark, sf_dir):
    return evaluation.accuracy(
        evaluation.to_results(evaluation.join_eval(*fx.graded(spark, sf_dir)))
    ).select(F.round("accuracy", 6).alias("accuracy"))


@query
def eval_source_rate(spark, sf_dir):
    return evaluation.source_rate(
        evaluation.to_results(evaluation.join_eval(*fx.graded(spark, sf_dir)))
    ).select(F.round("source_rate", 6).alias("source_rate"))


# Sorts, limits, top-k


@query
def longest_document(spark, sf_dir):
    return tables.longest(fx.table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def limit_then_offset(spark, sf_dir):
    rows = fx.chunks(spark, sf_dir).select("doc_id", "chunk_no", "text")
    return tables.page(rows, 900, 850, ("doc_id", "chunk_no"))


@query
def fixed_size_batches(spark, sf_dir):
    rows = fx.chunks(spark, sf_dir).select("doc_id", "chunk_no")
    return tables.batches(rows, keys=("doc_id", "chunk_no"))


@query
def fixed_size_batches_full_only(spark, sf_dir):
    rows = fx.chunks(spark, sf_dir).select("doc_id", "chunk_no")
    return tables.batches(rows, keys=("doc_id", "chunk_no"), full_only=True)


@query
def topk_retrieval(spark, sf_dir):
    near = retrieval.retrieve(
        fx.questions(spark, sf_dir),
        fx.chunk_index(spark, sf_dir),
        hashed_embedding(fx.DIM),
        fx.K,
        payload=("text",),
    )
    return near.select(
        "question_id", "rank", "chunk_id", "text", F.round("distance", 6).alias("distance")
    )


def _chunk_lists(spark, sf_dir):
    """The chunk index by list, and the embedded questions."""
    path = scratch_path(spark, "lists")
    lists.build_lists(fx.chunk_index(spark, sf_dir), path, lists=64)
    questions = fx.questions(spark, sf_dir).select("question_id", hashed_embedding(fx.DIM)("question").alias("embedding"))
    return lists.open_lists(spark, path), materialize(questions, "questions")


def _list_hits(opened, hits) -> DataFrame:
    texts = opened.rows.select("chunk_id", "text").join(hits, "chunk_id")
    return texts.select("question_id", "rank", "chunk_id", "text", F.round("distance", 6).alias("distance"))


@query
def topk_in_lists(spark, sf_dir):
    """The exact search of ``topk_retrieval`` over an index by list, without the files that cannot matter."""
    opened, questions = _chunk_lists(spark, sf_dir)
    return _list_hits(opened, lists.nearest_in_lists(questions, opened, fx.K).hits)


@query
def topk_probed(spark, sf_dir):
    """The nearest among each question's 16 nearest lists of 64: mostly the same rows."""
    opened, questions = _chunk_lists(spark, sf_dir)
    return _list_hits(opened, lists.probe(questions, opened, fx.K, probes=16).hits)


@query
def head_rows(spark, sf_dir):
    return tables.head(fx.questions(spark, sf_dir), 5, ("question_id",))


# Index maintenance


@query
def index_merge(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings")
    return _index_rows(index.append_index(vectors, vectors.withColumn("label", F.col("label") + 100)))


@query
def index_merge_idempotent(spark, sf_dir):
    base = fx.table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.lit(1).alias("version"), "embedding"
    )
    other = base.select(
        "vec_id",
        (F.col("label") + 100).alias("label"),
        (2 - F.col("vec_id") % 3).cast("int").alias("version"),
        "embedding",
    )
    once = index.merge_index(base, other, "vec_id")
    twice = index.merge_index(once, other, "vec_id")
    return twice.select("vec_id", "label", "version")


@query
def index_sync_upsert(spark, sf_dir):
    return index.apply_changes(
        fx.versioned_documents(spark, sf_dir), fx.document_changes(spark, sf_dir)
    )


def _bucketed(spark, df, key):
    name = f"index_{uuid.uuid4().hex}"
    bucketed_index.save_bucketed(df, name, key, 16, scratch_path(spark, name))
    return name


@query
def index_bucketed_merge(spark, sf_dir):
    """U3 over a bucketed table, whose rows stay in their buckets."""
    name = _bucketed(spark, fx.versioned_documents(spark, sf_dir), "doc_id")
    changes = fx.document_changes(spark, sf_dir)
    into = f"{name}_merged"
    return bucketed_index.merge_bucketed(spark, name, into, changes, path=scratch_path(spark, into))


@query
def index_bucketed_lookup(spark, sf_dir):
    """Names of the parts of all line items from a bucketed table."""
    name = _bucketed(spark, fx.table(spark, sf_dir, "part"), "p_partkey")
    hits = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return bucketed_index.look_up(spark, name, hits, "p_partkey", ["p_name"])


def _two_snapshots(spark, sf_dir):
    first, second = fx.document_snapshots(spark, sf_dir)
    paths = [scratch_path(spark, "snapshot") for _ in range(2)]
    for df, path in zip((first, second), paths):
        snapshots.save_snapshot(df, path, buckets=64)
    return first, snapshots.snapshot_changes(spark, *paths, version=2)


@query
def snapshot_changes(spark, sf_dir):
    """The change feed between two snapshots of the documents."""
    return _two_snapshots(spark, sf_dir)[1].select("doc_id", "op", "version", "text")


@query
def snapshot_sync(spark, sf_dir):
    """An index of the first snapshot that follows the feed: the second snapshot."""
    first, changes = _two_snapshots(spark, sf_dir)
    held = first.withColumn("version", F.lit(1).cast("long"))
    return index.apply_changes(held, changes).select("doc_id", "text", "source")


def _half(written: DataFrame) -> int:
    """How many files of a stored table a stream reads at a time for two batches."""
    return -(-len(written.inputFiles()) // 2)


@query
def incremental_index_build(spark, sf_dir):
    rows = fx.chunks(spark, sf_dir).select("chunk_id", "source", "text")
    chunk_dir, path = scratch_path(spark, "chunks"), scratch_path(spark, "index")
    rows.repartition(FILES, "chunk_id").write.parquet(chunk_dir)
    sync.build_incremental(
        spark,
        chunk_dir,
        rows.schema,
        path,
        scratch_path(spark, "stream"),
        embedder=hashed_embedding(fx.DIM),
        max_files_per_trigger=_half(spark.read.parquet(chunk_dir)),
    ).awaitTermination()
    return index_store.load_index(spark, path).select(
        "chunk_id",
        "source",
        F.size(F.filter("embedding", lambda x: x > 0)).alias("n_used_dims"),
    )


# Scalar functions


@query
def chunk_documents(spark, sf_dir):
    return fx.chunks(spark, sf_dir).select("doc_id", "chunk_no", "text")


@query
def chunk_documents_spaced(spark, sf_dir):
    rows = fx.documents(spark, sf_dir).select("doc_id", "text")
    made = chunking.chunk_documents(rows, size=fx.SIZE, overlap=fx.OVERLAP, keep_spacing=True)
    return made.select("doc_id", "chunk_no", "text")


@query
def chunk_documents_no_tail(spark, sf_dir):
    rows = fx.documents(spark, sf_dir).select("doc_id", "text")
    made = chunking.chunk_documents(rows, size=fx.SIZE, overlap=fx.OVERLAP, drop_contained_tail=True)
    return made.select("doc_id", "chunk_no", "num_chunks", "text")


@query
def chunk_documents_default(spark, sf_dir):
    rows = fx.documents(spark, sf_dir).select("doc_id", "text")
    return chunking.chunk_documents(rows).select("doc_id", "chunk_no", "num_chunks", "text")


@query
def num_chunks(spark, sf_dir):
    rows = fx.documents(spark, sf_dir).select("doc_id", "text")
    made = chunking.with_chunks(rows, size=fx.SIZE, overlap=fx.OVERLAP)
    return made.select("doc_id", F.size("chunks").alias("num_chunks"))


@query
def explode_chunks(spark, sf_dir):
    rows = fx.documents(spark, sf_dir).select("doc_id", "text")
    made = chunking.with_chunks(rows, size=fx.SIZE, overlap=fx.OVERLAP)
    return chunking.explode_chunks(made).select("doc_id", "chunk_id", "text")


@query
def text_length_query(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", text_length("text").alias("chars"), "n_chars"
    )


@query
def embed_text(spark, sf_dir):
    made = embedding.embed(
        fx.documents(spark, sf_dir).select("doc_id", "text"), embedder=hashed_embedding(fx.DIM)
    )
    return (
        made.select("doc_id", F.posexplode("embedding").alias("bucket", "weight"))
        .filter(F.col("weight") > 0)
        .select("doc_id", "bucket", F.round(F.col("weight").cast("double"), 5).alias("weight"))
    )


@query
def vector_distance_query(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings")
    ahead = vectors.select(
        (F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")
    )
    return vectors.join(ahead, "vec_id").select(
        "vec_id",
        *[
            F.round(vector_distance("embedding", "other", m), 6).alias(m)
            for m in ("l2sq", "cosine", "ip")
        ],
    )


@query
def build_prompt_query(spark, sf_dir):
    turns = fx.table(spark, sf_dir, "conversations")
    replies = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("context"))
    asked = turns.select("conv_id", "turn", F.col("text").alias("question"))
    chat = asked.join(replies, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.posexplode(build_prompt("context", "question")).alias("place", "message")
    )
    return chat.select("conv_id", "turn", "place", "message.role", "message.content")


@query
def expand_abbreviations_query(spark, sf_dir):
    odd = F.col("turn") % 2 == 1
    question = F.concat(F.when(odd, F.lit("An rpm for MPH? ")).otherwise(F.lit("WRPM and rpm: ")), "text")
    return fx.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", expand_abbreviations(question).alias("question")
    )


@query
def expand_from_table(spark, sf_dir):
    """Abbreviations are the short words of all documents, their full texts how often these are there."""
    word = F.explode(words("text")).alias("word")
    seen = fx.table(spark, sf_dir, "documents").select(word).where("word rlike '^[a-z]{2,4}$'")
    counts = seen.groupBy("word").agg(F.count("*").alias("n"))
    pairs = counts.select(F.upper("word").alias("short"), F.concat(F.lit("seen "), "n").alias("full"))
    turns = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return abbreviations.expand_from_table(turns, "text", pairs)


@query
def same_as_answer(spark, sf_dir):
    results = evaluation.to_results(evaluation.join_eval(*fx.graded(spark, sf_dir)))
    return results.select("eval_id", "same_as_answer")


@query
def find_correct_source(spark, sf_dir):
    results = evaluation.to_results(evaluation.join_eval(*fx.graded(spark, sf_dir)))
    return results.select("eval_id", "source", "correct_source", "find_correct_source")


@query
def json_path_lookup(spark, sf_dir):
    nested = F.to_json(F.struct(F.struct(F.col("event_type").alias("kind")).alias("tags")))
    return fx.table(spark, sf_dir, "events").select(
        "event_id",
        json_path("props", "k?").alias("k"),
        json_path("props", "tags?.kind?").alias("absent"),
        (json_path(nested, "tags?.kind?") == "click").alias("is_click"),
    )


@query
def lookback_window_filter(spark, sf_dir):
    kept = tables.date_window(fx.table(spark, sf_dir, "events"), "ts", "2024-01-20", lookback=7)
    return kept.select("event_id", "user_id", "event_type")


@query
def daily_snapshot_filter(spark, sf_dir):
    kept = tables.snapshot(fx.table(spark, sf_dir, "events"), "ts", "2024-01-20")
    return kept.select("event_id", "user_id", "event_type")


@query
def split_sql_scripts(spark, sf_dir):
    script = F.concat(
        F.lit("-- first; second\nselect "),
        F.col("doc_id").cast("string"),
        F.lit(";\n\n  ;\n\n  -- only a comment\n;select '"),
        F.col("text"),
        F.lit("' -- kept\n  -- gone"),
    )
    made = fx.table(spark, sf_dir, "documents").select("doc_id", script.alias("script"))
    return tables.split_scripts(made, "script", ("doc_id",)).select(
        "doc_id", "statement_no", strip("statement").alias("statement")
    )


# Streaming


def _followed(follow, spark, changes, **options) -> str:
    """The path of what ``follow`` makes of a stream over ``changes``, in two batches."""
    source, path = scratch_path(spark, "changes"), scratch_path(spark, "index")
    if changes.rdd.getNumPartitions() < FILES:
        changes = changes.repartition(FILES, "doc_id", "version")
    with shuffles_dropped(spark):
        changes.write.option("compression", "zstd").parquet(source)
    written = spark.read.parquet(source)
    schema = T.StructType([f for f in written.schema])
    follow(
        spark,
        source,
        schema,
        path,
        scratch_path(spark, "stream"),
        size=fx.SIZE,
        overlap=fx.OVERLAP,
        embedder=hashed_embedding(fx.DIM),
        max_files_per_trigger=_half(written),
        **options,
    ).awaitTermination()
    return path


def _all_changes(spark, sf_dir) -> DataFrame:
    changes = fx.versioned_documents(spark, sf_dir).withColumn("op", F.lit("insert"))
    return changes.unionByName(fx.document_changes(spark, sf_dir))


def _streamed_log(spark, sf_dir) -> DataFrame:
    return index_store.load_index(spark, _followed(sync.sync_stream, spark, _all_changes(spark, sf_dir)))


@query
def stream_index_sync(spark, sf_dir):
    state = sync.current_index(_streamed_log(spark, sf_dir))
    return state.select("doc_id", "version", "chunk_id", "text")


@query
def stream_index_compact(spark, sf_dir):
    """Fold the log, store it, and read the state from what is left and the first half of the log again."""
    log, path = _streamed_log(spark, sf_dir), scratch_path(spark, "compacted")
    index_store.save_index(sync.compact_log(log), path)
    late = log.filter(F.col("doc_id") % 2 == 0)
    state = sync.current_index(index_store.load_index(spark, path).unionByName(late))
    return state.select("doc_id", "version", "chunk_id", "text")


@query
def stream_index_upsert(spark, sf_dir):
    """The same changes merged batch by batch into a keyed table."""
    path = _followed(upsert.upsert_stream, spark, _all_changes(spark, sf_dir), buckets=32)
    return upsert.read_upserted(spark, path).select("doc_id", "version", "chunk_id", "text")


@query
def stream_index_fresh(spark, sf_dir):
    """Changes delivered twice, and many again unchanged under a later version, past a state per key."""
    changes = _all_changes(spark, sf_dir)
    again = fx.versioned_documents(spark, sf_dir).where("doc_id % 10 > 5").withColumn("version", F.lit(4).cast("long"))
    every = changes.unionByName(changes).unionByName(again.withColumn("op", F.lit("update")))
    path = _followed(sync.sync_stream, spark, every, fresh_only=True)
    return sync.current_index(index_store.load_index(spark, path)).select("doc_id", "chunk_id", "text")


@query
def stream_index_answers(spark, sf_dir):
    """From changed documents over the followed index to answers, by its own metadata."""
    return _flat_answers(
        answering.batch_predict(
            fx.questions(spark, sf_dir),
            sync.current_index(_streamed_log(spark, sf_dir)),
            hashed_embedding(fx.DIM),
            fx.K,
        )
    )


# Model calls and the answer flow


@query
def chunk_udf(spark, sf_dir):
    cut = chunking.chunk_udf(str.split, " ".join, fx.SIZE, fx.OVERLAP)
    rows = fx.documents(spark, sf_dir).select("doc_id", "text")
    made = chunking.explode_chunks(rows.withColumn("chunks", cut("text")))
    return made.select("doc_id", "chunk_no", "text")


@query
def chunk_table(spark, sf_dir):
    rows = fx.documents(spark, sf_dir).select("doc_id", "text")
    return chunking.chunk_table(rows, size=fx.SIZE, overlap=fx.OVERLAP)


@query
def embed_paced(spark, sf_dir):
    """Lengths and numbers of spaces as vectors, from a model of at most 200 batches a second."""

    def encode(texts):
        return np.array([[len(t), t.count(" ")] for t in texts])

    call = model_embedding(paced(encode, calls=200, seconds=1, lanes=8), 2)
    rows = in_lanes(fx.documents(spark, sf_dir).select("doc_id", "text"), 8)
    made = embedding.embed(rows, embedder=call)
    return made.select("doc_id", F.col("embedding")[0].cast("long").alias("chars"), F.col("embedding")[1].cast("long").alias("spaces"))


def _near(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    asked = fx.questions(spark, sf_dir)
    near = retrieval.retrieve(
        asked,
        fx.chunk_index(spark, sf_dir),
        hashed_embedding(fx.DIM),
        fx.K,
        payload=("text", "metadata"),
    )
    return asked, near


@query
def generate_answer(spark, sf_dir):
    asked, near = _near(spark, sf_dir)
    made = answering.generate_answers(near.join(asked, "question_id"))
    return made.select("question_id", "rank", "answer", "error")


def _flat_answers(answers: DataFrame) -> DataFrame:
    return answers.select(
        "question_id",
        "question",
        "answer",
        "source",
        F.col("output_metadata")["model"].alias("model"),
    )


@query
def answer_cascade(spark, sf_dir):
    return _flat_answers(answering.answer_cascade(*_near(spark, sf_dir)))


@query
def answer_early_stop(spark, sf_dir):
    asked, near = _near(spark, sf_dir)

    def length_model(chats):
        texts = [chat[-1]["content"] for chat in chats]
        return [f"length {len(t)}" if len(t) % 3 == 0 else "Sorry, no answer" for t in texts]

    return _flat_answers(answering.answer_until_good(asked, near, length_model, "length"))


@query
def batch_predict(spark, sf_dir):
    return _flat_answers(
        answering.batch_predict(
            fx.questions(spark, sf_dir),
            fx.chunk_index(spark, sf_dir),
            hashed_embedding(fx.DIM),
            fx.K,
        )
    )


@query
def grade_answers(spark, sf_dir):
    third = F.col("turn") % 3
    made = fx.table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.col("role").alias("question"),
        F.col("text").alias("answer"),
        F.when(third == 0, F.concat(F.lit(" "), F.regexp_replace("text", " ", " - "), F.lit("!")))
        .when(third == 1, F.concat("text", F.lit(" x")))
        .alias("prediction"),
    )
    return evaluation.grade_answers(made, exact_grader).select("conv_id", "turn", "grade")


@query
def evaluate_answers(spark, sf_dir):
    return evaluation.evaluate(
        fx.eval_set(spark, sf_dir), fx.chunk_index(spark, sf_dir), hashed_embedding(fx.DIM), fx.K
    )


@query
def evaluate_answers_summary(spark, sf_dir):
    return evaluation.evaluate_summary(evaluate_answers(spark, sf_dir)).select(
        "n_rows",
        F.round("accuracy", 6).alias("accuracy"),
        F.round("source_rate", 6).alias("source_rate"),
    )
