"""The registered queries of this subpackage; each thin, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm import (
    class_lm,
    hard_negatives,
    line_dedup,
    orchard,
    outliers,
    packing,
    piece_codec,
    quality_model,
    sharding,
    simhash_dedup,
    substring_dedup,
    topk_search,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substring_dedup.remove_repeated_spans(docs)
    return cut.select("doc_id", "cut.n_words", "cut.n_removed", "cut.kept_sha256")


@query
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash_dedup.near_duplicates(docs, shingle=3, radius=2)


@query
def op3_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = outliers.judge_documents(docs)
    return judged.select("doc_id", *outliers.NAMES, "base_failed", "kept")


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_model.score_documents(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query
def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), lists=False)


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.shard_by_bytes(docs, shards=16)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    lines = line_dedup.page_lines("html")
    kept = line_dedup.drop_boilerplate(pages, line_dedup.host_of("url"), lines)
    return kept.select(
        "page_id",
        line_dedup.host_of("url").alias("host"),
        (F.size("kept_lines") + F.col("n_dropped")).cast("long").alias("n_lines"),
        "n_dropped",
        F.concat_ws("\n", "kept_lines").alias("kept_text"),
    )


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks, model = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("tiktoken", "json"))
    return packing.pack_documents(docs, ranks, model, size=1024, ids=False)


@query
def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return class_lm.score_texts(docs, ~quality_model.held_out("doc_id", 7, 2))


@query
def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk_search.exact_top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.expr("vec_id % 7 = 0"), F.expr("(label + 1) % 10")).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives.mine_negatives(vectors, vectors.where("vec_id % 100 = 0"), positives=5, negatives=5)


@query
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), threshold=0.7)
    return scored.select("doc_id", "held_out", "score", "predicted")


@query
def op13_orchard_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return orchard.cluster_vectors(vectors, k=40, rounds=5, length=64, seed="2")
