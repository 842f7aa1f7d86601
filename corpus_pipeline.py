"""A training corpus from raw documents, stage by stage; every stage is one Spark job over its input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askloom.llm import line_dedup, packing, quality_model, simhash_dedup, substring_dedup
from askloom.operators.index import content_hash
from askloom.session import materialize, ship_package

#: SQL cannot express a trained classifier, SimHash groups or a fitted packing plan.
ORACLE_SQL = None


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores under 0.3 go."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_model.score_documents(docs.select(docs.columns), labels)
    return scored.where("predicted = 1").select(docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of a source's documents go; other texts stay as they are."""
    ship_package(spark)
    cut = line_dedup.drop_boilerplate(docs, F.col("source"), F.split("text", "\n"))
    text = F.when(F.col("n_dropped") > 0, F.concat_ws("\n", "kept_lines")).otherwise(F.col("text"))
    return cut.withColumn("text", text).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near-duplicates the document with the smallest id stays.

    Fingerprints of three-word shingles link at two differing bits or fewer. Rows of one id are one
    document: all its different texts stay, of rows that repeat one the row of least content hash. Rows
    without an id belong to no group and stay.
    """
    ship_package(spark)
    groups = simhash_dedup.near_duplicates(docs.select("doc_id", "text"), shingle=3, radius=2)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").withColumn("__hash", content_hash(docs))
    once = Window.partitionBy("doc_id", "text").orderBy("__hash")
    kept = kept.withColumn("__row", F.row_number().over(once)).where("__row = 1").select(docs.columns)
    return kept.union(docs.where("doc_id IS NULL"))


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in runs of 13 or more that an earlier document holds already are cut out."""
    ship_package(spark)
    cut = substring_dedup.remove_repeated_spans(docs)
    text = F.when(F.col("cut.n_removed") > 0, F.col("cut.kept_text")).otherwise(F.col("text"))
    return cut.withColumn("text", text).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in training sequences of 1024 tokens."""
    ship_package(spark)
    ranks, model = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("tiktoken", "json"))
    return packing.pack_documents(docs.select("doc_id", "text"), ranks, model, size=1024, ids=False)


STAGES = [
    ("quality classifier", keep_good_documents),
    ("line dedup", drop_boilerplate_lines),
    ("SimHash near-dedup", keep_one_of_each_group),
    ("substring dedup", drop_repeated_spans),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
