"""Index synchronisation as streams that run to the end of their input and stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from askloom.functions.vectors import hashed_embedding
from askloom.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, with_chunks
from askloom.operators.embedding import Embedder, add_metadata, embed
from askloom.operators.index import content_hash
from askloom.streaming.state import fresh_changes

CHANGE_HASH = "change_hash"


def index_changes(
    changes: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    embedder: Embedder | None = None,
    op_col: str = "op",
) -> DataFrame:
    """Changed documents to index log rows; a delete (or a chunkless text) keeps one marker row.

    Narrow and stateless, so it runs the same on a stream and on a table. Every
    row carries the content hash of its change, and ``metadata``, a map of its other columns.
    """
    hashed = add_metadata(changes.withColumn(CHANGE_HASH, content_hash(changes)), (text, op_col, CHANGE_HASH))
    kept = [c for c in hashed.columns if c != text]
    live = F.when(~F.col(op_col).eqNullSafe("delete"), F.col(text))
    cut = with_chunks(hashed.withColumn(text, live), text, size, overlap)
    rows = cut.select(*kept, F.posexplode_outer("chunks").alias("chunk_no", text))
    named = rows.withColumn(
        "chunk_id",
        F.when(
            F.col("chunk_no").isNotNull(),
            F.concat_ws("-", F.col(key).cast("string"), F.col("chunk_no").cast("string")),
        ),
    )
    return embed(named, text, embedder or hashed_embedding())


def sync_stream(
    spark: SparkSession,
    source_dir: str,
    schema: T.StructType,
    index_path: str,
    checkpoint: str,
    *,
    max_files_per_trigger: int = 1000,
    fresh_only: bool = False,
    **options,
) -> StreamingQuery:
    """Follow a folder of change files (key, op, version, text) into an index log, then stop.

    ``fresh_only`` keeps a state per key (``state.fresh_changes``) before the embedder: redelivered, stale
    and unchanged documents are neither embedded nor written again.

    The file sink commits each batch once, so a restart after a failure neither
    loses nor doubles rows. The log is append-only; ``current_index`` reads the
    state from it, by version and not by arrival, so late changes are harmless.
    """
    changes = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(source_dir)
    )
    if fresh_only:
        names = {k: options[k] for k in ("key", "op_col") if k in options}
        changes = fresh_changes(changes, **names)
    return (
        index_changes(changes, **options)
        .writeStream.format("parquet")
        .option("path", index_path)
        .option("checkpointLocation", checkpoint)
        .option("compression", "zstd")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def compact_log(log: DataFrame, key: str = "doc_id", version: str = "version") -> DataFrame:
    """The log rows of each key's last change, deletes as their marker rows: a shorter log of the same state.

    Written to a new folder it replaces the log, and later changes may follow it: older versions that
    still arrive lose against the rows it keeps. Two different changes under one version are settled by
    content hash, and a change delivered twice counts once. Versions are reduced per task before their
    shuffle, one row per change, and no text or vector enters an aggregate. The join back is an
    equi-join that Spark may split when one key holds much of the log.
    """
    last = (
        log.filter(F.coalesce(F.col("chunk_no"), F.lit(0)) == 0)
        .groupBy(key)
        .agg(F.max(F.struct(version, CHANGE_HASH)).alias("_last"))
        .select(key, f"_last.{version}", f"_last.{CHANGE_HASH}")
    )
    same = [key, version, CHANGE_HASH]
    one = Window.partitionBy(*same, "chunk_no").orderBy("chunk_id")
    kept = log.join(last, same).withColumn("_row", F.row_number().over(one)).filter("_row = 1")
    return kept.select(*log.columns)


def current_index(
    log: DataFrame, key: str = "doc_id", version: str = "version", op_col: str = "op"
) -> DataFrame:
    """The index a log stands for: the chunks of each key's last change, deletes left out."""
    alive = ~F.col(op_col).eqNullSafe("delete") & F.col("chunk_id").isNotNull()
    return compact_log(log, key, version).filter(alive).drop(op_col, CHANGE_HASH)


def build_incremental(
    spark: SparkSession,
    chunk_dir: str,
    schema: T.StructType,
    index_path: str,
    checkpoint: str,
    *,
    text: str = "text",
    embedder: Embedder | None = None,
    max_files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Embed a folder of chunk files batch by batch and append each batch to the index, then stop.

    Each row gets ``metadata``, a map of its columns other than the text, unless it has one.

    The first batch creates the index; a later run picks up only new files.
    ``max_files_per_trigger`` sets the pace for rate-limited models.
    """
    chunks = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(chunk_dir)
    )
    return (
        embed(add_metadata(chunks, (text,)), text, embedder)
        .writeStream.format("parquet")
        .option("path", index_path)
        .option("checkpointLocation", checkpoint)
        .option("compression", "zstd")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
