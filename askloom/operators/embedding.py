"""Turn chunk rows into index rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame

from askloom.functions.vectors import hashed_embedding
from askloom.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, chunk_documents, metadata_map

Embedder = Callable[[Column | str], Column]


def embed(
    df: DataFrame, text: str = "text", embedder: Embedder | None = None, out: str = "embedding"
) -> DataFrame:
    """Add the vector of a text column."""
    return df.withColumn(out, (embedder or hashed_embedding())(text))


def add_metadata(df: DataFrame, exclude: Sequence[str]) -> DataFrame:
    """A ``metadata`` map of all columns but the excluded; a table that has one keeps it."""
    if "metadata" in df.columns:
        return df
    return df.withColumn("metadata", metadata_map([c for c in df.columns if c not in exclude]))


def build_index(
    documents: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    embedder: Embedder | None = None,
) -> DataFrame:
    """Documents to index rows in one narrow plan: chunk, describe, embed; no shuffle, no collect.

    Every row carries ``metadata``, a map of the document's other columns, for the answer flow.
    """
    described = add_metadata(documents, (text,))
    return embed(chunk_documents(described, text, key, size, overlap), text, embedder)
