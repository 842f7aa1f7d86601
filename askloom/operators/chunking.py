"""Split long texts into overlapping token windows."""

import re
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.functions.text import WHITESPACE, spaced_tokens, tokens

CHUNK_SIZE, CHUNK_OVERLAP = 2000, 300


def _check(size: int, overlap: int) -> int:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("need size > overlap >= 0")
    return size - overlap


def token_windows(
    toks: Column, size: int, overlap: int, sep: str = " ", drop_contained_tail: bool = False
) -> Column:
    """Windows of ``size`` tokens starting every ``size - overlap`` tokens, as ``array<string>``.

    A window starts as long as a token is left, so the last one may hold only
    tokens its predecessor already has; ``drop_contained_tail`` leaves that one out.
    ``toks`` should be a plain column: it is looked up once per window.
    """
    step = _check(size, overlap)
    reach = F.size(toks) - (1 + overlap if drop_contained_tail else 1)
    starts = F.when(
        F.size(toks) > 0, F.sequence(F.lit(0), F.greatest(reach, F.lit(0)), F.lit(step))
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(toks, i + 1, F.lit(size)), sep))


def with_chunks(
    df: DataFrame,
    text: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    *,
    keep_spacing: bool = False,
    drop_contained_tail: bool = False,
) -> DataFrame:
    """Add ``chunks``, the text's token windows, next to the other columns."""
    _check(size, overlap)
    toks, sep = (spaced_tokens(text), "") if keep_spacing else (tokens(text), " ")
    cut = token_windows(F.col("_toks"), size, overlap, sep, drop_contained_tail)
    return df.withColumn("_toks", toks).withColumn("chunks", cut).drop("_toks")


def explode_chunks(
    df: DataFrame, text: str = "text", key: str = "doc_id", chunks: str = "chunks"
) -> DataFrame:
    """One row per chunk: the other columns, ``num_chunks``, ``chunk_no``, ``chunk_id``, ``text``.

    The long text and the array are gone; a document without chunks gives no row.
    """
    kept = [c for c in df.columns if c not in (text, chunks)]
    # The count is taken below the explode, or every chunk row would carry the whole array.
    # An inner explode would make Spark infer a filter that cuts the text a second time,
    # once per window; the outer one with the empty row dropped afterwards does not.
    counted = df.select(*kept, F.size(chunks).alias("num_chunks"), chunks)
    return (
        counted.select(*kept, "num_chunks", F.posexplode_outer(chunks).alias("chunk_no", "_chunk"))
        .filter(F.col("chunk_no").isNotNull())
        .select(
            *kept,
            "num_chunks",
            "chunk_no",
            F.concat_ws("-", F.col(key).cast("string"), F.col("chunk_no").cast("string")).alias(
                "chunk_id"
            ),
            F.col("_chunk").alias(text),
        )
    )


def chunk_documents(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    **options: bool,
) -> DataFrame:
    """Documents to chunk rows, narrow and JVM-side from scan to output."""
    return explode_chunks(with_chunks(df, text, size, overlap, **options), text, key)


def chunk_udf(
    encode: Callable[[str], Sequence],
    decode: Callable[[Sequence], str],
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> Callable[[Column | str], Column]:
    """Chunk with a user's tokenizer (text to tokens and back), as an ``array<string>`` column.

    Arrow batches in and out; the tokenizer is shipped once per task, not built per row.
    """
    step = _check(size, overlap)

    def cut(text: str | None) -> list[str] | None:
        if text is None:
            return None
        toks = encode(text)
        return [decode(toks[i : i + size]) for i in range(0, len(toks), step)]

    def cut_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(cut)

    return F.pandas_udf(cut_batches, T.ArrayType(T.StringType()))


def stream_windows(
    text: str, size: int, overlap: int, drop_contained_tail: bool = False
) -> Iterator[tuple[int, int, str]]:
    """``(start, end, window)`` for each token window, one at a time; places count characters.

    No more than one window's tokens are held, however long the text is.
    """
    step = _check(size, overlap)
    held: deque[tuple[int, int]] = deque()

    def window() -> tuple[int, int, str]:
        return held[0][0], held[-1][1], " ".join(text[a:b] for a, b in held)

    first, place = True, 0
    for gap in re.finditer(WHITESPACE + r"|\Z", text):
        if gap.start() > place:
            held.append((place, gap.start()))
        place = gap.end()
        if len(held) == size:
            yield window()
            first = False
            for _ in range(step):
                held.popleft()
    while held and (first or not drop_contained_tail or len(held) > overlap):
        yield window()
        first = False
        for _ in range(min(step, len(held))):
            held.popleft()


def chunk_table(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    drop_contained_tail: bool = False,
    batch_chars: int = 1 << 20,
) -> DataFrame:
    """Chunking as an Arrow table function: ``key``, ``chunk_no``, ``start``, ``end``, ``text``.

    The rows of ``chunk_documents`` with each window's place in its text, in characters. The function
    takes batches of the two columns and gives windows back in batches of about ``batch_chars``
    characters, so a text of any length never stands beside an array of all its windows. The plan stays
    narrow. Arrow table functions cannot stand in a lateral join, so the key travels through the function;
    further columns join by it. A null or blank text gives no row. Where texts have many MB, set
    ``spark.sql.execution.arrow.maxBytesPerBatch``.
    """
    _check(size, overlap)
    kind = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            T.StructField("chunk_no", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("text", T.StringType()),
        ]
    )
    if key in kind.names[1:]:
        raise ValueError(f"the key may not be named {key}")

    class Chunks:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            keys, texts = rows.column(0), rows.column(1)
            places, chunks, held = [], [], 0

            def batch() -> pa.RecordBatch:
                numbers, starts, ends, windows = zip(*chunks) if chunks else ((), (), (), ())
                columns = [
                    keys.take(pa.array(places, pa.int32())),
                    pa.array(numbers, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(ends, pa.int64()),
                    pa.array(windows, pa.string()),
                ]
                return pa.RecordBatch.from_arrays(columns, kind.names)

            for place in range(len(texts)):
                windows = stream_windows(texts[place].as_py() or "", size, overlap, drop_contained_tail)
                for number, (start, end, window) in enumerate(windows):
                    places.append(place)
                    chunks.append((number, start, end, window))
                    held += len(window)
                    if held >= batch_chars:
                        yield batch()
                        places, chunks, held = [], [], 0
            yield batch()

    return F.arrow_udtf(Chunks, returnType=kind)(df.select(key, text).asTable())


def metadata_map(columns: Sequence[str]) -> Column:
    """The named columns as one map from name to value, as strings."""
    pairs = [part for c in columns for part in (F.lit(c), F.col(c).cast("string"))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def with_metadata(
    df: DataFrame, text: str = "text", exclude: Sequence[str] = ("text", "num_chunks")
) -> DataFrame:
    """The text as ``page_content`` and all columns not excluded as one string map ``metadata``."""
    kept = [c for c in df.columns if c not in exclude]
    return df.select(F.col(text).alias("page_content"), metadata_map(kept).alias("metadata"))
