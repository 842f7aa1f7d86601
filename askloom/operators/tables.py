"""Helpers on whole tables: counts, longest text, pages, batches, date windows, scripts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.functions.text import script_statements
from askloom.session import materialize

BATCH_ROWS = 500


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))


def longest(df: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The row with the longest text; equal lengths go to the smaller key."""
    return df.orderBy(F.length(text).desc_nulls_last(), *keys).limit(1)


def head(df: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """The first n rows of the key order."""
    return df.orderBy(*keys).limit(n)


def _placed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows in key order, stored with their place: partition above bit 33, position below."""
    return materialize(
        df.orderBy(*keys).withColumn("_at", F.monotonically_increasing_id()), "numbered"
    )


def _numbered(placed: DataFrame, out: str) -> DataFrame:
    run, position = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(run.alias("_run")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        # starts has one row per partition of the sort: a proven bound
        placed.withColumn("_run", run)
        .join(F.broadcast(starts), "_run")
        .withColumn(out, F.col("_start") + position + 1)
        .drop("_at", "_run", "_start")
    )


def number_rows(df: DataFrame, keys: Sequence[str], out: str = "row_no") -> DataFrame:
    """Number all rows 1.. in key order without passing them through one task.

    A range sort gives each partition a run of the order; the position inside the
    run comes from ``monotonically_increasing_id``. The sorted rows are written
    once, so that partition bounds cannot differ between the two uses, and a
    table with one row per partition supplies the start of each run. The sort
    samples its input first: pass a stored table, not a long computation.
    """
    return _numbered(_placed(df, keys), out)


def page(df: DataFrame, limit: int, offset: int, keys: Sequence[str]) -> DataFrame:
    """Limit first, then skip: rows ``offset + 1 .. limit`` of the key order, which must be a total one.

    Only the keys are sorted and numbered; the wanted ones are joined back to the rows, so no text is
    moved for rows outside the page. The rows of the page come in no promised order.
    """
    wanted = number_rows(materialize(df.select(*keys), "keys"), keys, "_row_no")
    wanted = wanted.filter(F.col("_row_no").between(offset + 1, limit)).select(*keys)
    return df.join(wanted, list(keys), "left_semi")


def batches(
    df: DataFrame,
    size: int = BATCH_ROWS,
    keys: Sequence[str] = ("chunk_id",),
    full_only: bool = False,
) -> DataFrame:
    """Number fixed-size batches from 0 in key order.

    ``full_only`` drops a last short batch, as a loop over ``count // size`` would.
    The rows are stored before they are sorted, because the sort samples its input.
    """
    placed = _placed(materialize(df, "rows"), keys)
    numbered = _numbered(placed, "row_no").withColumn("batch_no", F.expr(f"(row_no - 1) div {size}"))
    return numbered.filter(F.col("batch_no") < placed.count() // size) if full_only else numbered


def _day_start(df: DataFrame, ts: str, day: dt.date) -> Column:
    """Midnight of a day as a literal of the column's own type, so the range filter is pushed down."""
    kind = df.schema[ts].dataType
    if isinstance(kind, T.DateType):
        return F.lit(day)
    text = F.lit(f"{day.isoformat()} 00:00:00")
    return F.to_timestamp_ntz(text) if isinstance(kind, T.TimestampNTZType) else F.to_timestamp(text)


def _as_date(day: dt.date | str) -> dt.date:
    return dt.date.fromisoformat(day) if isinstance(day, str) else day


def _days(df: DataFrame, ts: str, first: dt.date, last: dt.date) -> DataFrame:
    after = last + dt.timedelta(days=1)
    return df.filter((F.col(ts) >= _day_start(df, ts, first)) & (F.col(ts) < _day_start(df, ts, after)))


def date_window(df: DataFrame, ts: str, today: dt.date | str, lookback: int = 1) -> DataFrame:
    """Rows from ``today - (lookback + 1)`` through yesterday, both days included."""
    day = _as_date(today)
    return _days(df, ts, day - dt.timedelta(days=lookback + 1), day - dt.timedelta(days=1))


def snapshot(df: DataFrame, ts: str, today: dt.date | str) -> DataFrame:
    """Rows of yesterday."""
    yesterday = _as_date(today) - dt.timedelta(days=1)
    return _days(df, ts, yesterday, yesterday)


def split_scripts(df: DataFrame, script: str, keys: Sequence[str]) -> DataFrame:
    """One row per statement of each script, ``statement_no`` from 0 in script order."""
    return df.select(
        *keys, F.posexplode(script_statements(script)).alias("statement_no", "statement")
    )
