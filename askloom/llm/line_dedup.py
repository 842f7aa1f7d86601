"""Line deduplication by site-relative frequency.

A line is boilerplate of its site if more than ``ratio`` of the site's pages hold it. Pages and lines
are told apart by 64-bit hashes; a page that a site serves again counts once, so copies of a page do
not turn its content into boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.session import materialize

RATIO = 0.1
MIN_PAGES = 2

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
_UNSEEN = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
_BLOCK = r"(?i)</?(?:html|head|body|title|nav|ul|ol|li|div|article|section|header|footer|h[1-6]|p|br|table|tr|td|th|pre|blockquote)(?:\s[^>]*)?/?>"


def host_of(url: str) -> Column:
    """The host of an absolute URL in lower case, else an empty string."""
    return F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))


def page_lines(html: str) -> Column:
    """The visible lines of a page: text between block tags, trimmed, none empty."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), _UNSEEN, "")
    text = F.regexp_replace(F.regexp_replace(text, _BLOCK, "\n"), r"<[^>]*>", "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def drop_boilerplate(
    pages: DataFrame, host: Column, lines: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``pages`` with ``kept_lines`` and ``n_dropped``: the lines that are no boilerplate of ``host``.

    A line goes if it stands on at least ``min_pages`` different pages of the host, and these are more
    than ``ratio`` of the host's different pages. The least floor is two: a line on one page is not
    repeated, whatever its share; from there the ratio alone decides, on sites of every size. Lines are
    compared without outer spaces; blank ones stay. Null lines count as none; pages whose host is null
    or empty belong to no site and stay whole. All columns of ``pages`` are kept.
    """
    own = pages.columns
    lines = F.coalesce(lines, F.array().cast("array<string>"))
    rows = pages.withColumn("__lines", lines).withColumn("__host", F.xxhash64(F.nullif(host, F.lit(""))))
    rows = rows.withColumn("__known", F.coalesce(host != "", F.lit(False)))
    rows = rows.withColumn("__page", F.xxhash64("__lines"))
    blank = F.xxhash64(F.lit(None).cast("string"))
    hashes = F.array_distinct(F.transform("__lines", lambda x: F.xxhash64(F.nullif(F.trim(x), F.lit("")))))
    site = rows.where("__known").select("__host", "__page", F.array_remove(hashes, blank).alias("__hashes"))
    # All counts read this table, each page once and its lines as hashes, so they parse no line again.
    site = materialize(site.groupBy("__host", "__page").agg(F.first("__hashes").alias("__hashes")), "page-lines")
    total = site.groupBy("__host").agg(F.count("*").alias("__pages"))
    held = site.select("__host", "__page", F.explode("__hashes").alias("__line"))
    counts = held.groupBy("__host", "__line").agg(F.count("*").alias("__with")).where(F.col("__with") >= min_pages)
    common = (
        counts.join(total, "__host").where(F.col("__with") > ratio * F.col("__pages")).select("__host", "__line")
    )
    gone = held.join(common, ["__host", "__line"]).groupBy("__host", "__page").agg(F.collect_set("__line").alias("__gone"))
    joined = rows.join(gone, ["__host", "__page"], "left")
    kept = F.when(F.col("__gone").isNull() | ~F.col("__known"), F.col("__lines")).otherwise(
        F.filter("__lines", lambda x: ~F.array_contains("__gone", F.xxhash64(F.nullif(F.trim(x), F.lit("")))))
    )
    joined = joined.withColumn("kept_lines", kept).withColumn("n_dropped", (F.size("__lines") - F.size("kept_lines")).cast("long"))
    return joined.select(*own, "kept_lines", "n_dropped")
