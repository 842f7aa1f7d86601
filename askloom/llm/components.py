"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.session import materialize


def _least(edges: DataFrame) -> DataFrame:
    """Each edge with the least of its left end and that end's neighbours."""
    least = edges.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"))
    return edges.join(least, edges["u"] == least["_u"]).withColumn("m", F.least("u", "m"))


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = _least(large)
    rest = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` of two long columns to rows (node, component): the least node that each one reaches.

    Nodes that are the least of their component, and nodes without edges, are left out. Rounds grow
    with the logarithm of the longest path; each is written below the shared folder, and only two
    numbers of it come to the driver.
    """
    left, right = edges.columns
    edges = edges.select(
        F.greatest(left, right).alias("u"), F.least(left, right).alias("v")
    ).where("u <> v")
    edges = materialize(edges.distinct(), "edges")
    before = None
    while True:
        # Stars are a fixed point of a round; equal sums of hashes show that it was reached.
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
        edges = materialize(_round(edges), "edges")
