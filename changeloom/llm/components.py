"""Connected components of a graph in DataFrames: the alternating large-star and small-star steps of Kiveris et al."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.common import cut, join_sizes


def components(links: DataFrame) -> DataFrame:
    """links(a BIGINT, b BIGINT) to (node, root), a row for each node that has a link; root is the component's least node.

    Each round is written to the checkpoint folder; rounds are about the logarithm of the longest chain. A node may have
    most of the links: rows of such centres aren't shuffled to one place (``join_sizes``).

    Cases: links are undirected and may repeat; a link of a node to itself and links with a null are left out; no links
    give no rows; further columns are ignored.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), "a").alias("m"), F.count("*").alias("size"))
        large = join_sizes(both.filter("b > a"), least, "a", "size", "b", 2 * mark[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("size"))
        small = join_sizes(large, least, "a", "size", "b", mark[0]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = cut(small.select("e.*").filter("a <> b").distinct())
        if (now := _mark(edges)) == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
