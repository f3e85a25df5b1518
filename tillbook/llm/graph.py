"""Connected components as alternating star contractions; every round is a join and an aggregate over the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillbook.llm.common import settled


def _to_smallest(links: DataFrame) -> DataFrame:
    """(node, root) links of every u's neighbours in ``links`` (u, v) to the smallest node around u."""
    smallest = links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return links.join(smallest, "u").select(F.col("u"), F.col("v"), F.col("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node of its component.

    Large stars hang every larger neighbour on the smallest node around, small stars do so with the smaller ones;
    rounds end when the links stay the same, after about the square of the logarithm of the nodes at most. A hub with
    very many links is a join key like any other: minima combine before the shuffle, and skewed joins are split.
    """
    links = settled(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links"
    )
    seen = None
    while True:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _to_smallest(both).filter("v > u").select(F.col("v"), F.col("m").alias("u")).filter("u <> v").distinct()
        )
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        hung = _to_smallest(down)
        small = (
            hung.select(F.col("v").alias("v"), F.col("m").alias("u"))
            .unionByName(hung.select(F.col("u").alias("v"), F.col("m").alias("u")))
            .filter("u <> v")
            .distinct()
        )
        links = settled(small, "links")
        row = links.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        now = (row["n"], row["h"])
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
