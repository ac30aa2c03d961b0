"""Distributed connected components over an edge table (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import SMALL, cut, spread_join


def components(edges: DataFrame, *, small: int = SMALL) -> DataFrame:
    """(node, component) of an undirected edge table (a, b); component is the smallest node reached.

    Large-star / small-star contraction: each round links the larger neighbours of a node, then the
    smaller ones, to the smallest node it sees. The edge count never grows and the minimum is a
    map-side combined aggregate; nothing is gathered per node. The minima of nodes with very many
    links are broadcast (``spread_join``: a bounded number), so their edges stay where they are.
    Rounds grow with the logarithm of the longest chain; each is cut by a checkpoint.
    """
    links = cut(edges.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if links.isEmpty():
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = spread_join(both.filter("v > u"), low, ["u"], "n", small=small).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large)
        # the larger end points at its smaller ends: tie them all to the smallest
        joined = spread_join(large, large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), ["u"], "n", small=small)
        new = joined.select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.*").filter("u <> v").distinct()
        new = cut(new)
        sign = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        links = new
        if sign == before:
            break
        before = sign
    root = links.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(root)
