"""Connected components by alternating large-star and small-star steps.

Every node is linked to the smallest node of its neighbourhood, first among larger neighbours, then
among smaller ones, until the graph is a set of stars. Each round is written to the shared checkpoint
folder. Minima are combined before the shuffle, so a hub of any degree is a running minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictaudit.session import materialize


def _star(pairs: DataFrame) -> DataFrame:
    """For directed pairs (u, v): v and u linked to the smallest of u and its v."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(low, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in ``links`` (a, b); the component is its smallest node."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .distinct(), "cc")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        starred = _star(large)
        small = (starred.select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .union(starred.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b")
                 .select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
        edges = materialize(small, "cc")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
