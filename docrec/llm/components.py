"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrec.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` (undirected, longs) -> ``node, label``: the smallest node that each node of an edge can reach.

    Alternating large-star and small-star steps: each hangs the neighbours of a node on the smallest node it sees, so
    edges turn into stars in a few rounds. Each round is written to the shared folder; nothing comes to the driver but
    the count and checksum by which a round without change is known.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "links-least")  # written, so that the join on a star's centre can be split
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "links-large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "links-least")
        hung = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = stored(hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
