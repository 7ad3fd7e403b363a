"""Connected components of a table of links, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (node, comp): the least node of each node's component.

    Each round is checkpointed. A node of very many links, and a label of very
    many nodes, are hot keys of the round's joins.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp"), F.count(F.lit(1)).alias("links")))
    n_links, n_nodes = both.count(), labels.count()
    while True:
        there = labels.select(F.col("node").alias("b"), F.col("comp").alias("far"), "links")
        near = hot_join(both, there, ["b"], "links", n_links).groupBy(F.col("a").alias("node")).agg(F.min("far").alias("far"))
        hop = cut(labels.join(near, "node").select("node", "links", "comp", F.least("comp", "far").alias("next")))
        asked = hop.groupBy("next").agg(F.count(F.lit(1)).alias("m"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("over")).join(asked, "next")
        new = cut(hot_join(hop, jump, ["next"], "m", n_nodes).select("node", "links", F.least("next", "over").alias("new"), "comp"))
        changed = not new.where("new < comp").isEmpty()
        labels = new.select("node", F.col("new").alias("comp"), "links")
        if not changed:
            return labels.drop("links")
