"""Connected components by alternating stars, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from solvenza.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), the root being its component's
    smallest node.

    Large star: every node ties its larger neighbours to the smallest it sees; small
    star: it ties its smaller ones and itself. Rounds grow with the logarithm of the
    graph, the links never grow in number, and one fixed-size row a round reaches the
    driver. Links of a node with very many neighbours stay spread: their smallest is
    combined before the shuffle, and the join back may split them.
    """
    tied = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs, before = written(tied.distinct(), "links"), None
    while True:
        state = pairs.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == before or not state.n:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                pairs.select("v", "v").distinct()
            )
        before = state
        pairs = written(_small(written(_large(pairs), "large-star")), "small-star")


def _large(pairs: DataFrame) -> DataFrame:
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    tied = both.filter("v > u").join(least, "u")
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    tied = pairs.join(least, "u")
    others = tied.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()
