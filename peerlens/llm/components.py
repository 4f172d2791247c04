"""Connected components of links, by contraction: links, labels and vertices stay in tables all the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written_table


def components(links: DataFrame, name: str) -> DataFrame:
    """node, component for every node of `links` (a, b long): the smallest node reachable.

    In a round every vertex joins its smallest neighbour, if that is smaller; links are then drawn between what has been
    joined, and those within one vertex fall away. Minima are pre-aggregated, so a vertex with very many links costs no
    task more than its share; what is left shrinks by a constant factor a round where node numbers are hashes.
    Null ends are left out; no links give no rows.
    """
    left = links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = written_table(left.distinct(), f"{name}-links")
    labels = None
    while not left.isEmpty():
        ends = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        joins = written_table(ends.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("m")), f"{name}-joins")
        if labels is None:
            labels = joins.select(F.col("v").alias("node"), F.col("m").alias("component"))
        else:
            labels = labels.join(joins, F.col("component") == F.col("v"), "left").select("node", F.coalesce("m", "component").alias("component"))
            labels = written_table(labels, f"{name}-labels")
        low, high = joins.select(F.col("v").alias("a"), F.col("m").alias("ma")), joins.select(F.col("v").alias("b"), F.col("m").alias("mb"))
        drawn = left.join(low, "a").join(high, "b").where("ma <> mb")
        left = written_table(drawn.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct(), f"{name}-links")
    if labels is None:
        return links.sparkSession.createDataFrame([], "node long, component long")
    return labels
