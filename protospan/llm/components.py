"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protospan.llm.store import materialize, release


def components(links: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """node and component (the least node that links reach) of every node in a link between two different nodes.

    ``rows``, if known, is about how many links there are.

    Each round turns every node's larger neighbours, then its smaller ones, to the least node around;
    it ends when the links are stars around the components' least nodes: no node has a lesser neighbour
    and another one besides. Links that are such stars already take one look. Nodes may be of any type that
    has an order. Rows that share a node meet only in sums, whose parts tasks add up first, and in joins
    of rows with one least node for each; where one node has many rows, the session's adaptive
    execution (spark.sql.adaptive.skewJoin) splits them.
    """
    edges = materialize(
        links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), rows
    )
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ends, between = both.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("m")).agg(F.sum("n"), F.count_if((F.col("n") > 1) & (F.col("m") < F.col("u")))).first()
        if not between:
            break
        now = ends // 2
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Larger neighbours of a node are those of the links in which it is the lesser end.
        larger = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))
        large = materialize(larger.join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct(), now)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), now)
        release(last, large)
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
