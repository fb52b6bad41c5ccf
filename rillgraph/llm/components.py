"""Connected components of a table of links, by alternating large and small stars.

Each round joins links with their nodes' smallest neighbour; a node's links are
never gathered in one place, so a hub with a third of all links is split like
any skewed join. Rounds end when no link moves; each cuts the lineage, and the table of the round before goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _star(edges: DataFrame) -> DataFrame:
    """One large-star then one small-star step over links (a > b)."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "w")
    small = large.join(least, F.col("a") == F.col("w")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return small.union(least.toDF("a", "b")).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of links (a, b); component is its smallest id."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(most_rounds):
        before, edges = edges, written(_star(edges))
        forget(before)
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == mark:
            break
        mark = found
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots.select("id", "id"))
