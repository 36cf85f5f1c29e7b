"""Connected components of a graph that may have very large stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offsetlake.llm.common import Work


def components(links: DataFrame, work: Work, name: str) -> DataFrame:
    """``id, component`` of all ends of the links ``a, b``; a component is its smallest id.

    Alternates two steps until all edges lead to roots: each node links its larger neighbours to its
    smallest one, then its smaller neighbours and itself. Both keep the components, and the rounds
    grow with the logarithm of their diameter. Minima are taken before the shuffle, so a star
    with a third of all links is no hot task. Each round is written, which cuts the lineage.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = work.keep(edges, f"{name}-0")
    step = 0
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        each = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))
        small = large.join(least, "a").select(each.alias("e")).select("e.a", "e.b").filter("a <> b")
        step += 1
        edges = work.keep(small.distinct(), f"{name}-{step}")
        work.drop(f"{name}-{step - 1}")
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("b").alias("b"))))
    return edges.select(ends.alias("e")).select(F.col("e.a").alias("id"), F.col("e.b").alias("component")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Every node has one smaller neighbour at most, and none if it has larger ones."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("n")), F.struct(F.col("b").alias("id"), F.lit(0).alias("n"))))
    nodes = edges.select(ends.alias("e")).groupBy("e.id").agg(F.sum("e.n").alias("up"), F.min("e.n").alias("root"))
    return nodes.filter("up > 1 or (up = 1 and root = 0)").isEmpty()
