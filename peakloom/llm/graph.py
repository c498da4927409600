"""Connected components of links in a DataFrame, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import durable, removed


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for every node of the links (a, b); a component is named by its smallest node.

    Large-star and small-star steps in turn (Kiveris et al., 2014), each as a grouped minimum and a join. The minima are written
    before they are joined, so that a node with any number of links is a plain join that adaptive execution can split. Every
    round is written to the shared folder, and the one before it removed; the result is a written table.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(most):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = durable(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lowest = durable(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = durable(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        removed(edges, least, large, lowest)
        edges = after
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if now == before:
            roots = edges.select("v").distinct()
            found = durable(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("component"))), "components")
            removed(edges)
            return found
        before = now
    raise RuntimeError(f"the components haven't settled after {most} rounds")
