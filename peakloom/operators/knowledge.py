"""Knowledge graph: entity lookup, neighbours, and evidence packs, each as one plan over node, alias and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.operators import pools


def neighbours_of(edges: DataFrame) -> DataFrame:
    """Both directions of every edge with two ends."""
    whole = edges.where("subject_id IS NOT NULL AND object_id IS NOT NULL AND subject_id <> '' AND object_id <> ''")
    shared = ["edge_id", "predicate", "source"]
    out = whole.select(F.col("subject_id").alias("node_id"), F.col("object_id").alias("neighbor_id"), F.lit("out").alias("direction"), *shared)
    return out.unionByName(whole.select(F.col("object_id").alias("node_id"), F.col("subject_id").alias("neighbor_id"), F.lit("in").alias("direction"), *shared))


def lookup(nodes: DataFrame, aliases: DataFrame, k: int, query: str = "", formula: str = "", inchikey: str = "", source: str = "") -> DataFrame:
    """Nodes by key, formula and source, formula, alias, then name; a node keeps its first reason, ties go to the smaller id."""
    tries = []
    if inchikey:
        tries.append((nodes.where(F.col("inchikey") == inchikey), F.lit("inchikey")))
    if formula and source:
        tries.append((nodes.where((F.col("formula") == formula) & (F.col("source") == source)), F.lit("formula+source")))
    if formula:
        tries.append((nodes.where(F.col("formula") == formula), F.lit("formula")))
    if query:
        named = aliases.where(F.lower("alias") == query.lower()).groupBy("node_id").agg(F.min("alias_type").alias("alias_type"))
        tries.append((nodes.join(named, "node_id"), F.concat(F.lit("alias:"), F.col("alias_type"))))
        tries.append((nodes.where(F.contains(F.lower("name"), F.lit(query.lower()))), F.lit("name_like")))
    found = None
    for n, (rows, reason) in enumerate(tries):
        one = rows.select("node_id", "name", "source", F.lit(n).alias("priority"), reason.alias("match_reason"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = nodes.limit(0).select("node_id", "name", "source", F.lit(0).alias("priority"), F.lit("").alias("match_reason"))
    best = pools.first_wins(found, ["node_id"], [F.col("priority")])
    return best.orderBy("priority", "node_id").limit(k)


def attached(neighbours: DataFrame, nodes: DataFrame, wanted: DataFrame, each: int, predicates: list[str] | None = None, sources: list[str] | None = None) -> DataFrame:
    """Up to so many neighbours of each wanted node, with names; a missing node leaves its id only."""
    rows = neighbours
    rows = rows.where(F.col("predicate").isin(*predicates)) if predicates else rows
    rows = rows.where(F.col("source").isin(*sources)) if sources else rows
    rows = rows.join(wanted.select("node_id").distinct(), "node_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("node_id").orderBy("edge_id", "direction"))
    rows = rows.withColumn("nth", place).where(F.col("nth") <= each)
    names = nodes.select(F.col("node_id").alias("neighbor_id"), F.col("name").alias("neighbor_name"))
    return rows.join(names, "neighbor_id", "left")


def evidence(found: DataFrame, documents: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Evidence items of all three kinds in one order: nodes, documents, relations."""
    sure = F.when(F.col("match_reason").isin("inchikey", "formula"), "high").otherwise("medium")
    a = found.select(F.lit(1).alias("section"), F.col("node_id").alias("item_id"), F.concat(F.lit("KG contains "), F.coalesce("name", "node_id"), F.lit(" from "), F.col("source")).alias("claim"), F.lit("").alias("evidence"), sure.alias("confidence"))
    b = documents.select(F.lit(2).alias("section"), F.col("doc_id").alias("item_id"), F.col("title").alias("claim"), F.substring("text", 1, 700).alias("evidence"), F.lit("medium").alias("confidence"))
    text = F.concat("node_id", F.lit(" --"), "predicate", F.lit("--> "), F.coalesce("neighbor_name", "neighbor_id"))
    c = neighbours.select(F.lit(3).alias("section"), F.col("edge_id").alias("item_id"), F.concat("direction", F.lit(" relation "), "predicate").alias("claim"), text.alias("evidence"), F.lit("medium").alias("confidence"))
    return a.unionByName(b).unionByName(c)
