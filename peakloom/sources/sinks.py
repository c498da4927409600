"""Writers: graph parts, pools, search results and class maps; each is one committed Spark write."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.sources.adapters import Parts, counted


def graph(p: Parts, path: str, form: str = "json") -> None:
    """Each kind in a folder of its own, by source."""
    for kind in ("nodes", "edges", "documents", "aliases"):
        rows = getattr(p, kind)
        if rows is not None:
            rows.write.mode("overwrite").partitionBy("source").format(form).save(f"{path}/{kind}")


def manifest(p: Parts, version: str = "1") -> DataFrame:
    """One row: version, counts by source and kind as JSON, time."""
    rows = counted(p).orderBy("source", "kind")
    listed = rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct("source", "kind", "n")))).alias("counts"), F.sum("n").alias("total"))
    return listed.select(F.lit(version).alias("schema_version"), "counts", "total", F.current_timestamp().alias("written"))


def pool(candidates: DataFrame, folder: str, query: dict, prefix: str = "pool") -> str:
    """A pool under a new name: the query, the number of candidates and the candidates in their order."""
    name = f"{folder}/{prefix}_{time.strftime('%Y%m%d_%H%M%S')}_{uuid.uuid4().hex[:8]}.json"
    columns = candidates.columns
    held = candidates.agg(F.count("*").alias("count"), F.sort_array(F.collect_list(F.struct(*columns))).alias("candidates"))
    asked = F.from_json(F.lit(json.dumps(query)), "map<string,string>")
    held.select(asked.alias("query"), "count", "candidates").coalesce(1).write.json(name)
    return name


def results(ranks: DataFrame, path: str, by: str = "query_id") -> None:
    """A line for each query with its ranked results."""
    others = ["rank", *[c for c in ranks.columns if c not in (by, "rank")]]
    ranks.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*others))).alias("results")).write.mode("overwrite").json(path)


def events(spark: SparkSession, path: str, rows: list[dict]) -> None:
    """Appends trace events."""
    spark.createDataFrame([(r.get("ts"), r.get("event"), json.dumps(r, sort_keys=True, default=str)) for r in rows], "ts string, event string, payload string").coalesce(1).write.mode("append").json(path)


def memory(cases: DataFrame, path: str, namespace: str = "confirmed_cases", most: int = 10000) -> int:
    """The first cases by key, a line each with namespace, key and value; returns how many were written."""
    others = [c for c in cases.columns if c != "key"]
    chosen = cases.orderBy("key").limit(most)
    chosen.select(F.lit(namespace).alias("namespace"), "key", F.struct(*others).alias("value")).write.mode("overwrite").json(path)
    return cases.sparkSession.read.schema("key string").json(path).count()
