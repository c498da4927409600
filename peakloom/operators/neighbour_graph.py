"""Approximate search by a graph of nearest neighbours: built by rounds of joins, searched by a beam of joins.

Build: rows are put in the order of a random projection, several times, and cut into groups of ``GROUP`` rows; the nearest in a group are a
row's first neighbours. Then rounds (NN-descent): what two neighbours of a row have in common is likely near, so each row introduces its
neighbours, and those it is a neighbour of, to each other, and every row keeps the best it has met: ``WIDER`` times the ``k`` of the result, since with few it
would stop short of the nearest. A row introduces twice as many others at most, however many have it as a neighbour, so every group is bounded.

Search: each query holds a beam of its ``ef`` best so far, starting from fixed rows, twice the square root of all
but ``ENTRIES`` at most, so that some lie in every region that has its share of rows. A step joins the best rows not yet followed with
their edges, compares the query with what it has not seen, and keeps the best again; it ends when all in the beam have been followed. Only rows that are
reached are compared: ``compared`` says how many.

Vectors are compared by cosine; the build compares them in steps of 1 / ``STEPS``, which steers the graph only: the search compares the rows themselves. Defined cases: rows with a null vector, one that holds null or is not as long as the longest, and queries of that kind, take
no part; zero vectors have a cosine of 0 with all; ids are unique; fewer rows than ``k`` give what there is; an empty library gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.functions import spectra as S
from peakloom.operators import pools
from peakloom.session import stored

GROUP, PROJECTIONS, ROUNDS, ENOUGH, WIDER = 64, 3, 8, 0.005, 2
ENTRIES, FOLLOWED = 512, 4
STEPS = 32767


def _units(rows: DataFrame, key: str, vector: str, size: int | None = None) -> tuple[DataFrame, int]:
    """(id, vector) of length one, as floats, and the number of components."""
    held = rows.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("vector")).where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    size = size or held.agg(F.max(F.size("vector"))).first()[0] or 0
    return held.where(F.size("vector") == size).select("id", S.unit(F.col("vector")).cast("array<float>").alias("vector")), size


def _halves(rows: DataFrame) -> DataFrame:
    """The vectors, whose components lie between -1 and 1, as bytes of two for a component: a row is sent to each of its neighbours in every round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.rint(x.values.to_numpy(zero_copy_only=False) * STEPS).astype(np.int16).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], names=["id", "vector"])

    return rows.select("id", "vector").mapInArrow(run, "id long, vector binary")


def _matrix(held: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(held.to_pylist()), np.int16).astype(np.float32).reshape(len(held), -1) / np.float32(STEPS)


def _introduced(groups: DataFrame) -> DataFrame:
    """(a, b, near) of the members (id, least, vector) of each group that are nearer to each other than the first one's least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column("members"):
                held = members.values
                ids, least, vectors = held.field("id").to_numpy(), held.field("least").to_numpy(), _matrix(held.field("vector"))
                near = vectors @ vectors.T
                np.fill_diagonal(near, -2)
                i, j = np.nonzero(near > least[:, None])
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(near[i, j].astype(np.float64))], names=["a", "b", "near"])

    return groups.select("members").mapInArrow(run, "a long, b long, near double")


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each row, each once."""
    once = edges.groupBy("a", "b").agg(F.max("near").alias("near"), F.min("new").alias("new"))
    return pools.ranked(once, [F.desc("near"), F.col("b")], ["a"], "_n").where(F.col("_n") <= k).drop("_n")


def build(library: DataFrame, k: int = 12, key: str = "vec_id", vector: str = "vector", rounds: int = ROUNDS, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """(a, b, near) with the k nearest that each row has found, and the rows (id, vector) that the search compares."""
    rows, size = _units(library, key, vector)
    kept, k = k, WIDER * k
    rows = stored(rows)
    halves = stored(_halves(rows))
    member = lambda least: F.struct("id", least.alias("least"), "vector")
    edges = None
    for i in range(PROJECTIONS):
        way = np.random.default_rng(seed + i).normal(size=size)
        placed = pools.numbered(rows.select("id", S.dot(F.col("vector"), S.doubles(way)).alias("_p")), [], ["_p", "id"], "_at")
        groups = placed.join(halves, "id").groupBy(F.floor((F.col("_at") - 1) / GROUP).alias("_g")).agg(F.collect_list(member(F.lit(-1.5))).alias("members"))
        met = _introduced(groups)
        edges = met if edges is None else edges.unionByName(met)
    edges = stored(_best(edges.withColumn("new", F.lit(1)), k))
    total = rows.count()
    for _ in range(rounds):
        # A row's neighbours, and some of those whose neighbour it is; old ones meet again only for the sake of new ones.
        back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "new")
        back = pools.ranked(back, [F.desc("new"), F.xxhash64("a", "b"), F.col("b")], ["a"], "_n").where(F.col("_n") <= k).drop("_n")
        known = edges.select("a", "b", "new").unionByName(back).groupBy("a", "b").agg(F.max("new").alias("new"))
        least = edges.groupBy("a").agg(F.min("near").alias("least"), F.count("*").alias("_c")).select(F.col("a").alias("b"), F.when(F.col("_c") < k, -1.5).otherwise(F.col("least")).alias("least"))
        held = known.join(least, "b").join(halves.withColumnRenamed("id", "b"), "b")
        groups = held.groupBy("a").agg(F.collect_list(F.struct(F.col("b").alias("id"), "least", "vector")).alias("members"), F.max("new").alias("new")).where("new = 1")
        met = _introduced(groups).withColumn("new", F.lit(1))
        after = stored(_best(edges.withColumn("new", F.lit(0)).unionByName(met), k))
        changed = after.where("new = 1").count()
        edges = after
        if changed <= ENOUGH * k * total:
            break
    return _best(edges, kept).select("a", "b", "near"), rows


def search(asked: DataFrame, graph: tuple[DataFrame, DataFrame], k: int, ef: int = 32, key: str = "query_id", vector: str = "query", most: int = 60) -> tuple[DataFrame, DataFrame]:
    """(query, vec_id, score, rank) of the k best that the beam has found but the query's own id, and (query, compared)."""
    edges, rows = graph
    first = rows.select(F.size("vector")).first()
    queries = stored(_units(asked, key, vector, first[0] if first else 1)[0].withColumnsRenamed({"id": "q", "vector": "asked"}))
    # Both ways, so that a row which is nobody's neighbour is reached from its own; twice the row's own number at most.
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "near")
    width = edges.groupBy("a").count().agg(F.max("count")).first()[0] or 1
    back = pools.ranked(back, [F.desc("near"), F.col("b")], ["a"], "_n").where(F.col("_n") <= width).drop("_n")
    ways = stored(edges.unionByName(back).select("a", "b").distinct())

    def compared(pairs: DataFrame) -> DataFrame:
        near = pairs.join(queries, "q").join(rows, "id").select("q", "id", S.dot(F.col("asked"), F.col("vector")).alias("near"))
        return near.withColumn("open", F.lit(True))

    starts = min(ENTRIES, int(2 * rows.count() ** 0.5) + 1)
    entries = [r.id for r in rows.orderBy(F.xxhash64("id"), "id").select("id").limit(starts).collect()]
    seen = stored(compared(queries.select("q", F.explode(F.lit(entries).cast("array<bigint>")).alias("id"))))
    for _ in range(most):
        beam = pools.ranked(seen, [F.desc("near"), F.col("id")], ["q"], "_n").where(F.col("_n") <= ef)
        follow = stored(pools.ranked(beam.where("open"), [F.col("_n")], ["q"], "_m").where(F.col("_m") <= FOLLOWED).select("q", "id"))
        if follow.isEmpty():
            break
        reached = follow.join(ways.withColumnRenamed("a", "id"), "id").select("q", F.col("b").alias("id")).distinct().join(seen.select("q", "id"), ["q", "id"], "left_anti")
        done = seen.join(follow.withColumn("_f", F.lit(True)), ["q", "id"], "left").select("q", "id", "near", (F.col("open") & F.col("_f").isNull()).alias("open"))
        seen = stored(done.unionByName(compared(reached)))
    best = pools.ranked(seen.where("q <> id").withColumn("score", F.round("near", 6)), [F.desc("score"), F.col("id")], ["q"]).where(F.col("rank") <= k)
    return best.select(F.col("q").alias(key), F.col("id").alias("vec_id"), "score", "rank"), seen.groupBy(F.col("q").alias(key)).agg(F.count("*").alias("compared"))
