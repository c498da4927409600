"""The graph index finds nearly all that the exact search finds, and compares few rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from peakloom.operators import neighbour_graph, retrieval


def test_recall_and_rows_compared(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(30, 24))
    vectors = centres[r.integers(0, 30, 3000)] + 0.5 * r.normal(size=(3000, 24))
    rows = [(i, f"b{i % 3}", v.tolist()) for i, v in enumerate(vectors)] + [(9000, "b", None), (9001, "b", [1.0]), (9002, "b", [None] * 24), (9003, "b", [0.0] * 24)]
    library = spark.createDataFrame(rows, "vec_id long, bucket string, vector array<double>").repartition(4)
    asked = library.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "bucket", F.col("vector").alias("query"))
    edges, held = graph = neighbour_graph.build(library, 10)
    assert held.count() == 3001 and edges.groupBy("a").count().agg(F.max("count")).first()[0] == 10 and edges.where("a = b").isEmpty()
    near = {(x.a, x.b): x.near for x in edges.sample(0.05, 1).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    assert all(abs(unit[a] @ unit[b] - s) < 1e-4 for (a, b), s in near.items() if 9003 not in (a, b))
    found, compared = neighbour_graph.search(asked, graph, 5, ef=16)
    got = {(x.query_id, x.vec_id) for x in found.collect()}
    own = asked.where("query_id < 9000")
    want = {(x.query_id, x.vec_id) for x in retrieval.global_topk(own, library.where("vec_id < 9000"), 5).collect()}
    assert len(got & want) >= 0.9 * len(want) and all(q != v for q, v in got)
    counts = [x.compared for x in compared.collect()]
    assert sum(counts) < 0.2 * 3001 * len(counts)


def test_small_and_empty_libraries(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "vec_id long, vector array<double>")
    asked = rows.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    found, _ = neighbour_graph.search(asked, neighbour_graph.build(rows), 5)
    assert sorted((x.query_id, x.vec_id) for x in found.collect()) == [(q, v) for q in range(4) for v in range(4) if q != v]
    none = neighbour_graph.search(asked, neighbour_graph.build(rows.limit(0)), 5)[0]
    assert none.collect() == []


def test_neighbours_are_sent_in_two_bytes_for_a_component(spark):
    """What a round of the build sends of a vector is half of its floats, and compares as they do."""
    r = np.random.default_rng(5)
    vectors = r.normal(size=(50, 64)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[7] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<float>")
    held = neighbour_graph._halves(rows).orderBy("id").toArrow().column("vector").combine_chunks()
    assert all(len(x) == 128 for x in held.to_pylist())
    found = neighbour_graph._matrix(held)
    assert np.abs(found @ found.T - vectors @ vectors.T).max() < 1e-4
