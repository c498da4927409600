"""The best pairs by blocks against the plain join, with vectors of odd sizes and values."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.operators import best_pairs, pools, retrieval


@pytest.fixture(scope="module")
def vectors(spark):
    r = random.Random(5)
    rows = [(i, r.choice([0, 1, 2, None]), [r.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(300)]
    odd = [None, [], [0.0] * 4, [1.0, 0.5], [1.0, None, 0.0, 0.0], [math.nan, 0.0, 0.0, 1.0], [math.inf, 1.0, 0.0, 0.0], [1.0] * 5, [1e30, 1.0, 0.0, 0.0], [1e-30, 0.0, 0.0, 0.0]]
    rows += [(300 + i, i % 2, v) for i, v in enumerate(odd)]
    return spark.createDataFrame(rows, "vec_id long, bucket int, vector array<double>").repartition(3)


def _plain(asked, library, k, own):
    pairs = asked.join(library, "bucket") if own else asked.drop("bucket").crossJoin(library)
    scored = pairs.where("query_id <> vec_id").withColumn("score", F.round(retrieval.cosine(F.col("query"), F.col("vector")), 6))
    return pools.ranked(scored, [F.desc("score"), F.col("vec_id")], ["query_id"]).where(F.col("rank") <= k).select("query_id", "vec_id", "bucket", "score", "rank")


def _rows(found):
    return sorted(repr(tuple(r)) for r in found.select("query_id", "vec_id", "bucket", "score", "rank").collect())


def test_as_the_plain_join(vectors, monkeypatch):
    asked = vectors.where("vec_id % 10 = 0 OR vec_id >= 300").select(F.col("vec_id").alias("query_id"), "bucket", F.col("vector").alias("query"))
    want, every = _rows(_plain(asked, vectors, 4, True)), _rows(_plain(asked, vectors, 6, False))
    for name, value in ((None, None), ("SENT_BYTES", 1500), ("QUERIES", 3), ("ROWS", 7), ("PAIRS", 5)):
        with monkeypatch.context() as patch:
            if name:
                patch.setattr(best_pairs, name, value)
            assert _rows(retrieval.bucket_topk(asked, vectors, 4)) == want
            if name in ("SENT_BYTES", "QUERIES"):
                assert _rows(retrieval.global_topk(asked, vectors, 6)) == every


def test_no_pair_is_a_row(vectors):
    asked = vectors.select(F.col("vec_id").alias("query_id"), "bucket", F.col("vector").alias("query"))
    for found in (retrieval.bucket_topk(asked, vectors, 4), retrieval.global_topk(asked, vectors, 4)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "CartesianProduct" not in plan
    assert retrieval.global_topk(asked.limit(0), vectors, 4).count() == 0


def test_rounding_is_spark_s(spark):
    r = random.Random(2)
    values = [0.0000005, 0.1234565, 0.1234575, -0.1234565, 1.0, -0.0, 0.9999995, 1e13 + 0.5, 1e22, math.nan, math.inf] + [r.uniform(-2, 2) for _ in range(1000)] + [round(r.uniform(-2, 2), 7) for _ in range(1000)]
    want = [x.y for x in spark.createDataFrame([(v,) for v in values], "x double").select(F.round("x", 6).alias("y")).collect()]
    assert np.array_equal(best_pairs.half_up(np.array(values)), np.array(want), equal_nan=True)


def test_residuals(vectors):
    from peakloom.operators import fragments

    rows = vectors.where("size(vector) = 4 AND vec_id < 304")
    left, right = rows.select(F.col("vec_id").alias("q"), "bucket", F.col("vector").alias("a")), rows.select(F.col("vec_id").alias("k"), "bucket", F.col("vector").alias("b"))
    off = F.aggregate(F.zip_with(F.transform("a", lambda x: 0.1 - x), "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    near = pools.ranked(left.join(right, "bucket").where("q <> k").withColumn("d", F.round(off, 6)), [F.col("d"), F.col("k")], ["q"]).where("rank <= 3")
    want = {tuple(r) for r in near.groupBy(F.least("q", "k"), F.greatest("q", "k")).agg(F.min("d")).collect()}
    assert {tuple(r) for r in fragments.nearest_residuals(rows, 0.1, "vec_id", "vector", "bucket", 3).collect()} == want


def test_equal_lists_are_asked_and_compared_once(spark, monkeypatch):
    """Vectors of equal peaks meet once, whatever their copies; scores, ties and the query's own row are those of all rows."""
    from pyspark.sql import functions as F

    from peakloom.functions import spectra as S
    from peakloom.operators import retrieval

    lists = [[], [3.0], [3.0, 3.0], [40.0], [3.0, 9.0], [3.0, 9.5], [120.0, 7.0]]
    rows = spark.createDataFrame([(i, lists[(i * i + i // 7) % len(lists)]) for i in range(90)], "vec_id long, peaks array<double>").repartition(3)
    vector = lambda peaks: S.unit(S.gaussian_vector(peaks, *S.CARBON))
    asked = rows.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "peaks")
    plain = rows.select("vec_id", vector(F.col("peaks")).alias("vector"), (F.size("peaks") > 0).alias("has"))
    want = retrieval.product_topk(asked.select("query_id", vector(F.col("peaks")).alias("query")), plain, 0.5, 4)
    met, whole = [], retrieval.best_pairs
    monkeypatch.setattr(retrieval, "best_pairs", lambda a, b, *x, **y: met.append((a.count(), b.count())) or whole(a, b, *x, **y))
    found = retrieval.alike_topk(asked, rows, vector, 0.5, 4)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() == 18 * 4
    assert max(met[0]) <= len(lists)
