"""Band joins against plain loops, combinations against all multisets."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from peakloom.operators import bands, fragments, pools


def plain_pairs(left, right, tolerance):
    """Greedy over all pairs in the order of distance, positions and ranks among equal positions."""
    ok = lambda rows: [(g, at, k) for g, k, at in rows if g is not None and at is not None and abs(at) < float("inf")]
    out = []
    left, right = sorted(ok(left)), sorted(ok(right))
    for g in {x[0] for x in left}:
        a, b = [x[1:] for x in left if x[0] == g], [x[1:] for x in right if x[0] == g]
        rank = lambda rows, i: sum(x[0] == rows[i][0] for x in rows[:i])
        pairs = sorted((abs(x[0] - y[0]), x[0], y[0], rank(a, i), rank(b, j), i, j) for i, x in enumerate(a) for j, y in enumerate(b) if abs(x[0] - y[0]) <= tolerance)
        used_a, used_b = set(), set()
        for d, *_, i, j in pairs:
            if i not in used_a and j not in used_b:
                used_a.add(i), used_b.add(j)
                out.append((g, a[i][1], b[j][1], d))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_pairs_are_those_of_taking_the_best_again_and_again(spark, seed):
    r = random.Random(seed)
    grid = [0.1, 0.25, 1.0, 0.5][seed]
    some = lambda base: [(r.choice(["a", "b"]), base + i, round(r.randint(0, 40) * grid, 6)) for i in range(70)]
    odd = [("a", 900, None), ("a", 901, float("nan")), ("b", 902, float("inf")), (None, 903, 1.0), ("a", 904, -0.05)]
    left, right = some(0) + odd, some(1000) + [(g, k + 1000, at) for g, k, at in odd]
    l = spark.createDataFrame(left, "g string, l long, x double").repartition(3)
    r_ = spark.createDataFrame(right, "g string, r long, y double").repartition(3)
    tolerance = [0.3, 0.25, 2.0, 0.5][seed]
    found = bands.paired(l, r_, "l", "r", "x", "y", tolerance, ("g",)).collect()
    assert sorted((x.g, x.l, x.r, round(x.distance, 9)) for x in found) == [(g, a, b, round(d, 9)) for g, a, b, d in plain_pairs(left, right, tolerance)]
    plan = bands.within(l, r_.withColumnRenamed("g", "h"), "x", "y", tolerance)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    near = bands.within(l, r_, "x", "y", tolerance, ("g",)).select("l", "r").collect()
    want = [(k, m) for g, k, x in left for h, m, y in right if g == h and g and x is not None and y is not None and abs(x - y) <= tolerance]
    assert sorted(map(tuple, near)) == sorted(want)


def test_a_hot_position_pairs_in_one_round(spark):
    l = spark.range(30_000).select(F.col("id").alias("l"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") + 100.0).alias("x"))
    r = spark.range(12_000).select(F.col("id").alias("r"), F.lit(5.01).alias("y"))
    found = bands.paired(l, r, "l", "r", "x", "y", 0.1).agg(F.count("*"), F.countDistinct("l"), F.countDistinct("r"), F.max("r"), F.max(F.col("l") - 3 * F.col("r"))).first()
    assert tuple(found) == (10_000, 10_000, 10_000, 9_999, 0)


def test_chains_and_empty_sides(spark):
    gaps, at, left, right = [10, 9, 8, 7, 6, 5, 4, 3], 0.0, [], []
    for i, gap in enumerate([0, *gaps]):
        at += gap
        (left if i % 2 == 0 else right).append(("a", i, at))
    schema = "g string, {0} long, {1} double"
    l, r = spark.createDataFrame(left, schema.format("l", "x")), spark.createDataFrame(right, schema.format("r", "y"))
    assert sorted((x.g, x.l, x.r, x.distance) for x in bands.paired(l, r, "l", "r", "x", "y", 20.0, ("g",)).collect()) == plain_pairs(left, right, 20.0)
    assert bands.paired(l.limit(0), r, "l", "r", "x", "y", 20.0, ("g",)).collect() == []
    assert bands.paired(l, r, "l", "r", "x", "y", 0.5).collect() == []


def test_covers(spark):
    peaks = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 2.0), (2, 9.0), (3, None)], "query_id long, peak double")
    shifts = spark.createDataFrame([(7, 1.1), (7, 0.95), (8, 1.0), (8, 2.2), (9, 50.0), (6, 2.0)], "fragment_id long, shift double")
    assert [tuple(x) for x in bands.covers(peaks, shifts, 0.25, 2).orderBy("rank").collect()] == [(1, 8, 2, 0.2, 1), (1, 6, 1, 0.0, 2)]


@pytest.mark.parametrize("grid", [0.05, 0.5, 2.0])
def test_covers_are_those_of_all_pairs(spark, grid):
    """Fragments near few of the peaks go by lists, those near many by pairs; the best are the same, ties too."""
    r = random.Random(3)
    asked = {q: [round(r.randint(0, int(60 / grid)) * grid, 6) for _ in range(r.choice([1, 3, 5]))] for q in range(25)}
    parts = {100 + f: [round(r.randint(0, int(60 / grid)) * grid, 6) for _ in range(r.choice([1, 2, 2, 4]))] for f in range(300)}
    frames = [spark.createDataFrame([(k, x) for k, v in rows.items() for x in v], s).repartition(3) for rows, s in ((asked, "query_id long, peak double"), (parts, "fragment_id long, shift double"))]
    want = set()
    for q, peaks in asked.items():
        rows = []
        for f, shifts in parts.items():
            near = [min(abs(p - s) for s in shifts) for p in set(peaks) if any(abs(p - s) <= 0.6 for s in shifts)]
            if near:
                rows.append((-len(near), round(sum(near), 6), f))
        want |= {(q, f, -n, d, i) for i, (n, d, f) in enumerate(sorted(rows)[:4], 1)}
    assert {(x.query_id, x.fragment_id, x.covered, x.distance, x["rank"]) for x in bands.covers(*frames, 0.6, 4).collect()} == want


def test_covers_make_no_row_for_each_query_and_fragment(spark, monkeypatch):
    peaks = spark.range(400).selectExpr("id AS query_id", "explode(array(1D + id % 3, 10D)) AS peak")
    parts = spark.range(3000).selectExpr("id AS fragment_id", "10D + (id % 7) / 100 AS shift")

    def pairs(*_):
        raise AssertionError("1,200,000 pairs of queries and fragments")

    monkeypatch.setattr(bands, "within", pairs)
    found = bands.covers(peaks, parts, 0.25, 2)
    assert [x.fragment_id for x in found.where("query_id = 5").orderBy("rank").collect()] == [0, 7] and found.count() == 800


def test_numbered_in_order(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 11).cast("string")).alias("g"), F.hash("id").alias("k"))
    found = pools.numbered(rows, ["g"], ["k"]).collect()
    by = {}
    for x in sorted(found, key=lambda x: x.k):
        by.setdefault(x.g, []).append(x.rank)
    assert len(found) == 5000 and all(v == list(range(1, len(v) + 1)) for v in by.values())


@pytest.mark.parametrize("target,least,most", [((6, 3), 1, 6), ((4, 0), 3, 5), ((5, 2), 2, 3), ((0, 0), 1, 3)])
def test_combinations_meet_in_the_middle(spark, target, least, most):
    buckets = [("a", [1, 0], 1.5), ("b", [2, 1], 0.25), ("c", [1, 1], 4.0), ("d", [3, 0], 2.0), ("e", [7, 0], 9.0), ("f", [0, 0], 8.0), ("g", [1, 0], 0.5)]
    usable = [b for b in buckets if any(b[1]) and all(x <= t for x, t in zip(b[1], target, strict=True))]
    want = sorted((tuple(x[0] for x in c), n, sum(x[2] for x in c)) for n in range(least, most + 1) for c in itertools.combinations_with_replacement(usable, n) if tuple(map(sum, zip(*(x[1] for x in c), strict=True))) == target)
    rows = spark.createDataFrame(buckets, "k string, c array<int>, s double")
    found = fragments.bucket_combinations(rows, F.array(*map(F.lit, target)), "k", "c", "s", least, most)
    assert sorted((tuple(x["keys"]), x["size"], x.score) for x in found.collect()) == want
    wide = fragments.bucket_combinations(rows, F.array(*map(F.lit, target)), "k", "c", "s", least, most, beam=100)
    assert sorted((tuple(x["keys"]), x["size"], x.score) for x in wide.collect()) == want
    for x in (found, wide):
        assert "NestedLoop" not in x._jdf.queryExecution().toString()


def test_lists_are_paired_in_their_row(spark, monkeypatch):
    """Short lists never become rows of a round; long ones do, and both give the pairs of taking the best again and again."""
    r = random.Random(11)
    value = lambda: r.choice([None, float("nan"), float("inf")]) if r.random() < 0.05 else r.randint(0, 60) / 2
    rows = [(n if n else None, [value() for _ in range(r.randint(0, 12))], [value() for _ in range(r.randint(0, 12))]) for n in range(40)] + [(99, None, [1.0])]

    def plain(h, c):
        near = sorted((abs(x - y), x, y, i, j) for i, x in enumerate(h or []) for j, y in enumerate(c or []) if x is not None and y is not None and abs(x - y) <= 2)
        used, out = (set(), set()), set()
        for d, _, _, i, j in near:
            if i not in used[0] and j not in used[1]:
                used[0].add(i), used[1].add(j), out.add((i, j, d))
        return out

    want = {(n, *p) for n, h, c in rows for p in plain(h, c)}
    asked = spark.createDataFrame(rows, "id long, h array<double>, c array<double>")
    for most in (4096, 20):
        monkeypatch.setattr(bands, "IN_PLACE", most)
        found = bands.paired_lists(asked, "h", "c", 2.0)
        assert {tuple(x) for x in found.select("id", "h", "c", "distance").collect()} == want
        if most == 4096:
            assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
