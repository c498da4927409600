"""Refining in rounds gives what scoring and swapping everything again gives, and scores less and less."""

from __future__ import annotations

import random

import numpy as np
import pytest

from peakloom.functions.assignment import set_match
from peakloom.operators import refine


def plain(asked, fragments, candidates, keep, sigma, tolerance, offers, rounds):
    known = {q: {tuple(sorted(m)) for c, m in candidates if c == q} for q in asked}

    def best(q):
        score = lambda m: round(set_match(np.array(sorted(p for x in m for p in fragments.get(x, []))), np.array(asked[q]), sigma), 6)
        return sorted(((-score(m), m) for m in known[q]))[:keep]

    for _ in range(rounds):
        for q in asked:
            for _, m in best(q):
                held = [p for x in m for p in fragments.get(x, [])]
                missed = {a for a in asked[q] if not any(abs(p - a) <= tolerance for p in held)}
                offer = []
                for f, peaks in fragments.items():
                    near = [min(abs(p - a) for p in peaks) for a in missed if any(abs(p - a) <= tolerance for p in peaks)]
                    if near:
                        offer.append((-len(near), round(sum(near), 6), f))
                for *_, f in sorted(offer)[:offers]:
                    if f not in m:
                        known[q] |= {tuple(sorted((*m[:i], f, *m[i + 1 :]))) for i in range(len(m))}
    return {(q, m, -s, n) for q in asked for n, (s, m) in enumerate(best(q), 1)}


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds(spark, seed):
    r = random.Random(seed)
    fragments = {i: [float(r.randint(0, 60)) for _ in range(r.randint(1, 3))] for i in range(60)}
    asked = {0: [3.0, 11.0, 25.5, 40.0, 51.0], 1: [7.0, 7.0, 33.0]}
    candidates = [(q, [r.randrange(60) for _ in range(3)]) for q in asked for _ in range(3)] + [(0, [1, 999])]
    frames = spark.createDataFrame(list(asked.items()), "query_id long, peaks array<double>"), spark.createDataFrame([*fragments.items(), (70, None)], "id long, peaks array<double>"), spark.createDataFrame(candidates, "query_id long, members array<long>")
    found, counts = refine.refined(*frames, keep=4, sigma=2.0, tolerance=1.0, offers=3, rounds=4)
    assert {(x.query_id, tuple(x.members), x.score, x["rank"]) for x in found.collect()} == plain(asked, fragments, candidates, 4, 2.0, 1.0, 3, 4)
    later = counts[1:]
    assert later[0] > 0 and later[-1] < later[0]
    none, counts = refine.refined(frames[0], frames[1], frames[2].limit(0))
    assert none.collect() == [] and counts == [0]


def test_pairs_refined_in_time_that_copies_do_not_square(spark, monkeypatch):
    """The step that finds the swaps makes no row for each candidate and fragment, and the first pairs come from lists: the best three of 20,000 parts, refined."""
    from peakloom.operators import bands, rank_join

    def never(*_):
        raise AssertionError("rows for pairs")

    parts = spark.range(20_000).selectExpr("id", "array(double(id % 50), 22.5 + double(id % 1000) / 400) AS peaks")
    asked = spark.createDataFrame([(1, [4.0, 9.0, 14.0, 19.0, 24.0])], "query_id long, peaks array<double>")
    monkeypatch.setattr(bands, "within", never)
    monkeypatch.setattr(rank_join, "_by_bounds", never, raising=False)
    pairs = rank_join.top_pairs(asked, parts.withColumnRenamed("id", "fragment_id"), 3, 1.0)[0]
    found, counts = refine.refined(asked, parts, pairs.selectExpr("query_id", "array(left_id, right_id, left_id) AS members"), keep=3, sigma=1.0, tolerance=0.5, offers=4, rounds=2)
    rows = found.orderBy("rank").collect()
    assert len(rows) == 3 and rows[0].score >= pairs.agg({"score": "max"}).first()[0] * (4 / 6) ** 0.5 - 1e-6 and len(counts) >= 2


def test_rounds_make_lists_once_and_few_jobs(spark, monkeypatch):
    """All fragments are read for the lists alone, once, however many rounds follow, and a round is a few jobs."""
    from peakloom.operators import bands

    made, real = [], bands.cover_lists
    monkeypatch.setattr(bands, "cover_lists", lambda *a, **k: made.append(1) or real(*a, **k))
    asked = spark.createDataFrame([(1, [float(x) for x in range(0, 30, 3)])], "query_id long, peaks array<double>")
    fragments = spark.range(500).selectExpr("id", "array(double(id % 31), double(id % 29)) AS peaks")
    candidates = spark.createDataFrame([(1, [1, 2, 3, 5])], "query_id long, members array<long>")
    spark.sparkContext.setJobGroup("rounds", "rounds")
    found, counts = refine.refined(asked, fragments, candidates, keep=4, sigma=1.0, tolerance=0.5, offers=3, rounds=5)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds"))
    spark.sparkContext.setJobGroup("none", "none")
    assert len(counts) >= 4 and made == [1] and found.count() == 4
    assert jobs <= 25 + 15 * len(counts), jobs
