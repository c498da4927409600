"""Ranked lexical search against a plain ranking by the formula, with the cases that its docstring defines."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_llm import DOCS, lower, sample

from peakloom.llm import lexical

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, k=10):
    """(item, rank, score) and, where no other document ties, the key."""
    terms = [[lower(x) for x in TERMS.findall(text or "")] for _, text in docs]
    n, total = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(x for words in terms for x in set(words))
    counts = [Counter(x) for x in terms]
    out = []
    for item, text in items:
        asked, found = Counter(lower(x) for x in TERMS.findall(text or "")), []
        for (key, _), words, tf in zip(docs, terms, counts, strict=True):
            m = 100 - 75 + (75 * len(words) * n) // total if total else 0
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1000000000 * tf[x]) // (1000 * tf[x] + 8 * m)) for x, times in asked.items() if tf[x])
            if score > 0:
                found.append((-score, key is None, key or 0))
        out += [(item, rank, None if none else key, -score) for rank, (score, none, key) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


ITEMS = [(1, "again and again: lic,ense"), (2, None), (3, ""), (4, "x é\U0001f600 mit license İstanbul ſecret"), (5, "again"), (5, "again"), (6, "neverseenword"), (None, "password token general public license")]


def test_plain_ranking(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, DOCS).withColumnsRenamed({"score_": "rank", "search_": "item", "gone_": "terms"}).repartition(5)
    texts = [(r[0], r[1]) for r in rows]
    items = [*ITEMS, *((100 + i, t[:300]) for i, (_, t) in enumerate(texts[:30]) if t)]
    asked = spark.createDataFrame([(*x, 1, "s") for x in items], "item_id long, text string, rank int, score string").repartition(3)
    for k in (10, 1, 200):
        assert rows_of(lexical.search(docs, asked, k)) == plain(texts, items, k)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(none, asked).collect() == []
    assert lexical.search(some, asked.limit(0)).collect() == []
    assert lexical.search(some.where("text IS NULL"), asked).collect() == []
    assert [tuple(r)[:3] for r in lexical.search(some, asked).collect()] == [(1, 1, 1)]


def test_ties_and_long_texts(spark):
    long = " ".join(f"w{i % 50_000}" for i in range(400_000))
    rows = [(i, "same text here") for i in range(2000)] + [(-7, long), (5000, "same " + long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    items = [(1, "here same"), (2, long)]
    found = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in lexical.search(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [found[1, i][0] for i in range(1, 11)] == list(range(10))
    assert {found[2, 1][0], found[2, 2][0]} == {-7, 5000} and (2, 3) not in found or found[2, 3][0] == 0


@pytest.mark.parametrize("seed", range(6))
def test_bounds_lose_nothing(seed):
    """Any slicing of the documents gives the k best of all of them."""
    r = np.random.default_rng(seed)
    n_docs, n_terms, n_items, k = 300, 40, 5, 7
    tf = r.integers(0, 4, (n_docs, n_terms)) * (r.random((n_docs, n_terms)) < 0.3)
    m, weights = r.integers(25, 400, n_docs), r.integers(1, 9000, (n_items, n_terms)) * (r.random((n_items, n_terms)) < 0.5)
    impact = np.where(tf > 0, lexical._impact(tf, m[:, None]), 0)
    exact = impact @ weights.T
    item, term = np.nonzero(weights)
    group = lexical._Together(np.unique(item), item, term, weights[item, term], k)
    cuts = [0, *sorted(r.choice(n_docs, 8, replace=False).tolist()), n_docs]
    for a, b in zip(cuts, cuts[1:], strict=False):
        doc, at = np.nonzero(tf[a:b])
        some = tf[a:b][doc, at]
        group.meet(doc, at, -(-lexical._impact(some, m[a:b][doc]) // lexical.STEP), some, m[a:b], pa.array(range(a, b)))
    for i in range(n_items):
        want = sorted((-exact[d, i], d) for d in range(n_docs) if exact[d, i] > 0)[:k]
        assert sorted(zip((-group.scores[i]).tolist(), group.keys[i], strict=True)) == want


def test_best_keeps_the_smaller_key():
    r = random.Random(2)
    for _ in range(100):
        scores = np.array([r.randint(1, 4) for _ in range(20)])
        keys = [r.choice([None, *range(9)]) for _ in scores]
        order = sorted(zip((-scores).tolist(), [(x is None, x or 0) for x in keys], strict=True))[:5]
        kept = lexical.best(scores, keys, 5)
        assert sorted((-int(scores[i]), (keys[i] is None, keys[i] or 0)) for i in kept) == order
