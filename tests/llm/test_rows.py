"""Rows that share an id, rows without one however they are laid out, and texts of megabytes."""

from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F
from test_llm import SPACED, lower, plain_license, plain_repeats

from peakloom.llm import decontaminate, licenses, minhash, mixing, repeats, secret_scan


def shared_rows(seed, n=70, words=60):
    """Texts of a few families, one word changed here and there, under ids that different texts share."""
    r = random.Random(seed)
    base = [[f"w{k}x{i}" for i in range(words)] for k in range(6)]
    out = []
    for _ in range(n):
        t = list(r.choice(base))
        if r.random() < 0.6:
            t[r.randrange(words)] = f"new{r.randrange(1000)}"
        out.append((r.choice([*range(25), None]), " ".join(t[: r.choice([words, words, 55, 20])])))
    return [*out, (5, ""), (6, None), (7, "x")]


def plain_classes(rows, size):
    sets = []
    for _, text in rows:
        w = SPACED.findall(lower(text or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if None not in (rows[i][0], rows[j][0]) and sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if rows[i][0] == rows[j][0] or 100 * common >= 80 * len(sets[i] | sets[j]):
                    parent[root(i)] = root(j)
    low = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            low[root(i)] = min(key, low.get(root(i), key))
    return sorted(((key, len(sets[i]), None if key is None else low[root(i)]) for i, (key, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_near_duplicates_of_shared_ids(spark, seed):
    rows = shared_rows(seed)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size=4, block=5)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=repr) == plain_classes(rows, 4)


def test_links_of_each_text_of_an_id(spark):
    a, b = [f"a{i}" for i in range(200)], [f"b{i}" for i in range(200)]
    near = lambda t: " ".join([*t[:100], "other", *t[101:]])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (6, near(a)), (7, near(b))]
    for order in (rows, rows[::-1]):
        found = minhash.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").coalesce(1))
        assert {(r.doc_id, r.component_id, r.kept) for r in found.collect()} == {(5, 5, True), (6, 5, False), (7, 5, False)}


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_shared_ids(spark, seed):
    rows = shared_rows(seed)
    found = repeats.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), length=20, seed=5)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in found.collect()) == plain_repeats(rows, 20)


def test_a_text_that_repeats_nothing_keeps_its_words(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    found = repeats.deduplicated(spark.createDataFrame([(1, a), (2, a), (2, b)], "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_removed) for r in found.collect()) == [(1, 0), (2, 0), (2, 60)]


def test_mixing_without_ids_at_any_layout(spark):
    rows = [(None if i % 3 else i, None if i % 17 == 0 else " ".join(["w"] * (i % 23)), ["a", "b", None][i % 5 % 3]) for i in range(900)]
    found = []
    for parts in (1, 3, 8):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        found.append(sorted(map(repr, mixing.mix(docs, keep=("source", "text")).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 900


def test_mixing_of_many_equal_rows_comes_near_its_target(spark):
    docs = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("two words").alias("text"), F.when(F.col("id") < 500, "a").otherwise("b").alias("source")).repartition(7)
    for r in mixing.mix(docs, keep=("source",)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 3 * math.sqrt(5000)


# -- long texts ---------------------------------------------------------------------------------------------------

#: Fixed value: the text of a common license.
BODY = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the
software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or
substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of
contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""


def test_templates_of_any_length(spark):
    r, words = random.Random(4), BODY.split()
    noise = lambda n: [f"n{r.randrange(300)}" for _ in range(n)]
    changed = lambda share: [w if r.random() > share else "zz" for w in words]
    texts = [noise(a) + changed(share) + noise(b) for a in (0, 7, 100, 333) for b in (0, 50) for share in (0.0, 0.05, 0.4)] + [noise(500), words[:60], []]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    templates, width = [("body", " ".join(words))], licenses.width_of([("body", " ".join(words))])
    need = math.ceil(0.85 * len(set(words)) - 1e-9)
    for row in licenses.scan(docs, templates=templates).collect():
        t, half = texts[row.doc_id], width // 2
        blocks = [set(t[i * half : i * half + width]) for i in range(max(math.ceil((len(t) - half) / half), 1))]
        most = max(len(b & set(words)) for b in blocks)
        assert row.labels == ("body" if most >= need else "") and math.isclose(row.score, most / len(set(words)) if most >= need else 0)
    assert {licenses.width_of(), licenses.WIDTH} == {64}


def test_licenses_in_a_text_of_ten_megabytes(spark):
    words = [f"word{i % 997}" for i in range(1_250_000)]
    words[600_000:600_007] = "licensed under the gnu general public license".split()
    words[1_200_000:1_200_021] = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files".split()
    text = " ".join(words)
    began = time.time()
    found = licenses.scan(spark.createDataFrame([(1, text), (2, None), (3, "mit license")], "doc_id long, text string")).collect()
    assert len(text) > 9_000_000 and time.time() - began < 90
    assert {(r.doc_id, r.n_words, r.n_base, r.base_labels, r.labels) for r in found} == {(1, len(words), 1, "gpl", "gpl,mit"), (2, 0, 0, "", ""), (3, 2, 1, "mit", "mit")}
    assert plain_license("x mit license")[1] == 1


@pytest.mark.parametrize("piece", ["pwd=ab1", "token=a1B2c3D4e5F6g7H8", "a1=", "key_a1b2c3d4e5f6g7h8i9", "session=0123456789abcdef "])
def test_secrets_in_long_runs_take_linear_time(piece):
    def seconds(n):
        text = "auth " + piece * (n // len(piece))
        best = 1e9
        for _ in range(2):
            began = time.perf_counter()
            secret_scan.novel_in(text, secret_scan.patterns_in(text))
            best = min(best, time.perf_counter() - began)
        return best

    small, large = seconds(250_000), seconds(2_000_000)
    assert large < 8 * 3 * small + 0.5


def test_every_operator_takes_a_text_of_megabytes(spark):
    long = " ".join(f"w{i * 7919 % 100_003}" for i in range(600_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short text")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert {(r.doc_id, r.n_removed) for r in repeats.deduplicated(docs).select("doc_id", "n_removed").collect()} == {(1, 0), (2, 600_000), (3, 0)}
    assert {(r.doc_id, r.spans) for r in secret_scan.scan(docs).collect()} == {(1, ""), (2, ""), (3, "")}
    words = long.split()
    places = [i for i in range(len(words) - 12) if words[i] == words[1000]]
    hits = 20 * len(places)
    items = spark.createDataFrame([(9, " ".join(words[1000:1020]))], "item_id long, text string")
    assert {(r.doc_id, r.n_hit) for r in decontaminate.scan(docs, items).select("doc_id", "n_hit").collect()} == {(1, hits), (2, hits), (3, 0)}
