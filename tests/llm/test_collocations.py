"""Collocations against plain counting, the stack against plain prefix counts, with the cases that the docstring defines."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_llm import DOCS, lower, sample

from peakloom.llm import collocations


def plain(rows, least=10, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            lang = "und" if lang is None else lang
            total[lang] += len(words)
            counts[lang].update(words[i : i + m] for m in (1, 2, 3) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        frequent = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in frequent.items():
            score, _, left, right = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            if not any(len(x) > len(g) and 100 * b >= 50 * a and any(x[i : i + len(g)] == g for i in range(len(x))) for x, b in frequent.items()):
                found.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i, g.decode(), -a, left, right, total[lang], -score) for i, (score, a, g, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def odd_rows():
    r = random.Random(5)
    words = ["a", "a\x01", "b", "B", "the", "\x00", "é", "漢字", "x%0A", "of", "of-the", "\U0001f600"]
    rows = [("en" if i % 3 else None, " ".join(r.choice(words) for _ in range(r.randint(0, 40))) + r.choice([".", "", "\r\n", ",\t"]) * 2) for i in range(150)]
    rows += [("und", "A b\x0bc A b"), ("e%n\n", "the of the of " * 20), ("en", None), ("en", "...!"), ("", "a b " * 30), ("en", "again " * 3000), ("en\nthe", "b " * 40)]
    return rows


@pytest.mark.parametrize("least", [10, 1, 3])
def test_plain_counting(spark, least):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, x, 1, 2) for i, (x, t) in enumerate(rows)], "n long, text string, lang string, phrase int, suffix int").repartition(5)
    assert sorted(map(tuple, collocations.collocations(docs, least=least).collect())) == plain(rows, least)
    assert sorted(map(tuple, collocations.collocations(docs, least=least, top=3).collect())) == plain(rows, least, 3)


def test_sample_and_empty(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == plain([(r[2], r[1]) for r in rows])
    assert collocations.collocations(docs.limit(0)).collect() == []
    assert collocations.collocations(docs.withColumn("text", docs.text.substr(1, 0))).collect() == []


def test_long_text(spark):
    text = "Alpha beta, gamma " * 100_000
    found = collocations.collocations(spark.createDataFrame([(text, "en"), (None, None)], "text string, lang string")).collect()
    assert [tuple(r) for r in found] == [("en", 1, "gamma alpha beta", 99999, 100000, 100000, 300000, 999980)]


@pytest.mark.parametrize("seed", range(20))
def test_stack_counts_prefixes_over_any_batches(seed):
    r = random.Random(seed)
    words = ["a", "b", "a\x01", "", "the"][: r.randint(1, 5)]
    rows = Counter()
    for _ in range(r.randint(1, 300)):
        rows[(r.choice(["en", "fr"]), *(r.choice(words) + "x" for _ in range(r.randint(1, 3))))] += r.randint(1, 3)
    sorted_rows = sorted("".join(x + "\n" for x in k).encode() for k in rows)
    n = {"".join(x + "\n" for x in k).encode(): v for k, v in rows.items()}
    want = Counter()
    for k, v in rows.items():
        for m in range(1, len(k) + 1):
            want["".join(x + "\n" for x in k[:m]).encode()] += v
    got, i = Counter(), 0
    while i < len(sorted_rows):  # tasks of a few batches each
        stack = collocations._Stack(4)
        for _ in range(r.randint(1, 4)):
            some = sorted_rows[i : i + r.randint(1, 40)]
            if some:
                for x, v in stack.push(pa.array(some).cast(pa.string()), np.array([n[x] for x in some])):
                    got[x] += v
            i += len(some)
        for x, v in stack.end():
            got[x] += v
    assert {x: v for x, v in got.items() if v >= 4} == {x: v for x, v in want.items() if v >= 4}
    assert all(v <= want[x] for x, v in got.items())


def test_flushes_add_up(monkeypatch):
    monkeypatch.setattr(collocations, "FLUSH", 50)
    monkeypatch.setattr(collocations, "_BITS", 5)
    r, flush, got = random.Random(1), collocations._Flush(), Counter()
    words = [b"w%d" % r.randint(0, 200) if r.random() < 0.9 else b"." for _ in range(2000)]
    for batch in [*flush.add("en", words), *flush.out()]:
        for x, n in zip(batch.column("suffix").to_pylist(), batch.column("n").to_pylist(), strict=True):
            got[x] += n
    want = Counter()
    for piece in b" ".join(words).split(b"."):
        piece = piece.split()
        want.update("en\n" + "".join(x.decode() + "\n" for x in piece[i : i + 3]) for i in range(len(piece)))
    assert got == want
