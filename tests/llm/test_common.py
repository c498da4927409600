from __future__ import annotations

import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from peakloom.llm import common, decontaminate, lattice, minhash, repeats, secret_scan

TEXT = st.text(st.sampled_from("ab AZ\t\n\x0b\x1c\x85 é0_-/:@[`{~\U0001f600"), max_size=60)


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    data = text.encode()
    assert [w.decode() for w in common.spaced_words(data, lower=False)] == re.findall(common.SPACED, text)
    assert [w.decode() for w in common.spaced_words(data, lower=True)] == re.findall(common.SPACED, low)
    assert [w.decode() for w in common.plain_words(data)] == re.findall(common.PLAIN, low)


@given(st.lists(st.sampled_from(["a", "b", "ab", "ba", "abc", "é"]), max_size=30), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_hashes_tell_words_and_runs_apart(words, size):
    h = common.text_hashes(" ".join(words).encode(), lower=False)
    assert len(set(zip(words, h.tolist(), strict=True))) == len(set(words)) == len(set(h.tolist()))
    runs = common.runs(h, size)
    whole = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    assert len(runs) == len(whole) and len(set(zip(whole, runs.tolist(), strict=True))) == len(set(whole)) == len(set(runs.tolist()))


@given(st.lists(st.sampled_from(["a", "b", "c"]), min_size=4, max_size=40), st.integers(4, 8), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_anchors_cover_every_window_once(words, length, seed):
    h = common.text_hashes(" ".join(words).encode(), lower=False)
    if len(h) < length:
        return
    anchor, reach, begin, end = repeats.anchors(h, length, seed)
    assert [x for a, b in zip(begin, end, strict=True) for x in range(a, b + 1)] == list(range(len(h) - length + 1))
    window = {}
    assert all(0 <= d <= length - seed for d in reach.tolist())
    for a, b, e in zip(anchor.tolist(), begin.tolist(), end.tolist(), strict=True):
        for i in range(b, e + 1):
            assert window.setdefault(tuple(words[i : i + length]), a) == a


@given(st.lists(st.sampled_from("ab c"), max_size=12).map("".join), st.lists(st.lists(st.sampled_from("ab c"), max_size=8).map("".join), max_size=4), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_suffix_array_finds_every_place(text, items, width):
    block = decontaminate.Items([(i, t.encode()) for i, t in enumerate(items)], width)
    words = common.plain_words(text.encode())
    found = decontaminate.searched(block, [text.encode()])[0]
    hit = set()
    for t in items:
        v = common.plain_words(t.encode())
        m = min(width, len(v))
        for q in range(len(v) - m + 1 if m else 0):
            hit |= {x for p in range(len(words) - m + 1) if words[p : p + m] == v[q : q + m] for x in range(p, p + m)}
    assert {x for r in found["ranges"] for x in range(r["begin"], r["end"])} == hit


@given(st.text(st.sampled_from("tokenTOKEN=:\"' ab0_-AKIZ9"), max_size=80))
@settings(max_examples=300, deadline=None)
def test_spans_are_ordered_and_apart(text):
    base = secret_scan.patterns_in(text)
    assert base == sorted(base)
    assert all(not (a < d and c < b) for a, _, b in secret_scan.novel_in(text, base) for c, _, d in base)


def thue_morse(bits: int) -> tuple[str, str]:
    """Two words that polynomial hashes modulo 2^64 can't tell apart."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(1 << bits))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_rolling_hashes_confuse(spark):
    one, two = thue_morse(11)
    assert len(set(common.hashes_of([one.encode(), two.encode()]).tolist())) == 2
    words = [f"w{i}" for i in range(60)]
    texts = {1: " ".join([*words, one, *words[::-1][:20]]), 2: " ".join([*words[:30], two, *words[30:]]), 3: one, 4: two, 5: " ".join([one] * 60), 6: " ".join([two] * 60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    near = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, size=4).collect()}
    assert near[3] == 3 and near[4] == 4 and near[5] == 5 and near[6] == 6
    assert {r.doc_id: r.n_removed for r in repeats.deduplicated(docs).collect()} == dict.fromkeys(texts, 0)
    train = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 7 != 2][0]
    held = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 7 == 2][0]
    rows = spark.createDataFrame([(train, one), (held, two)], "doc_id long, text string")
    assert {r.doc_id: r.n_known for r in lattice.scan(rows).collect()} == {train: 2, held: 1}
