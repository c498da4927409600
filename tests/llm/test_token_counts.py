"""Token counts against the library's, with the cases that the docstring defines."""

from __future__ import annotations

import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_llm import DOCS, sample
from tokenizers import Tokenizer

from peakloom.llm import token_counts

PATH = public_tokenizers.path(token_counts.MODEL)
LIBRARY, MERGES = Tokenizer.from_file(PATH), token_counts.Merges(PATH)


def own(text):
    return sum(MERGES.counts(text.encode().split()))


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@given(st.text(st.sampled_from("abcdeth AZ'slvm\t\n\x0b\x1c\x85　  é́İΣς0123٣!?.,漢字ﬁ\x00<|>_\U0001f600�"), max_size=80))
@settings(max_examples=500, deadline=None)
def test_as_the_library(text):
    assert own(text) == library(text)


@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "|>", "a", " ", "The", "é", "'LL"]), max_size=12))
@settings(max_examples=300, deadline=None)
def test_special_strings(parts):
    assert own("".join(parts)) == library("".join(parts))


@pytest.mark.parametrize("alphabet", ["a", "ab", "the", "abcdefghijklmnopqrstuvwxyz", "é漢"])
@pytest.mark.parametrize("n", [511, 512, 513, 2000, 30_000])
def test_long_runs(alphabet, n):
    text = "".join(random.Random(n).choices(alphabet, k=n))
    assert own(text) == library(text)


def test_ragged_and_long_merges_agree():
    r = random.Random(3)
    words = ["".join(r.choices("abcdeinorst", k=r.randint(2, 40))) for _ in range(300)]
    assert MERGES.surviving(words).tolist() == [MERGES._one_long(np.array(MERGES.symbols(x), np.int64)) for x in words]


def test_rows(spark):
    rows = [*sample(), (900, "<|endoftext|>!" + "tokens " * 300_000, None, None, 0, None, None, None, None, None), (901, "ab" * 500_000, None, None, 0, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumnsRenamed({"search_": "n_tokens", "gone_": "n_bytes"}).repartition(3)
    found = sorted(map(tuple, token_counts.count(docs).collect()), key=repr)
    want = [(r[0], len((r[1] or "").encode()), n := library(r[1] or ""), n > 2048) for r in rows]
    assert found == sorted(want, key=repr)
    assert token_counts.count(docs.limit(0)).collect() == []
    assert all(r.over_limit == (r.n_tokens > 5) for r in token_counts.count(docs, limit=5).collect())


def test_refuses_other_vocabularies(tmp_path):
    with pytest.raises(ValueError, match="white space"):
        token_counts.Merges(public_tokenizers.path("byte_bpe_50k.json"))
    known = json.load(open(PATH, encoding="utf-8"))
    known["model"]["merges"].reverse()
    (tmp_path / "x.json").write_text(json.dumps(known))
    with pytest.raises(ValueError, match="before it is made"):
        token_counts.Merges(str(tmp_path / "x.json"))
