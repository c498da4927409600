"""The lattice takes many words at a time, whatever the size of Arrow's batches, and a word of a text's piece is hashed once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from peakloom.llm import lattice


def test_small_batches_are_scored_together():
    batches = [pa.RecordBatch.from_arrays([pa.array([b"%d" % (i * 10 + j) for j in range(10)])], names=["spelled"]) for i in range(500)]
    found = list(lattice._gathered(iter([*batches[:250], batches[0].slice(0, 0), *batches[250:]])))
    assert [b.num_rows for b in found] == [5000]
    assert found[0].column(0).to_pylist() == [b"%d" % i for i in range(5000)]
    large = [pa.RecordBatch.from_arrays([pa.array([b"x" * lattice.PIECE_BYTES])], names=["spelled"])] * 3
    assert [b.num_rows for b in lattice._gathered(iter(large))] == [1, 1, 1] and list(lattice._gathered(iter([]))) == []


def test_find_is_a_dictionary():
    vocabulary = lattice.Vocabulary()
    pieces = vocabulary.texts[256:]
    known = dict(zip(vocabulary._keys(pieces).tolist(), range(256, 256 + len(pieces)), strict=True))
    near = np.array(list(known), np.uint64)
    keys = np.concatenate((near, near + np.uint64(1), near ^ np.uint64(1 << 20), np.random.default_rng(1).integers(0, 1 << 63, 50_000).astype(np.uint64)))
    assert vocabulary.find(keys.reshape(-1, 1)).ravel().tolist() == [known.get(k, -1) for k in keys.tolist()]


def test_a_repeated_word_is_hashed_once(monkeypatch):
    """Each of a piece's words goes to the hash function once, however often it stands there."""
    seen, hashes_of = [], lattice.hashes_of
    monkeypatch.setattr(lattice, "hashes_of", lambda words: seen.extend(words) or hashes_of(words))
    texts = [b"a b c a B " * 50] * 20 + [b""]
    part = pa.RecordBatch.from_arrays([pa.array(range(21)), pa.array([True] * 20 + [False]), pa.array(texts)], names=["key", "train", "text"])
    found = lattice._dictionary(part).to_pylist()[0]
    assert sorted(seen) == [b"", b"a", b"b", b"c"]
    assert dict(zip(found["spelled"], found["sums"], strict=True)) == {b"a": 2000, b"b": 2000, b"c": 1000, b"": 20} and found["words"] == hashes_of(found["spelled"]).view(np.int64).tolist()
    assert found["n_tokens"] == [251] * 20 + [1] and found["kinds"] == [4] * 20 + [1]
    assert np.frombuffer(found["counts"], np.int32).sum() == 251 * 20 + 1
