"""Substring deduplication: windows of words that start in an earlier document too are removed. Seed and extend.

Seeds: every window of ``length`` words has one anchor, the run of ``seed`` words in it with the least hash (the first of
equals), so equal windows have equal anchors at equal places. Windows in a row share their anchor; such a group is one
row with the hash of the anchor and a digest of its reach, all the words that its windows cover. About one word in twenty starts an anchor.

Extension: documents are joined on anchors, never with each other. Of rows with equal anchors and equal reaches, those
in later documents are repeats as a whole: the match extends both ways to the ends of the reach. Where reaches differ, one
row of each (the earliest) is extended window by window: only these windows are hashed, and the smallest document of each is
found. Removed windows that overlap or touch make up the maximal repeats.

Counts and minima are taken by grouped aggregation, and joins are on hashes or ids, so an anchor or window that a third
of all documents hold is pre-aggregated and then split. Whether reaches or windows are equal is decided by 128-bit BLAKE2b
digests of their words themselves, not by rolling hashes; an anchor's hash only brings together what is then compared.
The tables written on the way are removed once the repeats are known.

Words are those between ASCII white space, unchanged. Defined cases: null and wordless texts keep nothing and remove nothing;
rows with null ids are left whole, and other rows don't see them; rows that share an id don't repeat each other, the windows of any
of them count as that document's, and each loses its own repeats alone (rows are told apart by id and a 64-bit hash of the text); an empty table gives no rows; texts of any length are taken whole; columns
beside key and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import by_batch, durable, hashes_of, removed, runs

LENGTH, SEED = 50, 10


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the first smallest value in each window of so many, by doubling."""
    best, at, reach = values, np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        right = best[step:] < best[: len(best) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        best = values[at]
        reach += step
    return at


def anchors(words: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """For each group of windows with one anchor: its hash, its distance from the first window, and the first and last window."""
    seeds = runs(words, seed)
    at = first_least(seeds, length - seed + 1)
    begin = np.append(0, np.flatnonzero(at[1:] != at[:-1]) + 1)
    end = np.append(begin[1:], len(at)) - 1
    return seeds[at[begin]], at[begin] - begin, begin, end


def _digests(words: list[bytes], spans: list[tuple[int, int, bytes]]) -> bytes:
    """For each (begin, end, more) 16 bytes of BLAKE2b over words[begin:end], which hold no space, and more."""
    whole = b" ".join(words)
    at = [0, *accumulate(len(w) + 1 for w in words)]
    digest = hashlib.blake2b
    return b"".join(digest(whole[at[a] : at[b]].rstrip() + more, digest_size=16).digest() for a, b, more in spans)


def _halves(digests: list[bytes]) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(c)) for c in np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2).T]


def _anchored(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(anchor, one, two, key, content, begin, end) of (key, content, text); one and two identify the words of the reach and the anchor's place in it."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts, digests = [], []
        for key, content, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = text.as_py().split()
            if len(words) >= length:
                anchor, distance, begin, end = anchors(hashes_of(words), length, seed)
                places = (b" %d %d" % x for x in zip(distance.tolist(), (end - begin).tolist(), strict=True))
                digests.append(_digests(words, list(zip(begin.tolist(), (end + length).tolist(), places, strict=True))))
                parts.append((anchor, np.full(len(anchor), key, np.int64), np.full(len(anchor), content, np.int64), begin.astype(np.int32), end.astype(np.int32)))
        if not parts:
            return None
        anchor, key, content, begin, end = (np.concatenate(c) for c in zip(*parts, strict=True))
        columns = [pa.array(anchor.view(np.int64)), *_halves(digests), pa.array(key), pa.array(content), pa.array(begin), pa.array(end)]
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "one", "two", "key", "content", "begin", "end"])

    return by_batch(docs.where("key IS NOT NULL"), work, "anchor long, one long, two long, key long, content long, begin int, end int")


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """(one, two, key, content, at): the digest of every window of (key, content, text, spans) rows."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keys, contents, places, digests = [], [], [], []
        for key, content, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            words = text.as_py().split()
            at = np.unique(np.concatenate([np.arange(s["begin"], s["end"] + 1) for s in spans]))
            at = at[at + length <= len(words)]
            digests.append(_digests(words, [(a, a + length, b"") for a in at.tolist()]))
            keys.append(np.full(len(at), key, np.int64))
            contents.append(np.full(len(at), content, np.int64))
            places.append(at.astype(np.int32))
        return pa.RecordBatch.from_arrays([*_halves(digests), *[pa.array(np.concatenate(x)) for x in (keys, contents, places)]], names=["one", "two", "key", "content", "at"])

    return by_batch(rows.select("key", "content", "text", "spans"), work, "one long, two long, key long, content long, at int")


def repeated_windows(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(key, content, begin, end): ranges of windows of (key, content, text) rows that start in a document with a smaller key too."""
    found = durable(_anchored(docs, length, seed), "anchors")
    # What is aggregated is written before it is joined: a join of plain exchanges can split a hot anchor, one above an aggregate can't.
    several = durable(found.groupBy("anchor").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("anchor"), "several")
    shared = durable(found.join(several, "anchor"), "shared")
    removed(found, several)
    reach = ["anchor", "one", "two"]
    firsts = durable(shared.groupBy(reach).agg(F.min("key").alias("first")), "firsts")
    told = shared.join(firsts, reach)
    whole = told.where("key > first").select("key", "content", "begin", "end")
    # The earliest of each reach; an anchor with one reach has nothing else to compare.
    several = durable(firsts.groupBy("anchor").agg(F.count("*").alias("reaches")).where("reaches > 1").select("anchor"), "open")
    open_ = told.where("key = first").join(several, "anchor", "left_semi").groupBy("key", "content").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    windows = durable(_windows(docs.where("key IS NOT NULL").join(open_, ["key", "content"]), length), "windows")
    least = durable(windows.groupBy("one", "two").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("one", "two", "low"), "least")
    single = windows.join(least, ["one", "two"]).where("key > low").select("key", "content", F.col("at").alias("begin"), F.col("at").alias("end"))
    spans = durable(whole.union(single), "repeats")
    removed(shared, firsts, several, windows, least)
    return spans


def _removed(spans: list[dict] | None, length: int, n: int) -> np.ndarray:
    """A mask of the words that the windows cover."""
    edges = np.zeros(n + 1, np.int64)
    for s in spans or ():
        if s["end"] + length <= n:
            edges[s["begin"]] += 1
            edges[s["end"] + length] -= 1
    return np.cumsum(edges[:-1]) > 0


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", *, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """For each row: key, n_words, n_removed, kept_sha256, and kept, the words that stay joined by one space."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(text)).alias("content"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    spans = repeated_windows(rows, length, seed).groupBy("key", "content").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, digests, kept = [], [], [], []
        for text, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            words = text.as_py().split()
            n_words.append(len(words))
            if found:
                gone = _removed(found, length, len(words))
                n_removed.append(int(gone.sum()))
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            else:
                n_removed.append(0)
            one = b" ".join(words)
            kept.append(one)
            digests.append(hashlib.sha256(one).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests), pa.array(kept, pa.binary())], names=["key", "n_words", "n_removed", "kept_sha256", "kept"])

    joined = rows.join(spans, ["key", "content"], "left").select("key", "text", "spans")
    out = by_batch(joined, work, "key long, n_words long, n_removed long, kept_sha256 string, kept binary")
    return out.select(F.col("key").alias(key), "n_words", "n_removed", "kept_sha256", F.col("kept").cast("string").alias("kept"))
