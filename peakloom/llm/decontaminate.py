"""Benchmark decontamination by suffix arrays over the training texts.

Each batch of documents is a shard. Its words become numbers by the benchmark's vocabulary; stretches in which every two
neighbours are neighbours in some item too are kept, since no match can reach beyond them, and get a suffix array by prefix doubling.
Every suffix of the test items is then searched in it, word by word, each word by binary search in the range of the suffixes that
agree so far. The range at the end of a window holds all places of that window; with ``longest`` the search goes on
until the range is empty, which gives the longest verbatim match of each test suffix and its locations.

Equal windows have one range, ranges are added up as edges, and items are joined to documents by the sets of items that share a
window, so neither time nor memory grows with the product of places in items and in documents.

The test items are searched in blocks of bounded size, which are sent to the tasks one at a time. With more than one block the
documents get row numbers in a written table, what each block finds is written, and one join by row number puts it together.
Documents are searched whole, in shards of bounded size; one longer text is a shard.

Words are those of letters and digits, A to Z in lower case. A window is ``width`` words of an item, or all of them if it
has fewer; a document is contaminated if words stand in windows, and make up at least 1/``share`` of its words.
Defined cases: null or wordless documents have no words and are clean; wordless items have no windows; repeated items
count once by id; a null item id is the empty string; repeated documents are each judged; an empty benchmark leaves all clean, empty
documents give no rows; ``clean`` keeps the columns it gets, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import durable, fresh, pieces, plain_words, removed

WIDTH, SHARE, BLOCK_BYTES, SHARD_BYTES = 13, 20, 16 << 20, 4 << 20


def suffix_array(numbers: np.ndarray) -> np.ndarray:
    """The places of all words in the order of the words that follow, each suffix up to the next 0, by prefix doubling."""
    rank, size = numbers.copy(), 1
    ended = rank == 0
    while True:
        after = np.where(ended, 0, np.append(rank[size:], np.zeros(min(size, len(rank)), rank.dtype)))
        _, rank = np.unique(rank * (int(rank.max(initial=0)) + int(after.max(initial=0)) + 1) + after, return_inverse=True)
        ended = ended | np.append(ended[size:], np.ones(min(size, len(ended)), bool))
        if ended.all():
            break
        size *= 2
    order = np.argsort(rank, kind="stable")
    return order[numbers[order] != 0]


class Items:
    """A block of test items as numbers of words, each item followed by a 0."""

    def __init__(self, items: list[tuple[object, bytes | None]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names, parts, owners, starts, sizes = [], [], [], [], []
        for item_id, text in items:
            found = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in plain_words(text)]
            if found:
                parts.append(np.array([*found, 0], np.int64))
                owners.append(np.full(len(found) + 1, len(self.names)))
                starts.append(np.arange(len(found) + 1))
                sizes.append(np.full(len(found) + 1, min(width, len(found))))
                self.names.append("" if item_id is None else str(item_id))
        none = [np.zeros(0, np.int64)]
        self.numbers, self.owner, self.at, self.size = (np.concatenate(c or none) for c in (parts, owners, starts, sizes))
        self.least = int(self.size.min(initial=width))
        pairs = self._pairs(self.numbers)
        self.pairs = np.unique(pairs[(self.numbers[:-1] != 0) & (self.numbers[1:] != 0)]) if len(self.numbers) else pairs

    def _pairs(self, numbers: np.ndarray) -> np.ndarray:
        return numbers[:-1] * (len(self.vocabulary) + 1) + numbers[1:]

    def shortened(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretches of a shard that could hold a window, each followed by a 0, and the place of each of their words."""
        pairs = self._pairs(numbers)
        slot = np.minimum(np.searchsorted(self.pairs, pairs), max(len(self.pairs) - 1, 0))
        linked = (self.pairs[slot] == pairs) & (numbers[:-1] != 0) & (numbers[1:] != 0) if len(self.pairs) else np.zeros(len(pairs), bool)
        run = np.append(0, np.cumsum(~linked))[: len(numbers)]
        keep = np.flatnonzero((np.bincount(run)[run] >= self.least) & (numbers != 0))
        _, nth = np.unique(run[keep], return_inverse=True)
        out, place = np.zeros(len(keep) + (int(nth[-1]) + 1 if len(nth) else 0), np.int64), np.full(len(keep) + (int(nth[-1]) + 1 if len(nth) else 0), -1)
        out[np.arange(len(keep)) + nth], place[np.arange(len(keep)) + nth] = numbers[keep], keep
        return out, place

    def search(self, text: np.ndarray, array: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(suffix, words, low, high): for each test suffix that stands in the text with its window, how far it was followed, and its range there.

        Suffixes are followed to the end of their windows, or to the end of the longest match if depth is given.
        """
        known = np.zeros(len(self.vocabulary) + 1, bool)
        known[text] = True
        known[0] = False
        # A suffix that is shorter than its window begins none.
        left = np.append(np.flatnonzero(self.numbers == 0), len(self.numbers))
        suffix = np.flatnonzero(known[self.numbers])
        suffix = suffix[left[np.searchsorted(left, suffix)] - suffix >= self.size[suffix]]
        low, high = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(array))
        done = []
        words = 0
        while len(suffix):
            goal = self.size[suffix]
            full = (words == goal) if depth is None else np.zeros(len(suffix), bool)
            word = self.numbers[suffix + words]
            first, last = self._bound(text, array, low, high, words, word, False), self._bound(text, array, low, high, words, word, True)
            stop = full | (first >= last) | (word == 0)
            here = stop & (words >= goal)
            done.append((suffix[here], np.full(here.sum(), words), low[here], high[here]))
            suffix, low, high = suffix[~stop], first[~stop], last[~stop]
            words += 1
        none = [np.zeros(0, np.int64)] * 4
        return tuple(np.concatenate(c) for c in zip(*done, strict=True)) if done else tuple(none)

    @staticmethod
    def _bound(text: np.ndarray, array: np.ndarray, low: np.ndarray, high: np.ndarray, words: int, word: np.ndarray, after: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            there = text[array[middle] + words]
            less = there <= word[open_] if after else there < word[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        return low


def searched(items: Items, texts: list[bytes | None], longest: bool = False) -> list[dict]:
    """For each text of a shard: n_words, ranges of hit words, items whose windows occur, and, if asked for, the longest matches."""
    parts, bounds = [], [0]
    for text in texts:
        words = plain_words(text)
        parts.append(np.fromiter(map(items.vocabulary.get, words, repeat(0)), np.int64, len(words)))
        parts.append(np.zeros(1, np.int64))
        bounds.append(bounds[-1] + len(words) + 1)
    out = [{"n_words": b - a - 1, "ranges": [], "items": [], "longest": []} for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    text, place = items.shortened(np.concatenate(parts)) if parts else (np.zeros(0, np.int64),) * 2
    if not len(text):
        return out
    array = suffix_array(text)
    suffix, words, low, high = items.search(text, array)
    if not len(suffix):
        return out
    kinds, kind = np.unique(np.stack((low, high, words)), axis=1, return_inverse=True)
    edges, counts = np.zeros(bounds[-1] + 1, np.int64), kinds[1] - kinds[0]
    of = np.repeat(np.arange(len(counts)), counts)
    at = place[array[np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + kinds[0][of]]]
    np.add.at(edges, at, 1)
    np.add.at(edges, at + kinds[2][of], -1)
    hit = np.concatenate(([False], np.cumsum(edges) > 0, [False]))
    turns = np.flatnonzero(hit[1:] != hit[:-1])
    for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        n = int(np.searchsorted(bounds, a, "right")) - 1
        out[n]["ranges"].append({"begin": a - bounds[n], "end": b - bounds[n]})
    held: list[set[str]] = [set() for _ in range(len(counts))]
    for k, i in np.unique(np.stack((kind.ravel(), items.owner[suffix])), axis=1).T.tolist():
        held[k].add(items.names[i])
    sets: dict[frozenset, int] = {}
    number = np.array([sets.setdefault(frozenset(h), len(sets)) for h in held], np.int64)
    every, found = list(sets), [set() for _ in texts]
    owners = np.searchsorted(bounds, at, "right") - 1
    for n, k in np.unique(np.stack((owners, number[of])), axis=1).T.tolist():
        found[n] |= every[k]
    for n, names in enumerate(found):
        out[n]["items"] = sorted(names)
    if longest:
        _longest(items, text, array, place, bounds, out)
    return out


def _longest(items: Items, text: np.ndarray, array: np.ndarray, place: np.ndarray, bounds: list[int], out: list[dict]) -> None:
    """Adds the longest match of each test suffix that no longer one includes, at its first place in each document."""
    suffix, words, low, high = items.search(text, array, depth=0)
    order = np.argsort(suffix)
    reach = -1
    for i in order.tolist():
        j, n = int(suffix[i]), int(words[i])
        if j + n <= reach:
            continue
        reach = j + n
        at = np.sort(place[array[low[i] : high[i]]])
        owners = np.searchsorted(bounds, at, "right") - 1
        docs, first = np.unique(owners, return_index=True)
        for d, f in zip(docs.tolist(), first.tolist(), strict=True):
            out[d]["longest"].append({"item": items.names[items.owner[j]], "start": int(at[f]) - bounds[d], "item_start": int(items.at[j]), "words": n})


_RANGES = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_LONGEST = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("item_start", pa.int64()), ("words", pa.int64())]))
_STATE = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("longest", _LONGEST)])
_FOUND = "ranges array<struct<begin:bigint,end:bigint>>, items array<string>, longest array<struct<item:string,start:bigint,item_start:bigint,words:bigint>>"
STATE = "struct<n_words:bigint,n_hit:bigint,items:array<string>,longest:array<struct<item:string,start:bigint,item_start:bigint,words:bigint>>>"


def _state(n_words: int, parts: list[dict]) -> dict:
    """What the blocks have found in one text, together."""
    reach, n_hit = 0, 0
    for a, b in sorted((r["begin"], r["end"]) for p in parts for r in p["ranges"]):
        n_hit += max(0, b - max(a, reach))
        reach = max(reach, b)
    return {"n_words": n_words, "n_hit": n_hit, "items": sorted({i for p in parts for i in p["items"]}), "longest": [m for p in parts for m in p["longest"]]}


def _blocks(benchmark: DataFrame, item: str, text: str, width: int, most: int) -> Iterator[tuple[int, Items]]:
    """The number of blocks, of about so many bytes of text, and each block, read when it is asked for."""
    rows = benchmark.select(F.col(item).alias("item"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text")).distinct()
    count = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most))
    for n in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == n)
        yield count, Items([(r["item"], bytes(r["text"])) for r in part.collect()], width)


def annotate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", *, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, longest: bool = False, into: str = "search_") -> DataFrame:
    """The documents with one more column of what was found; the text column is binary in it and has to be cast back."""
    rows, context = docs.withColumn(text, F.col(text).cast("binary")), docs.sparkSession.sparkContext
    at, column = len(docs.columns), docs.columns.index(text)
    layout = rows.withColumn(into, F.lit(None).cast(STATE)).schema
    tables, number = [], fresh(docs, "row_")
    for count, block in _blocks(benchmark, item, item_text, width, block_bytes):
        sent = context.broadcast(block)

        def state(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, batch.schema.names[column], SHARD_BYTES) if batch.num_rows else ():
                    found = [_state(f["n_words"], [f]) for f in searched(sent.value, part.column(column).to_pylist(), longest)]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, _STATE)], names=[*part.schema.names, into])

        if count == 1:
            return rows.mapInArrow(state, layout)
        if not tables:
            rows = durable(rows.withColumn(number, F.monotonically_increasing_id()), "numbered")

        def hits(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, "text", SHARD_BYTES) if batch.num_rows else ():
                    found = searched(sent.value, part.column(1).to_pylist(), longest)
                    keep = [i for i, f in enumerate(found) if f["items"]]
                    if keep:
                        columns = [pa.array([found[i][c] for i in keep], t) for c, t in (("ranges", _RANGES), ("items", pa.list_(pa.string())), ("longest", _LONGEST))]
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), *columns], names=["row", "ranges", "items", "longest"])

        tables.append(durable(rows.select(F.col(number).alias("row"), F.col(text).alias("text")).mapInArrow(hits, f"row long, {_FOUND}"), "hits"))
        sent.destroy()
    every = tables[0]
    for more in tables[1:]:
        every = every.union(more)
    every = durable(every.groupBy(F.col("row").alias(fresh(docs, "of_"))).agg(F.collect_list(F.struct("ranges", "items", "longest")).alias(fresh(docs, "parts_"))), "hits")
    removed(*tables)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = zip(batch.column(column).to_pylist(), batch.column(at).to_pylist(), strict=True)
            found = [_state(len(plain_words(t)), p or []) for t, p in parts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(found, _STATE)], names=[*batch.schema.names[:at], into])

    joined = rows.join(every, F.col(number) == F.col(fresh(docs, "of_")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(fresh(docs, "parts_"))).mapInArrow(merged, layout)


def judged(share: int = SHARE, at: str = "search_") -> dict:
    """Columns of the judgement on what annotate() has found."""
    n_words, n_hit = F.col(f"{at}.n_words"), F.col(f"{at}.n_hit")
    return {
        "n_words": n_words, "n_hit": n_hit, "n_items": F.size(f"{at}.items").cast("long"),
        "items_sha256": F.sha2(F.array_join(f"{at}.items", ",").cast("binary"), 256),
        "contaminated": (n_hit > 0) & (n_hit * share >= n_words),
    }


def scan(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", *, width: int = WIDTH, share: int = SHARE, block_bytes: int = BLOCK_BYTES, longest: bool = False) -> DataFrame:
    """For each document: key, n_words, n_hit, n_items, items_sha256, contaminated, and, if asked for, the longest matches."""
    found = annotate(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), benchmark, "text", item, item_text, width=width, block_bytes=block_bytes, longest=longest)
    columns = [c.alias(name) for name, c in judged(share).items()]
    return found.select(F.col("key").alias(key), *columns, F.col("search_.longest").alias("longest"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", *, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    name = fresh(docs, "search_")
    found = annotate(docs, benchmark, text, item, item_text, width=width, into=name)
    kept = found.where(~judged(share, name)["contaminated"])
    return kept.select(*[F.col(f"`{text}`").cast("string").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])
