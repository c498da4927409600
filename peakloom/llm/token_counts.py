"""Token counts of whole texts under a public byte-pair vocabulary, by merging arrays of pre-tokens rank by rank.

The vocabulary's own file says how text is normalised and cut into pre-tokens; the library does both, for each distinct chunk between
ASCII white space (this kind of vocabulary drops white space, so no pre-token and no normal form reaches over it). The merges are done here:
the pre-tokens of a batch lie end to end in one array, with the places where each begins. In a round, every pre-token applies all the
occurrences of its own lowest-ranked pair at once, from left to right where they overlap, and only the pairs beside a merge are looked up
again; a pre-token with no pair left is taken out with its count. This gives what merging one pair after another gives, because each symbol comes
from exactly one merge, which ranks after those of its parts: no pair that a merge brings forth can rank before it. The loader checks that.

A pre-token of over ``LONG`` symbols would need up to as many rounds as it has ranks, each over its whole length; it keeps lists of
places by rank instead, and touches only the places of the rank at hand, so its time grows with n log n.

Map only: no row is shuffled. What a worker keeps between batches are counts of chunks, up to ``KEPT_BYTES`` of their spelling.

Defined cases: null is the empty text, of no bytes and no tokens; strings of special tokens inside a text are one token each, as the library's
default has it; repeated rows and null ids each count; an empty table gives no rows; texts and pre-tokens of any length are counted whole;
columns beside key and text are not read, whatever their names.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import batches, pieces

MODEL = "word_bpe_49k.json"
LIMIT, LONG, KEPT_BYTES = 2048, 512, 96 << 20
NONE = np.iinfo(np.int32).max


class Merges:
    """The symbols and merges of a byte-pair vocabulary as arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        model, added = known["model"], known["added_tokens"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("unk_token"):
            raise ValueError(f"{path} is not a plain byte-pair vocabulary")
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or x["content"].split() != [x["content"]] for x in added):
            raise ValueError(f"{path} has added tokens that depend on the text around them")
        library = Tokenizer.from_file(path)
        self._normal, self._cut = library.normalizer.normalize_str if library.normalizer else str, library.pre_tokenizer.pre_tokenize_str
        if [x for x, _ in self._cut(self._normal("a \t\n\v\f\rb"))] != ["a", "b"]:
            raise ValueError(f"{path} keeps white space, so texts can't be cut there")
        if self._normal(" ".join(map(chr, range(33, 127)))).split(" ") != [self._normal(chr(x)) for x in range(33, 127)]:
            raise ValueError(f"{path} doesn't normalise ASCII characters one by one")
        longest_first = sorted((x["content"] for x in added), key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None
        ids, end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        rank_of = {a + b: rank for rank, (a, b) in enumerate(pairs)}
        if len(rank_of) < len(pairs) or any(rank_of.get(x, -1) >= rank for rank, pair in enumerate(pairs) for x in pair):
            raise ValueError(f"{path} has a symbol that two merges make, or that is merged before it is made")
        self.width = max(ids.values()) + 1
        self.inner = {x: i for x, i in ids.items() if len(x) == 1}
        self.last = {x.removesuffix(end): i for x, i in ids.items() if x.endswith(end) and len(x) == 1 + len(end)}
        keys = np.array([ids[a] * self.width + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], order.astype(np.int32)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; NONE where there is no merge."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._ranks[at], NONE).astype(np.int32)

    def symbols(self, pre_token: str) -> list[int]:
        return [*map(self.inner.__getitem__, pre_token[:-1]), self.last[pre_token[-1]]]

    def surviving(self, pre_tokens: list[str]) -> np.ndarray:
        """How many symbols are left of each pre-token once all merges are done."""
        out = np.ones(len(pre_tokens), np.int64)
        sizes = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
        for i in np.flatnonzero(sizes > LONG):
            out[i] = self._one_long(np.array(self.symbols(pre_tokens[i]), np.int64))
        short = np.flatnonzero((sizes > 1) & (sizes <= LONG))
        if len(short):
            out[short] = self._ragged(np.array([x for i in short for x in self.symbols(pre_tokens[i])], np.int64), sizes[short])
        return out

    def _ragged(self, symbol: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out, which = np.zeros(len(sizes), np.int64), np.arange(len(sizes))
        sizes = sizes.copy()
        ends = np.cumsum(sizes) - 1
        rank = np.full(len(symbol), NONE, np.int32)
        rank[:-1] = self.ranks(symbol[:-1], symbol[1:])
        rank[ends] = NONE
        while len(sizes):
            lowest = np.minimum.reduceat(rank, ends - sizes + 1)
            done = lowest == NONE
            if done.any():
                out[which[done]] = sizes[done]
                stay = np.repeat(~done, sizes)
                symbol, rank, which, sizes, lowest = symbol[stay], rank[stay], which[~done], sizes[~done], lowest[~done]
                if not len(sizes):
                    break
                ends = np.cumsum(sizes) - 1
            hit = np.flatnonzero(rank == np.repeat(lowest, sizes))
            first = np.concatenate(([True], np.diff(hit) > 1))
            hit = hit[(hit - hit[first][np.cumsum(first) - 1]) % 2 == 0]
            symbol[hit] = self.made[rank[hit]]
            sizes = sizes - np.bincount(np.searchsorted(ends, hit), minlength=len(sizes))
            stay = np.ones(len(symbol), bool)
            stay[hit + 1] = False
            symbol, rank = symbol[stay], rank[stay]
            ends = np.cumsum(sizes) - 1
            changed = np.zeros(len(symbol) + 1, bool)
            changed[hit - np.arange(len(hit))] = True
            changed[:-1] |= changed[1:]
            rank[np.flatnonzero(changed[:-1])] = NONE
            changed[ends] = False
            beside = np.flatnonzero(changed[:-1])
            rank[beside] = self.ranks(symbol[beside], symbol[beside + 1])
        return out

    def _one_long(self, symbol: np.ndarray) -> int:
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, NONE, np.int32)
        rank[:-1] = self.ranks(symbol[:-1], symbol[1:])
        alive, left, waiting = np.ones(n, bool), n, {}
        queue: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[rank[places] != NONE]
            if not len(places):
                return
            places = places[np.argsort(rank[places], kind="stable")]
            values, starts = np.unique(rank[places], return_index=True)
            for value, group in zip(values.tolist(), np.split(places, starts[1:]), strict=True):
                if value not in waiting:
                    waiting[value] = []
                    heapq.heappush(queue, value)
                waiting[value].append(group)

        wait(np.arange(n))
        while queue:
            lowest = heapq.heappop(queue)
            hit = np.unique(np.concatenate(waiting.pop(lowest)))
            hit = hit[alive[hit] & (rank[hit] == lowest)]
            if not len(hit):
                continue
            first = np.concatenate(([True], after[hit[:-1]] != hit[1:]))
            place = np.arange(len(hit))
            hit = hit[(place - place[first][np.cumsum(first) - 1]) % 2 == 0]
            gone = after[hit]
            symbol[hit] = self.made[lowest]
            alive[gone] = False
            left -= len(gone)
            after[hit] = after[gone]
            inside = after[hit] < n
            before[after[hit[inside]]] = hit[inside]
            rank[hit] = NONE
            beside = np.unique(np.concatenate((hit, before[hit][before[hit] >= 0])))
            beside = beside[after[beside] < n]
            rank[beside] = self.ranks(symbol[beside], symbol[after[beside]])
            wait(beside)
        return left

    def counts(self, chunks: Iterable[bytes]) -> list[int]:
        """The number of tokens of each chunk; equal pre-tokens are merged once."""
        texts = [x.decode("utf-8", "replace") for x in chunks]
        out = np.zeros(len(texts), np.int64)
        plain = [i for i, x in enumerate(texts) if x.isascii() and x.isprintable() and not (self._special and self._special.search(x))]
        owner, normal = plain.copy(), self._normal(" ".join(texts[i] for i in plain)).split(" ") if plain else []
        for i in sorted(set(range(len(texts))).difference(plain)):
            parts = self._special.split(texts[i]) if self._special else [texts[i]]
            out[i] = len(parts) - 1
            owner += [i] * sum(map(bool, parts))
            normal += [self._normal(x) for x in parts if x]
        place: dict[str, int] = {}
        owners, member = [], []
        for start in range(0, len(normal), 4096):
            some = normal[start : start + 4096]
            begins = np.cumsum([0, *(len(x) + 1 for x in some[:-1])])
            found = self._cut(" ".join(some))
            at = np.searchsorted(begins, [a for _, (a, _) in found], side="right") - 1
            owners.append(np.array(owner[start : start + 4096], np.int64)[at])
            member.extend([place.setdefault(x, len(place)) for x, _ in found])
        if member:
            left = self.surviving(list(place))[member]
            out += np.bincount(np.concatenate(owners), weights=left, minlength=len(out)).astype(np.int64)
        return out.tolist()


class _Known(dict):
    """Token counts of chunks, cleared when their spelling takes more than KEPT_BYTES."""

    size = 0

    def add(self, merges: Merges, chunks: set[bytes]) -> None:
        if self.size > KEPT_BYTES:
            self.clear()
            self.size = 0
        new = [x for x in chunks if x not in self]
        self.update(zip(new, merges.counts(new), strict=True))
        self.size += sum(map(len, new)) + 100 * len(new)


@functools.lru_cache(4)
def _loaded(path: str) -> tuple[Merges, _Known]:
    return Merges(path), _Known()


def count(docs: DataFrame, model: str | None = None, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit): the tokens of each whole text, without those that a template would add.

    ``model`` is the vocabulary's file, at the same place on every executor; by default that of ``MODEL`` among the public tokenizers.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        path = model
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(MODEL)
        merges, known = _loaded(path)
        for part in pieces(batch, "text"):
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column("text")]
            chunks = [x.split() for x in texts]
            known.add(merges, set().union(*chunks))
            n = np.fromiter((sum(map(known.__getitem__, x)) for x in chunks), np.int64, len(chunks))
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(list(map(len, texts)), pa.int64()), pa.array(n), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(key), F.col(text).cast("binary").alias("text"))
    return batches(rows, work, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
