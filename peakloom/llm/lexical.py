"""Ranked lexical search with integer scores, by a two-level quantised index.

1. ``counts``: one pass over the texts writes, for each document, its number of terms and, for the terms that may be asked for, how often it
   holds each. Terms are 64-bit BLAKE2b hashes; those that no item asks for are passed over by a bitmap of ``SLOTS`` bits, of fixed size
   however many there are, in which a few strangers slip through and are never asked for.
2. ``indexed``: with the corpus' sums known, the first level of a document is one byte for each term, its impact in steps of ``STEP``, rounded up;
   the second level is what the exact impact is computed from. Both are columns of one written table.
3. ``search``: asked items meet the index in blocks of ``BLOCK`` weighted terms, one broadcast each, whose size is that of the block and not of
   the tables. A task multiplies its documents' bytes with the items' weights, which bounds every score from above; an item's k-th highest
   bound less one step for each of its terms is a score that k documents reach. Only documents whose bound reaches the k-th
   best so far, or that, are scored from the second level, in 64-bit integers. A task hands on the k best of each item; these are ranked.

Documents are never shuffled, and no row is made for a pair of a document and an item that is not among a task's k best. Bounds are sums of
integers below 2^53 in doubles, so they are exact.

Terms are runs of letters, digits and characters from U+0080, A to Z in lower case. A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its
impact (10^9 tf) div (1000 tf + 8 m) with m = 25 + (75 n N) div L; a score sums weight times impact over an item's terms, repeats included.

Defined cases: null has no terms, in documents and items; a document without terms counts nowhere; repeated rows of documents are documents of
their own; each row of the items is asked for itself, also where its id is repeated; ties go to the smaller key, a null key after all
others; empty tables give no rows; texts and items of any length are taken whole; columns beside key and text are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.llm.common import batches, durable, hashes_of, pieces, plain_words, removed

SLOTS, STEP = 1 << 20, -(-1_000_000 // 255)
#: Weighted terms of a block of items; cells of the matrix of bytes that a task makes at a time; items that share such a matrix.
BLOCK, CELLS, TOGETHER = 1 << 20, 1 << 21, 512


def _terms(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each text: its number of terms, the distinct ones in order, and how often each stands there."""
    for x in batch.column("text"):
        words = hashes_of(plain_words(x.as_buffer().to_pybytes() if x.is_valid else b""))
        yield len(words), *np.unique(words.view(np.int64), return_counts=True)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else [], kind))


def _counted(rows: DataFrame, key: str, bits: np.ndarray | None) -> DataFrame:
    """(key, n, terms, tfs) for every row with a term; bits, where given, say which slots of terms are kept."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in pieces(batch, "text"):
            at, n, terms, tfs = [], [], [], []
            for i, (size, term, tf) in enumerate(_terms(part)):
                if size:
                    if bits is not None:
                        slot = term & (SLOTS - 1)
                        asked = bits[slot >> 3] >> (slot & 7) & 1 == 1
                        term, tf = term[asked], tf[asked]
                    at.append(i), n.append(size), terms.append(term), tfs.append(tf)
            yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(at, pa.int32())), pa.array(n, pa.int64()), _lists(terms, pa.int64()), _lists(tfs, pa.int32())], names=[key, "n", "terms", "tfs"])

    return batches(rows, work, f"`{key}` {rows.schema[key].dataType.simpleString()}, n long, terms array<long>, tfs array<int>")


def _impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def indexed(counts: DataFrame, key: str, n_docs: int, n_terms: int) -> DataFrame:
    """(key, terms, steps, tfs, m): the two levels of every document that has a term which may be asked for."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column("tfs")
        sizes = np.diff(lists.offsets.to_numpy())
        m = 25 + 75 * batch.column("n").to_numpy() * n_docs // n_terms
        step = -(-_impact(lists.flatten().to_numpy().astype(np.int64), np.repeat(m, sizes)) // STEP)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        steps = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(step.astype(np.uint8))])
        yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("terms"), steps, lists, pa.array(m)], names=[key, "terms", "steps", "tfs", "m"])

    return batches(counts.where(F.size("terms") > 0), work, f"`{key}` {counts.schema[key].dataType.simpleString()}, terms array<long>, steps binary, tfs array<int>, m long")


def best(scores: np.ndarray, keys: list, k: int) -> list[int]:
    """Places of the k highest scores, ties by the smaller key, null last."""
    if len(scores) <= k:
        return list(range(len(scores)))
    least = np.partition(scores, -k)[-k]
    above, level = np.flatnonzero(scores > least).tolist(), np.flatnonzero(scores == least).tolist()
    return above + heapq.nsmallest(k - len(above), level, key=lambda i: (keys[i] is None, keys[i]))


class _Together:
    """Some items of a block: their terms, the matrix of their weights, and the best documents so far."""

    def __init__(self, items: np.ndarray, item: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int):
        self.items, self.k = items, k
        self.terms, column = np.unique(term, return_inverse=True)
        row = np.searchsorted(items, item)
        self.weights = np.zeros((len(self.terms), len(items)))
        self.weights[column, row] = weight
        order = np.argsort(row, kind="stable")
        cuts = np.cumsum(np.bincount(row, minlength=len(items)))[:-1]
        self.columns, self.exact = np.split(column[order], cuts), np.split(weight[order].astype(np.int64), cuts)
        self.slack = self.weights.sum(axis=0)
        self.least = np.ones(len(items), np.int64)
        self.scores, self.keys = [np.zeros(0, np.int64) for _ in items], [[] for _ in items]

    def meet(self, doc: np.ndarray, term: np.ndarray, step: np.ndarray, tf: np.ndarray, m: np.ndarray, keys: pa.Array) -> None:
        """Documents lie side by side: doc gives the place of the one that an entry belongs to."""
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        entry = np.flatnonzero(self.terms[at] == term)
        if not len(entry):
            return
        doc, at = doc[entry], at[entry]
        level = np.zeros((len(m), len(self.terms)))
        level[doc, at] = step[entry]
        bound = level @ self.weights
        if len(m) >= self.k:
            sure = np.partition(bound, -self.k, axis=0)[-self.k] - self.slack
            self.least = np.maximum(self.least, (STEP * sure).astype(np.int64))
        asked, rows = np.nonzero((bound.T * STEP >= self.least[:, None]) & (bound.T > 0))
        if not len(rows):
            return
        place = np.full(level.shape, -1, np.int32)
        place[doc, at] = entry
        for i in np.unique(asked).tolist():
            found = rows[asked == i]
            where = place[np.ix_(found, self.columns[i])]
            impact = np.where(where >= 0, _impact(tf[where], m[found][:, None]), 0)
            score = impact @ self.exact[i]
            good = score >= self.least[i]
            score, named = np.concatenate((self.scores[i], score[good])), self.keys[i] + keys.take(pa.array(found[good])).to_pylist()
            kept = best(score, named, self.k)
            self.scores[i], self.keys[i] = score[kept], [named[x] for x in kept]
            if len(kept) == self.k:
                self.least[i] = max(self.least[i], self.scores[i].min())


def _met(index: DataFrame, key: str, block: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> DataFrame:
    """(item, key, score): the k best documents of each task for each item of a block, given as its items, terms and weights by entry."""
    sent = index.sparkSession.sparkContext.broadcast(block)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, term, weight = sent.value
        groups, all_items = [], np.unique(item)
        for i in range(0, len(all_items), TOGETHER):
            these = all_items[i : i + TOGETHER]
            mine = (item >= these[0]) & (item <= these[-1])
            groups.append(_Together(these, item[mine], term[mine], weight[mine], k))
        kind = None
        for batch in found:
            kind = batch.schema.field(key).type
            for group in groups:
                rows = max(CELLS // len(group.terms), 1)
                for start in range(0, batch.num_rows, rows):
                    part = batch.slice(start, rows)
                    terms, steps = part.column("terms"), part.column("steps")
                    doc = np.repeat(np.arange(part.num_rows), np.diff(terms.offsets.to_numpy()))
                    step = np.frombuffer(b"".join(x.as_py() for x in steps), np.uint8)
                    group.meet(doc, terms.flatten().to_numpy(), step, part.column("tfs").flatten().to_numpy().astype(np.int64), part.column("m").to_numpy(), part.column(key))
        for group in groups:
            for i, scores, keys in zip(group.items.tolist(), group.scores, group.keys, strict=True):
                if len(scores):
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(scores), pa.int64()), pa.array(keys, kind), pa.array(scores)], names=["item", key, "score"])

    return index.mapInArrow(run, f"item long, `{key}` {index.schema[key].dataType.simpleString()}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item key, rank, key, score): each item's k highest-scoring documents with a score above 0."""
    texts = docs.select(F.col(key), F.col(text).cast("binary").alias("text"))
    named = durable(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_key).alias("asked"), F.col(item_text).cast("binary").alias("text")), "items")
    asked = durable(_counted(named.select("item", "text"), "item", None).select("item", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("item", F.col("x.terms").alias("term"), F.col("x.tfs").alias("times")), "asked")
    slots = asked.select(F.col("term").bitwiseAND(SLOTS - 1).alias("slot")).distinct().toArrow().column("slot").to_numpy()
    bits = np.zeros(SLOTS, np.uint8)
    bits[slots] = 1
    counts = durable(_counted(texts, key, np.packbits(bits, bitorder="little")), "counts")
    n_docs, n_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequent = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weighted = durable(asked.join(frequent, "term").select("item", "term", (idf * F.col("times")).cast("long").alias("weight")).where("weight > 0"), "weighted")
    index = durable(indexed(counts, key, n_docs, max(n_terms, 1)), "index")
    blocks = -(-weighted.count() // BLOCK)
    removed(counts, asked)
    found = None
    for block in range(blocks):
        rows = weighted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).orderBy("item").toArrow()
        if rows.num_rows:
            one = _met(index, key, tuple(rows.column(x).to_numpy() for x in ("item", "term", "weight")), k)
            found = one if found is None else found.union(one)
    if found is None:
        found = docs.select(F.lit(0).cast("long").alias("item"), F.col(key), F.lit(0).cast("long").alias("score")).limit(0)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last(key))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(named.select("item", "asked"), "item").select(F.col("asked").alias(item_key), "rank", key, "score")
