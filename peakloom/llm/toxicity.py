"""Toxicity by two class-conditional Kneser-Ney models over characters.

Texts become sequences of 64 symbols: a to z in either case, digits, one gap for any run of other ASCII, and 36 classes of
the bytes of other scripts, by their remainder, so that unrelated letters of these share symbols. Each class counts runs of four symbols, each once a
document, so that one that repeats its lines has no more say than others; what discounting leaves goes to Kneser-Ney
continuation counts of three, two and one symbols that both classes share, so that runs that neither class has seen, or
just one has and rarely, say little. The difference of the two log-likelihoods, by symbol, is one table of the runs seen.

The score is a logistic function of the difference per symbol over the whole text and of its highest mean over ``window``
symbols. Counts cover all labelled rows and are summed in map tasks. The function is fitted on a sample of at most about
``fit_rows`` of them, drawn by label, with the differences that the rows outside the sample give; a label too rare for its share
has up to ``FIT_LEAST`` rows in the sample, half of its rows at most, that weigh as much as its share. If a label has
no row outside, all counts serve. There are at most 64^4 runs, whatever the corpus is.

Defined cases: null is the empty text, and gets the score that the fit has for no evidence; rows with a null id or no label
are never learned from; of repeated labels the largest holds; without rows of both classes every score is 0; repeated rows each
count and are each scored; an empty table gives no rows; texts of any length are taken whole; ``clean`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.llm.common import by_batch, crc_of, fresh, pieces

SYMBOLS, ORDER, DISCOUNT, WINDOW, FIT_ROWS, FIT_SHARE, THRESHOLD = 64, 4, 0.75, 10, 20_000, 0.25, 0.7
FIT_LEAST, _DRAWS = 50, 1 << 30
_BITS = 6
_SYMBOL = np.array([c - 96 if 97 <= c <= 122 else c - 64 if 65 <= c <= 90 else 27 if 48 <= c <= 57 else 28 + c % 36 if c >= 128 else 0 for c in range(256)], np.int32)


def symbols(text: bytes | None) -> np.ndarray:
    """A text's symbols, with a gap before and after; runs of gaps are one."""
    s = _SYMBOL[np.frombuffer(b" " + (text or b"") + b" ", np.uint8)]
    return s[np.append(True, (s[1:] != 0) | (s[:-1] != 0))]


def grams(s: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The number of each run of so many symbols; the first ones start in front of the text, where gaps are put."""
    s = np.concatenate((np.zeros(order - 1, np.int32), s))
    out = np.zeros(len(s) - order + 1, np.int32)
    for i in range(order):
        out = (out << _BITS) | s[i : len(s) - order + 1 + i]
    return out


def _counts(rows: DataFrame) -> DataFrame:
    """(part, gram, documents) of rows (part, text), summed by task and then over all; parts are 0 to 3."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        parts: dict[int, list] = {y: [] for y in range(4)}
        for part in pieces(batch, "text"):
            seen = part.column(0).to_pylist()
            for y in parts:
                if found := [np.unique(grams(symbols(t.as_buffer()))) for t, z in zip(part.column(1), seen, strict=True) if z == y and t.is_valid]:
                    parts[y].append(np.unique(np.concatenate(found), return_counts=True))
        if not len(label):
            return None
        out = []
        for y, found in parts.items():
            if found:
                keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                out.append((np.full(len(keys), y), keys, np.bincount(where, np.concatenate([n for _, n in found])).astype(np.int64)))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["part", "gram", "n"])

    return by_batch(rows.select("part", "text"), work, "part int, gram int, n long").groupBy("part", "gram").agg(F.sum("n").alias("n"))


def _interpolated(keys: np.ndarray, counts: np.ndarray, lower: np.ndarray, discount: float) -> np.ndarray:
    """Discounted relative counts of each key in its context plus the context's left-over mass times the lower order."""
    contexts, where = np.unique(keys >> _BITS, return_inverse=True)
    total = np.bincount(where, counts, len(contexts))
    kinds = np.bincount(where, counts > 0, len(contexts))
    known = total[where] > 0
    total = np.maximum(total, 1e-300)
    return np.where(known, np.maximum(counts - discount, 0) / total[where] + discount * kinds[where] / total[where] * lower, lower)


def differences(keys: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray, discount: float = DISCOUNT) -> np.ndarray:
    """log P(symbol | three before) of the toxic model less that of the ordinary one, for each run that either has seen."""
    mask = lambda order: (1 << _BITS * order) - 1
    levels, runs = [], keys
    for order in range(ORDER - 1, 0, -1):
        runs, kinds = np.unique(runs & mask(order), return_counts=True)
        levels.append((order, runs, kinds))
    order, below, kinds = levels.pop()
    p = np.maximum(kinds - discount, 0) / kinds.sum() + discount * len(kinds) / kinds.sum() / SYMBOLS
    for order, runs, kinds in reversed(levels):
        p = _interpolated(runs, kinds.astype(float), p[np.searchsorted(below, runs & mask(order - 1))], discount)
        below = runs
    shared = p[np.searchsorted(below, keys & mask(ORDER - 1))]
    return np.log(_interpolated(keys, toxic, shared, discount)) - np.log(_interpolated(keys, ordinary, shared, discount))


class Model:
    """The table of differences and the fitted logistic function."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, window: int = WINDOW):
        self.keys, self.values, self.window = keys, values.astype(np.float32), window
        self.weights = np.zeros(4)
        self._table = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def features(self, text: bytes | None) -> tuple[float, float]:
        """Mean difference by symbol, and the highest mean over a window."""
        if self._table is None:
            self._table = np.zeros(SYMBOLS**ORDER, np.float32)
            self._table[self.keys] = self.values
        d = self._table[grams(symbols(text))]
        if len(d) < 2:
            return 0.0, 0.0
        sums = np.concatenate(([0.0], np.cumsum(d, dtype=np.float64)))
        w = min(self.window, len(d))
        return float(sums[-1] / len(d)), float((sums[w:] - sums[:-w]).max() / self.window)

    def score(self, mean: np.ndarray, peak: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(mean, peak) @ self.weights, -30, 30)))

    def fit(self, mean: np.ndarray, peak: np.ndarray, label: np.ndarray, ridge: float = 1e-2, weight: np.ndarray | float = 1.0) -> None:
        """Iteratively reweighted least squares with a small ridge; evidence for a toxic text never lowers its score."""
        x, active = _design(mean, peak), [0, 1, 2, 3]
        while True:
            part, w = x[:, active], np.zeros(len(active))
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
                step = np.linalg.solve(part.T @ (part * (weight * p * (1 - p))[:, None]) + ridge * np.eye(len(w)), part.T @ (weight * (label - p)) - ridge * w)
                w += step
                if np.abs(step).max() < 1e-8:
                    break
            against = [a for a, v in zip(active, w, strict=True) if a and v < 0]
            if not against:
                break
            active.remove(against[0])
        self.weights = np.zeros(4)
        self.weights[active] = w


def _design(mean: np.ndarray, peak: np.ndarray) -> np.ndarray:
    return np.stack((np.ones(len(mean)), 20 * mean, peak, np.maximum(peak - 1, 0)), axis=1)


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(crc_of(key), F.lit(3)) == 1, F.lit(False))


def _draw() -> Column:
    return F.pmod(F.xxhash64(F.lit("fit"), F.col("key").cast("string")), F.lit(_DRAWS))


def _drawn(labelled: DataFrame, fit_rows: int) -> tuple[list[int], list[float]]:
    """For both labels of rows (key, toxic): the bound of the draws in the sample, and the weight of its rows."""
    n = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = min(FIT_SHARE, fit_rows / max(sum(n.values()), 1))
    limit, weight = [int(np.ceil(share * _DRAWS))] * 2, [1.0, 1.0]
    for y in (0, 1):
        if not 0 < (expected := share * n.get(y, 0)) < 4 * FIT_LEAST:
            continue
        # Few enough to be drawn exactly: the smallest draws of the label.
        rows = max(round(expected), min(FIT_LEAST, -(-n[y] // 2)))
        nth = F.row_number().over(Window.partitionBy("toxic").orderBy("draw", "key"))
        draws = labelled.where(F.col("toxic") == y).select("toxic", "key", _draw().alias("draw")).withColumn("nth", nth).where(F.col("nth") <= rows)
        limit[y], weight[y] = draws.agg(F.max("draw")).first()[0] + 1, expected / rows
    return limit, weight


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", label: str = "toxic", *, fit_rows: int = FIT_ROWS, window: int = WINDOW) -> Model:
    """The model from the rows that are not held out. Texts are joined with their labels on the key, in two passes: counts, and the sample's features."""
    known = labels.where(F.col(label).isNotNull() & F.col(label_key).isNotNull()).groupBy(F.col(label_key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    # One plan at every size: both sides are sorted by key, and nothing that grows with the labels is broadcast.
    known = known.where(~held_out(F.col("key")) & F.col("toxic").isin(0, 1))
    texts = docs.where(~held_out(F.col(key))).select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    limit, weight = _drawn(known.join(texts.select("key").hint("merge"), "key", "leftsemi"), fit_rows)
    inside = _draw() < F.when(F.col("toxic") == 1, limit[1]).otherwise(limit[0])
    found = _counts(texts.join(known.withColumn("part", F.col("toxic") + 2 * inside.cast("int")).hint("merge"), "key")).toPandas()
    keys, where = np.unique(found["gram"].to_numpy(np.int64), return_inverse=True)
    parts = [np.bincount(where[(y := found["part"].to_numpy() == k)], found["n"].to_numpy(float)[y], len(keys)) for k in range(4)]
    counts = [parts[0] + parts[2], parts[1] + parts[3]]
    if not all(c.sum() for c in counts):
        return Model(np.zeros(0, np.int64), np.zeros(0), window)
    model = others = Model(keys.astype(np.int32), differences(keys, *counts), window)
    if parts[0].any() and parts[1].any():
        seen = parts[0] + parts[1] > 0
        others = Model(keys[seen].astype(np.int32), differences(keys[seen], parts[0][seen], parts[1][seen]), window)
    sent = docs.sparkSession.sparkContext.broadcast(others)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = [sent.value.features(t.as_buffer() if t.is_valid else None) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in f]), pa.array([b for _, b in f])], names=["toxic", "mean", "peak"])

    sample = texts.where(_draw() < max(limit)).join(known.where(inside).hint("merge"), "key").select("toxic", "text")
    fitted = by_batch(sample, work, "toxic int, mean double, peak double").orderBy("mean", "peak", "toxic").toPandas()
    if fitted["toxic"].nunique() == 2:
        model.fit(fitted["mean"].to_numpy(), fitted["peak"].to_numpy(), fitted["toxic"].to_numpy(float), weight=np.array(weight)[fitted["toxic"].to_numpy()])
    return model


def scan(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """The rows with one more column, the score from 0 to 1, in place of one of that name. Only a map over the rows; the text stays as it is."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == into.lower()])
    at, columns = docs.columns.index(text), docs.columns
    if not len(model.keys):
        return docs.withColumn(into, F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([sent.value.features(t.as_buffer() if t.is_valid else None) for t in batch.column(at)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.score(f[:, 0], f[:, 1]))], names=[*columns, into])

    return docs.mapInArrow(run, docs.withColumn(into, F.lit(0.0)).schema)


def clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    name = fresh(docs, "score_")
    scored = scan(docs, train(docs, labels, key, text), text, name)
    return scored.where(F.col(name) < threshold).drop(name)
