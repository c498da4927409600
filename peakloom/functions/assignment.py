"""Optimal matching of two peak sets, as Arrow functions over batches: kernels that column expressions can't give."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sets of so many peaks at most, on the smaller side, are matched by a table over their subsets, many rows at a time.
SUBSETS, AT_ONCE = 7, 2048


def cheapest(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a cheapest one-to-one assignment; rows are no more than columns.

    Shortest augmenting paths with potentials: O(rows^2 columns).
    """
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, np.int64)
    for row in range(1, n + 1):
        owner[0], column = row, 0
        shortest, used, back = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, np.int64)
        while True:
            used[column] = True
            reduced = cost[owner[column] - 1] - u[owner[column]] - v[1:]
            better = ~used[1:] & (reduced < shortest[1:])
            shortest[1:][better], back[1:][better] = reduced[better], column
            after = int(np.argmin(np.where(used[1:], np.inf, shortest[1:]))) + 1
            step = shortest[after]
            u[owner[used]] += step
            v[used] -= step
            shortest[~used] -= step
            column = after
            if owner[column] == 0:
                break
        while column:
            owner[column], column = owner[back[column]], back[column]
    out = np.full(n, -1)
    for column in range(1, m + 1):
        if owner[column]:
            out[owner[column] - 1] = column - 1
    return out


def set_match(a: np.ndarray, b: np.ndarray, width: float) -> float:
    """The best one-to-one sum of exp(-(x - y)^2 / (2 width^2)) by the root of the sizes' product; 0 if either set is empty."""
    if not len(a) or not len(b):
        return 0.0
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    gain = np.exp(-((a[:, None] - b[None, :]) ** 2) / (2 * width * width))
    return float(gain[np.arange(len(a)), cheapest(-gain)].sum() / np.sqrt(len(a) * len(b)))


def subset_sums(gain: np.ndarray) -> np.ndarray:
    """(2^s, rows): the best one-to-one sum of exactly the peaks of each subset of the s, from gains (rows, s, others); -inf where the others are too few."""
    rows, s, others = gain.shape
    best = np.full((1 << s, rows), -np.inf)
    best[0] = 0
    masks = np.arange(1 << s)
    holding = [masks[masks >> i & 1 == 1] for i in range(s)]
    for j in range(others):
        after = best.copy()
        for i, held in enumerate(holding):
            after[held] = np.maximum(after[held], best[held ^ (1 << i)] + gain[:, i, j])
        best = after
    return best


def set_matches(left: pa.Array, right: pa.Array, width: float) -> np.ndarray:
    """``set_match`` of each two lists: rows of the same sizes together, those of more than ``SUBSETS`` peaks or with nulls one by one; a null list is empty."""
    sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (left, right)]
    starts = [np.cumsum(n) - n for n in sizes]
    values = [x.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) for x in (left, right)]
    out = np.zeros(len(left))
    shapes, shape = np.unique(np.stack(sizes, axis=1), axis=0, return_inverse=True)
    for at, both in enumerate(shapes.tolist()):
        if not min(both):
            continue
        every = np.flatnonzero(shape.ravel() == at)
        for rows in (every[i : i + AT_ONCE] for i in range(0, len(every), AT_ONCE)):
            a, b = (v[s[rows][:, None] + np.arange(n)] for v, s, n in zip(values, starts, both, strict=True))
            whole = np.isfinite(a).all(axis=1) & np.isfinite(b).all(axis=1) if min(both) <= SUBSETS else np.zeros(len(rows), bool)
            for i in np.flatnonzero(~whole):
                out[rows[i]] = set_match(a[i], b[i], width)
            a, b = (a[whole], b[whole]) if both[0] <= both[1] else (b[whole], a[whole])
            gain = np.exp(-((a[:, :, None] - b[:, None, :]) ** 2) / (2 * width * width))
            if len(a):
                out[rows[whole]] = subset_sums(gain)[-1] / np.sqrt(both[0] * both[1])
    return out


def similarity(h: np.ndarray, c: np.ndarray, predicted_h: np.ndarray, predicted_c: np.ndarray, wide_h: float = 1.0, wide_c: float = 10.0) -> float:
    """The mean of both nuclei's matches if the query has both, else that of the one it has."""
    scores = [set_match(q, p, w) for q, p, w in ((h, predicted_h, wide_h), (c, predicted_c, wide_c)) if len(q)]
    return float(np.mean(scores)) if scores else 0.0


def ordered_assignment(query: np.ndarray, predicted: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (query, predicted) of a cheapest assignment by absolute difference.

    The cost is convex, so some cheapest assignment keeps both orders: a table over the sorted peaks finds it.
    """
    if not len(query) or not len(predicted):
        return []
    a, b = np.argsort(query, kind="stable"), np.argsort(predicted, kind="stable")
    swap = len(a) > len(b)
    if swap:
        a, b, query, predicted = b, a, predicted, query
    n, m = len(a), len(b)
    best = np.full((n + 1, m + 1), np.inf)
    best[0] = 0
    for i in range(1, n + 1):
        pair = best[i - 1, :-1] + np.abs(query[a[i - 1]] - predicted[b])
        best[i, 1:] = np.minimum.accumulate(pair)
    pairs, j = [], m
    for i in range(n, 0, -1):
        while j > i and best[i, j] == best[i, j - 1]:
            j -= 1
        pairs.append((int(a[i - 1]), int(b[j - 1])))
        j -= 1
    return sorted((y, x) if swap else (x, y) for x, y in pairs)


def _numbers(cell) -> np.ndarray:
    return np.zeros(0) if cell is None else np.asarray(cell, dtype=float)


def set_match_udf(width: float):
    @F.arrow_udf(T.DoubleType())
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(set_matches(a, b, width))

    return score


@F.arrow_udf(T.DoubleType())
def similarity_udf(h: pa.Array, c: pa.Array, predicted_h: pa.Array, predicted_c: pa.Array) -> pa.Array:
    asked = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) > 0 for x in (h, c)]
    scores = [np.where(has, set_matches(q, p, w), 0.0) for has, q, p, w in zip(asked, (h, c), (predicted_h, predicted_c), (1.0, 10.0), strict=True)]
    return pa.array((scores[0] + scores[1]) / np.maximum(asked[0].astype(int) + asked[1], 1))


_PAIR = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("predicted", T.IntegerType()), T.StructField("residual", T.DoubleType())])
_PLACES = T.ArrayType(T.IntegerType())
ASSIGNMENT = T.StructType([T.StructField("matched", T.ArrayType(_PAIR)), T.StructField("unmatched", _PLACES), T.StructField("unused", _PLACES), T.StructField("cost", T.DoubleType())])


@F.pandas_udf(ASSIGNMENT)
def assignment_udf(query: pd.Series, predicted: pd.Series) -> pd.DataFrame:
    """Matched peaks with what is left between them, query peaks without and predicted peaks unused, and the total cost."""
    rows = []
    for q, p in zip(map(_numbers, query), map(_numbers, predicted), strict=True):
        pairs = ordered_assignment(q, p)
        matched = [{"query": i, "predicted": j, "residual": float(abs(q[i] - p[j]))} for i, j in pairs]
        rows.append((matched, sorted(set(range(len(q))) - {i for i, _ in pairs}), sorted(set(range(len(p))) - {j for _, j in pairs}), float(sum(x["residual"] for x in matched))))
    return pd.DataFrame(rows, columns=["matched", "unmatched", "unused", "cost"])
