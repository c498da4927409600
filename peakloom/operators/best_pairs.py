"""The best rows of a library for each of a set of queries, by dot products of whole blocks.

Queries go to the tasks in blocks of a counted size, and each task holds one block while it reads its part of the library: no pair is a
row of Spark's, and only the k best rows of each query leave a task. A product of matrices in single precision finds the pairs that can be
among the best, with a margin for all that single precision and rounding to six places can change; only these are computed as the column
expressions do it, in double precision and in the order of the components, so scores and ties are those of the plain join.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

#: Bound of the bytes that one block of queries takes in a task, with its best rows.
SENT_BYTES = 64 << 20
#: Queries and rows of one product of matrices, and pairs that are computed exactly at a time.
QUERIES, ROWS, PAIRS = 2048, 8192, 1 << 16
#: Stands for null, below all other scores.
UNKNOWN = -3e38


def half_up(x: np.ndarray, places: int = 6) -> np.ndarray:
    """Rounded as Spark rounds doubles: half away from zero, by their shortest decimal form."""
    y = np.abs(x) * 10.0**places
    out = np.floor(y + 0.5) / 10.0**places * np.sign(x) + 0.0
    with np.errstate(invalid="ignore"):
        doubtful = np.isfinite(x) & ((np.abs(y - np.floor(y) - 0.5) < 1e-6 + y * 1e-14) | (y >= 2.0**50))
    for i in np.flatnonzero(doubtful).tolist():
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) + 0.0 if abs(x[i]) < 1e20 else x[i]
    return np.where(np.isfinite(x), out, x)


class _Vectors:
    """Vectors of one width: in double precision, as rows for the product, and marked where they have no value or another size.

    What is no vector of finite numbers up to this width has zeros; ``size`` is -1 without a vector, with a null in it, or beyond the width.
    """

    def __init__(self, lists: pa.Array, width: int, measure: str, query: bool, target: float):
        held = lists.flatten()
        given = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(given)), given)
        place = np.arange(len(row)) - np.repeat(np.cumsum(given) - given, given)
        values = held.cast(pa.float64()).to_numpy(zero_copy_only=False)
        self.size = np.where(lists.is_null().to_numpy(zero_copy_only=False) | (given > width), -1, given)
        if held.null_count:
            self.size[row[held.is_null().to_numpy(zero_copy_only=False)]] = -1
        if len(values) == len(given) * width and (given == width).all():
            self.exact = np.array(values.reshape(len(given), width))
        else:
            kept = self.size[row] >= 0
            self.exact = np.zeros((len(given), width))
            self.exact[row[kept], place[kept]] = values[kept]
        self.exact[self.size < 0] = 0
        self.wild = ~np.isfinite(self.exact).all(axis=1)
        if measure == "residual" and query:
            self.exact = np.where(np.arange(width) < self.size[:, None], target - self.exact, 0.0)
        tame = np.where(self.wild[:, None], 0.0, self.exact)
        with np.errstate(over="ignore", invalid="ignore"):
            self.norm = np.zeros(len(given))
            for x in self.exact.T:
                self.norm += x * x
            self.norm = np.sqrt(self.norm)
            length = np.sqrt((tame * tame).sum(axis=1))
            # Lengths that single precision can't carry are left to the exact computation.
            self.wild |= ~(length < 1e15) | ((length > 0) & (length < 1e-15))
            tame[self.wild] = 0
            length[self.wild] = 0
        if measure == "cosine":
            tame = tame / np.where(length > 0, length, 1)[:, None]
            length = np.minimum(length, 1.0)
        if measure == "residual":
            squares, one = (length * length)[:, None], np.ones((len(given), 1))
            tame = np.concatenate((2 * tame, -squares, -one) if query else (tame, one, squares), axis=1)
        self.length, self.rough = length, tame.astype(np.float32)


class _Block:
    """Queries that meet the same rows, and the best of these so far: keys fall, equal ones by rising id."""

    def __init__(self, ids: np.ndarray, vectors: _Vectors, at: slice, k: int, measure: str, fallback: float, own: bool):
        self.ids, self.k, self.measure, self.fallback, self.own = ids[at], k, measure, fallback, own
        self.exact, self.rough, self.norm, self.length, self.size, self.wild = (getattr(vectors, n)[at] for n in ("exact", "rough", "norm", "length", "size", "wild"))
        self.mixed = bool((self.size != self.size[0]).any()) or self.size[0] < 0
        most = np.abs(self.rough).max(axis=0)
        used = (most > 1e-12) | (measure != "product")
        # Components that are next to nothing in every query stay out of the product; what they add is in the margin.
        self.used, self.left_out = None if used.all() else np.flatnonzero(used), float(np.sqrt((most[~used].astype(float) ** 2).sum()))
        self.asked = self.rough if self.used is None else np.ascontiguousarray(self.rough[:, self.used])
        n = len(self.ids)
        self.key, self.value, self.row_id = np.full((n, k), -np.inf), np.zeros((n, k)), np.full((n, k), np.iinfo(np.int64).max)
        self.also = np.full((n, k), None, object)

    def add(self, ids: np.ndarray, rows: _Vectors, at: np.ndarray, has: np.ndarray | None, also: pa.Array | None) -> None:
        rough = self.asked @ (rows.rough[at] if self.used is None else rows.rough[at[:, None], self.used[None, :]]).T
        sizes, wild = rows.size[at], rows.wild[at]
        if self.mixed or (sizes != self.size[0]).any():
            everyone = np.arange(len(self.ids))[:, None]
            rough[self.size[:, None] != sizes[None, :]] = 0
            rough[self._unknown(everyone, at[None, :], rows)] = -np.inf if self.measure == "residual" else UNKNOWN
        if wild.any() or self.wild.any():
            rough[(self.size[:, None] == sizes[None, :]) & (wild[None, :] | self.wild[:, None])] = np.inf
        most = rows.length[at].max(initial=0)
        # Twice what a product in single precision can be off, and what rounding to six places can.
        margin = 2.0**-23 * (self.rough.shape[1] + 8) * ((self.length + most) ** 2 if self.measure == "residual" else self.length * most) + self.left_out * most + 1e-6
        if has is not None:
            rough[:, ~has[at]] = self.fallback
        last = self.key[:, -1]
        if len(at) > self.k + 1 and not np.isfinite(last).all():
            cut = len(at) - self.k - 1
            last = np.maximum(last, np.partition(rough, cut, axis=1)[:, cut] - margin)
        # What single precision rounds off the bound itself is far within the margin.
        q, r = np.divmod(np.flatnonzero(rough >= (last - margin).astype(np.float32)[:, None]), len(at))
        for start in range(0, len(q), PAIRS):
            self._merge(q[start : start + PAIRS], at[r[start : start + PAIRS]], ids, rows, has, also)

    def _unknown(self, q: np.ndarray, r: np.ndarray, rows: _Vectors) -> np.ndarray:
        """Pairs without a score: as in the column expressions, a cosine with no vector or one of length 0 is 0."""
        a, b = self.size[q], rows.size[r]
        if self.measure == "cosine":
            return (a != b) & (a >= 0) & (b >= 0) & (self.norm[q] != 0) & (rows.norm[r] != 0)
        return (a != b) | (b < 0)

    def _merge(self, q: np.ndarray, r: np.ndarray, ids: np.ndarray, rows: _Vectors, has: np.ndarray | None, also: pa.Array | None) -> None:
        kept = (self.ids[q] != ids[r]) | self.own
        if has is not None:
            kept &= has[r] | (self.fallback > self.key[q, -1]) | ((self.fallback == self.key[q, -1]) & (ids[r] < self.row_id[q, -1]))
        q, r = q[kept], r[kept]
        value = self._scores(q, r, rows)
        if has is not None:
            value = np.where(has[r], value, half_up(np.array([self.fallback]))[0])
        key = np.where(np.isnan(value), np.inf, value)
        kept = (key > self.key[q, -1]) | ((key == self.key[q, -1]) & (ids[r] < self.row_id[q, -1]))
        if self.measure == "residual":
            kept &= ~self._unknown(q, r, rows)
        q, r, key, value = q[kept], r[kept], key[kept], value[kept]
        if not len(q):
            return
        touched = np.unique(q)
        names = also.take(pa.array(r)).to_pylist() if also is not None else None
        extra = np.full(len(r), None, object)
        if names is not None:
            extra[:] = names
        old = np.repeat(touched, self.k)
        q = np.concatenate((old, q))
        parts = [np.concatenate((a[touched].ravel(), b)) for a, b in ((self.key, key), (self.value, value), (self.row_id, ids[r]), (self.also, extra))]
        order = np.lexsort((parts[2], -parts[0], q))
        sizes = np.bincount(q)[touched]
        starts = np.cumsum(sizes) - sizes
        best = order[(starts[:, None] + np.arange(self.k)).ravel()]
        for into, part in zip((self.key, self.value, self.row_id, self.also), parts, strict=True):
            into[touched] = part[best].reshape(len(touched), self.k)

    def _scores(self, q: np.ndarray, r: np.ndarray, rows: _Vectors) -> np.ndarray:
        a, b, total = self.exact[q], rows.exact[r], np.zeros(len(q))
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            for d in range(a.shape[1]):
                if self.measure == "residual":
                    off = a[:, d] - b[:, d]
                    total += off * off
                else:
                    total += a[:, d] * b[:, d]
            if self.measure == "cosine":
                size = self.norm[q] * rows.norm[r]
                total = np.where(size == 0, 0.0, total / size)
        if self.measure == "residual":
            return -half_up(total)
        return np.where(self._unknown(q, r, rows), UNKNOWN, half_up(np.where((self.size[q] == rows.size[r]) & (rows.size[r] >= 0), total, 0.0)))

    def found(self) -> tuple[np.ndarray, ...]:
        held = self.key > -np.inf
        return np.repeat(self.ids, held.sum(axis=1)), self.row_id[held], self.value[held], self.also[held]


def best_pairs(asked: DataFrame, library: DataFrame, k: int, measure: str = "cosine", same: str | None = None, also: str | None = None, has: str | None = None, fallback: float = 0.0, target: float = 0.0, own: bool = False) -> DataFrame:
    """At least the k best of each row of (query_id, query) over (vec_id, vector) but its own id: (query_id, vec_id, score, ``also``), several parts of a query apart.

    ``cosine`` is 0 with no vector, with nulls in one, or a length of 0, and null for different sizes; ``product`` is null for all of these
    but the last, and ``fallback`` for rows that don't have a vector by the column ``has``; null is the lowest score. ``residual`` is the negative square distance of (target - query) to the vector; pairs of other
    sizes have none. Scores have six places. ``same`` names a column of both sides that has to be equal; it is in the result, as is the
    library's column ``also``. Ids are whole numbers; with ``own``, a row of the query's id counts like the others.
    """
    count, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("query")), F.lit(1))).first()
    width = max(width, 1)
    blocks = max(1, -(-count // max(1, SENT_BYTES // (20 * width + 40 * k))))
    numbered = asked.where("query_id IS NOT NULL").select("query_id", "query", *([same] if same else []), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("_block"))
    columns = ["vec_id", "vector", *dict.fromkeys(c for c in (same, also, has) if c)]
    layout = StructType([asked.schema["query_id"], library.schema["vec_id"], StructField("score", DoubleType()), *[library.schema[c] for c in (same, also) if c]])
    schema, found = to_arrow_schema(layout), None
    for block in range(blocks):
        held = numbered.where(F.col("_block") == block).drop("_block").toArrow().combine_chunks()
        sent = asked.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            queries, groups, kinds = sent.value, {}, None
            whole = lambda column: column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            if queries.num_rows == 0:
                return
            if same:
                kinds = pc.drop_null(pc.unique(whole(queries[same])))
                codes = pc.fill_null(pc.index_in(whole(queries[same]), value_set=kinds), -1).to_numpy(zero_copy_only=False)
                order = np.argsort(codes, kind="stable")
                queries, codes = queries.take(pa.array(order)), codes[order]
            else:
                codes = np.zeros(queries.num_rows, np.int64)
            names = whole(queries["query_id"]).to_numpy(zero_copy_only=False)
            vectors = _Vectors(whole(queries["query"]), width, measure, True, target)
            for code in np.unique(codes[codes >= 0]).tolist():
                low, high = np.searchsorted(codes, [code, code + 1]).tolist()
                groups[code] = [_Block(names, vectors, slice(i, min(i + QUERIES, high)), k, measure, fallback, own) for i in range(low, high, QUERIES)]
            most = 1024
            for batch in batches:
                start = 0
                while start < batch.num_rows:
                    part = batch.slice(start, most)
                    start, most = start + most, min(2 * most, ROWS)
                    ids = part.column("vec_id").to_numpy(zero_copy_only=False)
                    rows = _Vectors(part.column("vector"), width, measure, False, target)
                    given = part.column(has).to_numpy(zero_copy_only=False).astype(bool) if has else None
                    kind = pc.fill_null(pc.index_in(part.column(same), value_set=kinds), -1).to_numpy(zero_copy_only=False) if same else np.zeros(len(ids), np.int64)
                    for code in np.unique(kind[kind >= 0]).tolist():
                        at = np.flatnonzero(kind == code)
                        for one in groups.get(code, ()):
                            one.add(ids, rows, at, given, part.column(also) if also else None)
            for code, parts in groups.items():
                for one in parts:
                    query, row, score, extra = one.found()
                    cells = [query, row, pa.array(score, mask=score == UNKNOWN)]
                    if same:
                        cells.append([kinds[code].as_py()] * len(query))
                    if also:
                        cells.append(extra.tolist())
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)

        one = library.where("vec_id IS NOT NULL").select(*columns).mapInArrow(run, layout)
        found = one if found is None else found.unionByName(one)
    return found
