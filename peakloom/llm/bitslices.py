"""Exact top-k inner products by a bit-sliced index.

The index has one row for a block of vectors, in order of their ids: for each dimension and each bit of its quantised value,
one bitmap over the block's vectors. Values are floor(scale * x), less the block's least in that dimension.

For a batch of queries, a score's bit slices are the sum of the slices of all dimensions, each shifted by the bits of the query's
component that are set; for a negative component the complement is added, so every term is positive. Terms of one weight are
added three at a time (two bitmaps hold their sum), so a whole block is added up in bitmap arithmetic. The k best are then
selected from the most significant slice downward: rows with the bit stay if at least k of them do, else they are in, and the
rest are looked at. Rows that tie at the boundary are taken by smallest id, and the scores of the rows selected are
computed exactly from the vectors; at most k rows of a block leave it for each query.

Queries are rows of a table too: blocks of at most ``query_bytes``, dealt by id. Index blocks are dealt into groups by their number,
and every group meets every block of queries of its length in a task of its own, by a key of both, so that memory is bounded by one
group and one block, nothing is sent to the driver or broadcast, and a lost task is done again alone. The index is copied
once for each block of queries. All rows are indexed and looked at: recall is 1.

Any finite component takes part: bitmaps have as many slices as the block's values need, values from 2^62 on are kept as decimal
text, and scores are summed as Python integers where 64 bits may not hold them. A score among the k best that 64 bits
can't hold ends the job with an error, since the result is a long.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do null ids; only vectors of
equal length are compared, and empty vectors score 0; rows that share a query's id aren't its candidates; equal rows are
one query, and different vectors of one id ask together, for the k best of all; repeated candidates each count; an empty table
gives no rows; columns beside key and vector are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.llm.common import durable

SCALE, BLOCK_BYTES, QUERY_BYTES, GROUP_BYTES, BATCH, WIDE = 256, 32 << 20, 16 << 20, 64 << 20, 32, 1 << 62
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
INDEX = "dimensions int, bits int, wide boolean, ids binary, base binary, slices binary, vectors binary"


def quantised(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, x): the vectors that take part, as doubles."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite).select(F.col(key).cast("long").alias("id"), x.alias("x"))


def _vectors(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(wide, ids, floor(scale * x)) of (id, x) batches, by length and by whether the values need Python integers."""
    for batch in batches:
        lists, ids = batch.column(1), batch.column(0).to_numpy()
        ends = lists.offsets.to_numpy()
        flat, sizes = lists.values.to_numpy(zero_copy_only=False), np.diff(ends)
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            x = flat[ends[at][:, None] + np.arange(size)]
            wide = (np.abs(x) >= WIDE / scale).any(axis=1)
            if not wide.all():
                yield False, ids[at[~wide]], np.floor(x[~wide] * scale).astype(np.int64)
            if wide.any():
                yield True, ids[at[wide]], np.array([[math.floor(Fraction(c) * scale) for c in row] for row in x[wide].tolist()], object).reshape(-1, size)


def _cells(v: np.ndarray) -> bytes:
    return " ".join(map(str, v.ravel().tolist())).encode() if v.dtype == object else np.ascontiguousarray(v, np.int64).tobytes()


def _read(cells: bytes, shape: tuple[int, ...], wide: bool) -> np.ndarray:
    return (np.array([int(c) for c in cells.split()], object) if wide else np.frombuffer(cells, np.int64)).reshape(shape)


def _packed(flags: np.ndarray) -> np.ndarray:
    """Bitmaps of 64-bit words from rows of flags."""
    pad = -flags.shape[-1] % 64
    bits = np.packbits(np.pad(flags, [(0, 0)] * (flags.ndim - 1) + [(0, pad)]), axis=-1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64)


def index(vectors: DataFrame, scale: int = SCALE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each block of (id, x) rows; a block is what a task has of one length and width, up to so many bytes."""

    def row(wide: bool, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        base = v.min(axis=0) if v.shape[1] else v[0]
        above = (v - base).T
        bits = int(above.max(initial=0)).bit_length()
        slices = np.stack([_packed(((above >> b) & 1 == 1).astype(bool)) for b in range(bits)], axis=1) if bits else np.zeros(0, np.uint64)
        cells = (v.shape[1], bits, wide, ids.astype(np.int64).tobytes(), _cells(base), slices.tobytes(), _cells(v))
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, [pa.int32(), pa.int32(), pa.bool_()] + [pa.binary()] * 4, strict=True)], names=[f.split()[0] for f in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple, list] = {}
        for wide, ids, v in _vectors(batches, scale):
            key, most = (wide, v.shape[1]), max(64, block_bytes // (8 * max(v.shape[1], 1)))
            waiting.setdefault(key, []).append((ids, v))
            if sum(len(i) for i, _ in waiting[key]) >= most:
                i, v = (np.concatenate(c) for c in zip(*waiting.pop(key), strict=True))
                for cut in range(0, len(i), most):
                    yield row(wide, i[cut : cut + most], v[cut : cut + most])
        for (wide, _), held in waiting.items():
            yield row(wide, *(np.concatenate(c) for c in zip(*held, strict=True)))

    return vectors.mapInArrow(run, INDEX)


class Block:
    """One row of the index, ready for queries."""

    def __init__(self, dimensions: int, bits: int, wide: bool, ids: bytes, base: bytes, slices: bytes, vectors: bytes):
        self.ids, self.base = np.frombuffer(ids, np.int64), _read(base, (dimensions,), wide)
        self.words, self.bits, self.dimensions = -(-len(self.ids) // 64), bits, dimensions
        self.slices = np.frombuffer(slices, np.uint64).reshape(dimensions if bits else 0, bits, self.words)
        self.vectors = _read(vectors, (len(self.ids), dimensions), wide)
        self.most = max((abs(int(c)) for c in (self.vectors.max(initial=0), self.vectors.min(initial=0))), default=0)
        self.present = _packed(np.ones(len(self.ids), bool))

    def sums(self, queries: np.ndarray) -> list[np.ndarray]:
        """Bit slices of the scores, lowest first, each (queries, words), but for a constant of each query."""
        columns: list[list[np.ndarray]] = []

        def put(weight: int, bitmap: np.ndarray) -> None:
            while True:
                while len(columns) <= weight:
                    columns.append([])
                columns[weight].append(bitmap)
                if len(columns[weight]) < 3:
                    return
                a, b, c = columns[weight]
                either = a ^ b
                columns[weight] = [either ^ c]
                bitmap, weight = (a & b) | (either & c), weight + 1

        size, negative = np.abs(queries), np.where((queries < 0).astype(bool), _ALL, np.uint64(0))
        for j in range(self.dimensions if self.bits else 0):
            wanted = [(n, np.where(((size[:, j] >> n) & 1 == 1).astype(bool), _ALL, np.uint64(0))[:, None]) for n in range(int(size[:, j].max()).bit_length())]
            for b in range(self.bits):
                term = self.slices[j, b][None, :] ^ negative[:, j, None]
                for n, mask in wanted:
                    put(b + n, term & mask)
        out, carry = [], None
        for held in columns:
            parts = [*held, *([carry] if carry is not None else [])]
            carry = None
            if len(parts) == 3:
                either = parts[0] ^ parts[1]
                carry = (parts[0] & parts[1]) | (either & parts[2])
                parts = [either ^ parts[2]]
            elif len(parts) == 2:
                carry = parts[0] & parts[1]
                parts = [parts[0] ^ parts[1]]
            out.append(parts[0] if parts else np.zeros((len(queries), self.words), np.uint64))
        return [*out, *([carry] if carry is not None else [])]

    def best(self, names: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k best rows of this block for each query, or all of them if there are fewer."""
        open_ = np.repeat(self.present[None, :], len(names), axis=0)
        first, last = np.searchsorted(self.ids, names, "left"), np.searchsorted(self.ids, names, "right")
        for q, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
            for i in range(a, b):
                open_[q, i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        inside = np.zeros_like(open_)
        for s in reversed(self.sums(queries)):
            high = open_ & s
            enough = np.bitwise_count(inside | high).sum(axis=1, dtype=np.int64)[:, None] >= k
            inside = np.where(enough, inside, inside | high)
            open_ = np.where(enough, high, open_ & ~s)
        taken, rows = [], []
        for q in range(len(names)):
            sure, tied = self._places(inside[q]), self._places(open_[q])
            at = np.concatenate((sure, tied[: max(0, k - len(sure))]))
            taken.append(np.full(len(at), q))
            rows.append(at)
        taken, rows = np.concatenate(taken), np.concatenate(rows)
        bound = self.most * int(np.abs(queries).max(initial=0)) * max(self.dimensions, 1)
        kind = np.int64 if bound < 1 << 62 else object
        score = (self.vectors[rows].astype(kind) * queries[taken].astype(kind)).sum(axis=1)
        return names[taken], self.ids[rows], score

    @staticmethod
    def _places(bitmap: np.ndarray) -> np.ndarray:
        held = np.flatnonzero(bitmap)
        flags = np.unpackbits(bitmap[held].view(np.uint8).reshape(len(held), 8), axis=1, bitorder="little")
        where, bit = np.nonzero(flags)
        return held[where] * 64 + bit


def search(queries: DataFrame, candidates: DataFrame, k: int, key: str, vector: str, *, scale: int = SCALE, block_bytes: int = BLOCK_BYTES, query_bytes: int = QUERY_BYTES, group_bytes: int = GROUP_BYTES, batch: int = BATCH) -> DataFrame:
    """(query_id, rank, key, score): the k candidates of the largest inner product with each query, ties to the smaller id."""
    blocks = durable(index(quantised(candidates, key, vector), scale, block_bytes).withColumn("number", F.monotonically_increasing_id()), "slices")
    asked = quantised(queries, key, vector).distinct()
    # For each length, how many blocks its queries make, and how many groups its index: two numbers a length, on one row each.
    sizes = asked.groupBy(F.size("x").alias("dimensions")).agg(F.count("*").alias("n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("dimensions") * 8 / query_bytes)).cast("int")
    bytes_ = F.sum(F.octet_length("ids") + F.octet_length("slices") + F.octet_length("vectors"))
    groups = blocks.groupBy("dimensions").agg(F.greatest(F.lit(1), F.ceil(bytes_ / group_bytes)).cast("int").alias("groups"))
    plan = durable(sizes.select("dimensions", parts.alias("parts")).join(groups, "dimensions"), "plan")
    own = F.pmod(F.xxhash64("id", "x"), F.col("parts")).cast("int")
    to = F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
    left = asked.withColumn("dimensions", F.size("x")).join(plan, "dimensions").select("dimensions", own.alias("part"), to.alias("group"), "id", "x")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    right = blocks.join(plan, "dimensions").select("*", every.alias("part"), F.pmod(F.xxhash64("number"), F.col("groups")).cast("int").alias("group"))

    def meet(asking: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        for _, names, vectors in _vectors(asking.select(["id", "x"]).to_batches(), scale):
            for n in range(held.num_rows):
                block = Block(**{c: held.column(c)[n].as_py() for c in (f.split()[0] for f in INDEX.split(", "))})
                for i in range(0, len(names), batch):
                    q, ids, score = block.best(names[i : i + batch], vectors[i : i + batch], k)
                    out.append(pa.table([pa.array(q, pa.int64()), pa.array(ids, pa.int64()), pa.array([str(x) for x in score.tolist()], pa.string())], names=["query_id", "id", "score"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string())], names=["query_id", "id", "score"])

    keys = ["dimensions", "part", "group"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, id long, score string")
    # Scores beyond a long are ordered as what they are: by sign, then by the number of digits and the digits.
    digits = F.regexp_replace("score", "^-", "")
    order = [~F.startswith("score", F.lit("-")), F.when(F.startswith("score", F.lit("-")), -F.length(digits)).otherwise(F.length(digits))]
    turned = F.when(F.startswith("score", F.lit("-")), F.translate(digits, "0123456789", "9876543210")).otherwise(digits)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("plus"), F.desc("places"), F.desc("digits"), "id"))
    found = found.select("query_id", "id", "score", order[0].alias("plus"), order[1].alias("places"), turned.alias("digits"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), F.col("score").cast("long").alias("score"))
