"""Near duplicates by an inverted join on the coordinates of MinHash signatures, confirmed on full shingle sets.

1. Equal sets are one class, by count and two 64-bit sums over their hashed shingles; from here on a class is one row with a
   number of its own, and ids come back only at the end.
2. Each coordinate of a class's signature, with its value, is a token. Two sets of the wanted similarity agree on at least
   ``match`` of ``coordinates``; at the threshold itself a pair misses that about once in a thousand million times.
   Tokens are ordered by frequency; of a pair that agrees on so many, both have a common token among their first
   coordinates - match + 1 (prefix). Only those are posted: the longest lists, of boilerplate, are never merged, they are
   probed instead (skip), by the signatures that the posted rows carry, a byte for each coordinate. Bytes agree wherever
   coordinates do, so their count of collisions is never too small.
3. The members of a posted list meet one of them, its hub: the one whose tokens are the most frequent, the text that
   the others vary. A pair is retained if it has ``match`` collisions, and confirmed on the full sets of shingles, by 64-bit
   hashes of BLAKE2b word digests. Members that are then known to be connected with the hub have its group.
4. Lists whose members are still in different groups are finished in cells. Classes that share such lists are dealt into blocks
   of at most about ``block`` by the weightiest hub that their lists lead to in two steps, so that near texts stand together; a
   block by itself, and every two blocks that still meet in such a list, are a cell, once, whatever the number of lists. A cell is
   one bounded step of a task: it counts the collisions of all pairs of different groups in it, retains and confirms them in the
   same way, and gives links only, no candidate pairs.
5. Components of the confirmed links, once. Links between members of a group that a hub has joined are contracted before.

Every set takes these steps, however large its group is. Tables that are aggregated are written before they are joined, so that
adaptive execution can split a hot token, hub or class. A group of which all members are near, but below, the threshold to each
other costs a count in a cell for each of its pairs, and each of its texts goes to as many cells as the group has blocks.

Whether a pair is similar is decided in whole numbers: similar = (80, 100) asks for 100 * intersection >= 80 * union.
Defined cases: a null or wordless text has an empty set and is linked with nothing; a text of fewer words than a shingle is
one shingle; rows that share an id are one document in components, with the links of each of its texts; rows with a null id
are linked with nothing and have a null component; an empty table gives no rows; any length of text is taken whole; columns beside
key and text are not read by ``near_duplicates``, and ``deduplicated`` keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import by_batch, durable, fresh, mixed, removed, runs, text_hashes
from peakloom.llm.graph import components

SIZE, SIMILAR, COORDINATES, MATCH, BLOCK, BLOCK_BYTES, CACHED = 5, (80, 100), 64, 32, 1024, 32 << 20, 1 << 22
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """The distinct hashed shingles of a text, sorted."""
    words = text_hashes(text, lower=True)
    if not len(words):
        return words
    return np.unique(runs(words, min(size, len(words))))


def signature(found: np.ndarray, coordinates: int, step: int = 1 << 14) -> np.ndarray:
    """The least hash of the set under each of so many functions; every value also tells its coordinate."""
    seeds = mixed(np.arange(1, 2 * coordinates + 1, dtype=np.uint64) * _GOLDEN)
    flip, factor = seeds[:coordinates, None], seeds[coordinates:, None] | np.uint64(1)
    least = np.full(coordinates, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(found), step):
        h = (found[None, i : i + step] ^ flip) * factor
        h ^= h >> np.uint64(32)
        np.minimum(least, h.min(axis=1), out=least)
    return mixed(least + np.arange(coordinates, dtype=np.uint64) * _GOLDEN)


def sketches(docs: DataFrame, key: str, text: str, size: int = SIZE, coordinates: int = COORDINATES) -> DataFrame:
    """(key, content, n, one, two, signature, sketch) of each row; content is a hash of the text, one and two identify the set, the sketch has a byte of each coordinate, eight to a number."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, one, two, flat, packed, ends = [], [], [], [], [], [0]
        for value in batch.column(2):
            found = shingles(value.as_buffer() if value.is_valid else None, size)
            n.append(len(found))
            one.append(int(mixed(found).sum(dtype=np.uint64).astype(np.int64)))
            two.append(int(mixed(found ^ _GOLDEN).sum(dtype=np.uint64).astype(np.int64)))
            if len(found):
                flat.append(signature(found, coordinates).view(np.int64))
                packed.append(np.pad(flat[-1].astype(np.uint8), (0, -coordinates % 8)).view(np.int64))
            ends.append(ends[-1] + (coordinates if len(found) else 0))
        values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        short = pa.ListArray.from_arrays(pa.array([e // coordinates * -(-coordinates // 8) for e in ends], pa.int32()), pa.array(np.concatenate(packed) if packed else np.zeros(0, np.int64)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), lists, short], names=["key", "content", "n", "one", "two", "signature", "sketch"])

    return by_batch(docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(text)).alias("content"), _bytes(text)), work, "key long, content long, n long, one long, two long, signature array<long>, sketch array<long>")


def _bytes(text: str):
    return F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text")


def postings(classes: DataFrame, coordinates: int, match: int) -> DataFrame:
    """(token, rep, weight): the tokens of each class that the prefix rule posts and another class holds.

    The weight is the number of rows in all lists that would have the class.
    """
    tokens = classes.select("rep", F.explode("signature").alias("token"))
    shared = durable(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    ordered = tokens.join(shared, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("held"))
    room = F.size("held") - match + 1  # those that occur once come first in the order, so all of the last ones may be skipped
    weight = F.aggregate("held.n", F.lit(0).cast("long"), lambda x, n: x + n)
    found = durable(ordered.where(room > 0).select("rep", weight.alias("weight"), F.explode(F.slice("held.token", 1, room)).alias("token")).select("token", "rep", "weight"), "postings")
    removed(shared)
    return found


def _collisions(a: str, b: str, coordinates: int) -> Column:
    """The number of equal bytes in two sketches: those of their exclusive or that are 0."""
    differ = F.lit(0)
    for i in range(-(-coordinates // 8)):
        x = F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))
        for by in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return F.lit(coordinates) - differ


def full_sets(texts: DataFrame, size: int) -> DataFrame:
    """(key, shingles): the full sets of (key, text) rows, as sorted 64-bit hashes."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(text.as_buffer(), size).tobytes() for text in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["key", "shingles"])

    return by_batch(texts.select("key", "text"), work, "key long, shingles binary")


def _set(shingles: bytes) -> frozenset:
    return frozenset(np.frombuffer(shingles, np.uint64).tolist())


def _alike(one: frozenset, two: frozenset, similar: tuple[int, int]) -> bool:
    if min(len(one), len(two)) * similar[1] < similar[0] * max(len(one), len(two)):
        return False
    common = len(one & two)
    return common > 0 and common * similar[1] >= similar[0] * (len(one) + len(two) - common)


def confirmed(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs (rep, hub) whose full sets are similar."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, last, right = [], None, frozenset()
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if last != b:
                last, right = b, _set(b)
            keep.append(_alike(_set(a), right, similar))
        return batch.filter(pa.array(keep)).select(["rep", "hub"])

    side = lambda x: sets.select(F.col("key").alias(x), F.col("shingles").alias(f"set_{x}"))
    return by_batch(pairs.join(side("rep"), "rep").join(side("hub"), "hub").select("rep", "hub", "set_rep", "set_hub"), work, "rep long, hub long")


def _in_cells(rows: DataFrame, similar: tuple[int, int], match: int, coordinates: int) -> DataFrame:
    """The links (rep, hub) between the two blocks of each cell, from (one, two, side, node, group, sketch, shingles); a side of 0 is both."""

    def finish(cell: list[tuple]) -> tuple[list[int], list[int]]:
        side, node, group = (np.array([r[i] for r in cell], np.int64) for i in range(3))
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        if not len(left) or not len(right) or (group == group[0]).all():
            return [], []
        sketch = np.array([r[3] for r in cell], np.int64).view(np.uint8).reshape(len(cell), -1)[:, :coordinates]
        sets: dict[int, frozenset] = {}
        parent = {g: g for g in group.tolist()}

        def root(g: int) -> int:
            while parent[g] != g:
                parent[g] = g = parent[parent[g]]
            return g

        def held(i: int) -> frozenset:
            if i not in sets:
                if sum(map(len, sets.values())) > CACHED:
                    sets.clear()
                sets[i] = _set(cell[i][4])
            return sets[i]

        a, b = [], []
        step = max(1, (1 << 22) // (coordinates * len(right)))
        for k in range(0, len(left), step):
            some = left[k : k + step]
            near = (sketch[some][:, None, :] == sketch[right][None, :, :]).sum(axis=2, dtype=np.int32) >= match
            near &= (group[some][:, None] != group[right]) & ((side[right] != 0) | (right > some[:, None]))
            for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
                i, j = int(some[i]), int(right[j])
                x, y = root(int(group[i])), root(int(group[j]))
                if x == y:
                    continue
                if _alike(held(i), held(j), similar):
                    parent[x] = y
                    a.append(int(node[i]))
                    b.append(int(node[j]))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell = None, []

        def done() -> Iterator[pa.RecordBatch]:
            a, b = finish(cell) if len(cell) > 1 else ([], [])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["rep", "hub"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(2)]
            for key, *row in zip(zip(*columns, strict=True), *(batch.column(i).to_pylist() for i in range(2, 7)), strict=True):
                if key != now:
                    yield from done()
                    now, cell = key, []
                cell.append(tuple(row))
        yield from done()

    order = ["one", "two"]
    return rows.repartition(*order).sortWithinPartitions(*order).select(*order, "side", "node", "group", "sketch", "shingles").mapInArrow(run, "rep long, hub long")


def _blocks(lists: DataFrame, ends: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """(rep, block) for the members of lists (token, rep): those whose lists lead to the same hub, a bounded number of them in a block."""
    near = lists.join(ends, "token").groupBy("rep").agg(F.max(F.struct("weight", "hub")).alias("home"))
    homes = durable(near, "homes")
    ends = durable(lists.join(homes, "rep").groupBy("token").agg(F.max("home").alias("home")), "ends")
    found = durable(lists.join(ends, "token").groupBy("rep").agg(F.max("home.hub").alias("home")).join(nodes.select("rep", "n"), "rep"), "homes")
    parts = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") * 8 / BLOCK_BYTES))
    sizes = durable(found.groupBy("home").agg(parts.alias("parts")), "sizes")
    blocks = durable(found.join(sizes, "home").select("rep", F.xxhash64("home", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("block")), "blocks")
    removed(homes, ends, found, sizes)
    return blocks


def _cells(lists: DataFrame, blocks: DataFrame) -> DataFrame:
    """(one, two, block, side): each block by itself, and the blocks that meet in a list, each two once."""
    held = durable(lists.join(blocks, "rep").select("token", "block").distinct(), "held")
    several = durable(held.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token"), "several")
    some = durable(held.join(several, "token"), "held")
    met = some.withColumnRenamed("block", "one").join(some.withColumnRenamed("block", "two"), "token").where("one < two")
    cells = durable(met.select("one", "two").distinct(), "cells")
    removed(held, several, some)
    sides = F.explode(F.array(F.struct(F.col("one").alias("block"), F.lit(1).alias("side")), F.struct(F.col("two").alias("block"), F.lit(2).alias("side"))))
    same = blocks.select("block").distinct().select(F.col("block").alias("one"), F.col("block").alias("two"), "block", F.lit(0).alias("side"))
    return same.union(cells.select("one", "two", sides.alias("s")).select("one", "two", "s.block", "s.side"))


def links(posted: DataFrame, nodes: DataFrame, sets: DataFrame, similar: tuple[int, int], match: int, coordinates: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(node, group), and the confirmed links (rep, hub); nodes of one group are connected by links."""
    hub = F.max(F.struct("weight", (-F.col("rep")).alias("order"))).alias("m")
    ends = durable(posted.groupBy("token").agg(hub).select("token", "m.weight", (-F.col("m.order")).alias("hub")), "ends")
    pairs = durable(posted.select("token", "rep").join(ends.select("token", "hub"), "token").where("rep <> hub").select("rep", "hub").distinct(), "pairs")
    sketch = lambda x: nodes.select(F.col("rep").alias(x), F.col("sketch").alias(f"sketch_{x}"))
    counted = pairs.join(sketch("rep"), "rep").join(sketch("hub"), "hub").where(_collisions("sketch_rep", "sketch_hub", coordinates) >= match)
    retained = durable(counted.select("rep", "hub"), "retained")
    found = durable(confirmed(retained, sets, similar), "links")
    # What a hub is linked with gets the hub's group, if that is the smallest of those that link it.
    step = durable(found.groupBy(F.col("rep").alias("node")).agg(F.min("hub").alias("of")), "step")
    groups = durable(nodes.select(F.col("rep").alias("node")).join(step, "node", "left").select("node", F.coalesce("of", "node").alias("group")), "groups")
    now = posted.select("token", "rep").join(groups.withColumnRenamed("node", "rep"), "rep")
    open_ = durable(now.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("token"), "open")
    lists = durable(posted.select("token", "rep").join(open_, "token"), "lists")
    blocks = _blocks(lists, ends, nodes, block)
    cells = _cells(lists, blocks)
    members = blocks.withColumnRenamed("rep", "node").join(groups, "node").join(nodes.select(F.col("rep").alias("node"), "sketch"), "node").join(sets.withColumnRenamed("key", "node"), "node")
    members = durable(members, "members")
    some = durable(_in_cells(cells.join(members, "block"), similar, match, coordinates), "links")
    removed(ends, pairs, retained, step, open_, lists, blocks, members)
    return groups, found.union(some)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", *, size: int = SIZE, similar: tuple[int, int] = SIMILAR, coordinates: int = COORDINATES, match: int = MATCH, block: int = BLOCK) -> DataFrame:
    """For each row: key, n_shingles, component_id (the smallest id that links reach) and kept (whether that is its own)."""
    drawn = durable(sketches(docs, key, text, size, coordinates), "sketches")
    rows = drawn.where("n > 0 AND key IS NOT NULL")
    least = F.min(F.struct("key", "content"))
    classes = rows.groupBy("n", "one", "two").agg(least.alias("m"), F.any_value("signature").alias("signature"), F.any_value("sketch").alias("sketch"))
    # Numbers are given as the table is written, so they stay.
    classes = durable(classes.select(F.monotonically_increasing_id().alias("rep"), "n", "one", "two", F.col("m.key").alias("first"), F.col("m.content").alias("content"), "signature", "sketch"), "classes")
    posted = postings(classes, coordinates, match)
    ids = durable(posted.select("rep").distinct(), "ids")
    nodes = durable(classes.select("rep", "n", "sketch").join(ids, "rep"), "nodes")
    # One plan at every size: the ids grow with the corpus, and are never broadcast. An id may have several texts; its class's is known by its hash.
    wanted = durable(classes.join(ids, "rep").select("rep", F.col("first").alias("id"), F.col("content").alias("of")), "wanted")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("of"), _bytes(text)).join(wanted.hint("merge"), ["id", "of"])
    sets = durable(full_sets(texts.select(F.col("rep").alias("key"), "text"), size).distinct(), "sets")
    groups, found = links(posted, nodes, sets, similar, match, coordinates, block)
    group = lambda x: groups.select(F.col("node").alias(x), F.col("group").alias(f"of_{x}"))
    met = found.join(group("rep"), "rep").join(group("hub"), "hub").where("of_rep <> of_hub").select(F.col("of_rep").alias("a"), F.col("of_hub").alias("b"))
    own = groups.where("node <> group").select(F.col("node").alias("a"), F.col("group").alias("b"))
    # An id with several texts is one document: it is linked with the class of each.
    several = durable(rows.select("key", "n", "one", "two").groupBy("key").agg(F.min(F.struct("n", "one", "two")).alias("low"), F.max(F.struct("n", "one", "two")).alias("high")).where("low <> high").select("key"), "several")
    if not several.isEmpty():
        held = durable(rows.select("key", "n", "one", "two").join(several, "key").distinct().join(classes.select("rep", "n", "one", "two"), ["n", "one", "two"]).select("key", "rep"), "held")
        lowest = durable(held.groupBy("key").agg(F.min("rep").alias("low")), "lowest")
        own = own.union(held.join(lowest, "key").select(F.col("rep").alias("a"), F.col("low").alias("b")))
    joined = components(met.distinct().union(own.where("a <> b")))
    placed = durable(classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("n", "one", "two", "first", F.coalesce("component", "rep").alias("component")), "placed")
    smallest = durable(placed.groupBy("component").agg(F.min("first").alias("smallest")), "smallest")
    named = durable(placed.join(smallest, "component").select("n", "one", "two", F.col("smallest").alias("component")), "named")
    removed(posted, ids, nodes, wanted, sets, groups, several, joined, classes, placed, smallest)
    component = F.when(F.col("key").isNotNull(), F.coalesce("component", "key"))
    out = drawn.select("key", "n", "one", "two").join(named, ["n", "one", "two"], "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("key"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """One document of each component, the one with the smallest id, with its own columns; wordless documents all stay."""
    name = fresh(docs, "gone_")
    gone = near_duplicates(docs, key, text, **limits).where("NOT kept").select(F.col(key).alias(name)).distinct()
    return docs.join(gone, F.col(key) == F.col(name), "left_anti")
