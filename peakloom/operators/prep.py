"""Training data: seeded splits, class maps, vocabularies, padding, negative samples, masking and resumable order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.operators import pools

#: Vocabularies of so many bytes at most are sent to every task; rows meet larger ones by a join.
SENT_BYTES = 16 << 20


def seeded(seed: str, *keys: Column) -> Column:
    """A digest that orders rows at random, the same for the same seed."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys]).cast("binary"))


def placed(rows: DataFrame, key: str, seed: str, group: list[str]) -> DataFrame:
    """The rows with their place ``_at`` in the seeded order of their group, from 0, and the group's size ``_n``.

    A group is cut by the first three places of the digest: the pieces are counted, and rows are numbered within a piece,
    so that no task gets a whole group.
    """
    held = rows.withColumn("_d", seeded(seed, F.col(key))).withColumn("_p", F.substring("_d", 1, 3))
    counts = held.groupBy(*group, "_p").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*group).orderBy("_p")
    counts = counts.withColumns({"_before": F.sum("_c").over(before) - F.col("_c"), "_n": F.sum("_c").over(Window.partitionBy(*group))}).drop("_c")
    within = F.row_number().over(Window.partitionBy(*group, "_p").orderBy("_d", key))
    return held.withColumn("_r", within - 1).join(counts, [*group, "_p"]).withColumn("_at", F.col("_before") + F.col("_r")).drop("_p", "_r", "_before", "_d")


def split(rows: DataFrame, key: str, seed: str, parts: dict[str, int]) -> DataFrame:
    """Each row's part, by hundredths of the seeded digest: no sort, and a row stays where it is when others come."""
    at = F.pmod(F.conv(F.substring(seeded(seed, F.col(key)), 1, 8), 16, 10).cast("long"), F.lit(100))
    out, low = F.lit(None).cast("string"), 0
    for name, share in parts.items():
        out = F.when((at >= low) & (at < low + share), name).otherwise(out)
        low += share
    return rows.withColumn("part", out)


def first_validation(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The first n rows in seeded order are for validation, the others for training."""
    chosen = rows.select(key, seeded(seed, F.col(key)).alias("_d")).orderBy("_d", key).limit(n).select(key, F.lit("val").alias("part"))
    return rows.join(chosen, key, "left").withColumn("part", F.coalesce("part", F.lit("train")))


def class_map(rows: DataFrame, label: str, leave_out: list | None = None) -> DataFrame:
    """(label, count, idx): classes in order of their names, numbered from 0; null and left-out labels have none."""
    kept = rows.where(F.col(label).isNotNull())
    kept = kept.where(~F.col(label).isin(*leave_out)) if leave_out else kept
    counted = kept.groupBy(label).agg(F.count("*").alias("n"))
    return counted.withColumn("idx", F.row_number().over(Window.orderBy(label)) - 1)


def vocabulary(rows: DataFrame, key: str, tokens: str, specials: list[str]) -> DataFrame:
    """(token, id): specials first, then tokens in the order in which rows and places show them first; numbered by ranges, not in one task."""
    seen = rows.select(key, F.posexplode(tokens).alias("at", "token")).groupBy("token").agg(F.min(F.struct(key, "at")).alias("first"))
    seen = seen.where(~F.col("token").isin(*specials)) if specials else seen
    numbered = pools.numbered(seen.select("first", "token"), [], ["first", "token"]).select("token", (F.col("rank") + len(specials) - 1).cast("int").alias("id"))
    fixed = rows.sparkSession.createDataFrame(list(zip(specials, range(len(specials)), strict=True)), "token string, id int") if specials else numbered.limit(0)
    return fixed.unionByName(numbered)


def padded(values: Column, n: int, fill: Column) -> Column:
    """Cut or filled to n."""
    return F.concat(F.slice(values, 1, n), F.array_repeat(fill, F.greatest(F.lit(n) - F.size(values), F.lit(0)).cast("int")))


def mask_of(values: Column, n: int) -> Column:
    """True where padding stands."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i > F.size(values))


def ended(values: Column, n: int, end: Column) -> Column:
    """Cut to n so that the end mark stays."""
    return F.when(F.size(values) > n, F.concat(F.slice(values, 1, n - 1), F.array(end))).otherwise(values)


def pooled(vectors: Column, padding: Column) -> Column:
    """The mean of an array's vectors, all of one length, but for those that the mask marks; null if it marks all."""
    kept = F.filter(vectors, lambda v, i: ~F.get(padding, i))
    zeros = F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zeros, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))


def encoded(rows: DataFrame, key: str, tokens: str, vocab: DataFrame, unknown: int = 1, begin: int | None = 2, end: int | None = 3) -> DataFrame:
    """(key, ids): each row's tokens as the ids of a vocabulary (token, id), between the marks where they are given.

    The key is unique. Null tokens give the marks alone. A vocabulary of a counted size is looked up where the rows are, and no token is shuffled.
    """
    mark = lambda x: F.array(*([] if x is None else [F.lit(x)])).cast("array<int>")
    size = vocab.agg(F.sum(F.octet_length("token") + 16)).first()[0] or 0
    if size <= SENT_BYTES:
        held = vocab.where("token IS NOT NULL").select("token", F.col("id").cast("int").alias("id")).toArrow().combine_chunks()
        sent = rows.sparkSession.sparkContext.broadcast((held.column("token").combine_chunks(), pc.fill_null(held.column("id").combine_chunks(), unknown)))

        @F.arrow_udf("array<int>")
        def looked_up(lists: pa.Array) -> pa.Array:
            words, numbers = sent.value
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            found = pc.fill_null(numbers.take(pc.index_in(lists.flatten().cast(words.type), value_set=words)), unknown)
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), found)

        return rows.select(key, F.concat(mark(begin), looked_up(F.col(tokens)), mark(end)).alias("ids"))
    each = rows.select(key, F.posexplode(tokens).alias("_at", "token")).join(vocab, "token", "left")
    found = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("id", F.lit(unknown)).alias("id")))).alias("_ids"))
    ids = F.coalesce(F.transform("_ids", lambda e: e["id"]), F.array().cast("array<int>"))
    return rows.select(key).join(found, key, "left").select(key, F.concat(mark(begin), ids, mark(end)).alias("ids"))


def decoded(rows: DataFrame, key: str, ids: str, vocab: DataFrame, leave_out: tuple[int, ...] = (0, 2), end: int = 3, unknown: str = "<unk>") -> DataFrame:
    """(key, text): the tokens of the ids before the first end mark, without those left out; ids that the vocabulary lacks show as unknown."""
    at = F.coalesce(F.array_position(ids, end), F.lit(0))
    before = F.when(at > 0, F.slice(F.col(ids), F.lit(1), (at - 1).cast("int"))).otherwise(F.col(ids))
    shown = F.filter(before, lambda x: ~x.isin(*leave_out)) if leave_out else before
    each = rows.select(key, F.posexplode(shown).alias("_at", "id")).join(vocab.select("id", "token"), "id", "left")
    found = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("token", F.lit(unknown)).alias("token")))).alias("_t"))
    return rows.select(key).join(found, key, "left").select(key, F.coalesce(F.array_join(F.transform("_t", lambda e: e["token"]), ""), F.lit("")).alias("text"))


def negatives(rows: DataFrame, key: str, bucket: str, seed: str, k: int) -> DataFrame:
    """(anchor, negative, nth): up to k others of the anchor's bucket, in seeded order.

    The bucket's rows stand in one seeded circle and an anchor takes those after it, so that a bucket of any size gives
    k rows an anchor, never all its pairs.
    """
    circle = placed(rows.select(key, bucket), key, seed, [bucket])
    asked = circle.where("_n > 1").select(F.col(key).alias("anchor"), bucket, F.explode(F.sequence(F.lit(1), F.least(F.lit(k), F.col("_n") - 1).cast("int"))).alias("nth"), "_at", "_n")
    asked = asked.withColumn("_at", F.pmod(F.col("_at") + F.col("nth"), F.col("_n"))).drop("_n")
    return asked.join(circle.select(F.col(key).alias("negative"), bucket, "_at"), [bucket, "_at"]).select("anchor", "negative", "nth")


def masked_ranks(rows: DataFrame, sample: str, kind: str, at: str, value: str, masked: str) -> DataFrame:
    """The k-th smallest masked value of a sample's kind becomes -k; others stay."""
    place = F.row_number().over(Window.partitionBy(sample, kind, masked).orderBy(value, at))
    return rows.withColumn("shown", F.when(F.col(masked), -place.cast("double")).otherwise(F.col(value)))


def resumed(rows: DataFrame, key: str, seed: str, skip: int, ranks: int = 1, rank: int = 0) -> DataFrame:
    """What is left of a seeded order after ``skip`` rows, for one of several readers that take rows in turn."""
    order = placed(rows, key, seed, []).withColumnRenamed("_at", "nth").drop("_n")
    return order.where((F.col("nth") >= skip) & (F.pmod(F.col("nth"), F.lit(ranks)) == rank))


def flattened(h: Column, c: Column) -> Column:
    """Both nuclei's peaks as array<struct<shift, kind>>, protons first as 0, carbons as 1."""
    of = lambda values, kind: F.transform(F.coalesce(values, F.array().cast("array<double>")), lambda x: F.struct(x.alias("shift"), F.lit(kind).alias("kind")))
    return F.concat(of(h, 0), of(c, 1))


def jittered(values: Column, key: Column, seed: str, share: float, width: float) -> Column:
    """With the given chance all of a row's values move by one seeded amount within the width."""
    draw = lambda what: F.conv(F.substring(seeded(f"{seed}:{what}", key), 1, 8), 16, 10).cast("double") / float(1 << 32)
    moved = F.transform(values, lambda x: x + (2 * draw("by") - 1) * width)
    return F.when(draw("if") < share, moved).otherwise(values)
