"""Candidate pools: merging with provenance, quotas, floors and first-wins deduplication, all by explicit orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.session import cut_lineage


def ranked(rows: DataFrame, order: list[Column], by: list[str] | None = None, into: str = "rank") -> DataFrame:
    """Rows numbered from 1 in the order, within each group where groups are given."""
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order)))


def numbered(rows: DataFrame, by: list[str], order: list[str], into: str = "rank") -> DataFrame:
    """Rows numbered from 1 within each group in the order of the columns, which is unique; no task gets a whole group.

    Ranges of group and order are written with their number, rows are numbered within a range, and each range's first number is what the
    ranges before it hold of the group.
    """
    ranges = rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id())
    held = cut_lineage(ranges)
    counts = held.groupBy(*by, "_range").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_range").alias("_at"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    within = held.withColumn("_w", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)))
    same = F.col("_range") == F.col("_at")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return within.join(counts, same).select(*rows.columns, (F.col("_w") + F.col("_before")).alias(into))


def first_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the one with the least values of the order (a falling one is given by its negative).

    An aggregate, so repeated keys shrink before the shuffle.
    """
    others = [c for c in rows.columns if c not in key]
    first = F.min_by(F.struct(*others), F.struct(*order))
    return rows.groupBy(*key).agg(first.alias("_row")).select(*key, *[F.col(f"_row.{c}").alias(c) for c in others])


def merged(pools: list[DataFrame], key: str, score: str, source: str) -> DataFrame:
    """Union of pools: the best row of each key, every source that had it, and how often."""
    rows = pools[0]
    for p in pools[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    others = [c for c in rows.columns if c not in (key, score, source)]
    best = F.max(F.struct(F.col(score), *[F.col(c) for c in others]))
    out = rows.groupBy(key).agg(best.alias("_b"), F.array_sort(F.collect_set(source)).alias("sources"), F.count("*").alias("copies"))
    return out.select(key, F.col(f"_b.{score}").alias(score), *[F.col(f"_b.{c}").alias(c) for c in others], "sources", "copies")


def branch_top(pool: DataFrame, order: list[Column], keep: int) -> DataFrame:
    return pool.orderBy(*order).limit(keep)


def quota(rows: DataFrame, group: str, order: list[Column], most: int, total: int) -> DataFrame:
    """At most so many rows of each group, and of all."""
    return ranked(rows, order, [group], "_n").where(F.col("_n") <= most).drop("_n").orderBy(*order).limit(total)


def floor_then_fill(rows: DataFrame, bucket: str, buckets: list[str], key: str, order: list[Column], limit: int) -> DataFrame:
    """The first few of each bucket, in the order of the buckets, then all rows in order; each key once, up to a limit.

    The floor of a bucket is a quarter of the limit, between 5 and 30.
    """
    floor = max(5, min(30, limit // 4))
    names = F.array(*[F.lit(b) for b in buckets])
    place = F.array_position(names, F.col(bucket)).cast("int")
    place = F.when(place > 0, place).otherwise(len(buckets) + 1)
    # Both sides shrink before they meet: the floors to a few rows a bucket, the rest to the first rows of distinct keys.
    first = ranked(rows, order, [bucket], "_n").where(F.col("_n") <= floor).drop("_n").withColumn("_tier", place)
    rest = first_wins(rows, [key], order).orderBy(*order).limit(limit).withColumn("_tier", F.lit(len(buckets) + 2))
    kept = first_wins(first.unionByName(rest), [key], [F.col("_tier"), *order])
    return ranked(kept, [F.col("_tier"), *order], None, "merged_rank").where(F.col("merged_rank") <= limit).drop("_tier")


def novel(rows: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """Rows whose key the pool doesn't have."""
    return rows.join(pool.select(key).distinct(), key, "left_anti")


def augmented(pool: DataFrame, new: DataFrame, key: str, score: str, source: str) -> DataFrame:
    """The pool with new keys added; a key in both keeps the pool's row and gets the new sources."""
    both = pool.withColumn("_late", F.lit(0)).unionByName(new.withColumn("_late", F.lit(1)), allowMissingColumns=True)
    kept = both.groupBy(key).agg(F.min(F.struct("_late", (-F.col(score)).alias("_s"))).alias("_m"), F.array_sort(F.collect_set(source)).alias("sources"))
    return kept.select(key, (-F.col("_m._s")).alias(score), "sources", (F.col("_m._late") == 1).alias("added"))


def hits_at(ranks: DataFrame, query: str, rank: str, relevant: Column, ks: list[int]) -> DataFrame:
    """For each query, whether a relevant row stands among the first k, and the rank of the first one."""
    within = [F.max((relevant & (F.col(rank) <= k)).cast("int")).alias(f"hit_{k}") for k in ks]
    return ranks.groupBy(query).agg(*within, F.min(F.when(relevant, F.col(rank))).alias("first_rank"))
