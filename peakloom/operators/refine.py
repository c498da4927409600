"""Refining of candidates in rounds: a candidate is some fragments, and changes by swapping one for a fragment that covers what it misses.

A round looks only at candidates that are new among a query's best (semi-naive): what they miss is looked up by a band join, the swaps that nobody has
seen are scored, and the best are taken anew. Candidates that were there before have had their swaps; so nothing is scored twice, and the result is that of
swapping and scoring everything again in each round. It ends when a round brings nothing new among the best of any query, or after ``rounds``.
The lists that the fragments are looked up in are made once, for all peaks of the queries; rounds read them and the fragments that stand in them, not all fragments.
Every round is written to a table. A round scores at most ``keep`` x fragments of a candidate x ``offers`` rows for a query.

Defined cases: null peaks are none; a candidate that names an unknown fragment has that one's peaks as none; repeated candidates are one; a query or
candidate without peaks scores 0; fragment ids are unique numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.functions.assignment import set_match_udf
from peakloom.operators import bands, pools
from peakloom.session import stored


def _scored(rows: DataFrame, asked: DataFrame, fragments: DataFrame, sigma: float) -> DataFrame:
    """(query_id, members) with the peaks of all members, and the score against the query's."""
    each = rows.select("query_id", "members", F.explode("members").alias("id")).join(fragments, "id", "left")
    held = each.groupBy("query_id", "members").agg(F.array_sort(F.flatten(F.collect_list(F.coalesce("peaks", F.array().cast("array<double>"))))).alias("peaks"))
    return held.join(asked, "query_id").select("query_id", "members", "peaks", F.round(set_match_udf(sigma)("peaks", "asked"), 6).alias("score"))


def _swaps(rows: DataFrame, asked: DataFrame, lists: tuple[DataFrame, DataFrame | None], tolerance: float, offers: int) -> DataFrame:
    """(query_id, members): each fragment of a candidate in turn swapped for each of those that cover most of the peaks it misses."""
    named = rows.join(asked, "query_id").withColumn("name", F.to_json(F.struct("query_id", "members")))
    missed = F.filter("asked", lambda a: ~F.exists("peaks", lambda p: F.abs(p - a) <= tolerance))
    offered = bands.covering(named.select("name", F.explode(missed).alias("peak")), lists, tolerance, offers, query="name", fragment="id")
    met = named.select("name", "query_id", "members", F.posexplode("members").alias("at", "out")).join(offered.select("name", "id"), "name").where(~F.array_contains("members", F.col("id")))
    swapped = F.array_sort(F.transform("members", lambda m, i: F.when(i == F.col("at"), F.col("id")).otherwise(m)))
    return met.select("query_id", swapped.alias("members")).distinct()


def refined(asked: DataFrame, fragments: DataFrame, candidates: DataFrame, keep: int = 10, sigma: float = 2.0, tolerance: float = 1.0, offers: int = 5, rounds: int = 6) -> tuple[DataFrame, list[int]]:
    """(query_id, members, score, rank) of each query's best, from queries (query_id, peaks), fragments (id, peaks) and first candidates (query_id, members); and the rows scored in each round."""
    none = F.array().cast("array<double>")
    asked = stored(asked.select("query_id", F.coalesce(F.col("peaks").cast("array<double>"), none).alias("asked")))
    fragments = fragments.select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("peaks").cast("array<double>"), none).alias("peaks"))
    fresh = stored(candidates.select("query_id", F.array_sort(F.col("members").cast("array<bigint>")).alias("members")).distinct())
    lists = bands.cover_lists(asked.select(F.explode("asked").alias("peak")), fragments.select("id", F.explode("peaks").alias("shift")), tolerance, offers, fragment="id")
    used = fresh.select(F.explode("members").alias("id")).unionByName(lists[0].select(F.explode("_best.id").alias("id")))
    used = used if lists[1] is None else used.unionByName(lists[1].select("id"))
    fragments = stored(fragments.join(used.distinct(), "id", "left_semi"))
    known, best, counts = None, None, []
    for n in range(rounds + 1):
        scored = stored(_scored(fresh, asked, fragments, sigma).withColumn("round", F.lit(n)))
        counts.append(scored.count())
        known = scored if known is None else known.unionByName(scored)
        best = pools.ranked(scored if best is None else best.drop("rank").unionByName(scored), [F.desc("score"), F.col("members")], ["query_id"])
        best = stored(best.where(F.col("rank") <= keep))
        new = best.where(F.col("round") == n)
        if n == rounds or new.isEmpty():
            break
        fresh = _swaps(new, asked, lists, tolerance, offers).join(known.select("query_id", "members"), ["query_id", "members"], "left_anti")
    return best.select("query_id", "members", "score", "rank"), counts
