"""Candidates by how well their predicted peaks match a query's, with the peaks that are left over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions import assignment as A
from peakloom.functions import shifts, structures
from peakloom.operators import pools


def enriched(candidates: DataFrame, predictor: shifts.Predictor = shifts.rule_based) -> DataFrame:
    """Candidates (smiles, h, c) with peaks; the predictor is asked only for rows without any."""
    none = F.coalesce(F.size("h"), F.lit(0)) + F.coalesce(F.size("c"), F.lit(0)) <= 0
    with_peaks = candidates.where(~none)
    asked = candidates.where(none).withColumn("_p", shifts.predicted("smiles", predictor)).withColumns({"h": F.col("_p.h"), "c": F.col("_p.c")}).drop("_p")
    return with_peaks.unionByName(asked)


def split_by_formula(candidates: DataFrame, target: str) -> DataFrame:
    """Valid candidates with their formula and whether it is the target's, in one pass."""
    rows = candidates.withColumn("formula", structures.formula_udf("smiles")).where("formula IS NOT NULL")
    return rows.withColumn("exact", F.col("formula") == target)


def rerank(asked: DataFrame, candidates: DataFrame, k: int, order: str = "score", predictor: shifts.Predictor = shifts.rule_based) -> DataFrame:
    """For each query (query_id, formula, asked_h, asked_c) its candidates (query_id, smiles, score, h, c) by similarity.

    Structures that don't parse, or of another formula, are dropped; of equal structures the best-scored one counts.
    A query without a formula takes all.
    """
    rows = candidates.withColumns({"canonical": structures.canonical_udf("smiles"), "found": structures.formula_udf("smiles")}).where("canonical IS NOT NULL")
    rows = pools.first_wins(rows, ["query_id", "canonical"], [-F.col(order), F.col("smiles")])
    rows = rows.join(asked, "query_id").where("formula IS NULL OR formula = found")
    rows = enriched(rows, predictor)
    rows = rows.withColumn("similarity", F.round(A.similarity_udf("asked_h", "asked_c", "h", "c"), 6))
    rows = rows.withColumns({"h_match": A.assignment_udf("asked_h", "h"), "c_match": A.assignment_udf("asked_c", "c")})
    return pools.ranked(rows, [F.desc("similarity"), F.col("canonical")], ["query_id"]).where(F.col("rank") <= k)


def bad_peaks(rows: DataFrame, asked: str, match: str, tolerance: float) -> DataFrame:
    """Rows with the query peaks that found no partner, or one too far."""
    far = F.transform(F.filter(F.col(f"{match}.matched"), lambda x: x["residual"] > tolerance), lambda x: x["query"])
    return rows.withColumn("bad", F.transform(F.concat(F.col(f"{match}.unmatched"), far), lambda i: F.get(asked, i)))


def covered(bad: Column, shifts: Column, tolerance: float) -> Column:
    """Those of a query's bad peaks that a fragment's shifts come nearer to than the tolerance."""
    return F.filter(bad, lambda b: F.exists(shifts, lambda s: F.abs(s - b) < tolerance))
