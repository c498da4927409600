"""New candidates from a pool: cut, pair by complementary cuts and formula, stitch, in a few rounds; and single edits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.functions import shifts, spectra, structures
from peakloom.operators import fragments, pools
from peakloom.session import cut_lineage


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stitched(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([structures.stitch(a, b) for a, b in zip(left, right, strict=True)])


@F.pandas_udf(T.IntegerType())
def _largest_ring(s: pd.Series) -> pd.Series:
    return s.map(lambda x: structures.parse(x).largest_ring())


def fragment_table(pool: DataFrame, asked_h: list[float], asked_c: list[float], elements: list[str], rounds: int = 1, predictor: shifts.Predictor = shifts.rule_based) -> DataFrame:
    """Fragments of a pool (smiles, score): cuts, formula, peaks and a score against the query; the best source of each is kept.

    Further rounds cut the fragments again. Elements outside the target's are dropped.
    """
    now = pool.select(F.col("smiles").alias("source"), F.col("smiles").alias("text"), "score")
    found = None
    for _ in range(rounds):
        cut = now.select("source", "score", F.explode(structures.cuts_udf("text")).alias("x")).select("source", "score", F.col("x.fragment").alias("fragment"), F.array_join("x.ends", ",").alias("ends"), F.array_join("x.partners", ",").alias("partners"))
        found = cut if found is None else found.unionByName(cut)
        now = cut.where((F.length("fragment") - F.length(F.replace("fragment", F.lit("*"), F.lit("")))) < 2).select("source", F.col("fragment").alias("text"), "score")
    best = pools.first_wins(found, ["fragment", "ends", "partners"], [-F.col("score"), F.col("source")])
    rows = best.withColumn("_f", structures.formula_udf("fragment")).withColumn("_p", shifts.predicted("fragment", predictor))
    rows = rows.withColumn("counts", spectra.formula_counts(F.col("_f"))).drop("_f")
    rows = rows.where(F.size(F.array_except(F.map_keys("counts"), F.array(*[F.lit(e) for e in elements]))) == 0)
    score = spectra.greedy_match(spectra.doubles(asked_h) if asked_h else F.array().cast("array<double>"), F.col("_p.h"), 1.0) + spectra.greedy_match(spectra.doubles(asked_c) if asked_c else F.array().cast("array<double>"), F.col("_p.c"), 10.0)
    rows = rows.withColumn("frag_score", F.round(score, 6)).withColumn("frag_formula", spectra.formula_text(F.col("counts")))
    return rows.withColumn("frag_id", F.xxhash64("fragment", "ends", "partners")).drop("_p")


def crossover(pool: DataFrame, formula: str, asked_h: list[float], asked_c: list[float], rounds: int = 2, per_formula: int = 20, total: int = 2000, pairs: int = 20000, most_new: int = 200, largest_ring: int = 8) -> DataFrame:
    """New structures (smiles, score, round) of the target's formula from a pool (smiles, score); ends early if a round finds none."""
    spark = pool.sparkSession
    target = F.lit(formula)
    elements = [*spark.range(1).select(F.map_keys(spectra.formula_counts(target)).alias("k")).first().k]
    now = pool.select(structures.canonical_udf("smiles").alias("smiles"), "score").where("smiles IS NOT NULL")
    now, new = cut_lineage(pools.first_wins(now, ["smiles"], [-F.col("score")])), None
    for turn in range(1, rounds + 1):
        rows = fragment_table(now, asked_h, asked_c, elements)
        order = [F.desc("frag_score"), F.col("fragment")]
        rows = cut_lineage(pools.quota(rows, "frag_formula", order, per_formula, total))
        cut, complement = F.concat_ws("/", "ends", "partners"), F.concat_ws("/", "partners", "ends")
        found = fragments.complement_pairs(rows.withColumns({"cut": cut, "complement": complement}), "frag_id", "cut", "complement", "source")
        found = found.join(fragments.sums_to(rows, spectra.formula_counts(target), "frag_id", "counts"), ["left_id", "right_id"], "left_semi")
        side = lambda x, rows=rows: rows.select(F.col("frag_id").alias(f"{x}_id"), F.col("fragment").alias(x), F.col("frag_score").alias(f"{x}_score"))
        joined = found.join(side("left"), "left_id").join(side("right"), "right_id").withColumn("score", F.col("left_score") + F.col("right_score"))
        joined = joined.orderBy(F.desc("score"), "left_id", "right_id").limit(pairs)
        made = joined.select(F.explode(_stitched("left", "right")).alias("smiles"), "score").where(~F.contains("smiles", F.lit("*")))
        made = pools.first_wins(made, ["smiles"], [-F.col("score")]).withColumn("_f", structures.formula_udf("smiles"))
        made = made.where(spectra.formula_text(spectra.formula_counts(F.col("_f"))) == spectra.formula_text(spectra.formula_counts(target))).drop("_f")
        made = pools.novel(made.where(_largest_ring("smiles") <= largest_ring), now, "smiles")
        made = cut_lineage(made.orderBy(F.desc("score"), "smiles").limit(most_new).select("smiles", F.round("score", 6).alias("score"), F.lit(turn).alias("round")))
        new = made if new is None else new.unionByName(made)
        if made.isEmpty():
            break
        now = now.unionByName(made.select("smiles", "score"))
    return new


def within_size(rows: DataFrame, formula: str, target: str, excess: int, text: str | None = None) -> DataFrame:
    """Rows with no more heavy atoms than the target formula and the excess; with a text, those without open ends in it."""
    most = spectra.heavy_atoms(spectra.formula_counts(F.lit(target))) + excess
    kept = rows.where(spectra.heavy_atoms(spectra.formula_counts(F.col(formula))) <= most)
    return kept.where(~F.contains(F.col(text), F.lit("*"))) if text else kept


def rerank_input(originals: DataFrame, new: DataFrame, keep_original: int, keep_new: int) -> DataFrame:
    """The best of both (smiles, score), originals first; a structure once."""
    best = lambda rows, n, kind: rows.orderBy(F.desc("score"), "smiles").limit(n).select("smiles", "score", F.lit(kind).alias("kind"))
    both = best(originals, keep_original, 0).unionByName(best(new, keep_new, 1)).withColumn("canonical", structures.canonical_udf("smiles"))
    return pools.first_wins(both.where("canonical IS NOT NULL"), ["canonical"], [F.col("kind"), -F.col("score"), F.col("smiles")])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _edited(s: pd.Series) -> pd.Series:
    def each(text):
        out = set()
        try:
            m = structures.parse(text)
            for i, a in enumerate(m.atoms):
                if (x := structures.without_atom(text, i)) and len(m.atoms) > 1:
                    out.add(x)
                for e in ("C", "N", "O"):
                    if e != a.element and not a.aromatic and (x := structures.with_element(text, i, e)):
                        out.add(x)
        except (ValueError, KeyError, IndexError):
            return []
        return sorted(out)

    return s.map(each)


def edits(pool: DataFrame) -> DataFrame:
    """Structures one edit away from a pool's (smiles): an atom less, or another element in its place."""
    return pool.select(F.col("smiles").alias("source"), F.explode(_edited("smiles")).alias("smiles")).where("smiles <> source")
