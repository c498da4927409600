"""Retrieval plans over a library of vectors: modes, two stages, fallbacks, approximate search and memory recall."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions import spectra as S
from peakloom.operators import pools
from peakloom.operators.best_pairs import best_pairs
from peakloom.session import stored

#: Bound of the vectors' bytes for which the queries are sent to every task; larger sets go in blocks.
SENT_BYTES = 64 << 20


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(S.dot(a, a)) * F.sqrt(S.dot(b, b))
    return F.when(size > 0, S.dot(a, b) / size).otherwise(0.0)


def clamped(k: int, low: int = 1, high: int = 1000) -> int:
    return max(low, min(int(k), high))


def _top(pairs: DataFrame, k: int, score: str = "score", key: str = "vec_id") -> DataFrame:
    return pools.ranked(pairs, [F.desc(score), F.col(key)], ["query_id"]).where(F.col("rank") <= k)


def met(asked: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """Each row with each of a stated set of queries, whose own width is given in bytes.

    The queries are numbered into blocks of a size that is sure to fit a task; each row meets each block once, by an equal
    join on the block. One block is sent to every task, for its size has been counted.
    """
    block = max(1, SENT_BYTES // max(width, 1))
    count = asked.count()
    blocks = max(1, -(-count // block))
    numbered = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    spread = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return spread.join(F.broadcast(numbered) if blocks == 1 else numbered, "_block").drop("_block")


def global_topk(asked: DataFrame, library: DataFrame, k: int) -> DataFrame:
    """Exact top-k of (query_id, bucket, query) over the whole library (vec_id, bucket, vector); only the k best of each query leave a task."""
    found = best_pairs(asked, library, k, also="bucket")
    return _top(found.select("query_id", "vec_id", "bucket", "score"), k)


def bucket_topk(asked: DataFrame, library: DataFrame, k: int) -> DataFrame:
    """Exact top-k within the query's own bucket."""
    found = best_pairs(asked, library, k, same="bucket")
    return _top(found.select("query_id", "vec_id", "bucket", "score"), k)


def by_mode(asked: DataFrame, library: DataFrame, k: int, mode: str = "auto", formula_k: int | None = None) -> DataFrame:
    """Retrieval in one of four modes: (query_id, vec_id, bucket, score, branch, matched, merged_rank).

    formula_only and auto search the query's bucket, auto also fills up from the rest of the library; non_formula searches
    it all; mixed returns every row of its bucket branch (3k of them) and k others.
    """
    k = clamped(k)
    own = bucket_topk(asked, library, formula_k or 3 * k).withColumn("branch", F.lit("formula"))
    if mode in ("formula_only", "auto"):
        rows = own
    if mode != "formula_only":
        every = global_topk(asked, library, 3 * k).withColumn("branch", F.lit("global"))
        rows = every if mode == "non_formula" else own.unionByName(every)
    rows = rows.drop("rank").join(asked.select("query_id", F.col("bucket").alias("wanted")), "query_id")
    rows = rows.withColumn("matched", F.col("bucket") == F.col("wanted")).drop("wanted")
    rows = pools.first_wins(rows, ["query_id", "vec_id"], [F.col("branch")])
    if mode == "mixed":
        rows = pools.ranked(rows, [F.desc("score"), F.col("vec_id")], ["query_id", "matched"], "_n").where(F.col("matched") | (F.col("_n") <= k)).drop("_n")
        return pools.ranked(rows, [F.desc("matched"), F.desc("score"), F.col("vec_id")], ["query_id"], "merged_rank")
    order = [F.desc("matched"), F.desc("score"), F.col("vec_id")] if mode == "auto" else [F.desc("score"), F.col("vec_id")]
    return pools.ranked(rows, order, ["query_id"], "merged_rank").where(F.col("merged_rank") <= k)


def two_stage(asked: DataFrame, library: DataFrame, k: int, coarse: int, factor: int = 3, most: int = 3000) -> DataFrame:
    """The best ``factor`` k by the first ``coarse`` dimensions, ranked again by all of them."""
    cut = lambda rows, c: rows.withColumn(c, F.slice(c, 1, coarse))
    pool = global_topk(cut(asked, "query"), cut(library, "vector"), min(most, factor * k)).select("query_id", "vec_id", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    rows = pool.join(asked.select("query_id", "query"), "query_id").join(library.select("vec_id", "vector"), "vec_id")
    return _top(rows.select("query_id", "vec_id", "vector_score", "vector_rank", F.round(cosine(F.col("query"), F.col("vector")), 6).alias("score")), k)


def reranked(candidates: DataFrame, query: Column, vector: Column, has: Column, fallback: Column, k: int, key: str = "vec_id") -> DataFrame:
    """Candidates by the product of their vectors; those without keep their retrieval score, and say so."""
    score = F.round(F.when(has, S.dot(query, vector)).otherwise(fallback), 6)
    return _top(candidates.withColumn("score", score).withColumn("fallback", ~has), k, key=key)


def embedding_reranked(results: DataFrame, payload: DataFrame, k: int) -> DataFrame:
    """The k best of each query by the cosine with the stored embeddings of its results: (query_id, vec_id, score, fallback, rank).

    Results (query_id, query, vec_id, db_key, db_id, vector_score, vector_rank) find their payload (key, id, embedding) by key, or by id
    where the key is null, blank or unknown; keys and ids of the payload are unique. Those without a payload, and those whose
    payload has no embedding, keep their retrieval score and say so. Ties stay in the order of retrieval.
    """
    by = lambda name, into, held: payload.where(F.col(name).isNotNull()).select(F.col(name).alias(into), F.struct("embedding").alias(held))
    rows = results.withColumn("db_key", F.when(F.trim("db_key") != "", F.col("db_key")))
    rows = rows.join(by("key", "db_key", "_first"), "db_key", "left").join(by("id", "db_id", "_second"), "db_id", "left")
    held = rows.withColumn("_held", F.coalesce("_first", "_second")["embedding"])
    has = F.coalesce(F.size("_held") > 0, F.lit(False))
    scored = held.withColumns({"fallback": ~has, "score": F.round(F.when(has, cosine(F.col("query"), F.col("_held"))).otherwise(F.col("vector_score")), 6)})
    return pools.ranked(scored, [F.desc("score"), F.col("vector_rank")], ["query_id"]).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "fallback", "rank")


def by_backend(asked: DataFrame, library: DataFrame, k: int, backend: str = "embedding", factor: int = 3, most: int = 3000) -> DataFrame:
    """Top-k (query_id, vec_id, score, fallback, rank) of (query_id, gaussian, embedding) over (vec_id, bucket, gaussian, embedding).

    embedding and gaussian search by that vector; gaussian_then_embedding (or hybrid_gaussian_embedding) ranks the best ``factor`` k
    of gaussian again by embedding, where a row without one keeps its gaussian score.
    """
    k = clamped(k)
    if backend not in ("embedding", "gaussian", "gaussian_then_embedding", "hybrid_gaussian_embedding"):
        raise ValueError(f"no backend {backend!r}")
    two = backend not in ("embedding", "gaussian")
    first = "gaussian" if two else backend
    found = global_topk(asked.select("query_id", F.col(first).alias("query")), library.select("vec_id", "bucket", F.col(first).alias("vector")), min(most, factor * k) if two else k)
    if not two:
        return found.select("query_id", "vec_id", "score", F.lit(False).alias("fallback"), "rank")
    rows = found.join(asked.select("query_id", F.col("embedding").alias("query")), "query_id")
    rows = rows.select("query_id", "query", "vec_id", F.lit(None).cast("string").alias("db_key"), F.col("vec_id").alias("db_id"), F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    return embedding_reranked(rows, library.select(F.lit(None).cast("string").alias("key"), F.col("vec_id").alias("id"), "embedding"), k)


def outcomes(rows: DataFrame, skipped: Column, failed: Column) -> DataFrame:
    """One row: how many queries were processed, failed and skipped; one that is skipped can't fail, and unknown is no."""
    left_out, broken = F.coalesce(skipped, F.lit(False)), F.coalesce(failed, F.lit(False))
    return rows.agg(F.count_if(~left_out & ~broken).alias("processed"), F.count_if(~left_out & broken).alias("failed"), F.count_if(left_out).alias("skipped"))


def product_topk(asked: DataFrame, rows: DataFrame, fallback: float, k: int) -> DataFrame:
    """Top-k of (query_id, query) over (vec_id, vector, has) but its own row, by the product of vectors of one length, to six places.

    (query_id, vec_id, fallback, score, rank); rows without a vector score ``fallback``.
    """
    found = best_pairs(asked, rows, k, "product", also="has", has="has", fallback=fallback)
    return _top(found.withColumn("fallback", ~F.col("has")), k).select("query_id", "vec_id", "fallback", "score", "rank")


def alike_topk(asked: DataFrame, rows: DataFrame, vector: Callable[[Column], Column], fallback: float, k: int) -> DataFrame:
    """``product_topk`` of (query_id, peaks) over (vec_id, peaks), whose vectors follow from their peaks; rows without peaks have no vector.

    Equal peaks have equal scores, so each distinct list is one row with its k + 1 smallest ids, and asks once: the k + 1 best rows are among those of the
    k + 1 best lists, ties to the smallest id, and a query leaves out itself after that. The work grows with distinct queries times distinct lists.
    """
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    few = pools.ranked(rows.select("vec_id", "peaks"), [F.col("vec_id")], ["peaks"], "_n").where(F.col("_n") <= k + 1)
    lists = few.groupBy("peaks").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("vec_id", F.col("ids")[0])
    lists = stored(lists.repartition(tasks))
    named = stored(asked.select("query_id", "peaks"))
    once = stored(named.groupBy("peaks").agg(F.min("query_id").alias("name")))
    held = lists.select("vec_id", vector(F.col("peaks")).alias("vector"), (F.size("peaks") > 0).alias("has"))
    found = best_pairs(once.select(F.col("name").alias("query_id"), vector(F.col("peaks")).alias("query")), held, k + 1, "product", also="has", has="has", fallback=fallback, own=True)
    best = _top(found.withColumn("fallback", ~F.col("has")), k + 1).select(F.col("query_id").alias("name"), "vec_id", "fallback", "score")
    rows = best.join(lists.select("vec_id", "ids"), "vec_id").select("name", "fallback", "score", F.explode("ids").alias("vec_id"))
    best = pools.ranked(rows, [F.desc("score"), F.col("vec_id")], ["name"], "_n").where(F.col("_n") <= k + 1).drop("_n")
    each = named.join(once, "peaks").select("query_id", "name").join(best, "name").where("query_id <> vec_id")
    return _top(each, k).select("query_id", "vec_id", "fallback", "score", "rank")


def partitioned(library: DataFrame, cells: int, seed: int = 7) -> tuple[DataFrame, list[list[float]]]:
    """The library with each row's cell, by k-means over all of it, and the cells' centres (as many as asked for)."""
    rows = library.withColumn("features", array_to_vector(F.transform("vector", lambda x: x.cast("double"))))
    model = KMeans(k=cells, seed=seed, featuresCol="features", predictionCol="cell").fit(rows)
    return model.transform(rows).drop("features"), [c.tolist() for c in model.clusterCenters()]


def approximate_topk(asked: DataFrame, cells: DataFrame, centres: list[list[float]], probes: int, k: int) -> DataFrame:
    """Top-k among the rows of the cells nearest to each query."""
    centre = F.array(*[F.struct(F.lit(i).alias("cell"), S.doubles(c).alias("at")) for i, c in enumerate(centres)])
    away = F.transform(centre, lambda c: F.struct(F.aggregate(F.zip_with(c["at"], F.col("query"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("d"), c["cell"].alias("cell")))
    near = asked.select("query_id", "query", F.explode(F.slice(F.array_sort(away), 1, probes)).alias("_c")).select("query_id", "query", "_c.cell")
    return _top(best_pairs(near, cells, k, same="cell").select("query_id", "vec_id", "score"), k)


def _padded(lists: pa.Array) -> np.ndarray:
    """One row for each list, as long as the longest, with NaN where there is nothing."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    out = np.full((len(sizes), max(int(sizes.max(initial=0)), 1)), np.nan)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return out


def _tolerated(query: np.ndarray, memory: np.ndarray, tolerance: float) -> np.ndarray:
    """The score of ``spectra.tolerance_match`` before it is rounded, of one query with each row of the memory."""
    used, n, off = np.isnan(memory), np.zeros(len(memory)), np.zeros(len(memory))
    for x in query:
        far = np.abs(memory - x)
        far[used | ~(far <= tolerance)] = np.inf
        at = memory.shape[1] - 1 - np.argmin(far[:, ::-1], axis=1)
        best = far[np.arange(len(far)), at]
        hit = np.flatnonzero(np.isfinite(best))
        used[hit, at[hit]] = True
        n[hit] += 1
        off[hit] += best[hit]
    close = np.maximum(0.0, 1 - off / np.maximum(n, 1) / tolerance)
    return 0.7 * n / max(len(query), 1) + np.where(n > 0, 0.3 * close, 0.0)


def _rounded(x: float, places: int, how: str) -> float:
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), how))


def recalled(asked: DataFrame, memory: DataFrame, k: int, near_h: float = 0.08, near_c: float = 2.0) -> DataFrame:
    """Stored cases by 0.15 for an equal formula, 0.35 and 0.5 of the matches of both nuclei: (query_id, key, score, rank); null peaks are none.

    Cases of equal peaks match alike, so these are one row with their k smallest keys, and another for each formula with the k smallest of that: queries of equal
    peaks meet the former once, and those of equal formula too the latter of their formula, with its 0.15. A case with the query's formula that is found among the
    former as well counts by the higher score. Queries go to every task in blocks of a counted size; a task matches one query with all rows of a batch at a time, and
    keeps the k best of each. The work grows with distinct queries times distinct cases.
    """
    first = stored(pools.ranked(memory.select("key", "formula", "h", "c"), [F.col("key")], ["formula", "h", "c"], "_n").where(F.col("_n") <= k).drop("_n"))
    keys = F.array_sort(F.collect_list(F.col("key").cast("long"))).alias("keys")
    every = pools.ranked(first, [F.col("key")], ["h", "c"], "_n").where(F.col("_n") <= k).groupBy("h", "c").agg(keys).select(F.lit(None).cast("string").alias("formula"), "h", "c", "keys")
    cases = stored(first.where("formula IS NOT NULL").groupBy("formula", "h", "c").agg(keys).unionByName(every).repartition("h", "c").sortWithinPartitions("formula"))
    alike = lambda *by: F.min("query_id").over(Window.partitionBy(*by))
    named = stored(asked.select("*", alike("asked_h", "asked_c").alias("_every"), F.when(F.col("asked_formula").isNotNull(), alike("asked_formula", "asked_h", "asked_c")).alias("_same")))
    once = named.where("query_id = _every").select("query_id", F.lit(None).cast("string").alias("asked_formula"), "asked_h", "asked_c").unionByName(named.where("query_id = _same").select("query_id", "asked_formula", "asked_h", "asked_c"))
    count, width = once.agg(F.count("*"), F.coalesce(F.max(F.size("asked_h") + F.size("asked_c")), F.lit(0))).first()
    blocks = max(1, -(-count * (8 * max(width, 0) + 64 + 32 * k) // SENT_BYTES))
    numbered = once.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        held: dict = {}
        for r in numbered.where(F.col("_block") == block).collect():
            held.setdefault(r.asked_formula, []).append((r.query_id, [np.array([np.nan if x is None else x for x in p or ()], float) for p in (r.asked_h, r.asked_c)]))
        sent = asked.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best: dict = {(formula, q[0]): [] for formula, some in sent.value.items() for q in some}
            for batch in batches:
                formulas = batch.column("formula").to_pylist()
                cuts = [0, *(i for i in range(1, len(formulas)) if formulas[i] != formulas[i - 1]), len(formulas)]
                for start, end in ((s, min(s + 4096, end)) for begin, end in zip(cuts, cuts[1:], strict=False) for s in range(begin, end, 4096)):
                    formula, part = formulas[start], batch.slice(start, end - start)
                    if formula not in sent.value:
                        continue
                    keys, same = part.column("keys"), 0.0 if formula is None else 0.15
                    peaks = [_padded(part.column(c)) for c in ("h", "c")]
                    for name, query in sent.value[formula]:
                        h, c = (_tolerated(q, m, t) for q, m, t in zip(query, peaks, (near_h, near_c), strict=True))
                        rough = same + 0.35 * h + 0.5 * c
                        mine = best[formula, name]
                        least = np.partition(rough, -k)[-k] if len(rough) > k else -np.inf
                        least = max(least, mine[-1][0] if len(mine) == k else -np.inf) - 1e-3  # more than rounding to four places takes
                        some = np.flatnonzero(rough >= least).tolist()
                        for i in some:
                            exact = same + 0.35 * _rounded(float(h[i]), 4, ROUND_HALF_EVEN) + 0.5 * _rounded(float(c[i]), 4, ROUND_HALF_EVEN)
                            score = _rounded(exact, 6, ROUND_HALF_UP)
                            mine.extend((score, key) for key in keys[i].as_py())
                        if some:
                            best[formula, name] = sorted(mine, key=lambda x: (-x[0], x[1]))[:k]
            for (formula, name), rows in best.items():
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(rows), pa.int64()), pa.array([formula is not None] * len(rows)), pa.array([x for _, x in rows], pa.int64()), pa.array([x for x, _ in rows], pa.float64())], names=["name", "same", "key", "score"]
                    )

        one = cases.mapInArrow(run, "name long, same boolean, key long, score double")
        found = one if found is None else found.unionByName(one)
    found = stored(pools.ranked(found, [F.desc("score"), F.col("key")], ["name", "same"], "_n").where(F.col("_n") <= k).drop("_n"))
    of = lambda which, name: named.select("query_id", F.col(name).alias("name")).join(found.where(which), "name").select("query_id", "key", "score")
    each = of("same", "_same").unionByName(of("NOT same", "_every")).groupBy("query_id", "key").agg(F.max("score").alias("score"))
    return pools.ranked(each, [F.desc("score"), F.col("key")], ["query_id"]).where(F.col("rank") <= k)


def truth_ranks(ranks: DataFrame, truth: DataFrame, key: str = "vec_id") -> DataFrame:
    """Rank of the true row of each query (query_id, key), null where it isn't found."""
    return truth.join(ranks.select("query_id", key, "rank"), ["query_id", key], "left")


def centroids(library: DataFrame, bucket: str, vector: str) -> DataFrame:
    """Mean vector of each bucket, with its size."""
    flat = library.select(bucket, F.posexplode(vector).alias("at", "x")).groupBy(bucket, "at").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("*").alias("n"))
    return flat.groupBy(bucket).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "mean"))).alias("_v")).select(bucket, "n", F.transform("_v", lambda v: v["mean"]).alias("centroid"))
