"""Every query over the driver's whole tables, by name, with the SQL that it is compared with, where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions import spectra as S
from peakloom.functions import text as T
from peakloom.operators import fragments, knowledge, pools, prep, retrieval, text_search
from peakloom.plans.registry import ORACLES, QUERIES, register, table
from peakloom.session import written_folder

__all__ = ["ORACLES", "QUERIES"]

# -- vector search ----------------------------------------------------------------------------------------------

_COS = "round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6)"


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("bucket"), F.col("embedding").alias("vector"))


def _asked(spark: SparkSession, sf_dir: str, every: int = 25) -> DataFrame:
    rows = _library(spark, sf_dir).where(F.col("vec_id") % every == 0)
    return rows.select(F.col("vec_id").alias("query_id"), "bucket", F.col("vector").alias("query"))


def _ranked(inner: str, k: int, columns: str = "query_id, vec_id, bucket, score", score: str = "score") -> str:
    return f"SELECT {columns}, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, vec_id) AS INTEGER) AS rank FROM ({inner})) WHERE rank <= {k}"


_OWN = f"SELECT q.vec_id AS query_id, e.vec_id, e.label AS bucket, q.label AS wanted, {_COS} AS score FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 25 = 0"
_ANY = _OWN.replace("q.label = e.label AND ", "")


@register("vec_formula_topk", _ranked(_OWN, 5))
def vec_formula_topk(spark, sf_dir):
    return retrieval.bucket_topk(_asked(spark, sf_dir), _library(spark, sf_dir), 5)


@register("vec_global_topk", _ranked(_ANY, 10))
def vec_global_topk(spark, sf_dir):
    return retrieval.global_topk(_asked(spark, sf_dir), _library(spark, sf_dir), 10)


def _mode_sql(mode: str, k: int) -> str:
    own = f"SELECT *, 'formula' AS branch FROM ({_ranked(_OWN, 3 * k, 'query_id, vec_id, bucket, wanted, score')})"
    every = f"SELECT *, 'global' AS branch FROM ({_ranked(_ANY, 3 * k, 'query_id, vec_id, bucket, wanted, score')})"
    rows = {"formula_only": own, "non_formula": every}.get(mode, f"{own} UNION ALL {every}")
    first = f"SELECT query_id, vec_id, min(branch) AS branch, any_value(bucket) AS bucket, any_value(score) AS score, any_value(bucket = wanted) AS matched FROM ({rows}) GROUP BY 1, 2"
    by = {"mixed": "matched DESC, score DESC, vec_id", "auto": "matched DESC, score DESC, vec_id"}.get(mode, "score DESC, vec_id")
    if mode == "mixed":
        first = f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, matched ORDER BY score DESC, vec_id) AS n FROM ({first})) WHERE matched OR n <= {k}"
    cut = "" if mode == "mixed" else f"WHERE merged_rank <= {k}"
    return f"SELECT * FROM (SELECT query_id, vec_id, bucket, score, branch, matched, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {by}) AS INTEGER) AS merged_rank FROM ({first})) {cut}"


for _mode in ("auto", "formula_only", "non_formula", "mixed"):

    @register(f"vec_mode_{_mode}", _mode_sql(_mode, 4))
    def _by_mode(spark, sf_dir, mode=_mode):
        rows = retrieval.by_mode(_asked(spark, sf_dir), _library(spark, sf_dir), 4, mode)
        return rows.select("query_id", "vec_id", "bucket", "score", "branch", "matched", "merged_rank")


_COARSE = "round(list_cosine_similarity(q.embedding[1:32]::DOUBLE[], e.embedding[1:32]::DOUBLE[]), 6)"


@register(
    "vec_two_stage",
    f"""WITH pool AS ({_ranked(_ANY.replace(_COS, _COARSE), 15, 'query_id, vec_id, score AS vector_score', 'score')}),
    s AS (SELECT query_id, p.vec_id, vector_score, p.rank AS vector_rank, {_COS} AS score FROM pool p JOIN embeddings q ON q.vec_id = query_id JOIN embeddings e ON e.vec_id = p.vec_id)
    {_ranked('SELECT * FROM s', 5, 'query_id, vec_id, vector_score, vector_rank, score')}""",
)
def vec_two_stage(spark, sf_dir):
    return retrieval.two_stage(_asked(spark, sf_dir), _library(spark, sf_dir), 5, 32)


@register(
    "vec_payload_rerank",
    f"""WITH pool AS ({_ranked(_ANY.replace(_COS, _COARSE), 15, 'query_id, vec_id, score AS vector_score', 'score')}),
    r AS (SELECT query_id, vec_id, vector_score, p.rank AS vector_rank, CASE WHEN vec_id % 6 = 0 THEN ' ' WHEN vec_id % 3 = 0 THEN 'x' || vec_id ELSE 'k' || vec_id END AS db_key, CASE WHEN vec_id % 2 = 0 THEN vec_id END AS db_id FROM pool p),
    s AS (SELECT query_id, r.vec_id, vector_rank, CASE WHEN e.vec_id IS NULL THEN vector_score ELSE {_COS} END AS score, e.vec_id IS NULL AS fallback
      FROM r JOIN embeddings q ON q.vec_id = query_id LEFT JOIN embeddings e ON (e.vec_id = r.db_id OR 'k' || e.vec_id = r.db_key) AND e.vec_id % 7 <> 0)
    SELECT query_id, vec_id, score, fallback, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_rank) AS rank FROM s) WHERE rank <= 5""",
)
def vec_payload_rerank(spark, sf_dir):
    asked, library, at = _asked(spark, sf_dir), _library(spark, sf_dir), F.col("vec_id")
    cut = lambda rows, c: rows.withColumn(c, F.slice(c, 1, 32))
    found = retrieval.global_topk(cut(asked, "query"), cut(library, "vector"), 15).withColumnsRenamed({"score": "vector_score", "rank": "vector_rank"})
    key = F.when(at % 6 == 0, " ").when(at % 3 == 0, F.concat(F.lit("x"), at.cast("string"))).otherwise(F.concat(F.lit("k"), at.cast("string")))
    results = found.join(asked.select("query_id", "query"), "query_id").withColumns({"db_key": key, "db_id": F.when(at % 2 == 0, at)})
    payload = library.select(F.concat(F.lit("k"), at.cast("string")).alias("key"), at.alias("id"), F.when(at % 7 != 0, F.col("vector")).alias("embedding"))
    return retrieval.embedding_reranked(results, payload, 5)


_BACKEND = "SELECT '{0}' AS backend, query_id, vec_id, score, rank FROM ({1})"


@register(
    "vec_backends",
    f"""WITH pool AS ({_ranked(_ANY.replace(_COS, _COARSE), 15, 'query_id, vec_id, score AS vector_score', 'score')}),
    s AS (SELECT query_id, p.vec_id, p.rank AS vector_rank, {_COS} AS score FROM pool p JOIN embeddings q ON q.vec_id = query_id JOIN embeddings e ON e.vec_id = p.vec_id)
    {_BACKEND.format('embedding', _ranked(_ANY, 5, 'query_id, vec_id, score'))} UNION ALL {_BACKEND.format('gaussian', _ranked(_ANY.replace(_COS, _COARSE), 5, 'query_id, vec_id, score'))}
    UNION ALL SELECT 'gaussian_then_embedding', query_id, vec_id, score, CAST(rank AS INTEGER) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_rank) AS rank FROM s) WHERE rank <= 5""",
)
def vec_backends(spark, sf_dir):
    both = lambda rows, c: rows.withColumnRenamed(c, "embedding").withColumn("gaussian", F.slice("embedding", 1, 32))
    asked, library = both(_asked(spark, sf_dir), "query"), both(_library(spark, sf_dir), "vector")
    parts = [retrieval.by_backend(asked, library, 5, b).select(F.lit(b).alias("backend"), "query_id", "vec_id", "score", "rank") for b in ("embedding", "gaussian", "gaussian_then_embedding")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register(
    "batch_outcomes",
    """SELECT count(*) FILTER (WHERE toxic IS NOT NULL AND NOT coalesce(text, '') = '') AS processed, count(*) FILTER (WHERE toxic IS NOT NULL AND coalesce(text, '') = '') AS failed,
    count(*) FILTER (WHERE toxic IS NULL) AS skipped FROM documents LEFT JOIN labels USING (doc_id)""",
)
def batch_outcomes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return retrieval.outcomes(rows, F.col("toxic").isNull(), F.coalesce("text", F.lit("")) == "")


@register("vec_ann_probe")
def vec_ann_probe(spark, sf_dir):
    cells, centres = retrieval.partitioned(_library(spark, sf_dir), 8)
    return retrieval.approximate_topk(_asked(spark, sf_dir), cells, centres, 6, 5)


@register(
    "vec_recall_at_k",
    f"""WITH r AS ({_ranked(_ANY, 10, 'query_id, vec_id, bucket, wanted')})
    SELECT query_id, {', '.join(f'CAST(max(CAST(bucket = wanted AND rank <= {k} AS INTEGER)) AS INTEGER) AS hit_{k}' for k in (1, 3, 5, 10))}, min(rank) FILTER (bucket = wanted) AS first_rank FROM r GROUP BY query_id""",
)
def vec_recall_at_k(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    ranks = retrieval.global_topk(asked, _library(spark, sf_dir), 10).join(asked.select("query_id", F.col("bucket").alias("wanted")), "query_id")
    return pools.hits_at(ranks, "query_id", "rank", F.col("bucket") == F.col("wanted"), [1, 3, 5, 10])


@register(
    "vec_target_in_library",
    f"""WITH r AS ({_ranked(_OWN, 20, 'query_id, vec_id')}), t AS (SELECT vec_id AS query_id, vec_id + 1 AS vec_id FROM embeddings WHERE vec_id % 25 = 0)
    SELECT t.query_id, t.vec_id, r.rank, r.rank IS NOT NULL AS found FROM t LEFT JOIN r USING (query_id, vec_id)""",
)
def vec_target_in_library(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    truth = asked.select("query_id", (F.col("query_id") + 1).alias("vec_id"))
    rows = retrieval.truth_ranks(retrieval.bucket_topk(asked, _library(spark, sf_dir), 20), truth)
    return rows.select("query_id", "vec_id", "rank", F.col("rank").isNotNull().alias("found"))


@register(
    "vec_bucket_centroid",
    """SELECT label AS bucket, pos, round(avg(x), 6) AS mean, count(*) AS n FROM
    (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY 1, 2""",
)
def vec_bucket_centroid(spark, sf_dir):
    rows = retrieval.centroids(_library(spark, sf_dir), "bucket", "vector")
    return rows.select("bucket", F.posexplode("centroid").alias("pos", "mean"), "n").select("bucket", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"), "n")


@register("vec_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x)), 6) AS total FROM embeddings")
def vec_norms(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(S.dot(v, v)), 6).alias("norm"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@register(
    "vec_tanimoto",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings WHERE embedding IS NOT NULL),
    p AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(range(1, 1 + greatest(len(q.b), len(e.b))), lambda i: least(coalesce(q.b[i], 0), coalesce(e.b[i], 0)))) AS n_both,
      list_sum(list_transform(range(1, 1 + greatest(len(q.b), len(e.b))), lambda i: greatest(coalesce(q.b[i], 0), coalesce(e.b[i], 0)))) AS n_either
      FROM v q, v e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)
    SELECT query_id, vec_id, round(n_both::DOUBLE / n_either, 6) AS tanimoto FROM p WHERE n_either > 0 AND 2 * n_both >= n_either""",
)
def vec_tanimoto(spark, sf_dir):
    """Bits of all components, in words of 32."""
    bit = lambda at: F.when(F.try_element_at(F.col("vector"), at) > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    word = lambda n: F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda s, i: s * 2 + bit((n * 32 + i + 1).cast("int")))
    rows = _library(spark, sf_dir).where("vector IS NOT NULL").select("vec_id", F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("vector") / 32).cast("int"), F.lit(1)) - 1), word).alias("words"))
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("words").alias("own"))
    zero = F.lit(0).cast("long")
    ones = lambda join: F.aggregate(F.zip_with("own", "words", lambda a, b: F.bit_count(join(F.coalesce(a, zero), F.coalesce(b, zero)))), F.lit(0), lambda s, n: s + n)
    width = asked.agg(F.max(8 * F.size("own"))).first()[0] or 8
    counted = retrieval.met(asked, rows, 16 + width).where("query_id <> vec_id").select("query_id", "vec_id", ones(lambda a, b: a.bitwiseAND(b)).alias("both"), ones(lambda a, b: a.bitwiseOR(b)).alias("either"))
    return counted.where("either > 0 AND 2 * both >= either").select("query_id", "vec_id", F.round(F.col("both") / F.col("either"), 6).alias("tanimoto"))


# -- spectra ----------------------------------------------------------------------------------------------------


def _spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as molecules: quantities of returned and other lines as two nuclei's peaks."""
    lines = table(spark, sf_dir, "lineitem")
    of = lambda returned: F.array_sort(F.collect_list(F.when((F.col("l_returnflag") == "R") == returned, F.col("l_quantity"))))
    return lines.groupBy(F.col("l_orderkey").alias("id")).agg(of(True).alias("h"), of(False).alias("c"))


_SPECTRA = "spectra AS (SELECT l_orderkey AS id, coalesce(list_sort(list(l_quantity) FILTER (l_returnflag = 'R')), []) AS h, coalesce(list_sort(list(l_quantity) FILTER (l_returnflag <> 'R')), []) AS c FROM lineitem GROUP BY 1)"


def _gaussian_sql(peaks: str, low: float, high: float, width: float) -> str:
    step = (high - low) / 127
    return f"list_transform(range(128), lambda i: coalesce(list_sum(list_transform({peaks}, lambda p: {step!r} / (sqrt(2 * pi()) * {width}) * exp(-0.5 * pow((p - ({low} + i * {step!r})) / {width}, 2)))), 0))"


@register(
    "spec_gaussian_vector",
    f"""WITH {_SPECTRA}, v AS (SELECT id, {_gaussian_sql('c', -10.0, 230.0, 2.0)} AS v FROM spectra)
    SELECT id, pos, round(x, 6) AS value FROM (SELECT id, unnest(v) AS x, unnest(range(128)) AS pos FROM v) WHERE round(x, 6) > 0""",
)
def spec_gaussian_vector(spark, sf_dir):
    return _gaussian_vectors(_spectra(spark, sf_dir))


def _gaussian_vectors(spectra: DataFrame) -> DataFrame:
    rows = spectra.select("id", F.explode(S.gaussian_bins(F.col("c"), *S.CARBON, 4e-7)).alias("b"))  # less rounds to 0
    return rows.select("id", "b.pos", F.round("b.x", 6).alias("value")).where("value > 0")


@register(
    "spec_vector_rerank",
    f"""WITH {_SPECTRA}, v AS (SELECT id, {_gaussian_sql('c', -10.0, 230.0, 2.0)} AS v, len(c) > 0 AS has FROM spectra),
    u AS (SELECT id, has, list_transform(v, lambda x: CASE WHEN has THEN x / sqrt(list_sum(list_transform(v, lambda y: y * y))) ELSE x END) AS v FROM v),
    s AS (SELECT q.id AS query_id, e.id AS vec_id, NOT e.has AS fallback, round(CASE WHEN e.has THEN list_inner_product(q.v, e.v) ELSE 0.5 END, 6) AS score FROM u q, u e WHERE q.id % 100 = 0 AND q.id <> e.id)
    {_ranked('SELECT * FROM s', 10, 'query_id, vec_id, fallback, score')}""",
)
def spec_vector_rerank(spark, sf_dir):
    return _vector_reranked(_spectra(spark, sf_dir))


def _vector_reranked(spectra: DataFrame) -> DataFrame:
    rows = spectra.select(F.col("id").alias("vec_id"), F.col("c").alias("peaks"))
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "peaks")
    return retrieval.alike_topk(asked, rows, lambda peaks: S.unit(S.gaussian_vector(peaks, *S.CARBON)), 0.5, 10)


@register(
    "spec_greedy_match",
    f"""WITH RECURSIVE {_SPECTRA}, s AS (SELECT id, h, c FROM spectra),
    g(id, n, acc, rest, q, m) AS (SELECT id, 0, 0.0::DOUBLE, c, h, len(c) FROM s UNION ALL
      SELECT id, n + 1, acc + exp(-pow(near[1], 2) / 200), list_concat(rest[1:near[2]::INT - 1], rest[near[2]::INT + 1:]), q, m FROM
      (SELECT *, list_min(list_transform(range(1, len(rest) + 1), lambda i: [abs(rest[i] - q[n + 1]), i::DOUBLE])) AS near FROM g WHERE n < len(q) AND len(rest) > 0))
    SELECT id, round(CASE WHEN any_value(len(q)) = 0 OR any_value(m) = 0 THEN 0 ELSE max(acc) / greatest(any_value(len(q)), any_value(m)) END, 6) AS score FROM g GROUP BY id""",
)
def spec_greedy_match(spark, sf_dir):
    return _greedily_matched(_spectra(spark, sf_dir))


def _greedily_matched(spectra: DataFrame) -> DataFrame:
    return spectra.select("id", F.round(S.greedy_match(F.col("h"), F.col("c"), 10.0), 6).alias("score"))


def _matchings_sql(gain: str, outcome: str) -> str:
    """SQL over every one-to-one matching of the shorter list into the longer; ``acc`` is the sum of a matching."""
    return f"""WITH RECURSIVE {_SPECTRA}, s AS (SELECT id, CASE WHEN len(h) <= len(c) THEN h ELSE c END AS a, CASE WHEN len(h) <= len(c) THEN c ELSE h END AS b FROM spectra),
    g(id, n, acc, rest, a, m) AS (SELECT id, 0, 0.0::DOUBLE, b, a, len(b) FROM s UNION ALL
      SELECT id, n + 1, acc + {gain}, list_concat(rest[1:j - 1], rest[j + 1:]), a, m FROM (SELECT *, unnest(range(1, len(rest) + 1)) AS j FROM g WHERE n < len(a)))
    SELECT id, {outcome} FROM g WHERE n = len(a) GROUP BY id"""


@register("spec_assign_cost", _matchings_sql("abs(a[n + 1] - rest[j])", "round(min(acc), 6) AS cost, any_value(len(a)) AS pairs"))
def spec_assign_cost(spark, sf_dir):
    from peakloom.functions.assignment import assignment_udf

    rows = _spectra(spark, sf_dir).select("id", assignment_udf("h", "c").alias("a"))
    return rows.select("id", F.round("a.cost", 6).alias("cost"), F.size("a.matched").cast("long").alias("pairs"))


@register("spec_assignment")
def spec_assignment(spark, sf_dir):
    from peakloom.functions.assignment import assignment_udf

    rows = _spectra(spark, sf_dir).select("id", assignment_udf("h", "c").alias("a"))
    return rows.select("id", F.round("a.cost", 6).alias("cost"), "a.matched", "a.unmatched", "a.unused")


@register("spec_set_match", _matchings_sql("exp(-pow(a[n + 1] - rest[j], 2) / 200)", "round(CASE WHEN any_value(len(a)) = 0 THEN 0 ELSE max(acc) / sqrt(any_value(len(a) * m)) END, 6) AS score"))
def spec_set_match(spark, sf_dir):
    from peakloom.functions.assignment import set_match_udf

    return _spectra(spark, sf_dir).select("id", F.round(set_match_udf(10.0)("h", "c"), 6).alias("score"))


@register("spec_similarity")
def spec_similarity(spark, sf_dir):
    from peakloom.functions.assignment import similarity_udf

    rows = _spectra(spark, sf_dir)
    return rows.select("id", F.round(similarity_udf("h", "c", F.transform("h", lambda x: x + 0.5), F.transform("c", lambda x: x - 1)), 6).alias("score"))


@register(
    "spec_tolerance",
    f"""WITH RECURSIVE {_SPECTRA}, g(id, n, hits, off, rest, q) AS (SELECT id, 0, 0, 0.0::DOUBLE, c, h FROM spectra UNION ALL
      SELECT id, n + 1, hits + CASE WHEN near IS NULL THEN 0 ELSE 1 END, off + coalesce(near[1], 0),
        CASE WHEN near IS NULL THEN rest ELSE list_concat(rest[1:CAST(-near[2] AS INTEGER) - 1], rest[CAST(-near[2] AS INTEGER) + 1:]) END, q FROM
      (SELECT *, list_min(list_filter(list_transform(range(1, len(rest) + 1), lambda i: [abs(rest[i] - q[n + 1]), -(i::DOUBLE)]), lambda x: x[1] <= 2)) AS near FROM g WHERE n < len(q)))
    SELECT id, hits AS matched, CAST(len(q) AS INTEGER) AS total, CASE WHEN hits > 0 THEN round_even(off / hits, 4) END AS mean_delta,
      round_even(0.7::DOUBLE * hits / greatest(len(q), 1) + CASE WHEN hits > 0 THEN 0.3::DOUBLE * greatest(0.0, 1 - off / hits / 2) ELSE 0 END, 4) AS score FROM g WHERE n = len(q)""",
)
def spec_tolerance(spark, sf_dir):
    return _spectra(spark, sf_dir).select("id", S.tolerance_match(F.col("h"), F.col("c"), 2.0).alias("m")).select("id", "m.*")


@register("memory_recall")
def memory_recall(spark, sf_dir):
    rows = _spectra(spark, sf_dir).select(F.col("id").alias("key"), F.pmod("id", F.lit(7)).cast("string").alias("formula"), "h", "c")
    asked = rows.where("key % 100 = 0").select(F.col("key").alias("query_id"), F.col("formula").alias("asked_formula"), F.col("h").alias("asked_h"), F.col("c").alias("asked_c"))
    return retrieval.recalled(asked, rows, 5)


_REGION = "CASE " + " ".join(f"WHEN q >= {low} AND q {'<=' if n == 0 else '<'} {high} THEN '{name}'" for n, (low, high, name) in enumerate(S.REGIONS)) + f" ELSE '{S.UNUSUAL}' END"


@register("region_label", f"SELECT {_REGION} AS region, count(*) AS n FROM (SELECT p_size * 5.0 AS q FROM part) GROUP BY 1")
def region_label(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(S.region(F.col("p_size") * 5.0).alias("region")).agg(F.count("*").alias("n"))


@register(
    "peak_regions",
    f"WITH {_SPECTRA} SELECT id, len(list_filter(c, lambda x: x >= 40)) > 0 AS high, len(list_filter(c, lambda x: x >= 20 AND x <= 40)) > 0 AS middle, len(list_filter(h, lambda x: x < 5)) > 0 AS low FROM spectra",
)
def peak_regions(spark, sf_dir):
    return _spectra(spark, sf_dir).select("id", F.exists("c", lambda x: x >= 40).alias("high"), F.exists("c", lambda x: (x >= 20) & (x <= 40)).alias("middle"), F.exists("h", lambda x: x < 5).alias("low"))


@register(
    "spectrum_flatten",
    f"WITH {_SPECTRA} SELECT id, pos, shift, kind FROM (SELECT id, unnest(list_concat(h, c)) AS shift, unnest(range(len(h) + len(c))) AS pos, unnest(list_concat(list_transform(h, lambda x: 0), list_transform(c, lambda x: 1))) AS kind FROM spectra)",
)
def spectrum_flatten(spark, sf_dir):
    return _flattened(_spectra(spark, sf_dir))


def _flattened(spectra: DataFrame) -> DataFrame:
    rows = spectra.select("id", F.posexplode(prep.flattened(F.col("h"), F.col("c"))).alias("pos", "p"))
    return rows.select("id", F.col("pos").cast("long").alias("pos"), "p.shift", "p.kind")


# -- formulas and fragments -------------------------------------------------------------------------------------

_F = "'C' || (1 + p_size % 9) || 'H' || (2 + p_partkey % 11) || 'O' || (CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_partkey % 3 AS VARCHAR) END)"


def _formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.pmod("p_partkey", F.lit(3))
    text = F.concat(F.lit("C"), (1 + F.pmod("p_size", F.lit(9))).cast("string"), F.lit("H"), (2 + F.pmod("p_partkey", F.lit(11))).cast("string"), F.lit("O"), F.when(third == 0, "").otherwise(third.cast("string")))
    # A table of few bytes is read by one task; its formulas cost more than its bytes.
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    return part.select("p_partkey", text.alias("formula")).withColumn("counts", S.formula_counts(F.col("formula")))


_COUNTS = f"SELECT p_partkey, {_F} AS formula, 1 + p_size % 9 AS c, 2 + p_partkey % 11 AS h, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE p_partkey % 3 END AS o FROM part"


@register("formula_parse", f"SELECT p_partkey, formula, CAST(c AS INTEGER) AS c, CAST(h AS INTEGER) AS h, CAST(o AS INTEGER) AS o, CAST(0 AS INTEGER) AS n FROM ({_COUNTS})")
def formula_parse(spark, sf_dir):
    v = S.count_vector(F.col("counts"), ["C", "H", "O", "N"])
    return _formulas(spark, sf_dir).select("p_partkey", "formula", *[v[i].alias(n) for i, n in enumerate("chon")])


@register(
    "formula_difference",
    f"""SELECT p_partkey, CASE WHEN c = 5 THEN '' ELSE 'C' || CASE WHEN c = 6 THEN '' ELSE CAST(c - 5 AS VARCHAR) END END || CASE WHEN h = 8 THEN '' ELSE 'H' || CASE WHEN h = 9 THEN '' ELSE CAST(h - 8 AS VARCHAR) END END
      || 'N-1' || CASE WHEN o = 2 THEN '' ELSE 'O' || CAST(o - 2 AS VARCHAR) END AS difference FROM ({_COUNTS})""",
)
def formula_difference(spark, sf_dir):
    target = S.formula_counts(F.lit("C5H8NO2"))
    return _formulas(spark, sf_dir).select("p_partkey", S.formula_text(S.formula_difference(F.col("counts"), target)).alias("difference"))


@register(
    "formula_sum_pairs",
    f"""WITH f AS ({_COUNTS}), s AS (SELECT * FROM f)
    SELECT a.p_partkey AS left_id, b.p_partkey AS right_id FROM s a JOIN s b ON a.p_partkey < b.p_partkey AND a.c + b.c = 10 AND a.h + b.h = 16 AND a.o + b.o = 3""",
)
def formula_sum_pairs(spark, sf_dir):
    return _sum_pairs(_formulas(spark, sf_dir))


def _sum_pairs(formulas: DataFrame) -> DataFrame:
    rows = formulas.select(F.col("p_partkey").alias("id"), "counts")
    return fragments.sums_to(rows, S.formula_counts(F.lit("C10H16O3")), "id", "counts")


@register("formula_fits", f"SELECT p_partkey, c <= 6 AND h <= 9 AND o <= 1 AS fits FROM ({_COUNTS})")
def formula_fits(spark, sf_dir):
    return _formulas(spark, sf_dir).select("p_partkey", S.fits_within(F.col("counts"), S.formula_counts(F.lit("C6H9O"))).alias("fits"))


@register("formula_size", f"SELECT p_partkey, CAST(c + o AS INTEGER) AS heavy FROM ({_COUNTS}) WHERE c + o <= 7 + 2")
def formula_size(spark, sf_dir):
    from peakloom.operators import optimise

    return optimise.within_size(_formulas(spark, sf_dir), "formula", "C6H9O", 2).select("p_partkey", S.heavy_atoms(F.col("counts")).alias("heavy"))


@register(
    "frag_covers_bad",
    f"WITH {_SPECTRA} SELECT id, len(list_filter(h, lambda b: len(list_filter(c, lambda s: abs(s - b) < 2.0)) > 0)) > 0 AS covers, CAST(len(list_filter(h, lambda b: len(list_filter(c, lambda s: abs(s - b) < 2.0)) > 0)) AS INTEGER) AS n_covered FROM spectra",
)
def frag_covers_bad(spark, sf_dir):
    from peakloom.operators import rerank

    found = F.size(rerank.covered(F.col("h"), F.col("c"), 2.0))
    return _spectra(spark, sf_dir).select("id", (found > 0).alias("covers"), found.alias("n_covered"))


@register(
    "frag_pair_join",
    """SELECT DISTINCT a.p_partkey AS left_id, b.p_partkey AS right_id FROM part a JOIN part b
    ON a.p_partkey < b.p_partkey AND a.p_brand || ':' || a.p_size = b.p_brand || ':' || (51 - b.p_size) AND a.p_type <> b.p_type""",
)
def frag_pair_join(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(":", "p_brand", 51 - F.col("p_size")).alias("cut"), F.concat_ws(":", "p_brand", "p_size").alias("complement"), "p_type")
    return fragments.complement_pairs(rows, "p_partkey", "cut", "complement", "p_type")


_ENDS = "['C', 'N', 'O'][1 + p_partkey % 3] AS e1, ['C', 'N', 'O'][1 + p_size % 3] AS e2, ['C', 'N', 'O'][1 + (p_partkey + p_size) % 3] AS p1, ['C', 'O'][1 + p_partkey % 2] AS p2, p_brand AS b"


@register(
    "frag_mask_join",
    f"""WITH f AS (SELECT p_partkey AS id, {_ENDS} FROM part),
    q AS (SELECT id, b, CASE WHEN e1 = 'C' THEN p1 ELSE '*' END AS m1, CASE WHEN e2 = 'C' THEN p2 ELSE '*' END AS m2 FROM f),
    k AS (SELECT id, b, unnest([e1, '*', e1, '*']) AS m1, unnest([e2, e2, '*', '*']) AS m2 FROM f)
    SELECT DISTINCT q.id AS query_id, k.id AS key_id FROM q JOIN k USING (b, m1, m2) WHERE q.id <> k.id""",
)
def frag_mask_join(spark, sf_dir):
    return _mask_pairs(table(spark, sf_dir, "part"))


def _mask_pairs(part: DataFrame) -> DataFrame:
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = part.select(
        key.alias("id"), F.array(pick("CNO", key % 3), pick("CNO", size % 3)).alias("ends"), F.array(pick("CNO", (key + size) % 3), pick("CO", key % 2)).alias("partners"), F.array("p_brand").alias("bonds"))
    return fragments.mask_pairs(rows, "id", "ends", "partners", "bonds")


@register(
    "frag_knn_pairs",
    """WITH d AS (SELECT a.vec_id AS q, b.vec_id AS k, round(list_sum(list_transform(range(1, 65), lambda i: pow(0.1::DOUBLE - a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2))), 6) AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
    n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, k) AS nth FROM d)
    SELECT least(q, k) AS left_id, greatest(q, k) AS right_id, min(distance) AS distance FROM n WHERE nth <= 3 GROUP BY 1, 2""",
)
def frag_knn_pairs(spark, sf_dir):
    return fragments.nearest_residuals(_library(spark, sf_dir), 0.1, "vec_id", "vector", "bucket", 3)


@register(
    "subset_sum_combos",
    """WITH RECURSIVE b AS (SELECT p_size AS k, max(p_retailprice) AS s FROM part GROUP BY 1),
    r(keys, total, score, last) AS (SELECT [k], k, s, k FROM b UNION ALL SELECT list_append(keys, b.k), total + b.k, score + b.s, b.k FROM r JOIN b ON b.k >= last AND total + b.k <= 20 WHERE len(keys) < 4 AND total < 20)
    SELECT array_to_string(keys, ',') AS keys, CAST(len(keys) AS INTEGER) AS size, round(score, 4) AS score FROM r WHERE total = 20 AND len(keys) >= 2""",
)
def subset_sum_combos(spark, sf_dir):
    return _combinations(table(spark, sf_dir, "part"))


def _combinations(part: DataFrame) -> DataFrame:
    buckets = part.groupBy("p_size").agg(F.max("p_retailprice").alias("s")).withColumn("counts", F.array("p_size"))
    rows = fragments.bucket_combinations(buckets, F.array(F.lit(20)), "p_size", "counts", "s", 2, 4)
    return rows.select(F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("keys"), "size", F.round("score", 4).alias("score"))


@register("subset_sum_choices")
def subset_sum_choices(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    buckets = part.groupBy("p_size").agg(F.max("p_retailprice").alias("s")).withColumn("counts", F.array("p_size"))
    combos = fragments.bucket_combinations(buckets, F.array(F.lit(20)), "p_size", "counts", "s", 2, 3, beam=4).withColumn("combo", F.array_join(F.transform("keys", lambda k: k.cast("string")), "-"))
    return fragments.choices(combos, part, "combo", "keys", "p_size", "p_partkey", "p_brand", "p_retailprice", 3, 5)


# -- pools ------------------------------------------------------------------------------------------------------

_PRICE = "SELECT o_custkey AS id, o_totalprice AS score, CASE WHEN o_orderstatus = 'F' THEN 'retrieval' WHEN o_orderstatus = 'O' THEN 'denovo' ELSE 'other' END AS source, o_orderkey AS row FROM orders"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("o_orderstatus") == "F", "retrieval").when(F.col("o_orderstatus") == "O", "denovo").otherwise("other")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("score"), source.alias("source"), F.col("o_orderkey").alias("row"))


@register("pool_merge_best", f"SELECT id, max(score) AS score, arg_max(row, [score, row]) AS row, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, count(*) AS copies FROM ({_PRICE}) GROUP BY id")
def pool_merge_best(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    out = pools.merged([rows.where(F.col("source") == s) for s in ("retrieval", "denovo", "other")], "id", "score", "source")
    return out.select("id", "score", "row", F.array_join("sources", ",").alias("sources"), "copies")


@register(
    "pool_branch_merge",
    f"""WITH c AS ({_PRICE}), a AS (SELECT * FROM c WHERE source = 'retrieval' ORDER BY score DESC, row LIMIT 200), b AS (SELECT * FROM c WHERE source = 'denovo' ORDER BY score DESC, row LIMIT 100), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
    SELECT id, max(score) AS score, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, CAST(row_number() OVER (ORDER BY max(score) DESC, id) AS INTEGER) AS rank FROM u GROUP BY id""",
)
def pool_branch_merge(spark, sf_dir):
    rows, order = _candidates(spark, sf_dir), [F.desc("score"), F.col("row")]
    kept = [pools.branch_top(rows.where(F.col("source") == s), order, n) for s, n in (("retrieval", 200), ("denovo", 100))]
    out = pools.ranked(pools.merged(kept, "id", "score", "source"), [F.desc("score"), F.col("id")])
    return out.select("id", "score", F.array_join("sources", ",").alias("sources"), "rank")


@register("pool_quota_select", f"SELECT id, score, source, row FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, row) AS n FROM ({_PRICE})) WHERE n <= 40 ORDER BY score DESC, row LIMIT 100")
def pool_quota_select(spark, sf_dir):
    return pools.quota(_candidates(spark, sf_dir), "source", [F.desc("score"), F.col("row")], 40, 100)


@register(
    "pool_floor_fill",
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, row) AS a, row_number() OVER (ORDER BY score DESC, row) AS b FROM ({_PRICE})),
    t AS (SELECT *, CASE WHEN a <= 10 THEN CASE source WHEN 'denovo' THEN 1 WHEN 'retrieval' THEN 2 ELSE 3 END ELSE 4 END AS tier FROM n),
    f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, b) AS w FROM t)
    SELECT * FROM (SELECT id, score, source, row, CAST(row_number() OVER (ORDER BY tier, b) AS INTEGER) AS merged_rank FROM f WHERE w = 1) WHERE merged_rank <= 40""",
)
def pool_floor_fill(spark, sf_dir):
    return pools.floor_then_fill(_candidates(spark, sf_dir), "source", ["denovo", "retrieval"], "id", [-F.col("score"), F.col("row")], 40)


@register("pool_novel_anti", f"WITH c AS ({_PRICE}) SELECT id, score, source, row FROM c WHERE source = 'denovo' AND id NOT IN (SELECT id FROM c WHERE source = 'retrieval')")
def pool_novel_anti(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    return pools.novel(rows.where("source = 'denovo'"), rows.where("source = 'retrieval'"), "id").select("id", "score", "source", "row")


@register(
    "pool_augment",
    f"""WITH c AS ({_PRICE}), u AS (SELECT *, CAST(source <> 'retrieval' AS INTEGER) AS late FROM c WHERE source <> 'other')
    SELECT id, -min([late, -score])[2] AS score, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, min(late) = 1 AS added FROM u GROUP BY id""",
)
def pool_augment(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    out = pools.augmented(rows.where("source = 'retrieval'"), rows.where("source = 'denovo'"), "id", "score", "source")
    return out.select("id", "score", F.array_join("sources", ",").alias("sources"), "added")


@register("pool_first_wins", f"SELECT id, min(row) AS row, arg_min(score, row) AS score, arg_min(source, row) AS source FROM ({_PRICE}) GROUP BY id")
def pool_first_wins(spark, sf_dir):
    return pools.first_wins(_candidates(spark, sf_dir), ["id"], [F.col("row")]).select("id", "row", "score", "source")


# -- text -------------------------------------------------------------------------------------------------------

_TOKENS = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"


def _bm25_sql(asked: str, k: int, where: str = "TRUE") -> str:
    return f"""WITH w AS (SELECT doc_id, {where} AS allowed, {_TOKENS.format('text')} AS words FROM documents), s AS (SELECT count(*) AS n, avg(len(words)) AS mean_dl FROM w),
    q AS (SELECT query_id, unnest(list_distinct(terms)) AS term FROM ({asked})),
    t AS (SELECT doc_id, allowed, dl, term, count(*) AS tf FROM (SELECT doc_id, allowed, len(words) AS dl, unnest(words) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
    g AS (SELECT query_id, doc_id, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean_dl)) AS gain FROM t JOIN f USING (term) JOIN q USING (term), s WHERE allowed),
    r AS (SELECT query_id, doc_id, round(sum(gain), 6) AS score FROM g GROUP BY 1, 2)
    SELECT query_id, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r) WHERE rank <= {k}"""


def _bm25(spark, sf_dir, asked, k, where=None):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return text_search.bm25(docs, asked, "doc_id", ["text"], "query_id", "terms", k, where)


_THREE = "SELECT 1 AS query_id, ['license', 'stupid', 'mit'] AS terms"


def _three(spark):
    return spark.range(1).select(F.lit(1).alias("query_id"), T.query_terms(F.lit("License, stupid MIT"), 12).alias("terms"))


@register("bm25_search", _bm25_sql(_THREE, 20))
def bm25_search(spark, sf_dir):
    return _bm25(spark, sf_dir, _three(spark), 20)


@register("bm25_filtered", _bm25_sql(_THREE, 20, "lang = 'en'"))
def bm25_filtered(spark, sf_dir):
    return _bm25(spark, sf_dir, _three(spark), 20, F.col("lang") == "en")


@register("bm25_index", _bm25_sql(_THREE, 20, "lang = 'en'"))
def bm25_index(spark, sf_dir):
    path = written_folder(spark, "bm25")
    text_search.write_index(table(spark, sf_dir, "documents"), "doc_id", ["text"], path, ("lang",))
    return text_search.search_index(path, _three(spark), "doc_id", "query_id", "terms", 20, F.col("lang") == "en")


@register("bm25_batch", _bm25_sql(f"SELECT item_id AS query_id, list_distinct({_TOKENS.format('text')}) AS terms FROM benchmark", 5))
def bm25_batch(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(T.tokens(F.col("text"))).alias("terms"))
    return _bm25(spark, sf_dir, asked, 5)


@register("text_stats", f"SELECT lang, count(*) AS n, round(avg(len({_TOKENS.format('text')})), 6) AS mean_dl, max(len({_TOKENS.format('text')})) AS most FROM documents GROUP BY lang")
def text_stats(spark, sf_dir):
    n = F.size(T.tokens(F.col("text"))).cast("long")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean_dl"), F.max(n).alias("most"))


@register("document_listing", "SELECT doc_id, source, lang FROM documents WHERE source = 'src3' ORDER BY source, doc_id LIMIT 15")
def document_listing(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("source = 'src3'").select("doc_id", "source", "lang").orderBy("source", "doc_id").limit(15)


@register(
    "heading_breadcrumb",
    r"""WITH l AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS line FROM (SELECT page_id AS doc_id, string_split(html, '<') AS s FROM pages)),
    t AS (SELECT doc_id, pos, CASE WHEN starts_with(line, 'title>') THEN 1 WHEN starts_with(line, 'h1>') THEN 2 WHEN starts_with(line, 'b>') THEN 3 ELSE 0 END AS level, trim(substr(line, strpos(line, '>') + 1)) AS title FROM l),
    h AS (SELECT doc_id, pos, title, CASE WHEN title = '' THEN 0 ELSE level END AS level FROM t),
    r AS (SELECT doc_id, pos, """
    + ", ".join(f"last_value(CASE WHEN level = {x} THEN title END IGNORE NULLS) OVER o AS t{x}, max(CASE WHEN level = {x} THEN pos END) OVER o AS s{x}" for x in (1, 2, 3))
    + """ FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
    SELECT doc_id, pos, concat_ws(' / ', t1, CASE WHEN s2 > coalesce(s1, -1) THEN t2 END, CASE WHEN s3 > greatest(coalesce(s1, -1), coalesce(s2, -1)) THEN t3 END) AS breadcrumb FROM r""",
)
def heading_breadcrumb(spark, sf_dir):
    """The lines of pages, cut at their tags, under the titles, headings and bold openings that stand above them."""
    lines = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(F.split("html", "<")).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))
    said = F.expr("substr(line, instr(line, '>') + 1)")
    marked = F.lit("")
    for mark, tag in (("### ", "b>"), ("## ", "h1>"), ("# ", "title>")):
        marked = F.when(F.startswith("line", F.lit(tag)), F.concat(F.lit(mark), said)).otherwise(marked)
    return text_search.breadcrumbs(lines.withColumn("line", marked), "doc_id", "pos", "line").select("doc_id", "pos", "breadcrumb")


@register("markdown_chunks")
def markdown_chunks(spark, sf_dir):
    return text_search.markdown_chunks(table(spark, sf_dir, "documents"))


@register("normalise_text", r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS squeezed, substr(sha1(text), 1, 16) AS digest FROM documents")
def normalise_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.squeezed(F.col("text")).cast("binary")).alias("squeezed"), T.sha1_text(F.col("text")).alias("digest"))


@register("compact_ids", r"SELECT page_id, nullif(regexp_replace(regexp_replace(trim(regexp_replace(url, '\s+', ' ', 'g')), '[^A-Za-z0-9_.:-]+', '_', 'g'), '^_+|_+$', '', 'g'), '') AS id FROM pages")
def compact_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.compact_id(F.col("url")).alias("id"))


@register("contains_lookup", "SELECT doc_id, substr(text, 1, 2000) AS text FROM documents WHERE contains(lower(text), 'mit license') ORDER BY doc_id LIMIT 1")
def contains_lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("mit license"))).orderBy("doc_id").limit(1).select("doc_id", F.substring("text", 1, 2000).alias("text"))


@register(
    "numbers_in_text",
    r"SELECT doc_id, len(n) AS n, round(list_sum(list_transform(n, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM (SELECT doc_id, regexp_extract_all(text, '-?\d{1,6}(?:\.\d+)?') AS n FROM (SELECT page_id AS doc_id, url AS text FROM pages)) WHERE len(n) > 0",
)
def numbers_in_text(spark, sf_dir):
    found = F.transform(F.regexp_extract_all("url", F.lit(r"-?\d{1,6}(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), found.alias("n")).where("size(n) > 0")
    return rows.select("doc_id", F.size("n").cast("long").alias("n"), F.round(F.aggregate("n", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@register(
    "peak_text_parse",
    r"""WITH c AS (SELECT l_orderkey AS id, '1H NMR (400 MHz) δ ' || string_agg(CAST(l_quantity AS INTEGER) || CASE WHEN l_linenumber % 2 = 0 THEN '-' || CAST(l_quantity - 1 AS INTEGER) ELSE '' END || ' (m, ' || l_linenumber || 'H)', ', ' ORDER BY l_linenumber) AS t FROM lineitem GROUP BY 1), s AS (SELECT id, unnest(string_split(regexp_replace(CASE WHEN contains(t, 'δ') THEN split_part(t, 'δ', 2) ELSE t END, '\)\s*,', ');', 'g'), ';')) AS e FROM c),
    n AS (SELECT id, regexp_extract_all(e, '\d+(?:\.\d+)?') AS v, regexp_matches(e, '\d+(?:\.\d+)?\s*[–-]\s*\d+(?:\.\d+)?') AS r, coalesce(greatest(try_cast(regexp_extract(e, '(\d+)\s*H\b', 1) AS INTEGER), 1), 1) AS k FROM s),
    p AS (SELECT id, CASE WHEN r THEN round((v[1]::DOUBLE + v[2]::DOUBLE) / 2, 4) ELSE v[1]::DOUBLE END AS shift, k FROM n WHERE len(v) > 0)
    SELECT id, shift, CAST(sum(k) AS BIGINT) AS n FROM p GROUP BY 1, 2""",
)
def peak_text_parse(spark, sf_dir):
    """Every order's lines as the text of a spectrum, with single shifts and ranges, parsed again."""
    whole = lambda c: c.cast("int").cast("string")
    entry = F.concat(whole(F.col("l_quantity")), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("-"), whole(F.col("l_quantity") - 1))).otherwise(""), F.lit(" (m, "), F.col("l_linenumber").cast("string"), F.lit("H)"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", entry.alias("e")))).alias("lines"))
    rows = lines.select("id", F.concat(F.lit("1H NMR (400 MHz) δ "), F.array_join(F.transform("lines", lambda x: x["e"]), ", ")).alias("t"))
    return rows.select("id", F.explode(T.proton_shifts(F.col("t"))).alias("shift")).groupBy("id", "shift").agg(F.count("*").alias("n"))


@register("answer_extract", r"SELECT conv_id, turn, nullif(regexp_extract(text, '(?i)the ([a-z]+)', 1), '') AS word FROM conversations WHERE nullif(regexp_extract(text, '(?i)the ([a-z]+)', 1), '') IS NOT NULL AND lower(regexp_extract(text, '(?i)the ([a-z]+)', 1)) NOT IN ('none', 'null', 'n/a', 'na', 'unknown', 'error', 'failed')")
def answer_extract(spark, sf_dir):
    tagged = F.concat(F.lit("Answer: "), F.nullif(F.regexp_extract("text", r"(?i)the ([a-z]+)", 1), F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.answer(tagged).alias("word")).where("word IS NOT NULL")


@register("tool_call_parse", "SELECT event_id, event_type AS action, CAST('{\"k\":' || json_extract_string(props, '$.k') || '}' AS VARCHAR) AS arguments FROM events")
def tool_call_parse(spark, sf_dir):
    step = F.concat(F.lit("<think>hm</think>Thought: look\nAction: "), F.col("event_type"), F.lit('\nAction Input: {"k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", T.tool_call(step).alias("s")).select("event_id", "s.action", "s.arguments")


@register("json_props", "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.from_json("props", "k long")["k"]).alias("k"), F.count("*").alias("n"))


@register("intent_rules", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'evidence|rag') THEN 'rag' WHEN regexp_matches(lower(text), 'solve|structure|answer|run') THEN 'solve' WHEN regexp_matches(lower(text), '^(hi|hello|hey)') THEN 'greeting' ELSE 'chat' END AS intent FROM conversations")
def intent_rules(spark, sf_dir):
    rules = [("rag", "evidence|rag"), ("solve", "solve|structure|answer|run"), ("greeting", "^(hi|hello|hey)")]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.intent(F.col("text"), rules).alias("intent"))


# -- knowledge graph --------------------------------------------------------------------------------------------

_NODES = """nodes AS (SELECT 'region:' || r_regionkey AS node_id, r_name AS name, 'region' AS source, NULL AS formula, NULL AS inchikey FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation', 'R' || n_regionkey, NULL FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier', 'N' || s_nationkey, 'K' || s_suppkey FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'customer', 'N' || c_nationkey, NULL FROM customer)"""
_EDGES = """edges AS (SELECT 'e1:' || n_nationkey AS edge_id, 'nation:' || n_nationkey AS subject_id, 'in_region' AS predicate, 'region:' || n_regionkey AS object_id, 'nation' AS source FROM nation
  UNION ALL SELECT 'e2:' || s_suppkey, 'supplier:' || s_suppkey, 'in_nation', 'nation:' || s_nationkey, 'supplier' FROM supplier
  UNION ALL SELECT 'e3:' || c_custkey, 'customer:' || c_custkey, 'in_nation', 'nation:' || c_nationkey, 'customer' FROM customer)"""
_NEIGHBOURS = "nb AS (SELECT subject_id AS node_id, object_id AS neighbor_id, 'out' AS direction, edge_id, predicate, source FROM edges UNION ALL SELECT object_id, subject_id, 'in', edge_id, predicate, source FROM edges)"


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    nodes, links = None, None
    for kind, t, own, name, parent, prefix in (("region", "region", "r_regionkey", "r_name", None, ""), ("nation", "nation", "n_nationkey", "n_name", "n_regionkey", "R"), ("supplier", "supplier", "s_suppkey", "s_name", "s_nationkey", "N"), ("customer", "customer", "c_custkey", "c_name", "c_nationkey", "N")):
        rows = table(spark, sf_dir, t)
        formula = F.concat(F.lit(prefix), F.col(parent).cast("string")) if parent else none
        one = rows.select(key(kind, own).alias("node_id"), F.col(name).alias("name"), F.lit(kind).alias("source"), formula.alias("formula"), (F.concat(F.lit("K"), F.col(own).cast("string")) if kind == "supplier" else none).alias("inchikey"))
        nodes = one if nodes is None else nodes.unionByName(one)
        if parent:
            above, predicate, e = ("region", "in_region", "e1") if kind == "nation" else ("nation", "in_nation", "e2" if kind == "supplier" else "e3")
            two = rows.select(key(e, own).alias("edge_id"), key(kind, own).alias("subject_id"), F.lit(predicate).alias("predicate"), key(above, parent).alias("object_id"), F.lit(kind).alias("source"))
            links = two if links is None else links.unionByName(two)
    return nodes, links


@register("kg_neighbors", f"WITH {_EDGES}, {_NEIGHBOURS} SELECT node_id, predicate, direction, count(*) AS n FROM nb GROUP BY ALL")
def kg_neighbors(spark, sf_dir):
    return knowledge.neighbours_of(_graph(spark, sf_dir)[1]).groupBy("node_id", "predicate", "direction").agg(F.count("*").alias("n"))


@register(
    "kg_one_hop",
    f"""WITH {_NODES}, {_EDGES}, {_NEIGHBOURS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY node_id ORDER BY edge_id, direction) AS INTEGER) AS nth FROM nb WHERE predicate = 'in_nation' AND node_id LIKE 'nation:1%')
    SELECT neighbor_id, r.node_id, direction, edge_id, predicate, r.source, nth, name AS neighbor_name FROM r LEFT JOIN nodes ON nodes.node_id = neighbor_id WHERE nth <= 6""",
)
def kg_one_hop(spark, sf_dir):
    nodes, links = _graph(spark, sf_dir)
    wanted = nodes.where("node_id LIKE 'nation:1%'")
    return knowledge.attached(knowledge.neighbours_of(links), nodes, wanted, 6, ["in_nation"])


_LOOKUP = f"""WITH {_NODES}, f AS (SELECT node_id, name, source, 0 AS priority, 'inchikey' AS match_reason FROM nodes WHERE inchikey = 'K7' UNION ALL SELECT node_id, name, source, 1, 'formula' FROM nodes WHERE formula = 'N3'
  UNION ALL SELECT node_id, name, source, 2, 'alias:name' FROM nodes WHERE lower(name) = 'france' UNION ALL SELECT node_id, name, source, 3, 'name_like' FROM nodes WHERE contains(lower(name), 'france')),
  g AS (SELECT node_id, min(priority) AS priority, any_value(name) AS name, any_value(source) AS source, arg_min(match_reason, priority) AS match_reason FROM f GROUP BY node_id)"""


def _looked_up(spark, sf_dir, k):
    nodes, _ = _graph(spark, sf_dir)
    aliases = nodes.select(F.col("name").alias("alias"), F.lit("name").alias("alias_type"), "node_id")
    return knowledge.lookup(nodes, aliases, k, query="France", formula="N3", inchikey="K7")


@register("kg_entity_lookup", f"{_LOOKUP} SELECT node_id, name, source, CAST(priority AS INTEGER) AS priority, match_reason FROM g ORDER BY priority, node_id LIMIT 10")
def kg_entity_lookup(spark, sf_dir):
    return _looked_up(spark, sf_dir, 10).select("node_id", "name", "source", "priority", "match_reason")


@register("kg_manifest_counts", f"WITH {_NODES}, {_EDGES} SELECT source, 'nodes' AS kind, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT source, 'edges', count(*) FROM edges GROUP BY 1")
def kg_manifest_counts(spark, sf_dir):
    from peakloom.sources.adapters import Parts, counted

    nodes, links = _graph(spark, sf_dir)
    return counted(Parts(nodes, links))


@register("kg_first_wins_merge", "SELECT md5(text) AS doc_key, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS copies FROM documents GROUP BY 1")
def kg_first_wins_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("doc_key"), "doc_id", "source")
    return rows.groupBy("doc_key").agg(F.min(F.struct("doc_id", "source")).alias("m"), F.count("*").alias("copies")).select("doc_key", "m.doc_id", "m.source", "copies")


@register(
    "kg_edge_ids",
    f"WITH {_EDGES} SELECT edge_id, 'sha1:' || substr(sha1(subject_id || '|' || predicate || '|' || object_id || '|' || source), 1, 24) AS content_id FROM edges",
)
def kg_edge_ids(spark, sf_dir):
    links = _graph(spark, sf_dir)[1]
    return links.select("edge_id", F.concat(F.lit("sha1:"), T.sha1_text(F.concat_ws("|", "subject_id", "predicate", "object_id", "source"), 24)).alias("content_id"))


@register(
    "kg_graph_rag",
    f"""{_LOOKUP}, {_EDGES}, {_NEIGHBOURS}, l AS (SELECT * FROM g ORDER BY priority, node_id LIMIT 5),
    d AS (SELECT doc_id FROM documents WHERE contains(lower(text), 'mit license') ORDER BY doc_id LIMIT 5),
    n AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY edge_id, direction) AS nth FROM nb WHERE node_id IN (SELECT node_id FROM l))
    SELECT 1 AS section, node_id AS item_id, 'KG contains ' || name || ' from ' || source AS claim, '' AS evidence, CASE WHEN match_reason IN ('inchikey', 'formula') THEN 'high' ELSE 'medium' END AS confidence FROM l
    UNION ALL SELECT 2, CAST(doc_id AS VARCHAR), source, substr(text, 1, 700), 'medium' FROM documents WHERE doc_id IN (SELECT doc_id FROM d)
    UNION ALL SELECT 3, edge_id, direction || ' relation ' || predicate, n.node_id || ' --' || predicate || '--> ' || coalesce(nodes.name, neighbor_id), 'medium' FROM n LEFT JOIN nodes ON nodes.node_id = neighbor_id WHERE nth <= 2""",
)
def kg_graph_rag(spark, sf_dir):
    nodes, links = _graph(spark, sf_dir)
    found = _looked_up(spark, sf_dir, 5)
    docs = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("mit license"))).orderBy("doc_id").limit(5)
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"), "text")
    return knowledge.evidence(found, docs, knowledge.attached(knowledge.neighbours_of(links), nodes, found, 2))


# -- streams and sessions over finished tables ------------------------------------------------------------------


@register("trace_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def trace_windows(spark, sf_dir):
    from peakloom.streaming import traces

    rows = traces.windows(table(spark, sf_dir, "events"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register(
    "trace_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
)
def trace_sessions(spark, sf_dir):
    from peakloom.streaming import traces

    return traces.sessions(table(spark, sf_dir, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@register("trace_pairs", "SELECT a.user_id AS user, a.event_id AS start_id, b.event_id AS end_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR")
def trace_pairs(spark, sf_dir):
    from peakloom.streaming import traces

    return traces.pairs(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "view", "purchase", "2 hours").select("user", "start_id", "end_id")


_STATE = "CASE WHEN role = 'user' THEN text END AS asked, CASE WHEN role = 'assistant' THEN text END AS said"


def _turns(spark, sf_dir):
    part = lambda role: F.when(F.col("role") == role, F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", part("user").alias("asked"), part("assistant").alias("said"))


@register("session_state", f"SELECT conv_id, turn, last_value(asked IGNORE NULLS) OVER w AS asked, last_value(said IGNORE NULLS) OVER w AS said FROM (SELECT conv_id, turn, {_STATE} FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def session_state(spark, sf_dir):
    from peakloom.streaming import traces

    return traces.running(_turns(spark, sf_dir), "conv_id", ["turn"], ["asked", "said"])


@register("session_latest", f"SELECT conv_id, count(*) AS turns, arg_max(asked, turn) AS asked, arg_max(said, turn) AS said FROM (SELECT conv_id, turn, {_STATE} FROM conversations) GROUP BY 1")
def session_latest(spark, sf_dir):
    from peakloom.streaming import traces

    return traces.latest(_turns(spark, sf_dir), "conv_id", ["turn"], ["asked", "said"])


@register("session_recent", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def session_recent(spark, sf_dir):
    from peakloom.streaming import traces

    return traces.recent(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], 3).select("conv_id", "turn", "role")


# -- training data ----------------------------------------------------------------------------------------------


@register("split_parts", "SELECT doc_id, CASE WHEN nth < 80 THEN 'train' WHEN nth < 90 THEN 'val' ELSE 'test' END AS part FROM (SELECT doc_id, CAST('0x' || substr(md5('s:' || doc_id), 1, 8) AS BIGINT) % 100 AS nth FROM documents)")
def split_parts(spark, sf_dir):
    return prep.split(table(spark, sf_dir, "documents"), "doc_id", "s", {"train": 80, "val": 10, "test": 10}).select("doc_id", "part")


@register("split_first_n", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('v:' || doc_id), doc_id) <= 50 THEN 'val' ELSE 'train' END AS part FROM documents")
def split_first_n(spark, sf_dir):
    return prep.first_validation(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "v", 50)


@register("class_map", "SELECT source, count(*) AS n, CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS idx FROM documents WHERE source NOT IN ('src3') GROUP BY source")
def class_map(spark, sf_dir):
    return prep.class_map(table(spark, sf_dir, "documents"), "source", ["src3"])


@register(
    "vocab_build",
    """WITH t AS (SELECT item_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark)),
    f AS (SELECT token, min([item_id, pos]) AS first FROM t GROUP BY token)
    SELECT token, CAST(row_number() OVER (ORDER BY first) + 1 AS INTEGER) AS id FROM f UNION ALL SELECT '<pad>', 0 UNION ALL SELECT '<unk>', 1""",
)
def vocab_build(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("w"))
    return prep.vocabulary(rows, "item_id", "w", ["<pad>", "<unk>"])


@register(
    "pad_mask",
    f"WITH {_SPECTRA} SELECT id, array_to_string(list_concat(c[1:4], list_transform(range(greatest(4 - len(c), 0)), lambda i: 0.0)), ',') AS padded, array_to_string(list_transform(range(1, 5), lambda i: i > len(c)), ',') AS mask FROM spectra",
)
def pad_mask(spark, sf_dir):
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return _spectra(spark, sf_dir).select("id", text(prep.padded(F.col("c"), 4, F.lit(0.0))).alias("padded"), text(prep.mask_of(F.col("c"), 4)).alias("mask"))


@register(
    "masked_pool",
    """SELECT vec_id, CAST(d AS INTEGER) AS at, round(list_sum(list_transform(range(0, vec_id % 8 + 1), lambda i: embedding[i * 8 + d + 1]::DOUBLE)) / (vec_id % 8 + 1), 6) AS mean
    FROM (SELECT *, unnest(range(8)) AS d FROM embeddings)""",
)
def masked_pool(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    steps = F.sequence(F.lit(0), F.lit(7))
    vectors, padding = F.transform(steps, lambda i: F.slice("v", i * 8 + 1, 8)), F.transform(steps, lambda i: i > F.col("vec_id") % 8)
    return rows.select("vec_id", F.posexplode(prep.pooled(vectors, padding)).alias("at", "mean")).withColumn("mean", F.round("mean", 6))


_VOCAB = """t AS (SELECT item_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark)),
    f AS (SELECT token, min([item_id, pos]) AS first FROM t GROUP BY token), v AS (SELECT token, row_number() OVER (ORDER BY first) + 3 AS id FROM f)"""


def _encoded(spark, sf_dir, name: str, key: str) -> tuple[DataFrame, DataFrame]:
    words = lambda t, k: table(spark, sf_dir, t).select(k, T.tokens(F.col("text")).alias("w"))
    vocab = prep.vocabulary(words("benchmark", "item_id"), "item_id", "w", ["<pad>", "<unk>", "<bos>", "<eos>"])
    return prep.encoded(words(name, key), key, "w", vocab), vocab


@register(
    "token_encode",
    f"""WITH {_VOCAB}, d AS (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)),
    e AS (SELECT doc_id, string_agg(coalesce(id, 1), ',' ORDER BY pos) || ',' AS ids, count(*) AS n, count(*) FILTER (WHERE id IS NULL) AS unknown FROM d LEFT JOIN v USING (token) GROUP BY 1)
    SELECT doc_id, CAST(coalesce(n, 0) + 2 AS INTEGER) AS n_ids, CAST(coalesce(unknown, 0) AS INTEGER) AS n_unknown, md5('2,' || coalesce(ids, '') || '3') AS ids_md5 FROM documents LEFT JOIN e USING (doc_id)""",
)
def token_encode(spark, sf_dir):
    rows, _ = _encoded(spark, sf_dir, "documents", "doc_id")
    text = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return rows.select("doc_id", F.size("ids").alias("n_ids"), F.size(F.filter("ids", lambda x: x == 1)).alias("n_unknown"), F.md5(text.cast("binary")).alias("ids_md5"))


@register("token_decode", "SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), '') AS text FROM benchmark")
def token_decode(spark, sf_dir):
    rows, vocab = _encoded(spark, sf_dir, "benchmark", "item_id")
    return prep.decoded(rows, "item_id", "ids", vocab)


@register(
    "neg_sample",
    """WITH d AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('n:' || vec_id), vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
    a AS (SELECT vec_id AS anchor, label, unnest(range(1, CAST(least(4, n - 1) AS INTEGER) + 1)) AS nth, pos, n FROM d)
    SELECT anchor, d.vec_id AS negative, CAST(nth AS INTEGER) AS nth FROM a JOIN d ON d.label = a.label AND d.pos = (a.pos + nth) % a.n""",
)
def neg_sample(spark, sf_dir):
    return prep.negatives(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", "label", "n", 4)


@register(
    "identity_mask",
    """SELECT l_orderkey, l_linenumber, CASE WHEN m THEN -CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag, m ORDER BY l_quantity, l_linenumber) AS DOUBLE) ELSE l_quantity END AS shown
    FROM (SELECT *, l_partkey % 3 = 0 AS m FROM lineitem)""",
)
def identity_mask(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("m", F.col("l_partkey") % 3 == 0)
    return prep.masked_ranks(rows, "l_orderkey", "l_returnflag", "l_linenumber", "l_quantity", "m").select("l_orderkey", "l_linenumber", "shown")


@register("resume_order", "SELECT doc_id, nth FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('r:' || doc_id), doc_id) - 1 AS nth FROM documents) WHERE nth >= 100 AND nth % 4 = 1")
def resume_order(spark, sf_dir):
    return prep.resumed(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "r", 100, 4, 1)


@register("seeded_jitter")
def seeded_jitter(spark, sf_dir):
    return _spectra(spark, sf_dir).select("id", prep.jittered(F.col("h"), F.col("id"), "j", 0.2, 0.01).alias("h"))


@register("labelled_eval", "SELECT source, count(*) AS n, count(toxic) AS labelled, CAST(sum(toxic) AS BIGINT) AS toxic, round(avg(quality), 6) AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def labelled_eval(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count("toxic").alias("labelled"), F.sum("toxic").alias("toxic"), F.round(F.avg("quality"), 6).alias("quality"))
