"""The queries of this subpackage and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm import bitslices, collocations, decontaminate, lattice, lexical, licenses, minhash, mixing, repeats, secret_scan, token_counts, toxicity, warc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_WORDS, _SPACED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"


def _query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents")).drop("strings")


@_query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


@_query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.records(warc.archive(table(spark, sf_dir, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op3_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1),
j AS (SELECT p.*, CASE WHEN payload_bytes >= 1000 AND (page_id IS NULL OR page_id <> first) THEN first END AS refers_to FROM p LEFT JOIN m USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM j
"""


@_query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def _draw(what: str) -> str:
    return f"(CAST('0x' || substr(md5('{mixing.SEED}:{what}:' || drawn_by), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0)"


ORACLES["op9_mixing"] = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_SPACED}')) AS BIGINT) AS size,
  coalesce(CAST(doc_id AS VARCHAR), 'row ' || md5(coalesce('=' || source, '') || chr(10) || coalesce('=' || text, '')) || ':' || row_number() OVER (PARTITION BY doc_id, source, text)) AS drawn_by FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, 1 + (place - 1) % 3 AS weight, 3 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, place) AS nth FROM w),
l AS (SELECT *, (CAST((SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))::DOUBLE
  / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS level FROM o),
f AS (SELECT nth AS cut, level AS lambda_ FROM l WHERE level * weight <= cap ORDER BY nth LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN nth < cut THEN cap::DOUBLE ELSE least(lambda_ * weight, cap::DOUBLE) END AS target FROM l, f),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CAST(floor(rate) AS BIGINT) AS repeats FROM r),
q AS (SELECT *, CAST(floor((rate - repeats) * size + {_draw("part")}) AS BIGINT) AS part_words FROM p)
SELECT doc_id, size, source_size, target, repeats * size + part_words AS taken, repeats, part_words,
  CASE WHEN part_words > 0 THEN CAST(floor({_draw("start")} * (size - part_words + 1)) AS BIGINT) END AS part_start FROM q
"""


@_query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest")


def _plain(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}')"


ORACLES["op4_decontamination"] = f"""
WITH b AS (SELECT item_id, {_plain("text")} AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), 13) AS m FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, p + 1, p + m), ' ') AS g FROM (SELECT *, unnest(range(len(w) - m + 1)) AS p FROM i)),
d AS (SELECT doc_id, {_plain("text")} AS w FROM documents),
x AS (SELECT doc_id, p, m, array_to_string(list_slice(w, p + 1, p + m), ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(len(w) - m + 1)) AS p FROM d, (SELECT DISTINCT m FROM g) WHERE len(w) >= m)),
o AS (SELECT doc_id, p, m, item_id FROM x JOIN g USING (g, m)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + m)) AS q FROM o) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM o) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@_query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.scan(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@_query
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4)


ORACLES["op7_minhash"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p + 1, p + m), ' ') AS s
  FROM (SELECT *, least(len(w), 4) AS m, unnest(range(len(w) - least(len(w), 4) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


@_query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


ORACLES["op10_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
x AS (SELECT doc_id, p, array_to_string(list_slice(w, p + 1, p + 50), ' ') AS g FROM (SELECT *, unnest(range(len(w) - 49)) AS p FROM d WHERE len(w) >= 50)),
m AS (SELECT g, min(doc_id) AS low FROM x GROUP BY g HAVING min(doc_id) < max(doc_id)),
h AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM x JOIN m USING (g) WHERE doc_id > low),
k AS (SELECT doc_id, p, w[p + 1] AS word FROM (SELECT *, unnest(range(len(w))) AS p FROM d)),
j AS (SELECT k.doc_id, k.p, word, h.p IS NOT NULL AS gone FROM k LEFT JOIN h ON k.doc_id = h.doc_id AND k.p = h.p),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM j GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""


@_query
def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.scan(table(spark, sf_dir, "documents"), fitted=True)


@_query
def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return bitslices.search(vectors.where("vec_id % 50 = 0"), vectors, 5, "vec_id", "embedding")


ORACLES["op5_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: CAST(floor(256 * x) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def _license_sql() -> str:
    """The scan without its filters: every block against every template."""
    known = []
    for label, notice in licenses.TEMPLATES:
        tokens = sorted(set(notice.split()))
        known.append(f"('{label}', {tokens!r}, {math.ceil(licenses.THRESHOLD * len(tokens) - 1e-9)})")
    named = [(label, " AND ".join(f"w[p + {i + 1}] = '{word}'" for i, word in enumerate(phrase))) for label, phrase in licenses.PHRASES]
    step = licenses.WIDTH // 2
    return f"""
WITH d AS (SELECT doc_id, {_plain("text")} AS w FROM documents), t(label, tokens, need) AS (VALUES {", ".join(known)}),
b AS (SELECT doc_id, list_distinct(w[i * {step} + 1:i * {step} + {licenses.WIDTH}]) AS b FROM (SELECT doc_id, w, unnest(range(greatest(CAST(ceil((len(w) - {step}) / {step}) AS BIGINT), 1))) AS i FROM d)),
m AS (SELECT doc_id, label, len(list_intersect(tokens, b)) / len(tokens) AS score FROM b, t WHERE len(b) >= need AND len(list_intersect(tokens, b)) >= need),
p AS (SELECT doc_id, p, CASE {" ".join(f"WHEN {test} THEN '{label}'" for label, test in named)} END AS label FROM (SELECT doc_id, w, unnest(range(len(w))) AS p FROM d WHERE list_contains(w, 'license'))),
n AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM p WHERE label IS NOT NULL GROUP BY doc_id),
l AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM (SELECT doc_id, label FROM m UNION ALL SELECT doc_id, label FROM p WHERE label IS NOT NULL) GROUP BY doc_id),
s AS (SELECT doc_id, max(score) AS score FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0) END AS score FROM d LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)
"""


ORACLES["op2_license_scan"] = _license_sql()


@_query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_lexical_search"] = f"""
WITH d AS (SELECT doc_id, {_plain("text")} AS w FROM documents), b AS (SELECT item_id, {_plain("text")} AS w FROM benchmark),
s AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
t AS (SELECT doc_id, 25 + (75 * len(w) * docs) // terms AS m, w FROM d, s WHERE len(w) > 0),
p AS (SELECT doc_id, m, term, count(*) AS tf FROM (SELECT doc_id, m, unnest(w) AS term FROM t) GROUP BY 1, 2, 3),
f AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(w) AS term FROM b) GROUP BY 1, 2),
r AS (SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN p USING (term) GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10
"""


@_query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op12_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, m, g, count(*) AS f FROM (SELECT lang, m, array_to_string(list_slice(w, p + 1, p + m), ' ') AS g
  FROM (SELECT lang, w, m, unnest(range(len(w) - m + 1)) AS p FROM w, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m)) GROUP BY 1, 2, 3),
c AS (SELECT lang, m, g, f AS a, string_split(g, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
k AS (SELECT *, array_to_string(list_slice(w, 1, k), ' ') AS x, array_to_string(list_slice(w, k + 1, m), ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT k.lang, k.m, k.g, a, k, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.m = k.k AND x.g = k.x JOIN f y ON y.lang = k.lang AND y.m = k.m - k.k AND y.g = k.y),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, m, g ORDER BY score, k) AS nth FROM s) WHERE nth = 1),
o AS (SELECT lang, g, max(a) AS longer FROM (SELECT lang, a, array_to_string(list_slice(w, i + 1, i + 2), ' ') AS g FROM (SELECT *, unnest([0, 1]) AS i FROM c WHERE m = 3)) GROUP BY 1, 2),
d AS (SELECT b.* FROM b LEFT JOIN o ON b.m = 2 AND o.lang = b.lang AND o.g = b.g WHERE o.longer IS NULL OR 100 * o.longer < 50 * a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM d)
SELECT lang, CAST(rank AS INTEGER) AS rank, g AS phrase, a, l, r, n, score FROM q JOIN t USING (lang) WHERE rank <= 2000
"""


@_query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"))
