"""Queries that relate rows to rows: bands of peaks, fingerprints, neighbour graphs; importing it registers them beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom.operators import bands, fingerprints, neighbour_graph, rank_join, refine
from peakloom.plans.catalog import _SPECTRA, _library, _spectra
from peakloom.plans.registry import ORACLES, QUERIES, register, table
from peakloom.session import written_folder
from peakloom.sources import json_arrays

__all__ = ["ORACLES", "QUERIES"]

# -- bands of peaks ---------------------------------------------------------------------------------------------

_SHIFT = "p_retailprice / 40"


@register(
    "peak_band_join",
    f"""WITH l AS (SELECT l_orderkey * 8 + l_linenumber AS line, CAST(l_quantity AS DOUBLE) AS spot, row_number() OVER (PARTITION BY l_quantity ORDER BY l_orderkey * 8 + l_linenumber) AS nth FROM lineitem),
    p AS (SELECT p_partkey, CAST({_SHIFT} AS DOUBLE) AS shift FROM part),
    r AS (SELECT *, round(shift) AS spot, row_number() OVER (PARTITION BY round(shift) ORDER BY abs(shift - round(shift)), shift, p_partkey) AS nth FROM p WHERE abs(shift - round(shift)) <= 0.05::DOUBLE)
    SELECT line, p_partkey, round(abs(shift - spot), 6) AS distance FROM l JOIN r USING (spot, nth)""",
)
def peak_band_join(spark, sf_dir):
    """Quantities and scaled prices as peaks: each price within 0.05 of a quantity takes one of its lines, nearest first."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), F.col("l_quantity").alias("at"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.expr(_SHIFT).alias("shift"))
    return bands.paired(lines, parts, "line", "p_partkey", "at", "shift", 0.05).select("line", "p_partkey", F.round("distance", 6).alias("distance"))


@register(
    "peak_pairing",
    f"""WITH RECURSIVE {_SPECTRA}, p AS (SELECT id, list_sort(list_filter(flatten(list_transform(range(len(h)), lambda i: list_transform(range(len(c)), lambda j: [abs(h[i + 1] - c[j + 1]), h[i + 1], c[j + 1], i::DOUBLE, j::DOUBLE]))), lambda x: x[1] <= 2)) AS rest FROM spectra),
    g(id, taken, rest) AS (SELECT id, NULL::DOUBLE[], rest FROM p UNION ALL SELECT id, best, list_filter(rest, lambda x: x[4] <> best[4] AND x[5] <> best[5]) FROM (SELECT id, rest[1] AS best, rest FROM g WHERE len(rest) > 0))
    SELECT id, CAST(taken[4] AS INTEGER) AS h, CAST(taken[5] AS INTEGER) AS c, taken[1] AS distance FROM g WHERE taken IS NOT NULL""",
)
def peak_pairing(spark, sf_dir):
    """Both nuclei's peaks of every molecule, paired one to one within 2.0."""
    return bands.paired_lists(_spectra(spark, sf_dir), "h", "c", 2.0)


@register(
    "frag_swap_search",
    f"""WITH {_SPECTRA}, b AS (SELECT DISTINCT id AS query_id, unnest(list_concat(h, c)) AS peak FROM spectra WHERE id % 100 = 0),
    e AS (SELECT query_id, p_partkey AS fragment_id, peak, min(abs(peak - s.x)) AS d FROM b JOIN (SELECT p_partkey, unnest([p_size + 0.25, {_SHIFT}]) AS x FROM part) s ON abs(peak - s.x) <= 0.25 GROUP BY ALL),
    f AS (SELECT query_id, fragment_id, count(*) AS covered, round(sum(d), 6) AS distance FROM e GROUP BY 1, 2)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY covered DESC, distance, fragment_id) AS INTEGER) AS rank FROM f) WHERE rank <= 10""",
)
def frag_swap_search(spark, sf_dir):
    """The ten fragments that come near most peaks of a molecule; a part is a fragment with two shifts."""
    asked = _spectra(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("query_id"), F.explode(F.concat("h", "c")).alias("peak"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fragment_id"), F.explode(F.array(F.col("p_size") + F.lit(0.25), F.expr(_SHIFT))).alias("shift"))
    return bands.covers(asked, parts, 0.25, 10)


def _regions_and_parts(spark, sf_dir):
    """Regions as queries, whose nations' numbers are their peaks; parts as fragments of one or two peaks."""
    asked = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("query_id")).agg(F.collect_list(F.col("n_nationkey").cast("double")).alias("peaks"))
    peaks = F.when(F.col("p_partkey") % 3 == 0, F.array(F.col("p_size").cast("double"))).otherwise(F.array(F.col("p_size").cast("double"), F.expr(_SHIFT).cast("double")))
    return asked, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fragment_id"), peaks.alias("peaks"))


@register("frag_pair_rank")
def frag_pair_rank(spark, sf_dir):
    """The ten best pairs of parts for each region; the tests hold the ranks against all pairs."""
    return rank_join.top_pairs(*_regions_and_parts(spark, sf_dir), 10, 1.0)[0]


@register("frag_refine")
def frag_refine(spark, sf_dir):
    """The same pairs, refined by swaps with any part; the tests hold the rounds against plain ones."""
    asked, parts = _regions_and_parts(spark, sf_dir)
    first = rank_join.top_pairs(asked, parts, 3, 1.0)[0].select("query_id", F.array("left_id", "right_id").alias("members"))
    widened = first.select("query_id", F.concat("members", F.array(F.element_at("members", 1))).alias("members"))  # room for a third fragment
    return refine.refined(asked, parts.withColumnRenamed("fragment_id", "id"), widened, keep=5, sigma=1.0, tolerance=0.5, offers=4, rounds=4)[0]


# -- circular fingerprints --------------------------------------------------------------------------------------


def _graph(spark, sf_dir):
    """A molecule for each customer: the customer, its nation and region, and its orders."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    placed = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    mol = F.col("c_custkey").alias("mol")
    upper = placed.select(mol, F.explode(F.array(*[F.struct(F.lit(a).alias("atom"), F.col(c).alias("label")) for a, c in (("c", "c_mktsegment"), ("n", "n_name"), ("r", "r_name"))])).alias("x")).select("mol", "x.*")
    own = orders.select(F.col("o_custkey").alias("mol"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("atom"), F.col("o_orderpriority").alias("label"), "o_orderstatus")
    above = placed.select(mol, F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(k).alias("kind")) for a, b, k in (("r", "n", "in"), ("n", "c", "of"))])).alias("x")).select("mol", "x.*")
    return upper.unionByName(own.drop("o_orderstatus")), above.unionByName(own.select("mol", F.lit("c").alias("a"), F.col("atom").alias("b"), F.col("o_orderstatus").alias("kind")))


def _digest_sql(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"


def _identifiers_sql() -> str:
    rounds = [f"i0 AS (SELECT mol, atom, {_digest_sql('0', 'label')} AS i FROM atoms)"]
    for n in (1, 2):
        rounds.append(f"s{n} AS (SELECT ways.mol, ways.atom, count(*) AS n, CAST(sum({_digest_sql('kind', 'i')}) AS BIGINT) AS total FROM ways JOIN i{n - 1} ON i{n - 1}.mol = ways.mol AND i{n - 1}.atom = other GROUP BY 1, 2)")
        rounds.append(f"i{n} AS (SELECT mol, atom, {_digest_sql(str(n), 'i', 'coalesce(n, 0)', 'coalesce(total, 0)')} AS i FROM i{n - 1} LEFT JOIN s{n} USING (mol, atom))")
    return f"""placed AS (SELECT c_custkey AS mol, c_mktsegment, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    atoms AS (SELECT mol, unnest(['c', 'n', 'r']) AS atom, unnest([c_mktsegment, n_name, r_name]) AS label FROM placed UNION ALL SELECT o_custkey, 'o' || o_orderkey, o_orderpriority FROM orders),
    bonds AS (SELECT mol, unnest(['r', 'n']) AS a, unnest(['n', 'c']) AS b, unnest(['in', 'of']) AS kind FROM placed UNION ALL SELECT o_custkey, 'c', 'o' || o_orderkey, o_orderstatus FROM orders),
    ways AS (SELECT mol, a AS atom, b AS other, kind FROM bonds UNION ALL SELECT mol, b, a, kind FROM bonds),
    {", ".join(rounds)},
    prints AS (SELECT mol, list_sort(list(DISTINCT CAST(i % 2048 AS INTEGER))) AS bits FROM (SELECT * FROM i0 UNION ALL SELECT * FROM i1 UNION ALL SELECT * FROM i2) GROUP BY mol)"""


_PRINTS = _identifiers_sql()


@register("fingerprint_bits", f"WITH {_PRINTS} SELECT mol, array_to_string(bits, ',') AS bits FROM prints")
def fingerprint_bits(spark, sf_dir):
    rows = fingerprints.fingerprints(*_graph(spark, sf_dir))
    return rows.select("mol", F.array_join(F.transform("bits", lambda b: b.cast("string")), ",").alias("bits"))


@register(
    "fingerprint_links",
    f"""WITH {_PRINTS}, k AS (SELECT bits, min(mol) AS class FROM prints GROUP BY bits), e AS (SELECT class, len(bits) AS n, unnest(bits) AS bit FROM k),
    c AS (SELECT x.class AS a, y.class AS b, any_value(x.n) AS an, any_value(y.n) AS bn, count(*) AS common FROM e x JOIN e y ON x.bit = y.bit AND x.class < y.class GROUP BY 1, 2),
    l AS (SELECT unnest([a, b]) AS class FROM c WHERE 10 * common >= 6 * (an + bn - common))
    SELECT mol, class, coalesce(n, 0) AS links FROM (SELECT mol, class FROM prints JOIN k USING (bits)) LEFT JOIN (SELECT class, count(*) AS n FROM l GROUP BY class) USING (class)""",
)
def fingerprint_links(spark, sf_dir):
    """Each molecule's class of equal fingerprints, and how many other classes are at a Tanimoto of 0.6 or more."""
    named, members = fingerprints.classes(fingerprints.fingerprints(*_graph(spark, sf_dir)))
    found = fingerprints.links(named, 0.6)
    each = found.select(F.explode(F.array("left_class", "right_class")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    return members.join(each, "class", "left").select("mol", "class", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


@register(
    "fingerprint_topk",
    f"""WITH {_PRINTS}, e AS (SELECT mol, len(bits) AS n, unnest(bits) AS bit FROM prints),
    c AS (SELECT x.mol AS query_id, y.mol, x.n AS xn, y.n AS yn, count(*) AS common FROM e x JOIN e y ON x.bit = y.bit AND x.mol <> y.mol AND x.mol % 100 = 0 GROUP BY ALL),
    v AS (SELECT query_id, mol, round(common::DOUBLE / (xn + yn - common), 6) AS tanimoto, row_number() OVER (PARTITION BY query_id ORDER BY common::DOUBLE / (xn + yn - common) DESC, mol) AS rank FROM c)
    SELECT query_id, mol, tanimoto, CAST(rank AS INTEGER) AS rank FROM v WHERE rank <= 5""",
)
def fingerprint_topk(spark, sf_dir):
    prints = fingerprints.fingerprints(*_graph(spark, sf_dir))
    found = fingerprints.topk(prints.where("mol % 100 = 0"), prints, 5)
    return found.where("tanimoto > 0").select("query_id", "mol", F.round("tanimoto", 6).alias("tanimoto"), "rank")


# -- graph index ------------------------------------------------------------------------------------------------


@register("vec_graph_probe")
def vec_graph_probe(spark, sf_dir):
    """The five nearest of every hundredth vector, by a beam over the graph of nearest neighbours; the tests hold its recall."""
    library = _library(spark, sf_dir)
    asked = library.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    return neighbour_graph.search(asked, neighbour_graph.build(library), 5, ef=12)[0]


# -- sources ----------------------------------------------------------------------------------------------------


@register("json_array_source", "SELECT o_orderkey, o_custkey, o_orderpriority, o_comment_ AS note FROM (SELECT *, '{\"' || o_orderstatus || '\"}, [' || o_orderpriority AS o_comment_ FROM orders)")
def json_array_source(spark, sf_dir):
    """All orders, written as arrays of objects with braces and quotes in their texts, and read again by splits."""
    note = F.concat(F.lit('{"'), "o_orderstatus", F.lit('"}, ['), "o_orderpriority").alias("note")
    path = written_folder(spark, "arrays")
    json_arrays.write(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", note), path)
    return json_arrays.objects(spark, path, "o_orderkey long, o_custkey long, o_orderpriority string, note string")
