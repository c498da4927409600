from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from peakloom.functions import text as T
from peakloom.operators import text_search
from peakloom.sources import adapters, readers, sinks


def put(path, text):
    path.write_text(text)
    return str(path)


def test_json_readers(spark, tmp_path):
    lines = put(tmp_path / "a.jsonl", '{"a": 1}\n\n{"a": 2}\n{bad\n')
    good, bad = readers.tolerant_json_lines(spark, lines, "a int")
    assert [r.a for r in good.collect()] == [1, 2] and [r.raw for r in bad.collect()] == ["{bad"]
    assert readers.json_lines(spark, put(tmp_path / "b.jsonl", '{"a": 1}\n{"a": 2}\n'), "a int", 1).count() == 1
    assert [r.a for r in readers.json_array(spark, put(tmp_path / "c.json", '[{"a": 1},\n{"a": 3}]'), "a int").collect()] == [1, 3]
    saved = put(tmp_path / "d.json", json.dumps({"query": {}, "candidates": [{"smiles": "C", "score": 1.0}, {"smiles": "CC", "score": 0.5}]}))
    assert [(r["at"], r.smiles) for r in readers.pool_candidates(spark, saved).collect()] == [(0, "C"), (1, "CC")]
    memory = put(tmp_path / "e.json", json.dumps({"confirmed_cases": [{"key": "k", "value": {"formula": "C"}}, {"formula": "N"}]}))
    found = readers.memory_records(spark, memory).collect()
    assert found[0].key == "k" and json.loads(found[0].record) == {"formula": "C"} and found[1].key.startswith("case:")


def test_text_readers(spark, tmp_path):
    rows = readers.table_text(spark, put(tmp_path / "a.csv", 'x,y\n"1\n2","say ""so"""\n'))
    assert [tuple(r) for r in rows.collect()] == [("1\n2", 'say "so"')]
    three = readers.fields(spark, put(tmp_path / "b.tsv", "a\tb\tc\nshort\tline\n d \te\tf\n"), ["s", "p", "o"])
    assert [tuple(r) for r in three.collect()] == [("a", "b", "c"), ("d", "e", "f")]
    words = readers.glossary(spark, put(tmp_path / "g.tsv", "Relation-name\tInteraction-type\nr\tone\nr\ttwo\n"), "Relation-name")
    assert [tuple(r) for r in words.collect()] == [("r", "two")]
    drugs = readers.blocks(spark, put(tmp_path / "d.txt", "DRUG__ID\tD1\nDRUGNAME\tAlpha beta\nOTHER\tx\n\nDRUG__ID\tD2\nno tab\n"), ["DRUG__ID", "DRUGNAME"])
    assert [tuple(r) for r in drugs.collect()] == [("D1", "Alpha beta"), ("D2", None)]
    found = readers.grep(spark, put(tmp_path / "k.csv", "Aspirin,treats,x,pain\nother,a,b,c\n"), "ASPIRIN")
    assert [r.line for r in found.collect()] == ["- Aspirin --[treats]--> pain"]
    xyz = spark.range(1).select(readers.atoms(F.lit("3\n\nC 0 0 0.5\nH 1 0\nO 1.5 2 3 extra")).alias("a")).first().a
    assert [(x.element, x.z) for x in xyz] == [("C", 0.5), ("O", 3.0)]
    seeds = spark.range(1).select(*[readers.seed_candidates(F.lit(s)) for s in ('["CCO", "C"]', '{"smiles": "N"}', " CC ")]).first()
    assert list(seeds) == [["CCO", "C"], ["N"], ["CC"]]


@pytest.fixture(scope="module")
def products(spark):
    schema = "row long, identifier string, canonical_smiles string, standard_inchi string, standard_inchi_key string, name string, iupac_name string, synonyms string, molecular_formula string, molecular_weight string, chemical_class string, chemical_sub_class string, chemical_super_class string, organisms string, dois string, cas string"
    rows = [(1, "N1", "CCO", None, "KEY1", "Ethanol", "ethan-1-ol", "a|b", "C2H6O", "46.07", "alcohols", None, None, "yeast", "d1|d2", "64"), (2, "N2", "C", None, "", "", None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, schema)


def test_natural_products(products):
    p = adapters.natural_products(products, "np")
    nodes = {r.name: r for r in p.nodes.collect()}
    assert nodes["Ethanol"].node_id == "mol:inchikey:KEY1" and nodes["N2"].node_id == "np:N2"
    assert nodes["Ethanol"].properties["dois"] == "d1|d2" and "cas" not in nodes["N2"].properties
    texts = {r.title: r for r in p.documents.collect()}
    assert texts["Ethanol"].text == "Ethanol. formula C2H6O. molecular weight 46.07. chemical class alcohols. reported organism/source yeast. SMILES CCO."
    assert texts["Ethanol"].metadata == {"formula": "C2H6O", "smiles": "CCO", "inchikey": "KEY1", "source_id": "N1", "chemical_class": "alcohols"}
    assert sorted((r.alias, r.alias_type) for r in p.aliases.where("node_id = 'mol:inchikey:KEY1'").collect()) == sorted([("N1", "identifier"), ("Ethanol", "name"), ("ethan-1-ol", "name"), ("64", "name"), ("a", "synonym"), ("b", "synonym")])


def test_union_keeps_the_first(spark, products, tmp_path):
    other = adapters.structure_list(spark.createDataFrame([(1, "CCO", "L1"), (2, "C", "L1")], "row long, smiles string, id string"), "lists")
    p = adapters.deduplicated(adapters.union([adapters.natural_products(products, "np"), other, adapters.natural_products(products, "np")]))
    assert p.nodes.count() == 3 and p.nodes.where("node_id = 'lists:L1'").first().properties["smiles"] == "CCO"
    counts = {(r.source, r.kind): r.n for r in adapters.counted(p).collect()}
    assert counts["np", "nodes"] == 2 and counts["lists", "documents"] == 1
    sinks.graph(p, str(tmp_path / "kg"))
    assert spark.read.json(str(tmp_path / "kg/nodes")).count() == 3
    assert sinks.manifest(p).first().total == sum(counts.values())
    flat = {r.node_id: r for r in adapters.indexed_nodes(p.nodes).collect()}
    assert flat["mol:inchikey:KEY1"].formula == "C2H6O" and flat["mol:inchikey:KEY1"].labels == "molecule natural_product"


def test_records_with_edges(spark):
    schema = "row long, npaid string, inchikey string, original_name string, smiles string, inchi string, mol_formula string, mol_weight string, exact_mass string, synonyms array<string>, external_ids array<struct<external_db_name:string,external_db_code:string>>, classyfire struct<class:struct<name:string>,superclass:struct<name:string>,direct_parent:struct<name:string>,description:string>, npclassifier struct<pathway:string,superclass:string,class:string>, origin_organism struct<id:string,type:string,genus:string,species:string>"
    row = (1, "P1", "K", "Alpha", "C", None, "CH4", "16", "16.03", ["al"], [("db", "X1")], (("cl",), None, None, "a note."), ("path", None, None), ("1", "fungus", "Asp", "niger"))
    p = adapters.natural_product_records(spark.createDataFrame([row], schema), "npr")
    assert sorted((r.subject_id, r.predicate, r.object_id) for r in p.edges.collect()) == [("mol:inchikey:K", "has_class", "class:npr:cl"), ("mol:inchikey:K", "has_class", "class:npr:path"), ("mol:inchikey:K", "produced_by", "taxon:npr:Asp_niger")]
    assert p.nodes.count() == 4 and ("X1", "xref:db") in {(r.alias, r.alias_type) for r in p.aliases.collect()}
    assert p.documents.first().text.endswith("SMILES C. a note.")


def test_triples_ontology_and_entities(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Gene::1", "binds", "Drug::2")], "row long, subject string, predicate string, object string")
    relations = spark.createDataFrame([("binds", "binding")], "name string, `Interaction-type` string").withColumns({c: F.lit("x") for c in ("Data-source", "Connected entity-types", "Description")})
    p = adapters.triples(rows, relations, "tri")
    assert p.edges.first().relation_label == "binding" and {r.labels[1] for r in p.nodes.collect()} == {"Gene", "Drug"}
    edge = adapters.edges(spark.createDataFrame([(1,)], "row long"), "npatlas", "row", F.lit("a"), F.lit("has_class"), F.lit("b"), F.lit("")).first()
    assert edge.edge_id == "sha1:686c468e6ff8fb38bfd0bcda"
    graph = {"graphs": [{"nodes": [{"id": "http://x/CHEBI_5", "lbl": "water", "meta": {"basicPropertyValues": [{"pred": "http://p#mass", "val": "18"}, {"pred": "http://p/other", "val": "1"}], "synonyms": [{"val": "aqua"}]}}, {"id": "http://x/CHEBI_6", "lbl": "gone", "meta": {"deprecated": True}}, {"id": "http://x/CHEBI_7"}], "edges": [{"sub": "http://x/CHEBI_5", "pred": "is_a", "obj": "http://x/CHEBI_1"}]}]}
    nodes, links = readers.ontology(spark, put(tmp_path / "o.json", json.dumps(graph)))
    o = adapters.ontology(nodes.withColumn("row", F.lit(1)), links.withColumn("row", F.lit(1)), "chebi")
    assert [(r.node_id, r.properties) for r in o.nodes.collect()] == [("chebi:CHEBI_5", {"mass": "18"})]
    assert o.edges.first().object_id == "chebi:CHEBI_1" and {r.alias for r in o.aliases.collect()} == {"water", "aqua"}
    e = adapters.described_entities(spark.createDataFrame([(1, " iron ", ["a", "b", "c", "d"]), (2, "", [])], "row long, entity string, corpus array<string>"), "cards", each=2)
    assert e.nodes.count() == 1 and [r.text for r in e.documents.orderBy("metadata.corpus_index").collect()] == ["a", "b"]


def test_bm25_values(spark):
    docs = spark.createDataFrame([("a", "ketone lactone carbon ketone"), ("b", "lactone ester"), ("c", "alkene carbon aromatic"), ("d", "peak atom verifier mode"), ("e", "filler words here")], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "ketone OR lactone"), (2, "C20H30O3 OR ketone")], "query_id int, q string").select("query_id", F.array_except(T.query_terms("q", 12), F.array(F.lit("or"))).alias("terms"))
    found = {(r.query_id, r.doc_id): r.score for r in text_search.bm25(docs, asked, "doc_id", ["doc_id", "text"], "query_id", "terms", 5).collect()}
    assert found == {(1, "a"): pytest.approx(1.745931), (1, "b"): pytest.approx(0.381005), (2, "a"): pytest.approx(1.433782)}


def test_text_index(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"common word{i % 7} {'rare' if i == 5 else ''}", "en" if i % 2 else None) for i in range(50)] + [(50, "", "en"), (51, None, "en")], "doc_id int, text string, lang string")
    asked = spark.createDataFrame([(1, ["rare", "word3"]), (2, ["common"]), (3, ["nowhere"])], "query_id int, terms array<string>")
    text_search.write_index(docs, "doc_id", ["text"], str(tmp_path / "i"), ("lang",))
    for where in (None, F.col("lang") == "en"):
        rows = text_search.search_index(str(tmp_path / "i"), asked, "doc_id", "query_id", "terms", 4, where)
        plain = text_search.bm25(docs, asked, "doc_id", ["text"], "query_id", "terms", 4, where)
        assert sorted(rows.collect()) == sorted(plain.collect()) and rows.count() > 4
    pushed = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in pushed
    text_search.write_index(docs.limit(0), "doc_id", ["text"], str(tmp_path / "e"))
    assert text_search.search_index(str(tmp_path / "e"), asked, "doc_id", "query_id", "terms", 4).count() == 0


def test_chunks(spark):
    text = "# One\nintro\n## Two\n" + "word " * 100 + "\n# Three\n" + "x" * 500
    rows = text_search.markdown_chunks(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), most=200, overlap=20).orderBy("nth").collect()
    assert rows[0].heading == "One" and {r.heading for r in rows[1:-3]} == {"One / Two"} and rows[-1].heading == "Three"
    assert all(len(r.text) <= 200 for r in rows) and "".join(r.text for r in rows).count("x") >= 500
