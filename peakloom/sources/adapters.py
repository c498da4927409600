"""Heterogeneous sources as one graph: nodes, edges, documents and aliases, and their indexes.

Each adapter is one projection of its source into Parts; ``union`` puts parts together, and ``deduplicated`` keeps the
first of every key in the order of parts and rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions import text as T
from peakloom.operators import pools

#: Properties that go into a document's metadata, and those that ontology nodes keep.
METADATA = ("formula", "smiles", "inchikey", "source_id", "chemical_class")
ONTOLOGY_PROPERTIES = ("generalized_empirical_formula", "inchi_key_string", "inchi_string", "smiles_string", "charge", "mass", "monoisotopic_mass")
NODE = ["node_id", "labels", "name", "identifiers", "properties", "source", "row"]
EDGE = ["edge_id", "subject_id", "predicate", "object_id", "relation_label", "source", "row"]
DOCUMENT = ["doc_id", "node_id", "title", "text", "doc_type", "metadata", "source", "row"]
ALIAS = ["alias", "alias_type", "node_id", "source", "row"]


@dataclass
class Parts:
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    documents: DataFrame | None = None
    aliases: DataFrame | None = None


def union(parts: list[Parts]) -> Parts:
    """All parts, each row with the number of its part."""
    out = {}
    for kind in ("nodes", "edges", "documents", "aliases"):
        for n, p in enumerate(parts):
            rows = getattr(p, kind)
            if rows is not None:
                rows = rows.withColumn("part", F.lit(n))
                out[kind] = out[kind].unionByName(rows) if kind in out else rows
    return Parts(**out)


def deduplicated(p: Parts, edges: bool = True) -> Parts:
    """The first row of each node, document and alias; of each edge too, if asked."""
    order = [F.col("part"), F.col("row")]
    first = lambda rows, key: pools.first_wins(rows, key, order) if rows is not None else None
    alias = None
    if p.aliases is not None:
        held = p.aliases.withColumn("_key", F.concat_ws("\x1f", F.coalesce("node_id", F.lit("")), F.lower(F.coalesce("alias", F.lit(""))), F.coalesce("alias_type", F.lit("")), F.coalesce("source", F.lit(""))))
        alias = first(held, ["_key"]).drop("_key")
    return Parts(first(p.nodes, ["node_id"]), first(p.edges, ["edge_id"]) if edges else p.edges, first(p.documents, ["doc_id"]), alias)


def _map(values: dict[str, Column]) -> Column:
    """map<string, string> of the values that are filled."""
    held = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), T.blank_to_null(v))])
    return F.map_filter(held, lambda k, v: v.isNotNull())


def _typed(values: Column, kind: str) -> Column:
    """array<struct<alias, alias_type>> of texts of one kind."""
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.struct(T.squeezed(x).alias("alias"), F.lit(kind).alias("alias_type")))


def molecule_id(source: str, source_id: Column, inchikey: Column) -> Column:
    """The structure's key where there is one, else the source's id, else a digest of the row's own id."""
    key = T.blank_to_null(inchikey)
    return F.when(key.isNotNull(), F.concat(F.lit("mol:inchikey:"), key)).otherwise(F.concat(F.lit(f"{source}:"), F.coalesce(T.compact_id(source_id), F.lit("unknown"))))


def profile_text(title: Column, properties: Column, notes: Column | None = None) -> Column:
    """Sentences of a molecule's filled properties."""
    said = lambda label, k: F.concat(F.lit(label), properties[k])
    parts = F.array(title, said("formula ", "formula"), said("molecular weight ", "molecular_weight"), said("chemical class ", "chemical_class"), said("reported organism/source ", "organisms"), said("SMILES ", "smiles"), notes if notes is not None else F.lit(None).cast("string"))
    filled = F.filter(F.transform(parts, lambda x: F.regexp_replace(T.squeezed(x), r"\.+$", "")), lambda x: x.isNotNull() & (x != ""))
    return F.concat(F.array_join(filled, ". "), F.lit("."))


def molecules(rows: DataFrame, source: str, row: str, source_id: Column, inchikey: Column, name: Column, properties: dict[str, Column], labels: Column, doc_type: str, aliases: dict[str, Column], notes: Column | None = None) -> Parts:
    """Molecule rows as nodes, a document each, and aliases by type (arrays of text)."""
    named = F.coalesce(T.blank_to_null(name), T.squeezed(source_id))
    base = rows.select(F.col(row).cast("long").alias("row"), F.lit(source).alias("source"), molecule_id(source, source_id, inchikey).alias("node_id"), labels.alias("labels"), named.alias("name"), _map({"source_id": source_id, "inchikey": inchikey}).alias("identifiers"), _map({"source_id": source_id, "inchikey": inchikey, **properties}).alias("properties"), (notes if notes is not None else F.lit(None).cast("string")).alias("_notes"), F.flatten(F.array(*[_typed(v, k) for k, v in aliases.items()])).alias("_aliases"))
    documents = base.select(T.keyed("doc", F.col("node_id"), F.lit(doc_type), F.col("source")).alias("doc_id"), "node_id", F.col("name").alias("title"), profile_text(F.col("name"), F.col("properties"), F.col("_notes")).alias("text"), F.lit(doc_type).alias("doc_type"), F.map_filter("properties", lambda k, v: k.isin(*METADATA)).alias("metadata"), "source", "row")
    named_as = base.select("node_id", "source", "row", F.inline("_aliases")).where("alias IS NOT NULL AND alias <> '' AND length(alias) <= 512")
    return Parts(base.select(*NODE), None, documents.select(*DOCUMENT), named_as.select(*ALIAS))


def edges(rows: DataFrame, source: str, row: str, subject: Column, predicate: Column, target: Column, label: Column) -> DataFrame:
    made = rows.select(subject.alias("subject_id"), predicate.alias("predicate"), target.alias("object_id"), label.alias("relation_label"), F.lit(source).alias("source"), F.col(row).cast("long").alias("row"))
    return made.withColumn("edge_id", F.concat(F.lit("sha1:"), T.sha1_text(F.concat_ws("|", "subject_id", "predicate", "object_id", "source"), 24))).select(*EDGE)


def natural_products(rows: DataFrame, source: str, row: str = "row") -> Parts:
    """A delimited table of natural products with pipes in synonyms and references."""
    c = F.col
    properties = {"smiles": c("canonical_smiles"), "inchi": c("standard_inchi"), "formula": c("molecular_formula"), "molecular_weight": c("molecular_weight"), **{k: c(k) for k in ("chemical_class", "chemical_sub_class", "chemical_super_class", "organisms", "cas")}, "dois": F.array_join(T.split_pipe(c("dois")), "|")}
    aliases = {"identifier": F.array(c("identifier")), "name": F.array("name", "iupac_name", "cas"), "synonym": F.slice(T.split_pipe(c("synonyms")), 1, 20)}
    return molecules(rows, source, row, c("identifier"), c("standard_inchi_key"), c("name"), properties, F.array(F.lit("molecule"), F.lit("natural_product")), "molecule_profile", aliases)


def natural_product_records(rows: DataFrame, source: str, row: str = "row") -> Parts:
    """Nested records of natural products, with the organisms and classes that they point to as nodes and edges."""
    c = F.col
    organism = F.coalesce(T.blank_to_null(F.concat_ws(" ", "origin_organism.genus", "origin_organism.species")), T.blank_to_null(c("origin_organism.type")))
    properties = {"smiles": c("smiles"), "inchi": c("inchi"), "formula": c("mol_formula"), "molecular_weight": c("mol_weight"), "exact_mass": c("exact_mass"), "chemical_class": c("classyfire.class.name"), "chemical_super_class": c("classyfire.superclass.name"), "direct_parent": c("classyfire.direct_parent.name"), "organisms": organism}
    outside = F.transform("external_ids", lambda x: F.struct(T.squeezed(x["external_db_code"]).alias("alias"), F.concat(F.lit("xref:"), T.squeezed(x["external_db_name"])).alias("alias_type")))
    own = molecules(rows, source, row, c("npaid"), c("inchikey"), c("original_name"), properties, F.array(F.lit("molecule"), F.lit("natural_product")), "natural_product_profile", {"identifier": F.array("npaid"), "name": F.array("original_name"), "synonym": c("synonyms")}, c("classyfire.description"))
    keyed = rows.withColumn("_node", molecule_id(source, c("npaid"), c("inchikey"))).withColumn("_organism", organism)
    xrefs = keyed.select(F.col("_node").alias("node_id"), F.lit(source).alias("source"), F.col(row).cast("long").alias("row"), F.inline(outside)).where("alias IS NOT NULL AND alias <> ''")
    living = keyed.where("_organism IS NOT NULL").withColumn("_target", F.concat(F.lit(f"taxon:{source}:"), T.compact_id(F.col("_organism"))))
    groups = F.array("classyfire.superclass.name", "classyfire.class.name", "classyfire.direct_parent.name", "npclassifier.pathway", "npclassifier.superclass", "npclassifier.class")
    classed = keyed.withColumn("_class", F.explode(F.filter(groups, lambda x: T.blank_to_null(x).isNotNull()))).withColumn("_target", F.concat(F.lit(f"class:{source}:"), T.compact_id(F.col("_class"))))
    node = lambda r, name, labels: r.select(F.col("_target").alias("node_id"), labels.alias("labels"), T.squeezed(F.col(name)).alias("name"), F.expr("map()").cast("map<string,string>").alias("identifiers"), F.expr("map()").cast("map<string,string>").alias("properties"), F.lit(source).alias("source"), F.col(row).cast("long").alias("row"))
    nodes = own.nodes.unionByName(node(living, "_organism", F.array(F.lit("organism"), F.lit("taxon")))).unionByName(node(classed, "_class", F.array(F.lit("chemical_class"))))
    links = edges(living, source, row, c("_node"), F.lit("produced_by"), c("_target"), F.lit("produced by organism")).unionByName(edges(classed, source, row, c("_node"), F.lit("has_class"), c("_target"), F.lit("has chemical class")))
    return Parts(nodes, links, own.documents, own.aliases.unionByName(xrefs.select(*ALIAS)))


def structure_list(rows: DataFrame, source: str, row: str = "row", smiles: str = "smiles", key: str = "id") -> Parts:
    """Pairs of structure and id."""
    return molecules(rows, source, row, F.col(key), F.lit(None).cast("string"), F.col(key), {"smiles": F.col(smiles)}, F.array(F.lit("molecule"), F.lit("natural_product")), "minimal_molecule_profile", {"identifier": F.array(key)})


def approved_drugs(rows: DataFrame, source: str, row: str = "row", key: str = "DRUG__ID", name: str = "DRUGNAME", smiles: str = "DRUGSMIL", inchi: str = "DRUGINCH") -> Parts:
    """Key and value blocks of drugs; those without an id are dropped."""
    held = rows.where(T.blank_to_null(F.col(key)).isNotNull())
    return molecules(held, source, row, F.col(key), F.lit(None).cast("string"), F.col(name), {"smiles": F.col(smiles), "inchi": F.col(inchi)}, F.array(F.lit("molecule"), F.lit("approved_drug")), "approved_drug_profile", {"identifier": F.array(key), "name": F.array(F.coalesce(T.blank_to_null(F.col(name)), F.col(key)))})


def bioactive_compounds(rows: DataFrame, source: str, row: str = "row", extra: tuple[str, ...] = ("molregno", "max_phase", "therapeutic_flag", "molecule_type", "first_approval", "natural_product")) -> Parts:
    """A compound table joined with its structures; approved and natural ones get a further label."""
    c = F.col
    key = F.coalesce(T.blank_to_null(c("chembl_id")), F.concat(F.lit("molregno:"), c("molregno").cast("string")))
    labels = F.array_compact(F.array(F.lit("molecule"), F.lit("chembl_compound"), F.when((c("therapeutic_flag") == 1) | (c("max_phase") == 4), "drug_like_or_approved"), F.when(c("natural_product") == 1, "natural_product")))
    said = lambda x: F.coalesce(c(x).cast("string"), F.lit("None"))
    notes = F.concat(F.lit("ChEMBL molecule type "), said("molecule_type"), F.lit("; max phase "), said("max_phase"), F.lit("; therapeutic flag "), said("therapeutic_flag"), F.lit("; first approval "), said("first_approval"))
    properties = {"smiles": c("canonical_smiles"), "inchi": c("standard_inchi"), "pref_name": c("pref_name"), **{x: c(x) for x in extra}}
    return molecules(rows, source, row, key, c("standard_inchi_key"), c("pref_name"), properties, labels, "chembl_molecule_profile", {"identifier": F.array(key), "name": F.array(F.coalesce(T.blank_to_null(c("pref_name")), key))}, notes)


def paired_entities(rows: DataFrame, source: str, row: str = "row") -> Parts:
    """Rows of two entities and a relation: both as nodes and aliases, and one edge."""
    c = F.col
    part = lambda side, name, blank: F.coalesce(T.compact_id(c(f"{side}_{name}")), F.lit(blank))
    key = lambda side: F.concat_ws(":", F.lit(source), part(side, "type", "entity"), part(side, "source", "source"), part(side, "id", "unknown"))
    end = lambda side: F.struct(key(side).alias("node_id"), F.array(F.lit(f"{source}_entity"), part(side, "type", "entity")).alias("labels"), F.coalesce(T.blank_to_null(c(f"{side}_name")), key(side)).alias("name"), _map({"source_id": c(f"{side}_id"), "source": c(f"{side}_source")}).alias("identifiers"), _map({"entity_type": c(f"{side}_type")}).alias("properties"))
    nodes = rows.select(F.inline(F.array(end("x"), end("y"))), F.lit(source).alias("source"), F.col(row).cast("long").alias("row"))
    return Parts(nodes.select(*NODE), edges(rows, source, row, key("x"), T.squeezed(c("relation")), key("y"), T.squeezed(c("display_relation"))), None, nodes.select(F.col("name").alias("alias"), F.lit("name").alias("alias_type"), "node_id", "source", "row"))


def triples(rows: DataFrame, relations: DataFrame, source: str, row: str = "row") -> Parts:
    """Typed triples with a glossary (name, Interaction-type, Description ...) of their relations, whose entries are documents."""
    key = lambda x: F.concat(F.lit(f"{source}:"), F.col(x))
    kind = lambda x: F.when(F.contains(F.col(x), F.lit("::")), F.substring_index(x, "::", 1)).otherwise("entity")
    end = lambda x: F.struct(key(x).alias("node_id"), F.array(F.lit(f"{source}_entity"), F.coalesce(T.compact_id(kind(x)), F.lit("entity"))).alias("labels"), F.col(x).alias("name"), _map({"source_id": F.col(x)}).alias("identifiers"), _map({"entity_type": kind(x)}).alias("properties"))
    nodes = rows.select(F.inline(F.array(end("subject"), end("object"))), F.lit(source).alias("source"), F.col(row).cast("long").alias("row"))
    told = rows.join(relations.select(F.col("name").alias("predicate"), F.col("`Interaction-type`").alias("_label")), "predicate", "left")
    links = edges(told, source, row, key("subject"), F.col("predicate"), key("object"), F.coalesce("_label", "predicate"))
    blank = lambda x: F.coalesce(F.col(f"`{x}`"), F.lit(""))
    text = F.concat(F.lit("DRKG relation "), F.col("name"), F.lit(". Data source: "), blank("Data-source"), F.lit(". Connected entity types: "), blank("Connected entity-types"), F.lit(". Interaction type: "), blank("Interaction-type"), F.lit(". Description: "), blank("Description"), F.lit("."))
    documents = relations.select(T.keyed("doc", F.col("name"), F.lit("relation_glossary"), F.lit(source)).alias("doc_id"), F.lit(None).cast("string").alias("node_id"), F.col("name").alias("title"), text.alias("text"), F.lit("relation_glossary").alias("doc_type"), _map({"relation": F.col("name")}).alias("metadata"), F.lit(source).alias("source"), F.lit(0).cast("long").alias("row"))
    return Parts(nodes.select(*NODE), links, documents, None)


def ontology(nodes: DataFrame, links: DataFrame, source: str, row: str = "row") -> Parts:
    """Ontology nodes with their known properties, names, synonyms and references; edges between them."""
    term = lambda x: F.when(F.regexp_extract(x, r"CHEBI_(\d+)", 1) != "", F.concat(F.lit("chebi:CHEBI_"), F.regexp_extract(x, r"CHEBI_(\d+)", 1))).otherwise(F.concat(F.lit("chebi:"), F.coalesce(T.compact_id(x), F.lit("unknown"))))
    pairs = F.filter(F.transform(F.coalesce("meta.basicPropertyValues", F.expr("array()").cast("array<struct<pred:string,val:string>>")), lambda p: F.struct(F.element_at(F.split(p["pred"], "[/#]"), -1).alias("key"), T.squeezed(p["val"]).alias("value"))), lambda e: e["key"].isin(*ONTOLOGY_PROPERTIES) & (e["value"] != ""))
    held = nodes.select(term(F.col("id")).alias("node_id"), T.squeezed(F.col("lbl")).alias("name"), F.map_from_entries(pairs).alias("properties"), _map({"source_id": F.col("id")}).alias("identifiers"), F.lit(source).alias("source"), F.col(row).cast("long").alias("row"), F.col("meta.synonyms.val").alias("_s"), F.col("meta.xrefs.val").alias("_x"))
    text = F.concat(F.array_join(F.array_compact(F.array(F.col("name"), F.concat(F.lit("formula "), F.col("properties")["generalized_empirical_formula"]), F.concat(F.lit("SMILES "), F.col("properties")["smiles_string"]))), ". "), F.lit("."))
    documents = held.select(T.keyed("doc", F.col("node_id"), F.lit("ontology_profile"), F.col("source")).alias("doc_id"), "node_id", F.col("name").alias("title"), text.alias("text"), F.lit("ontology_profile").alias("doc_type"), F.col("properties").alias("metadata"), "source", "row")
    aliases = held.select("node_id", "source", "row", F.inline(F.concat(_typed(F.array("name"), "name"), _typed(F.col("_s"), "synonym"), _typed(F.col("_x"), "xref")))).where("alias IS NOT NULL AND alias <> ''")
    shown = held.withColumn("labels", F.array(F.lit("chebi_entity"), F.lit("ontology_node")))
    return Parts(shown.select(*NODE), edges(links, source, row, term(F.col("sub")), T.squeezed(F.col("pred")), term(F.col("obj")), T.squeezed(F.col("pred"))), documents, aliases.select(*ALIAS))


def described_entities(rows: DataFrame, source: str, row: str = "row", each: int = 3) -> Parts:
    """Entities with up to so many texts each."""
    held = rows.where(T.blank_to_null(F.col("entity")).isNotNull()).withColumn("name", T.squeezed(F.col("entity"))).withColumn("node_id", F.concat(F.lit("elementkg:"), T.sha1_text(F.col("name"), 20))).withColumn("row", F.col(row).cast("long")).withColumn("source", F.lit(source))
    nodes = held.select("node_id", F.array(F.lit("synthetic_knowledge_entity")).alias("labels"), "name", F.expr("map()").cast("map<string,string>").alias("identifiers"), F.expr("map()").cast("map<string,string>").alias("properties"), "source", "row")
    texts = held.select("node_id", "name", "source", "row", F.posexplode(F.slice("corpus", 1, each)).alias("at", "text"))
    documents = texts.select(T.keyed("doc", F.col("node_id"), F.col("at"), F.col("source")).alias("doc_id"), "node_id", F.col("name").alias("title"), "text", F.lit("synthetic_knowledge_card").alias("doc_type"), _map({"corpus_index": (F.col("at") + 1).cast("string")}).alias("metadata"), "source", "row")
    return Parts(nodes, None, documents, nodes.select(F.col("name").alias("alias"), F.lit("name").alias("alias_type"), "node_id", "source", "row"))


def counted(p: Parts) -> DataFrame:
    """Rows of each kind by source."""
    kinds = [getattr(p, k).select("source", F.lit(k).alias("kind")) for k in ("nodes", "edges", "documents", "aliases") if getattr(p, k) is not None]
    rows = kinds[0]
    for k in kinds[1:]:
        rows = rows.unionByName(k)
    return rows.groupBy("source", "kind").agg(F.count("*").alias("n"))


def indexed_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes as the index holds them: flat text columns, and JSON of the rest."""
    p, i = F.col("properties"), F.col("identifiers")
    formula = T.first_filled(p["formula"], p["generalized_empirical_formula"], p["molecular_formula"], p["mol_formula"])
    key = T.first_filled(i["inchikey"], p["inchikey"], p["inchi_key_string"], F.nullif(F.regexp_extract("node_id", "^mol:inchikey:(.+)$", 1), F.lit("")))
    return nodes.select("node_id", "name", F.array_join("labels", " ").alias("labels"), formula.alias("formula"), key.alias("inchikey"), T.first_filled(p["smiles"], p["canonical_smiles"], p["smiles_string"]).alias("smiles"), "source", F.to_json("properties").alias("properties_json"))
