"""Readers of the supported file formats; every one gives a DataFrame and leaves pruning and pushdown to Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakloom.functions import text as T
from peakloom.sources import json_arrays

CORRUPT = "_corrupt"


def json_lines(spark: SparkSession, path: str, schema: str, limit: int = -1) -> DataFrame:
    """One object a line, blank lines apart; a negative limit takes all."""
    rows = spark.read.schema(schema).json(path)
    return rows.limit(limit) if limit >= 0 else rows


def tolerant_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows that parse, and the text of those that don't."""
    rows = spark.read.text(path).where(F.trim("value") != "").withColumn("_row", F.from_json("value", f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col(f"_row.{CORRUPT}").isNotNull() | F.col("_row").isNull()
    return rows.where(~bad).select("_row.*").drop(CORRUPT), rows.where(bad).select(F.col("value").alias("raw"))


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of files that hold one JSON array each, by as many tasks as their size asks for."""
    return json_arrays.objects(spark, path, schema)


def table_text(spark: SparkSession, path: str, separator: str = ",", schema: str | None = None) -> DataFrame:
    """Delimited text with a heading; fields may hold line ends in quotes."""
    reader = spark.read.option("header", True).option("sep", separator).option("multiLine", separator == ",").option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def fields(spark: SparkSession, path: str, names: list[str], exact: bool = True) -> DataFrame:
    """Tab-separated lines as named columns; lines of another (or, if not exact, a smaller) number of fields are dropped."""
    rows = spark.read.text(path).select(F.split("value", "\t", -1).alias("_f"))
    fits = F.size("_f") == len(names) if exact else F.size("_f") >= len(names)
    return rows.where(fits).select(*[T.squeezed(F.col("_f")[i]).alias(n) for i, n in enumerate(names)])


def glossary(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Rows of a tab-separated table by key; of repeated keys the last line holds."""
    rows = table_text(spark, path, "\t").withColumn("_at", F.monotonically_increasing_id())
    others = [c for c in rows.columns if c not in (key, "_at")]
    last = rows.where(T.blank_to_null(F.col(f"`{key}`")).isNotNull()).groupBy(T.squeezed(F.col(f"`{key}`")).alias("name"))
    return last.agg(*[F.max_by(T.squeezed(F.col(f"`{c}`")), "_at").alias(c) for c in others])


def blocks(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Records of key, tab and value lines between blank lines; other keys are left out."""
    rows = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    pairs = F.transform(F.filter(F.split("value", "\n"), lambda x: F.contains(x, F.lit("\t"))), lambda x: F.struct(F.trim(F.substring_index(x, "\t", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^\t]*\t", "")).alias("v")))

    def last(name: str) -> Column:
        own = F.filter("_p", lambda e: e["k"] == name)
        return F.try_element_at(F.transform(own, lambda e: e["v"]), F.lit(-1)).alias(name)

    return rows.select(pairs.alias("_p")).select(*[last(n) for n in names])


OBO = (
    "graphs array<struct<nodes:array<struct<id:string,lbl:string,meta:struct<deprecated:boolean,synonyms:array<struct<val:string>>,xrefs:array<struct<val:string>>,"
    "basicPropertyValues:array<struct<pred:string,val:string>>>>>,edges:array<struct<sub:string,pred:string,obj:string>>>>"
)


def ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Live, named nodes and whole edges of the first graph of an ontology file."""
    graph = spark.read.schema(OBO).option("multiLine", True).json(path).select(F.get("graphs", 0).alias("g"))
    nodes = graph.select(F.inline("g.nodes")).where(~F.coalesce(F.col("meta.deprecated"), F.lit(False)) & T.blank_to_null(F.col("lbl")).isNotNull())
    edges = graph.select(F.inline("g.edges")).where("sub <> '' AND pred <> '' AND obj <> ''")
    return nodes, edges


def compounds(dictionary: DataFrame, structures: DataFrame, key: str = "molregno") -> DataFrame:
    """A compound table with its structures where there are any."""
    return dictionary.join(structures, key, "left")


def grep(spark: SparkSession, path: str, pattern: str, most: int = 20) -> DataFrame:
    """The first lines that meet a pattern in either case, as triples of the first, third and second field."""
    found = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id()).where(F.col("value").rlike(f"(?i){pattern}")).orderBy("_at").limit(most)
    f = F.split("value", ",")
    return found.select(F.concat(F.lit("- "), F.get(f, 0), F.lit(" --["), F.get(f, 1), F.lit("]--> "), F.get(f, 3)).alias("line"))


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("source_path"))


def atoms(c: Column) -> Column:
    """array<struct<element, x, y, z>> of coordinate text: lines of four fields or more; a heading count is no atom."""
    rows = F.filter(F.transform(F.split(c, "\n"), lambda x: F.split(F.trim(x), r"\s+")), lambda f: F.size(f) >= 4)
    made = F.transform(rows, lambda f: F.struct(f[0].alias("element"), *[f[i].try_cast("double").alias(n) for i, n in ((1, "x"), (2, "y"), (3, "z"))]))
    return F.filter(made, lambda a: a["x"].isNotNull() & a["y"].isNotNull() & a["z"].isNotNull())


def pool_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of saved pools, one row each, with their pool's path and place."""
    rows = spark.read.option("multiLine", True).json(path)
    return rows.select(F.input_file_name().alias("pool"), F.posexplode("candidates").alias("at", "c")).select("pool", "at", "c.*")


def labelled(rows: DataFrame, h: str, c: str, label: str) -> DataFrame:
    """Rows with at least one peak and a label that isn't blank."""
    some = F.coalesce(F.size(h), F.lit(0)) + F.coalesce(F.size(c), F.lit(0)) > 0
    return rows.where(some & T.blank_to_null(F.col(label)).isNotNull())


def memory_records(spark: SparkSession, path: str) -> DataFrame:
    """(key, record as JSON) of exported memory: a list, or an object of confirmed cases; bare records get a content key."""
    raw = spark.read.text(path, wholetext=True).select(F.coalesce(F.get_json_object("value", "$.confirmed_cases"), F.col("value")).alias("list"))
    each = raw.select(F.explode(F.from_json("list", "array<string>")).alias("item"))
    value = F.get_json_object("item", "$.value")
    record = F.coalesce(value, F.col("item"))
    return each.select(F.coalesce(F.get_json_object("item", "$.key"), T.keyed("case", record)).alias("key"), record.alias("record"))


def seed_candidates(c: Column) -> Column:
    """Structures of a list, an object or bare text."""
    items = F.coalesce(F.from_json(c, "array<string>"), F.when(F.trim(c).startswith("{"), F.array(c)), F.array(c))
    return F.transform(items, lambda x: F.trim(F.coalesce(F.get_json_object(x, "$.smiles"), x)))


def tail(lines: DataFrame, at: str, line: str, most: int = 80) -> DataFrame:
    """The last lines in their order; one that isn't JSON stays as raw text."""
    rows = lines.orderBy(F.desc(at)).limit(most)
    ok = F.try_parse_json(F.col(line)).isNotNull()
    return rows.select(at, F.when(ok, F.get_json_object(line, "$.event")).alias("event"), F.when(~ok, F.col(line)).alias("raw")).orderBy(at)


def first_of_parts(parts: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return parts.withColumn("_n", place).where("_n = 1").drop("_n")
