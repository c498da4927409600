"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Targets: the sources share all words in proportion to their weights; one that would pass its cap of ``epochs`` times its
own size stops there, and the rest share the excess by weight until none is above its cap. With the sources in order of
cap / weight this has a closed form: the first source that fits under the level of those not yet stopped sets the level.

Sampling: a source's rate (target / size) is a number of whole repetitions of each document and a fraction of one more.
The fraction is a run of the document's words from a seeded place; its length is rounded up or down by a seeded draw for
each document, so that a source's total comes within a few words of its target, however few or uneven its documents are.

Sizes are counted in one pass, which writes key, source and size; the rest works on that table.

Defined cases: a null text has size 0; null sources are one source, ordered last; a source or a corpus without words has
target 0; rows with null ids draw by their source and text, and equal ones of these by a number each, so results agree however the
table is cut into files and tasks; other repeated rows each count, and get equal results; texts of any length are counted whole; an
empty table gives no rows; columns that are not named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.llm.common import SPACED, durable

WEIGHTS, EPOCHS, SEED = (1, 2, 3), 3, "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACED)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, size) rows. Windows here run over one row per source, after aggregation."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    rows = rows.withColumn("place", place).withColumn("weight", F.get(cycle, (F.col("place") - 1) % len(weights)))
    rows = rows.withColumn("cap", F.col("source_size") * epochs)
    order = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), "place")
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        F.row_number().over(order).alias("nth"),
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("words_left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    ).withColumn("level", F.col("words_left").cast("double") / F.col("weight_left"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("nth", "level"))
    rows = rows.withColumn("set_by", F.min(fits).over(everything))
    level = F.least(F.col("set_by.level") * F.col("weight"), F.col("cap").cast("double"))
    return rows.select("source", "source_size", F.when(F.col("nth") < F.col("set_by.nth"), F.col("cap").cast("double")).otherwise(level).alias("target"))


def draw(seed: str, what: str, key: Column) -> Column:
    """A number from 0 up to 1 that depends on the seed, its purpose and the key alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{what}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _drawn_by(sized: DataFrame) -> DataFrame:
    """The rows with what they draw by: their key as text; without one, the digest of source and text, and a number among equal ones.

    Equal rows are numbered within the task that wrote them, on from what the tasks before it wrote, so no task gets all of them.
    """
    named = sized.where("key IS NOT NULL").withColumn("drawn_by", F.col("key").cast("string"))
    held = sized.where("key IS NULL")
    counts = held.groupBy("content", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("content").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("content", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("content", "task").orderBy("size"))
    numbered = held.withColumn("nth", nth).join(counts, ["content", "task"])
    drawn = numbered.withColumn("drawn_by", F.concat(F.lit("row "), "content", F.lit(":"), (F.col("before") + F.col("nth")).cast("string")))
    return named.unionByName(drawn.select(*named.columns))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", *, keep: tuple[str, ...] = (), weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """Key, size, source_size, target, taken, and how the words are taken: ``repeats`` whole ones and ``part_words`` from word ``part_start``.

    ``keep`` names further columns to carry along. Only (source, size) is aggregated and only rows without texts are
    shuffled; the join on a source that holds a third of the rows is split by adaptive execution.
    """
    kept = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]
    told = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    content = F.when(F.col(key).isNull(), F.md5(F.concat(told(source), F.lit("\n"), told(text)).cast("binary")))
    sized = durable(docs.select(F.col(key).alias("key"), content.alias("content"), F.spark_partition_id().alias("task"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *kept), "sizes")
    goal = targets(sized.select("source", "size"), weights, epochs).withColumnRenamed("source", "of")
    rows = sized.withColumn("drawn_by", F.col("key").cast("string")) if sized.where("key IS NULL").isEmpty() else _drawn_by(sized)
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("of")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("rate", rate).withColumn("repeats", F.floor("rate"))
    part = F.floor((F.col("rate") - F.col("repeats")) * F.col("size") + draw(seed, "part", F.col("drawn_by")))
    rows = rows.withColumn("part_words", part)
    start = F.floor(draw(seed, "start", F.col("drawn_by")) * (F.col("size") - F.col("part_words") + 1))
    return rows.select(
        F.col("key").alias(key), "size", "source_size", "target", (F.col("repeats") * F.col("size") + F.col("part_words")).alias("taken"),
        "repeats", "part_words", F.when(F.col("part_words") > 0, start).alias("part_start"), *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)],
    )
