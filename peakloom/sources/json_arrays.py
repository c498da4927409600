"""Files that hold one JSON array of objects each, read by as many tasks as their size asks for.

The text reader cuts a file at closing braces, and so can begin anywhere in it. Where a cut lies (inside a string or not, and how deep) depends on all
that comes before; but what a split does to that is known without it, for both cases: each split is summed up as whether it holds an odd
number of quotes, and by how much it deepens if it begins outside a string, or inside one. Running sums over the splits of a file, a row each,
tell every split its beginning; then each gives out the objects that it holds whole, and the pieces at its ends are put together by their
numbers. The file is read twice, and only pieces are shuffled.

Defined cases: white space, a byte order mark and line ends count for nothing; braces, brackets and escaped quotes inside strings are text; an empty
array or file has no rows; an array that ends early, or holds something other than objects, is an error; compressed files are one split each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Splits whose beginnings are sent to every task; those of more are joined to their rows instead.
SENT_SPLITS = 1 << 18
_ESCAPED = re.compile(r"\\.", re.DOTALL)
_BLANK = " \t\r\n﻿,"


def _step(text: str) -> tuple[int, int, int]:
    """What a piece of text, with the brace that the reader has cut off, does: odd quotes, and the change of depth if it begins outside or inside a string."""
    parts = (_ESCAPED.sub("", text) if "\\" in text else text).split('"')
    deeper = lambda some: sum(x.count("{") + x.count("[") - x.count("}") - x.count("]") for x in some)
    odd = (len(parts) - 1) % 2
    return odd, deeper(parts[::2]) - (not odd), deeper(parts[1::2]) - odd


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"))


def _splits(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple[tuple, bool, list[str]]]:
    """The texts of each split, in order and a batch at a time, with the columns that name it and whether it begins with them."""
    now = None
    for batch in batches:
        names, texts = list(zip(*(batch.column(c).to_pylist() for c in ("file", "split", *more)), strict=True)), batch.column("value").to_pylist()
        start = 0
        for i in range(1, len(names) + 1):
            if i == len(names) or names[i] != names[start]:
                yield names[start], names[start] != now, texts[start:i]
                now, start = names[start], i


def _beginnings(pieces: DataFrame) -> DataFrame:
    """(file, split, inside, depth): whether each split begins inside a string, and how deep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, odd, out, into = None, 0, 0, 0
        summed = lambda: pa.RecordBatch.from_pylist([{"file": now[0], "split": now[1], "odd": odd, "out": out, "into": into}], pa.schema([("file", pa.string()), ("split", pa.int64()), ("odd", pa.int64()), ("out", pa.int64()), ("into", pa.int64())]))
        for name, begins, texts in _splits(batches):
            if begins:
                if now is not None:
                    yield summed()
                now, odd, out, into = name, 0, 0, 0
            for text in texts:
                step = _step(text)
                out, into = (out + step[1], into + step[2]) if not odd else (out + step[2], into + step[1])
                odd ^= step[0]
        if now is not None:
            yield summed()

    steps = pieces.select("value", "file", "split").mapInArrow(run, "file string, split long, odd long, out long, into long")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    rows = steps.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    return rows.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside") == 0, F.col("out")).otherwise(F.col("into"))).over(before), F.lit(0))).select("file", "split", "inside", "depth")


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(value, file): the text of each object of the arrays in the files."""
    pieces = _pieces(spark, path)
    begins = _beginnings(pieces)
    few = pieces.select("file", "split").distinct().limit(SENT_SPLITS + 1).count() <= SENT_SPLITS
    joined = pieces.join(F.broadcast(begins) if few else begins, ["file", "split"])
    if not few:
        joined = joined.repartition("file", "split").sortWithinPartitions("file", "split", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("file", pa.string()), ("split", pa.int64()), ("value", pa.string()), ("part", pa.int32()), ("last", pa.bool_())])
        row = lambda value, part, last: {"file": file, "split": split, "value": value, "part": part, "last": last}
        file, split, inside, depth, held, starts = None, 0, 0, 0, [], False
        for name, begins, texts in _splits(batches, "inside", "depth"):
            rows = []
            if begins:
                if held:
                    rows.append(row("".join(held), 1, False))
                file, split, inside, depth = name
                held, starts = [], inside == 0 and depth <= 1
            for text in texts:
                odd, out, into = _step(text)
                held.append(text + "}")
                depth += into if inside else out
                inside ^= odd
                if not inside and depth == 1:
                    rows.append(row("".join(held), -1 if starts else 0, True))
                    held, starts = [], True
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kind)
        if held:
            yield pa.RecordBatch.from_pylist([row("".join(held), 1, False)], kind)

    found = joined.select("value", "file", "split", "inside", "depth").mapInArrow(run, "file string, split long, value string, part int, last boolean")
    cut = found.where("part >= 0")
    before = Window.partitionBy("file").orderBy("split", "part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = cut.withColumn("_id", F.coalesce(F.sum(F.col("last").cast("long")).over(before), F.lit(0)))
    joined_up = numbered.groupBy("file", "_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "part", "value"))), lambda x: x["value"]), "").alias("value"), F.max("last").alias("last"))
    text = lambda c: F.ltrim(c, F.lit(_BLANK))
    rows = found.where("part < 0").select("file", "value", "last").unionByName(joined_up.select("file", "value", "last"))
    bare = text(F.col("value"))
    # Only the first object of a file has the array's own bracket before it; what comes after the last one is the closing bracket, and the brace that was put back.
    bare = F.when(F.startswith(bare, F.lit("[")), text(F.substr(bare, F.lit(2)))).otherwise(bare)
    rows = rows.select("file", "last", bare.alias("value"))
    closing = ~F.col("last") & F.regexp_like("value", F.lit(r"^(\][\s﻿]*)?\}?$"))
    wrong = F.when(~F.col("last"), F.raise_error(F.concat(F.lit("an array ends early in "), F.col("file")))).when(~F.startswith("value", F.lit("{")), F.raise_error(F.concat(F.lit("not an array of objects: "), F.col("file"))))
    return rows.where(~closing).select(F.coalesce(wrong.cast("string"), F.col("value")).alias("value"), "file")


def objects(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The objects of the arrays as rows of the schema; a value of another type is null."""
    return elements(spark, path).select(F.from_json("value", schema).alias("_x")).select("_x.*")


def write(rows: DataFrame, path: str) -> None:
    """The rows as objects, nulls left out; each task writes one array to a file of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, any_ = "[", False
        for batch in batches:
            if batch.num_rows:
                any_ = True
                lines = [before + batch.column(0)[0].as_py(), *("," + x for x in batch.column(0)[1:].to_pylist())]
                before = ","
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if any_ else "[]"])], names=["value"])

    rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value")).mapInArrow(run, "value string").write.text(path)
