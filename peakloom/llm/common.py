"""What several operators share: words, hashes, batches and tables that outlive an executor."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words between ASCII white space; and words of letters and digits, where every code point from U+0080 counts as a letter.
SPACED, PLAIN = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between PLAIN words; cutting at it is several times faster on the JVM than matching the words.
PLAIN_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TO_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def lowered(text: Column) -> Column:
    """A to Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def spaced_words(text: bytes | None, lower: bool) -> list[bytes]:
    """The words of SPACED in UTF-8 text; bytes.split() cuts at just those six characters."""
    return ((text.translate(_TO_LOWER) if lower else text) if text else b"").split()


def plain_words(text: bytes | None) -> list[bytes]:
    """The words of PLAIN in UTF-8 text, A to Z in lower case."""
    return text.translate(_TO_PLAIN).split() if text else []


def fresh(docs: DataFrame, name: str) -> str:
    """The name, with underscores put after it until no column of the rows has it (case apart)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_of(key: Column) -> Column:
    """crc32 of a key as text; null for a null key."""
    return F.crc32(key.cast("string").cast("binary"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; where none is set, a temporary one if all runs on this machine."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a table in the shared folder and read again: computed once, and not lost with an executor.

    The table stays until ``removed`` takes it away, or the cluster clears spark.checkpoint.dir: results that are read lazily may need it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(table)] = (weakref.ref(table, lambda _, key=id(table): _WRITTEN.pop(key, None)), path)
    return table


_WRITTEN: dict[int, tuple] = {}


def removed(*tables: DataFrame) -> None:
    """Deletes tables that ``durable`` has written; nothing that is still to be computed may read them."""
    for table in tables:
        if (known := _WRITTEN.pop(id(table), None)) is not None:
            context = table.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(known[1])
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def by_batch(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Applies work to each Arrow batch; empty batches are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Applies work, which may give several batches, to each Arrow batch that has rows."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            if batch.num_rows:
                yield from work(batch)

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of a binary column, one row at least, so that arrays made from them stay small."""
    sizes = np.zeros(batch.num_rows, np.int64)
    lengths = batch.column(column)
    for i, x in enumerate(lengths):
        sizes[i] = len(x.as_buffer()) if x.is_valid else 0
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    yield batch.slice(start)


# -- hashes over words -------------------------------------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Hashes(dict):
    """64-bit BLAKE2b hashes of words, kept for as many short words as fit."""

    def __init__(self, most: int = 1 << 18, longest: int = 64):
        self.most, self.longest = most, longest

    def __missing__(self, word: bytes) -> int:
        found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found


_HASHES = _Hashes()


def hashes_of(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word, the same in every process."""
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def text_hashes(text: bytes | pa.Buffer | None, lower: bool) -> np.ndarray:
    """The hashes of a text's words, in order."""
    return hashes_of(spaced_words(bytes(text) if text else b"", lower))


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for every run of so many words; for a few words, since it is linear in their hashes until it is mixed."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[i : i + n]
    return mixed(out)
