"""A keyed table that a stream adds to: the first row of a key stays, and a batch that is done again changes nothing.

The table is a folder in a store that all executors share: ``rows/batch=n/bucket=b`` holds the new keys of a batch by hash bucket, and ``log/batch=n`` says
that the batch is whole. A batch first looks for its entry in the log; without one it takes the least row of each key by the given order, leaves out keys
that batches in the log have (reading only the buckets that it touches), writes its own folder anew, and then its entry. A run that ends between the two
leaves a folder without an entry, which no reader sees and the next try replaces.

Defined cases: rows with a null in the key are left out; of rows of one batch with equal order any may stay; an empty batch is logged and adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.operators import pools

BUCKETS = 64


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def committed(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches that are whole."""
    if not _there(spark, f"{path}/log"):
        return []
    return sorted(r.batch for r in spark.read.schema("n long, batch long").parquet(f"{path}/log").select("batch").distinct().collect())


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all whole batches, with their batch and bucket."""
    done = committed(spark, path)
    some = [f"{path}/rows/batch={n}" for n in done if _there(spark, f"{path}/rows/batch={n}")]
    empty = spark.createDataFrame([], f"{schema}, batch long, bucket int")
    return spark.read.schema(f"{schema}, batch long, bucket int").option("basePath", f"{path}/rows").parquet(*some) if some else empty


def merger(path: str, key: list[str], order: list[str], schema: str, buckets: int = BUCKETS, fails: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls; ``fails``, called between a batch's rows and its entry in the log, is for tests."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number in committed(spark, path):
            return
        rows = pools.first_wins(batch.dropna(subset=key), key, [F.col(c) for c in order]) if [c for c in batch.columns if c not in key] else batch.dropna(subset=key).distinct()
        rows = rows.withColumn("bucket", F.pmod(F.hash(*key), F.lit(buckets)))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
        known = table(spark, path, schema).where(F.col("bucket").isin(touched)).select(*key, "bucket")
        new = rows.join(known, [*key, "bucket"], "left_anti")
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/batch={number}")
        if fails is not None:
            fails(number)
        spark.range(1).select(F.lit(len(touched)).cast("long").alias("n")).write.mode("overwrite").parquet(f"{path}/log/batch={number}")

    return merge
