"""From raw documents to a weighted mix, in five stages; each works on all that the one before has kept.

1. toxicity: documents that score at or above the threshold go.
2. near_duplicates: one document of each group of near copies stays (five words a shingle, similarity 0.8).
3. decontamination: documents that hold benchmark passages go.
4. secrets: every secret that the scan finds is replaced by a mark; no document goes.
5. mixing: how often each document is taken, for sources to come near their target weights; the text, as cleaned, stands beside it.

All but the last return the columns of the documents that they get, whatever these are. Nulls, repeated rows, empty texts and empty
tables are as the operators define them: a null text is never toxic, contaminated or a copy, and has no secrets; repeated ids are one
document in components; an empty table gives no rows in any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm import decontaminate, minhash, mixing, secret_scan, toxicity
from peakloom.llm.common import durable


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = secret_scan.without_secrets(docs)
    return marked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else marked


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, keep=("source", "text"))


STAGES = [
    ("toxicity", _toxicity),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _decontamination),
    ("secrets", _secrets),
    ("mixing", _mixing),
]

#: SQL can't express the first and the fourth stage; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the documents; what each stage keeps is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
