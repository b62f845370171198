"""The corpus pipeline: each stage works on all that the one before kept.

Toxic documents go; of near duplicates one stays; passages that occur before are cut, and a document of
which nothing is left goes; documents with a benchmark passage go; what is left is packed into sequences.
A row whose id or text is null can't be judged and stays up to the last stage. Rows that share an id
share its fate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontaminate, minhash, packing, suffix, toxicity
from tracewright.llm.common import Spooled, hinted, table, without


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = toxicity.rejected(docs, table(spark, sf_dir, "labels")).select(F.col("doc_id").alias("__id"))
    return without(docs, hinted(Spooled(gone).df))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = minhash.near_duplicates(docs).select(F.col("doc_id").alias("__id"))
    return without(docs, hinted(Spooled(gone).df))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = suffix.cut(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__id"))
    return without(docs, hinted(Spooled(gone).df))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", contaminated),
    ("packing", packed),
]
#: SQL can't express these stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = Spooled(stage(spark, docs, sf_dir)).df
    return STAGES[-1][1](spark, docs, sf_dir)
