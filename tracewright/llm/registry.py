"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, imatch, licenses, lm, minhash, packing, suffix, toxicity, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.chunked(table(spark, sf_dir, "pages"), "page_id", "html", as_base64=True)
    return rows.withColumnRenamed("record", "page_id")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.turn_spans(table(spark, sf_dir, "conversations"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rejected(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.duplicates(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.found(table(spark, sf_dir, "documents"), templates=licenses.TEMPLATES + licenses.FULL_TEXTS, anywhere=True)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    made = (op1_warc, op2_chat, op3_toxicity, op4_decontamination, op5_packing, op6_lm, op7_imatch, op8_licenses, op9_minhash, op10_suffix)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.ORACLE_SQL, "op2_chat": chat.ORACLE_SQL, "op4_decontamination": decontaminate.ORACLE_SQL, "op7_imatch": imatch.ORACLE_SQL}
