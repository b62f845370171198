"""One plan from raw records to stored training records: read, normalise, format, validate, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import formats, validate
from ..sources import scans, storage
from . import adapters


class FormatValidationError(ValueError):
    """A record that can't take the format asked for."""


def format_messages(spark: SparkSession, messages: list[dict], format_name: str) -> dict:
    """The record of one message list. For many, use convert()."""
    import json

    if format_name not in formats.FORMATS:
        raise FormatValidationError(f"no format {format_name!r}; there are {', '.join(formats.available_formats())}")
    raw = json.dumps({"messages": messages, "source_framework": "local", "metadata": {}})
    rows = adapters.normalized(spark.createDataFrame([("agno", "-", 0, raw)], scans.RAW), "agno")
    return json.loads(formats.formatted(rows, format_name).first()["value"])


def normalized(spark: SparkSession, path: str, source: str = "auto", compat: bool = False) -> DataFrame:
    name = adapters.source_name(source)
    return adapters.normalized(scans.read(spark, path, name), name, compat)


def accepted(df: DataFrame, skip_invalid: bool = False) -> DataFrame:
    """Rows without an error. Unless they are to be skipped, an error fails the query, naming the record."""
    if skip_invalid:
        return df.where("error is null")
    stop = F.raise_error(F.concat(F.lit("record "), F.col("rec_key"), F.lit(": "), F.col("error"))).cast("string")
    return df.withColumn("error", F.when(F.col("error").isNotNull(), stop)).where("error is null")


def rejected(df: DataFrame) -> DataFrame:
    return df.where("error is not null").select("rec_key", "error")


def convert(spark: SparkSession, path: str, source: str = "auto", format_name: str = "openai_chat", skip_invalid: bool = False, compat: bool = False, messages_only: bool = False, **options) -> DataFrame:
    """(value) for each interaction. messages_only leaves out metadata, and so tool schemas."""
    rows = accepted(normalized(spark, path, source, compat), skip_invalid)
    if messages_only:
        rows = rows.drop("metadata")
    return formats.formatted(rows, format_name, **options).select("value")


def save(df: DataFrame, uri: str, format_name: str = "openai_chat", check: bool = False, **options) -> storage.WriteResult:
    """Formats interactions and writes them; returns what was written. check leaves out invalid records."""
    records = formats.formatted(df, format_name).select("value")
    if check:
        records = validate.split(records, format_name)[0]
    return storage.write_jsonl(records, uri, format_name=format_name, **options)


def info(spark: SparkSession) -> DataFrame:
    """(kind, name) of all formats, sources and schemes."""
    rows = [("format", n) for n in formats.available_formats()] + [("source", n) for n in adapters.sources()] + [("scheme", n) for n in storage.schemes()]
    return spark.createDataFrame(rows, "kind string, name string")
