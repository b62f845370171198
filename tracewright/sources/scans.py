"""Scans of trace exports: JSON documents, JSON lines, gzip and text at hand, as rows (source, file, pos, raw).

``raw`` is the record's exact JSON text: a schema inferred over all records would lose which keys are absent,
and how numbers are spelled.
"""

from __future__ import annotations

import json
import re
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonx import not_blank
from ..schema import RAW

LINES = (".jsonl", ".ndjson")


def suffixes(path: str) -> list[str]:
    name = re.split(r"[\\/]", path.split("?", 1)[0].rstrip("/\\"))[-1]
    return [f".{s}" for s in name.lower().split(".")[1:]]


def is_lines(path: str, source: str = "auto") -> bool:
    """Whether a path holds a record a line: by the source's name or any suffix."""
    return source == "jsonl" or any(s in LINES for s in suffixes(path))


def _named(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("source", F.lit(source)).select("source", "file", F.col("pos").cast("bigint").alias("pos"), "raw")


def jsonl(spark: SparkSession, path: str | list[str], source: str = "jsonl") -> DataFrame:
    """A record a line, blank lines left out; compression by suffix. pos orders the records of a file.

    Lines are split and placed by Spark's text scan, so a large file is read by many tasks; pos grows with
    the place in the file but has gaps between splits.
    """
    lines = spark.read.text(path).select(F.col("value").alias("raw"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("pos"))
    return _named(lines.where(not_blank(F.col("raw"))), source)


def numbered_jsonl(spark: SparkSession, path: str | list[str], source: str = "jsonl") -> DataFrame:
    """jsonl() with pos counting from 0 without gaps in each file, for messages that name a record; a file a task."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\r?\n").alias("lines"))
    kept = whole.select("file", F.posexplode(F.filter("lines", not_blank)).alias("pos", "raw"))
    return _named(kept, source)


def _records(batches):
    """The elements of a document that is a list, else the document, each as its own text."""
    for batch in batches:
        file, pos, raw = [], [], []
        for name, text in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
            parts = elements(text)
            file += [name] * len(parts)
            pos += range(len(parts))
            raw += parts
        yield pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(pos, pa.int64()), pa.array(raw, pa.string())], names=["file", "pos", "raw"])


def elements(text: str) -> list[str]:
    """Texts of a JSON list's elements, as they are spelled; a document that isn't a list, or not JSON, by itself."""
    decoder, body = json.JSONDecoder(), text.strip().lstrip("﻿").strip()
    if not body:
        return []
    if body[0] != "[":
        return [body]
    out, at = [], 1
    blank = re.compile(r"[\s,]*")
    try:
        while (at := blank.match(body, at).end()) < len(body) and body[at] != "]":
            _, end = decoder.raw_decode(body, at)
            out.append(body[at:end])
            at = end
    except ValueError:
        return [body]
    return out if at < len(body) else [body]


def documents(spark: SparkSession, path: str | list[str], source: str = "auto") -> DataFrame:
    """A JSON document a file."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return _named(whole.mapInArrow(_records, "file string, pos long, raw string"), source)


class BadInput(ValueError):
    pass


def given(spark: SparkSession, text: str, source: str = "auto") -> DataFrame:
    """Text from a pipe: one JSON document, or else a record a line; nothing is no record."""
    try:
        json.loads(text)
        parts = elements(text)
    except ValueError:
        parts = []
        for k, line in enumerate(text.splitlines(), 1):
            if line.strip():
                try:
                    json.loads(line)
                except ValueError as e:
                    raise BadInput(f"line {k}: {e}") from e
                parts.append(line.strip())
    return spark.createDataFrame([(source, "-", k, p) for k, p in enumerate(parts)], RAW)


def read(spark: SparkSession, path: str, source: str = "auto") -> DataFrame:
    """Any of the above, by path and source. ``-`` is the standard input."""
    if path == "-":
        return given(spark, sys.stdin.read(), source)
    from .storage import spark_path

    where = spark_path(spark, path)
    return jsonl(spark, where, source) if is_lines(path, source) else documents(spark, where, source)


def problem(raw: Column) -> Column:
    """Why a text is no record, or null: it isn't JSON, or not an object."""
    shape = F.schema_of_variant(F.try_parse_json(raw))
    return F.when(shape.isNull(), "not JSON").when(~shape.startswith("OBJECT"), "not a JSON object")


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejected rows with an ``error``)."""
    judged = df.withColumn("error", problem(F.col("raw")))
    return judged.where("error is null").drop("error"), judged.where("error is not null")
