"""Plan helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one to three longs up to which a side is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spool_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset a temporary one, if all runs on this machine."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def _fs_path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs_path(spark, path)
    fs.delete(p, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        try:
            delete(spark, path)
        except Exception:  # the JVM is already gone: nothing can be removed through it
            return


#: Rows of an Arrow batch while a table is written; a task holds some batches on either side, and texts can be long.
BATCH_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """At most BATCH_ROWS rows in an Arrow batch of what is run within."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_ROWS if int(before) <= 0 else min(BATCH_ROWS, int(before))))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


class Spooled:
    """A DataFrame written once to the shared folder, so that its lineage ends there."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{spool_dir(self.spark)}/tw-{uuid.uuid4().hex}"
        with small_batches(self.spark):
            df.write.parquet(self.path)
        atexit.register(_at_exit, self.spark, self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def spool(df: DataFrame) -> DataFrame:
    return Spooled(df).df


def hinted(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows. Give a spooled, narrow df."""
    return F.broadcast(df) if df.count() <= limit else df


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` less the rows whose id is in the one column of ``ids``; a null id stays."""
    return docs.join(ids, docs[id_col] == ids[ids.columns[0]], "left_anti")


def equals(df: DataFrame, by: str) -> DataFrame:
    """(id, root) of the rows whose value of ``by`` a smaller id has, the smallest such. Equal values are counted
    before they are shuffled and never meet in one task."""
    low = df.groupBy(by).agg(F.min("id").alias("root"), F.count("*").alias("n")).where("n > 1").select(by, "root")
    return df.join(hinted(Spooled(low).df, BROADCAST_ROWS // 4), by).where("root <> id").select("id", "root")


def column(df: DataFrame, name: str) -> Column:
    """A top-level column whatever dots its name holds."""
    return df["`" + name.replace("`", "``") + "`"]


def number(df: DataFrame, name: str) -> Column:
    """An id: a whole number, or text that spells one. Anything else counts as a null id."""
    return column(df, name).try_cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of letters."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name += "_"
    return name
