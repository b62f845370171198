"""Places to read from and write to: URIs, backends by scheme, JSON-lines and JDBC sinks."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import parse_qs, urlencode, urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class StorageError(RuntimeError):
    pass


@dataclass(frozen=True)
class Place:
    """A parsed URI. A one-letter scheme is the drive of a path."""

    uri: str
    scheme: str
    path: str
    bucket: str = ""
    options: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, uri: str) -> Place:
        u = urlsplit(uri)
        if "://" not in uri or len(u.scheme) < 2:
            return cls(uri, "file", uri)
        scheme = {"gcs": "gs", "postgres": "postgresql"}.get(u.scheme.lower(), u.scheme.lower())
        if scheme == "file":
            return cls(uri, scheme, u.path)
        return cls(uri, scheme, u.path.lstrip("/"), u.netloc, {k: v[-1] for k, v in parse_qs(u.query).items()})

    @property
    def shown(self) -> str:
        """The URI without a password."""
        return re.sub(r"(://[^:/@]*):[^@/]*@", r"\1:***@", self.uri)


@dataclass
class WriteResult:
    uri: str
    records_written: int
    bytes_written: int
    backend: str


Backend = Callable[[SparkSession, Place], str]
#: Writes rows of ``value`` to a place, in mode w or a, by whatever Spark writer.
Writer = Callable[[DataFrame, Place, str], None]
_backends: dict[str, tuple[str, Backend]] = {}
_writers: dict[str, Writer] = {}


def register_backend(schemes: str | list[str], name: str, path_of: Backend, writer: Writer | None = None) -> None:
    """path_of gives the path Spark reads or writes for a place of these schemes. With a writer, rows go to it
    instead of JSON-lines files at that path."""
    for s in [schemes] if isinstance(schemes, str) else schemes:
        _backends[s.lower()] = name, path_of
        _writers.pop(s.lower(), None)
        if writer:
            _writers[s.lower()] = writer


def backend_of(uri: str) -> tuple[str, Backend]:
    scheme = Place.parse(uri).scheme
    if scheme not in _backends:
        raise StorageError(f"no backend for {scheme!r}; there are {', '.join(schemes())}")
    return _backends[scheme]


def schemes() -> list[str]:
    return sorted(_backends)


def _r2(spark: SparkSession, p: Place) -> str:
    """An S3 bucket at an endpoint of its own: an option, the environment, or the account's."""
    account = p.options.get("account_id") or os.environ.get("R2_ACCOUNT_ID")
    end = p.options.get("endpoint_url") or os.environ.get("R2_ENDPOINT_URL") or (f"https://{account}.r2.cloudflarestorage.com" if account else None)
    if not end:
        raise StorageError("an r2 URI needs endpoint_url, R2_ENDPOINT_URL or an account id")
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.s3a.bucket.{p.bucket}.endpoint", end)
    return f"s3a://{p.bucket}/{p.path}"


def _no_read(spark: SparkSession, p: Place) -> str:
    raise StorageError(f"{p.scheme} can be written, not read")


register_backend("file", "local", lambda _, p: p.path)
register_backend(["s3", "s3a"], "s3", lambda _, p: f"s3a://{p.bucket}/{p.path}")
register_backend("r2", "s3", _r2)
register_backend("gs", "gcs", lambda _, p: f"gs://{p.bucket}/{p.path}")
register_backend(["az", "abfs", "abfss"], "azure", lambda _, p: f"{'abfss' if p.scheme == 'az' else p.scheme}://{p.bucket}/{p.path}")
register_backend("postgresql", "postgres", _no_read)


def spark_path(spark: SparkSession, uri: str) -> str:
    return backend_of(uri)[1](spark, Place.parse(uri))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def check(spark: SparkSession, uri: str) -> dict[str, Any]:
    """What is known of a place without reading it."""
    place, (name, path_of) = Place.parse(uri), backend_of(uri)
    about: dict[str, Any] = {"uri": place.shown, "scheme": place.scheme, "backend": name, "path": place.path, "bucket": place.bucket or None, "key": place.path if place.bucket else None, "exists": None}
    if path_of is not _no_read:
        fs, p = _fs(spark, path_of(spark, place))
        about["exists"] = bool(fs.exists(p))
    return about


def batched(items: list, n: int) -> Iterator[list]:
    if n <= 0:
        raise ValueError("a batch holds at least one")
    for k in range(0, len(items), n):
        yield items[k : k + n]


def write_jsonl(df: DataFrame, uri: str, mode: str = "w", compression: str = "infer", single: bool = False, batch_size: int = 1000, dataset: str = "default", format_name: str = "", metadata: dict | None = None) -> WriteResult:
    """Rows of ``value`` (JSON text) as lines. w replaces what is there once all is written, a adds to it.

    A path is a folder of part files; single joins these to one file once they are written. Metadata is kept
    by JDBC alone.
    """
    if mode not in ("w", "a"):
        raise ValueError("mode is w or a")
    place = Place.parse(uri)
    name, path_of = backend_of(uri)
    seen = Observation()
    counted = df.select("value").observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes"))
    if (writer := _writers.get(place.scheme)) is not None:
        writer(counted, place, mode)
    elif name == "postgres":
        _write_jdbc(counted, place, batch_size, dataset, format_name, metadata or {})
    else:
        spark = df.sparkSession
        path = path_of(spark, place)
        gz = compression == "gzip" or (compression == "infer" and any(s in (".gz", ".gzip") for s in re.findall(r"\.[^./]+", path)))
        _write_text(counted, path, mode, "gzip" if gz else "none", single)
    # a plan that Spark knows to be empty reports nothing, and waiting for it would not end
    planned = "CollectMetrics" in counted._jdf.queryExecution().optimizedPlan().toString()
    got = seen.get if planned else {"n": 0, "bytes": 0}
    return WriteResult(place.shown, got["n"], got["bytes"], name)


def _replace(spark: SparkSession, staged: str, final: str) -> None:
    """Puts what is staged in the place of what is there. What was there stays until the new one has its name, or
    comes back: a file is replaced at once where the file system can, else the old one steps aside meanwhile."""
    fs, new = _fs(spark, staged)
    old = _fs(spark, final)[1]
    if fs.exists(old) and fs.getFileStatus(old).isFile() and fs.getFileStatus(new).isFile():
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        how[0] = hadoop.Options.Rename.OVERWRITE
        try:
            hadoop.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(new, old, how)
            return
        except Py4JJavaError:  # no such file context for this scheme, or none that replaces
            if not fs.exists(new):
                raise
    aside = _fs(spark, f"{final.rstrip('/')}.{uuid.uuid4().hex}.old")[1] if fs.exists(old) else None
    if aside is not None and not fs.rename(old, aside):
        raise StorageError(f"{final} can't be moved aside")
    if not fs.rename(new, old):
        if aside is not None:
            fs.rename(aside, old)
        raise StorageError(f"{staged} can't be renamed to {final}")
    if aside is not None:
        fs.delete(aside, True)


def _joined(spark: SparkSession, parts: list, into: str) -> None:
    """Files one after another; gzip members may follow one another."""
    fs, whole = _fs(spark, into)
    out = fs.create(whole)
    for p in parts:
        source = fs.open(p)
        spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
        source.close()
    out.close()


def _write_text(df: DataFrame, path: str, mode: str, codec: str, single: bool) -> None:
    spark = df.sparkSession
    fs, final = _fs(spark, path)
    if not single and mode == "a":
        df.write.mode("append").text(path, compression=codec)
        return
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    try:
        df.write.text(staged, compression=codec)  # by all tasks, also for one file
        if not single:
            _replace(spark, staged, path)
            return
        parts = sorted((s.getPath() for s in fs.listStatus(_fs(spark, staged)[1]) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
        _joined(spark, [*([final] if mode == "a" and fs.exists(final) else []), *parts], f"{staged}/joined")
        _replace(spark, f"{staged}/joined", path)
    finally:
        fs.delete(_fs(spark, staged)[1], True)


_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def jdbc_plan(place: Place, batch_size: int = 1000) -> dict[str, str]:
    """Options of the JDBC writer. The target and a staging table beside it are plain identifiers."""
    schema, table = place.options.get("schema", "public"), place.options.get("table", "agent_records")
    for n in (schema, table):
        if not _NAME.fullmatch(n):
            raise StorageError(f"{n!r} is no identifier")
    if batch_size <= 0:
        raise ValueError("a batch holds at least one")
    host = place.bucket.rpartition("@")[2]
    user, _, password = place.bucket.rpartition("@")[0].partition(":")
    rest = {k: v for k, v in place.options.items() if k not in ("schema", "table", "dataset", "format")} | {"stringtype": "unspecified"}
    out = {"url": f"jdbc:postgresql://{host}/{place.path}?{urlencode(rest)}", "dbtable": f'"{schema}"."{table}"', "batchsize": str(batch_size), "driver": "org.postgresql.Driver"}
    return out | ({"user": user} if user else {}) | ({"password": password} if password else {})


def jdbc_ddl(options: dict[str, str]) -> str:
    return (
        f"CREATE TABLE IF NOT EXISTS {options['dbtable']} (id bigserial PRIMARY KEY, dataset text NOT NULL, format text NOT NULL, "
        "payload jsonb NOT NULL, metadata jsonb NOT NULL DEFAULT '{}'::jsonb, created_at timestamptz NOT NULL DEFAULT now())"
    )


def jdbc_rows(df: DataFrame, dataset: str, format_name: str, metadata: dict) -> DataFrame:
    import json

    return df.select(F.lit(dataset).alias("dataset"), F.lit(format_name).alias("format"), F.col("value").alias("payload"), F.lit(json.dumps(metadata, ensure_ascii=False)).alias("metadata"), F.current_timestamp().alias("created_at"))


def _write_jdbc(df: DataFrame, place: Place, batch_size: int, dataset: str, format_name: str, metadata: dict) -> None:
    """Appends, whatever the mode: tasks fill a staging table, one statement moves it, so a repeated task adds nothing."""
    options = jdbc_plan(place, batch_size)
    rows = jdbc_rows(df, place.options.get("dataset", dataset), place.options.get("format", format_name), metadata)
    staging = options | {"dbtable": options["dbtable"][:-1] + f'_{uuid.uuid4().hex[:12]}"'}
    rows.write.format("jdbc").options(**staging).mode("overwrite").save()
    connect = df.sparkSession.sparkContext._jvm.java.sql.DriverManager.getConnection
    db = connect(options["url"], options.get("user", ""), options.get("password", ""))
    try:
        db.setAutoCommit(False)
        run = db.createStatement().execute
        run(jdbc_ddl(options))
        run(f"INSERT INTO {options['dbtable']} (dataset, format, payload, metadata, created_at) SELECT dataset, format, payload::jsonb, metadata::jsonb, created_at FROM {staging['dbtable']}")
        run(f"DROP TABLE {staging['dbtable']}")
        db.commit()
    finally:
        db.close()


def write_json(spark: SparkSession, value: Any, uri: str) -> WriteResult:
    """One document."""
    import json

    name, path_of = backend_of(uri)
    if name == "postgres":
        raise StorageError("a single document can't go to a database")
    data = (json.dumps(value, ensure_ascii=False, separators=(",", ":")) + "\n").encode()
    fs, p = _fs(spark, path_of(spark, Place.parse(uri)))
    out = fs.create(p, True)
    out.write(bytearray(data))
    out.close()
    return WriteResult(Place.parse(uri).shown, 1, len(data), name)


def read_jsonl(spark: SparkSession, uri: str) -> DataFrame:
    """(value) of each line that isn't blank; a line that isn't JSON fails the query."""
    from .scans import jsonl

    raw = jsonl(spark, spark_path(spark, uri)).select("raw")
    bad = F.raise_error(F.concat(F.lit("not JSON: "), F.substring("raw", 1, 200))).cast("string")
    return raw.select(F.when(F.try_parse_json("raw").isNull(), bad).otherwise(F.col("raw")).alias("value"))


def stdout(df: DataFrame) -> int:
    """Prints lines as they come, a partition at a time."""
    n = 0
    for row in df.select("value").toLocalIterator():
        print(row["value"])
        n += 1
    return n


def key_values(pairs: list[str]) -> dict[str, str]:
    """K=V, cut at the first =."""
    out = {}
    for p in pairs:
        k, eq, v = p.partition("=")
        if not eq or not k.strip():
            raise ValueError(f"{p!r} is not KEY=VALUE")
        out[k.strip()] = v
    return out
