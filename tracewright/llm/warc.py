"""WARC records as tables of chunks, so that no record is held whole.

A payload is rows (record, chunk, offset, length, data, digest, last): ``CHUNK`` bytes at most in each,
and the SHA-256 of the payload up to and including the chunk, carried on from chunk to chunk. The digest
of the last chunk is that of the record; any prefix of a transfer can be checked without what follows.

``read`` streams WARC files, plain or gzip by member, in blocks through one pass: headers, then payload
bytes straight into chunks; a task holds one chunk and one block. ``write`` makes files of records from a
table of payloads, ``write_chunks`` from a table of chunks. ``chunked`` cuts payloads that are already in a column, without copying them whole.

Defined cases: an empty payload is one chunk of length 0, marked last; a null record id or payload gives
no rows; records that share an id are cut each; an empty table gives no rows; further columns are
ignored. A file that ends inside a record gives the chunks that are there, none of them marked last. What is
no record (headers that can't be read or are longer than ``LINE``, a missing Content-Length, bytes between
records, damaged gzip members) is one row with an ``error`` and no chunk, and reading goes on at
the next line that begins a record, or the next member. Chunks are marked last only if their record is whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, number
from .kernels import buffers

CHUNK = 65536
#: Bytes of chunks that a task gathers before it hands them on.
FLUSH = 8_000_000
BLOCK = 1 << 16
#: Bytes of a header line; a longer one is no header.
LINE = 1 << 20
_MEMBER = b"\x1f\x8b\x08"

ORACLE_SQL = """
WITH p AS (SELECT page_id, hex(encode(html)) AS x FROM pages WHERE page_id IS NOT NULL AND html IS NOT NULL),
c AS (SELECT page_id, x, unnest(range(CAST(greatest(1, ceil(length(x) / 131072.0)) AS INTEGER))) AS k FROM p)
SELECT page_id, CAST(k AS INTEGER) AS chunk, CAST(k * 65536 AS BIGINT) AS "offset",
  CAST(length(substr(x, k * 131072 + 1, 131072)) // 2 AS INTEGER) AS length,
  base64(unhex(substr(x, k * 131072 + 1, 131072))) AS data,
  sha256(unhex(substr(x, 1, (k + 1) * 131072))) AS digest, (k + 1) * 131072 >= length(x) AS last
FROM c"""


def chunks(payload, size: int = CHUNK) -> Iterator[tuple[int, int, memoryview, str, bool]]:
    """(chunk, offset, data, digest so far, last) of a buffer, without copying it."""
    view, digest, n = memoryview(payload), hashlib.sha256(), len(payload)
    for k, at in enumerate(range(0, max(n, 1), size)):
        part = view[at : at + size]
        digest.update(part)
        yield k, at, part, digest.hexdigest(), at + size >= n


class _Rows:
    """Chunks gathered into record batches of about FLUSH bytes."""

    def __init__(self, kind: pa.DataType, text: bool):
        self.kind, self.text = kind, text
        self.clear()

    def clear(self) -> None:
        self.cols: list[list] = [[] for _ in range(7)]
        self.bytes = 0

    def add(self, record, k: int, at: int, part, digest: str, last: bool) -> None:
        data = base64.b64encode(part).decode() if self.text else bytes(part)
        for c, v in zip(self.cols, (record, k, at, len(part), data, digest, last), strict=True):
            c.append(v)
        self.bytes += len(part)

    def batch(self) -> pa.RecordBatch:
        kinds = (self.kind, pa.int32(), pa.int64(), pa.int32(), pa.string() if self.text else pa.binary(), pa.string(), pa.bool_())
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.cols, kinds, strict=True)], names=["record", "chunk", "offset", "length", "data", "digest", "last"])
        self.clear()
        return out


def chunked(records: DataFrame, id_col: str, payload_col: str, size: int = CHUNK, as_base64: bool = False) -> DataFrame:
    """(record, chunk, offset, length, data, digest, last); data is binary, or base64 text."""

    def run(batches):
        rows = _Rows(pa.int64(), as_base64)
        for batch in batches:
            data, offsets = buffers(batch.column("payload"))
            for k, record in enumerate(batch.column("record").to_pylist()):
                for c in chunks(data[offsets[k] : offsets[k + 1]], size):
                    rows.add(record, *c)
                    if rows.bytes >= FLUSH:
                        yield rows.batch()
        yield rows.batch()

    src = records.select(number(records, id_col).alias("record"), column(records, payload_col).cast("string").alias("payload")).where("record is not null and payload is not null")
    return src.mapInArrow(run, f"record long, chunk int, offset long, length int, data {'string' if as_base64 else 'binary'}, digest string, last boolean")


class Source:
    """Bytes of a file, decompressed if it is gzip, one block at a time. What can't be decompressed ends the bytes
    until ``recover`` finds the next member; ``damage`` then says why."""

    def __init__(self, file: BinaryIO):
        self.file, self.held, self.zip, self.rest, self.damage = file, b"", None, b"", ""
        head = file.read(BLOCK)
        if head[:2] == b"\x1f\x8b":
            self.zip, self.rest = zlib.decompressobj(31), head
        else:
            self.held = head

    def _more(self) -> bytes:
        if self.zip is None:
            return self.file.read(BLOCK)
        while not self.damage:
            raw = self.rest or self.file.read(BLOCK)
            if not raw:
                return b""
            try:
                out = self.zip.decompress(raw, BLOCK)
            except zlib.error as e:
                self.damage, self.rest = str(e), raw
                return b""
            self.rest = self.zip.unconsumed_tail
            if self.zip.eof:  # the next member is the next record
                self.rest, self.zip = self.zip.unused_data, zlib.decompressobj(31)
            if out:
                return out
        return b""

    def recover(self) -> bool:
        """To the next gzip member after what is damaged; False if there is none."""
        raw = self.rest[1:]
        while (at := raw.find(_MEMBER)) < 0:
            more = self.file.read(BLOCK)
            if not more:
                self.rest = b""
                return False
            raw = raw[-2:] + more
        self.rest, self.held, self.damage, self.zip = raw[at:], b"", "", zlib.decompressobj(31)
        return True

    def line(self) -> bytes | None:
        """Up to a line feed; None at the end of the file, and if there is none within LINE bytes."""
        while (at := self.held.find(b"\n")) < 0:
            if len(self.held) > LINE or not (more := self._more()):
                return None
            self.held += more
        out, self.held = self.held[: at + 1], self.held[at + 1 :]
        return out

    def skip(self) -> bool:
        """To the next line that begins a record; False if there is none."""
        seen = b"\n" + self.held
        while (at := seen.find(b"\nWARC/")) < 0:
            more = self._more()
            if not more:
                self.held = b""
                return False
            seen = seen[-5:] + more
        self.held = seen[at + 1 :]
        return True

    def read(self, n: int) -> bytes:
        """n bytes; fewer if the file ends or is damaged."""
        out = bytearray()
        while len(out) < n:
            if not self.held and not (more := self._more()):
                break
            self.held = self.held or more
            take = n - len(out)
            out += self.held[:take]
            self.held = self.held[take:]
        return bytes(out)


def records(file: BinaryIO, size: int = CHUNK) -> Iterator[tuple[dict[str, str], Iterator[tuple[int, int, bytes, str, bool]]]]:
    """Headers of each record and its chunks. Take a record's chunks before the next record. What can't be read has
    the header ``error`` and no chunks."""
    src = Source(file)
    while True:
        head: dict[str, str] = {}
        line = src.line()
        while line is not None and not line.strip():
            line = src.line()
        wrong = ""
        if line is None:
            wrong = src.damage or ("a line is too long" if src.held and len(src.held) > LINE else "bytes that are no record" if src.held else "")
            if not wrong:
                return
        elif not line.startswith(b"WARC/"):
            wrong = "bytes that are no record"
        else:
            while (line := src.line()) is not None and line.strip():
                key, _, value = line.decode("utf-8", "replace").partition(":")
                head[key.strip().lower()] = value.strip()
            if line is None:
                wrong = src.damage or "headers that don't end"
            elif not head.get("content-length", "").isdigit():
                wrong = "no Content-Length"
        if not wrong:
            body = _chunked(src, int(head["content-length"]), size)
            yield head, body
            for _ in body:  # what the caller left
                pass
            wrong = src.damage
            if not wrong:
                continue
        yield head | {"error": wrong}, iter(())
        if not (src.recover() if src.damage else src.skip()) and not (src.damage and src.recover()):
            return


def _chunked(src: Source, n: int, size: int) -> Iterator[tuple[int, int, bytes, str, bool]]:
    digest, at, k = hashlib.sha256(), 0, 0
    while at < n or not k:
        part = src.read(min(size, n - at))
        if len(part) < min(size, n - at):  # the file ends here
            if part:
                digest.update(part)
                yield k, at, part, digest.hexdigest(), False
            return
        digest.update(part)
        yield k, at, part, digest.hexdigest(), at + len(part) >= n
        at, k = at + len(part), k + 1


def _open(path: str) -> BinaryIO:
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return where.open_input_file(name)


def _paths(spark: SparkSession, path: str) -> list[str]:
    """Files at path and in its folders, but for hidden ones."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top, each, found = fs.makeQualified(base).toUri().getPath(), fs.listFiles(base, True), []
    while each.hasNext():
        uri = each.next().getPath().toUri()
        if not any(part.startswith(("_", ".")) for part in uri.getPath()[len(top) :].split("/")):
            found.append(uri.toString().replace("file:/", "file:///").replace("file://///", "file:///"))
    return sorted(found)


def read(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """(file, record, type, target, chunk, offset, length, data, digest, last, error) of the WARC files at path, a file a task."""
    files = _paths(spark, path)
    names = ["file", "record", "type", "target", "chunk", "offset", "length", "data", "digest", "last", "error"]
    kinds = [pa.string()] * 4 + [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.bool_(), pa.string()]

    def rows_of(file: str):
        with _open(file) as f:
            for head, body in records(f, size):
                known = (file, head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"))
                if "error" in head:
                    yield (*known, *[None] * 6, head["error"])
                for k, at, part, digest, last in body:
                    yield (*known, k, at, len(part), part, digest, last, None)

    def run(batches):
        rows, held = [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                for row in rows_of(file):
                    rows.append(row)
                    held += (row[6] or 0) + 200
                    if held >= FLUSH:
                        yield out()
                        rows, held = [], 0
        if rows:
            yield out()

    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files)), "file")
    return listed.mapInArrow(run, "file string, record string, type string, target string, chunk int, offset long, length int, data binary, digest string, last boolean, error string")


def record_head(record: str, target: str | None, n: int, date: str = "1970-01-01T00:00:00Z") -> bytes:
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: {record}", *([f"WARC-Target-URI: {target}"] if target else []), f"WARC-Date: {date}", f"Content-Length: {n}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n"


def _written(src: DataFrame, path: str) -> int:
    """src: (record, target, total, first, last, data, part); the rows of a record follow one another."""

    def run(batches):
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        where.create_dir(base, recursive=True)
        n, out, temp, part, z = 0, None, f"{base}/.{uuid.uuid4().hex}", 0, None
        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("record", "target", "total", "first", "last", "part"))
            for record, target, total, first, last, part, data in zip(*cols, batch.column("data"), strict=True):
                out = out or where.open_output_stream(temp, compression=None)
                if first:
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.write(z.compress(record_head(f"<urn:record:{record}>", target, total)))
                    n += 1
                view = memoryview(data.as_buffer())
                for at in range(0, len(view), CHUNK):
                    out.write(z.compress(view[at : at + CHUNK]))
                if last:
                    out.write(z.compress(b"\r\n\r\n") + z.flush())
        if out:
            out.close()
            where.move(temp, f"{base}/part-{part:05d}.warc.gz")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return src.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def write(df: DataFrame, path: str, id_col: str, payload_col: str, target_col: str | None = None) -> int:
    """Writes a gzip WARC file for each partition, a member a record, and returns the number of records. The payload
    is text or binary and is compressed piece by piece. A task writes under a name of its own and renames at its
    end, so a repeated task leaves no half file."""
    target = column(df, target_col) if target_col else F.lit(None)
    payload, yes = column(df, payload_col).cast("binary"), F.lit(True)
    src = df.select(
        column(df, id_col).cast("string").alias("record"), target.cast("string").alias("target"), F.length(payload).cast("long").alias("total"),
        yes.alias("first"), yes.alias("last"), payload.alias("data"), F.spark_partition_id().alias("part"),
    )
    return _written(src.where("record is not null and data is not null"), path)


def write_chunks(rows: DataFrame, path: str) -> int:
    """Writes the records of a chunk table, as ``write`` does, holding a chunk at a time. rows: (record, chunk, offset,
    length, data, last) with binary data, and target if there is one; a record that lacks a chunk or its end is an error,
    as is one with a chunk twice."""
    key = column(rows, "record").cast("string").alias("record")
    target = column(rows, "target") if "target" in rows.columns else F.lit(None)
    src = rows.select(key, target.cast("string").alias("target"), *(column(rows, c) for c in ("chunk", "offset", "length", "data", "last"))).where("record is not null and chunk is not null")
    whole = src.groupBy("record").agg(F.max(F.col("offset") + F.col("length")).alias("total"), F.max("chunk").alias("end"), F.count("*").alias("n"), F.sum("length").alias("sum"), F.max("last").alias("done"))
    ok = (F.col("n") == F.col("end") + 1) & (F.col("sum") == F.col("total")) & F.col("done")
    whole = whole.select("record", F.when(ok, F.col("total")).otherwise(F.raise_error(F.concat(F.lit("chunks missing of record "), "record"))).cast("long").alias("total"), "end")
    each = src.join(whole, "record").repartition("record").sortWithinPartitions("record", "chunk")
    flags = ((F.col("chunk") == 0).alias("first"), (F.col("chunk") == F.col("end")).alias("last"))
    return _written(each.select("record", "target", "total", *flags, "data", F.spark_partition_id().alias("part")), path)
