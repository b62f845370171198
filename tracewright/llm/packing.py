"""Best-fit decreasing packing of documents into sequences of ``CAPACITY`` tokens.

A document longer than a sequence is cut into full sequences and a rest. Pieces of one length are
interchangeable, and so are bins of one remaining capacity. So the packing is decided on the histogram
of lengths, whatever the number of documents: lengths from long to short; for each, a segment tree
over remaining capacities finds the tightest open bin that has room; as many pieces as bins of that
kind go there at once. The result is that of best-fit decreasing over all pieces of the corpus, piece
by piece. It is a list of runs: pieces so many to so many of a length go to bins from so many on. Its
length depends on ``CAPACITY``, not on the corpus. Pieces are numbered within their length in parts of about
``TOGETHER``, so that no length is numbered in one task; the parts' first numbers are from counts. Of bins that
are equally tight, the one takes the piece that came to that room first.

Defined cases: a null text or a text without tokens goes to no bin; a null id is kept as such; rows
that share an id are packed each; pieces of one length are taken by part, id, row hash and chunk. An
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spooled, column, number
from .kernels import batch_blocks, byte_prefix, hash_spans
from .tokens import VOCABULARY, tokenizer

CAPACITY = 2048
#: Pieces of one length that are numbered together, about.
TOGETHER = 1_000_000


class SegmentTree:
    """Which remaining capacities have an open bin; the least one at or above a length in O(log n)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def set(self, i: int, n: int) -> None:
        i += self.size
        self.count[i] = n
        while i > 1:
            i >>= 1
            self.count[i] = self.count[2 * i] + self.count[2 * i + 1]

    def least(self, at: int) -> int:
        """Smallest i >= at with a bin, or -1."""
        i = at + self.size
        if self.count[i]:
            return at
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, piece, bin, per, room) by best-fit decreasing: pieces ``piece`` and on of a length, up
    to the next run of it, go ``per`` after one another to bins ``bin`` and on, which had ``room`` left.

    Where the tightest bin has room for a second piece it is the tightest again, so each bin of a kind
    takes room // length pieces in a row, a new bin too.
    """
    tree = SegmentTree(capacity)
    open_: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]  # by room: runs of bins
    have = [0] * (capacity + 1)
    out, bins = [], 0

    def change(room: int, n: int) -> None:
        have[room] += n
        tree.set(room, have[room])

    for length in sorted(histogram, reverse=True):
        piece, left = 0, histogram[length]
        while left:
            room = tree.least(length)
            if room < 0:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_[room].popleft()
                change(room, -n)
            per = min(room // length, left)
            used = min(n, left // per)
            out.append((length, piece, first, per, room))
            piece, left = piece + used * per, left - used * per
            if room > per * length:
                open_[room - per * length].append((first, used))
                change(room - per * length, used)
            if n > used:
                open_[room].appendleft((first + used, n - used))
                change(room, n - used)
    return out


def _sized(capacity: int, vocabulary: str):
    def run(batches):
        tok = tokenizer(vocabulary)
        for batch, i, j, data, offsets in batch_blocks(batches, "text"):
            n = tok.counts(data, offsets)
            h = hash_spans(byte_prefix(data), offsets[:-1], offsets[1:])
            full, rest = n // capacity, n % capacity
            chunks = full + (rest > 0)
            row = np.repeat(np.arange(j - i), chunks)
            chunk = np.arange(len(row)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
            length = np.where(chunk < full[row], capacity, rest[row])
            ids = batch.column("id").slice(i, j - i).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([ids, pa.array(chunk.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(h.view(np.int64)[row])], names=["doc_id", "chunk", "length", "row"])

    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, chunk, length, row): the pieces of each row's text, and a hash of it."""
    src = docs.select(number(docs, id_col).alias("id"), column(docs, text_col).alias("text")).where("text is not null")
    return src.mapInArrow(_sized(capacity, vocabulary), "doc_id long, chunk int, length int, row long")


def _lookup(counts: list[tuple[int, int, int]], capacity: int) -> dict[str, np.ndarray]:
    """The plan and the parts' first numbers as sorted arrays. counts: (length, part, n)."""
    histogram: dict[int, int] = {}
    parts, base = [], []
    for length, part, n in sorted(counts):
        parts.append((length << 40) + part)
        base.append(histogram.get(length, 0))
        histogram[length] = base[-1] + n
    runs = np.array(sorted(plan(histogram, capacity)) or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    return {"parts": np.array(parts, np.int64), "base": np.array(base, np.int64), "runs": runs}


def _at(known: dict[str, np.ndarray], capacity: int, length: np.ndarray, part: np.ndarray, rank: np.ndarray):
    """Bin and place of pieces by their rank within length and part."""
    rank = rank + known["base"][np.searchsorted(known["parts"], (length << 40) + part)]
    runs = known["runs"]
    r = runs[np.searchsorted((runs[:, 0] << 48) + runs[:, 1], (length << 48) + rank, side="right") - 1]
    turn = rank - r[:, 1]
    return r[:, 2] + turn // r[:, 3], capacity - r[:, 4] + turn % r[:, 3] * length


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, together: int = TOGETHER) -> DataFrame:
    """(doc_id, start, length, bin, place): tokens from ``start`` on, ``length`` of them, of the document
    are in sequence ``bin`` from ``place`` on."""
    hashed = pieces(docs, id_col, text_col, capacity, vocabulary).withColumn("hash", F.xxhash64("doc_id", "row", "chunk"))
    sized = Spooled(hashed).df
    parts = [1] * (capacity + 1)
    for length, n in sized.groupBy("length").agg(F.count("*")).collect():
        parts[length] = -(-n // together)
    sized = sized.withColumn("part", F.pmod("hash", F.element_at(F.lit(parts), F.col("length") + 1)))
    counts = [tuple(r) for r in sized.groupBy("length", "part").agg(F.count("*").alias("n")).collect()]
    known = docs.sparkSession.sparkContext.broadcast(_lookup(counts, capacity))

    def run(batches):
        for b in batches:
            bin_, place = _at(known.value, capacity, *(b.column(c).to_numpy().astype(np.int64) for c in ("length", "part", "rank")))
            start = pa.array(b.column("chunk").to_numpy().astype(np.int64) * capacity)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), start, b.column("length"), pa.array(bin_), pa.array(place.astype(np.int32))], names=["doc_id", "start", "length", "bin", "place"])

    ranked = sized.withColumn("rank", F.expr("row_number() over (partition by length, part order by doc_id, row, chunk) - 1"))
    return ranked.mapInArrow(run, "doc_id long, start long, length int, bin long, place int")
