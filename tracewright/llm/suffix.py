"""Passages of ``LENGTH`` or more words that occur before, by a distributed difference-cover suffix sort.

The string is made of words (white space apart, as 64-bit hashes). The suffixes at positions 1 and 2
modulo 3 are the sample: their triples are sorted across buckets and named in order; the names, first
those of positions 1 then those of 2, are the next level's string, on which the same is done. The
recursion ends when a name covers ``LENGTH`` words, since no later word can matter. On the way back the
remaining suffixes, at positions 0 modulo 3, are merged with the ranked sample: two suffixes compare by
one or two letters and then by ranks. In the final order suffixes with the same first ``LENGTH`` words
are neighbours: adjacent prefixes are compared, and of those that are equal all but the first one (least
document, then least position) are repeats.

Before sorting, what can't repeat is left out, exactly: any ``LENGTH`` words hold the least of their
``WINDOW``-word windows (by hash); only where such a window occurs twice in the corpus can a passage
repeat, so the string is made of the stretches around these. Bloom filters say which windows those are: what
passes them by chance is sorted for nothing, and nothing is missed. They go to every task up to
``FILTER_BYTES``; larger ones are replaced by a join of the windows' places with their documents. Of documents with the same text one goes
into the string; the others are repeats as a whole.

Letters travel packed: a row is all that one task has for one bucket, as a binary array, so that sorting
is numpy's work and a shuffle moves bytes, not rows. A position is a blob of stretches and a place in
it; blobs follow the order of documents. Every level is written to the shared folder, so lineage is
short, and the level before is removed once it isn't needed.

Defined cases: a null id or text has no passage; rows that share an id are one document, whose text is
that with the least MD5; a document of fewer than ``LENGTH`` words has none; overlapping repeats within
one document count; passages don't cross documents. An empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Spooled, column, equals, fresh, hinted, number
from .kernels import SPACE, U, batch_blocks, buffers, frugal, mix, spans, windows, words

LENGTH = 51
WINDOW = 34
#: Words of a blob and bytes of a bucket, about.
BLOB = 1 << 18
BUCKET = 24_000_000
#: Bits of a filter for each window hash that occurs twice, and bytes of all filters up to which every task gets them.
FILTER_BITS = 12
FILTER_BYTES = 64_000_000
_LOW = U((1 << 32) - 1)
_PACKED = "key long, data binary"
_TOP = U((1 << 64) - 1)


def _pack(*cols: np.ndarray) -> bytes:
    return np.stack([c.astype(U, copy=False) for c in cols]).tobytes()


def _unpack(table: pa.Table | pa.RecordBatch, n: int) -> np.ndarray:
    frugal()
    return np.concatenate([np.frombuffer(raw.as_buffer(), U).reshape(n, -1) for raw in table.column("data")], axis=1)


def _rows(key: np.ndarray, *cols: np.ndarray) -> pa.RecordBatch:
    """One row for each key, with the columns of its entries packed."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)
    arranged = np.stack([c.astype(U, copy=False) for c in cols])[:, order]
    data = [np.ascontiguousarray(arranged[:, a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(key[cut[:-1]].astype(np.int64)), pa.array(data, pa.binary())], names=["key", "data"])


def _sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """best over x[i:i+n], shorter at the end."""
    out, have = x.copy(), 1
    while have < n:
        step = min(have, n - have)
        out[: len(out) - step] = best(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(hashes: np.ndarray, doc: np.ndarray, length: int = LENGTH, window: int = WINDOW):
    """Positions and hashes of the windows that are least in some ``length`` words. doc: of each word."""
    if len(hashes) < window:
        return np.zeros(0, np.int64), np.zeros(0, U)
    w = np.minimum(windows(hashes, window), _TOP - U(1))
    w[doc[: len(w)] != doc[window - 1 :]] = _TOP
    reach = length - window + 1
    low = _sliding(w, reach, np.minimum)
    high = _sliding(low[::-1], reach, np.maximum)[::-1]
    at = np.flatnonzero((w == high) & (w != _TOP))
    return at, w[at]


def _anchored(buckets: int, length: int, window: int):
    def run(batches):
        for batch, i, j, data, offsets in batch_blocks(batches, "text"):
            _, _, first, h = words(data, offsets, SPACE)
            doc = np.repeat(np.arange(j - i), np.diff(first))
            at, w = anchors(h, doc, length, window)
            ids = batch.column("id").slice(i, j - i).to_numpy().astype(np.int64).view(U)
            yield _rows(mix(w.copy()) % U(buckets), w, ids[doc[at]], (at - first[doc[at]]).astype(U))

    return run


def _repeated(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        w, ids, at = _unpack(table, 3)
        order = np.argsort(w, kind="stable")
        same = w[order][1:] == w[order][:-1]
        more = np.zeros(len(w), bool)
        more[1:] |= same
        more[:-1] |= same
        keep = order[more]
        return pa.Table.from_batches([_rows(mix(ids[keep]) % U(buckets), ids[keep], at[keep])])

    return run


def _by_document(table: pa.Table) -> pa.Table:
    ids, at = _unpack(table, 2)
    out = _rows(ids.view(np.int64), at)
    return pa.Table.from_arrays(out.columns, names=["id", "anchors"])


def _distinct_anchors(buckets: int, length: int, window: int):
    """Hashes of a block's anchors by bucket, each once, or twice if it occurs again in the block."""

    def run(batches):
        for _, i, j, data, offsets in batch_blocks(batches, "text"):
            _, _, first, h = words(data, offsets, SPACE)
            w, n = np.unique(anchors(h, np.repeat(np.arange(j - i), np.diff(first)), length, window)[1], return_counts=True)
            w = np.concatenate([w, w[n > 1]])
            yield _rows(mix(w.copy()) % U(buckets), w)

    return run


_STEPS = tuple(U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _places(w: np.ndarray, bits: np.ndarray | int):
    """Where a filter of 2**bits bits marks each hash."""
    return [mix(w * step) >> (U(64) - U(1) * np.asarray(bits).astype(U)) for step in _STEPS]


def _filter(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A bucket's Bloom filter of the hashes that occur twice: FILTER_BITS bits or more for each."""
    w = np.sort(_unpack(table, 1)[0])
    w = np.unique(w[1:][w[1:] == w[:-1]])
    size = max(6, int(len(w) * FILTER_BITS).bit_length())
    marked = np.zeros(1 << size, bool)
    for at in _places(w, size):
        marked[at] = True
    return pa.table({"key": pa.array([key[0].as_py()]), "data": pa.array([np.packbits(marked, bitorder="little").tobytes() if len(w) else b""], pa.binary())})


class Repeated:
    """Filters of all buckets: which window hashes may occur twice. Some others pass too; sorting leaves them out."""

    def __init__(self, buckets: int, rows: pa.Table):
        self.size = np.zeros(buckets, np.int64)
        self.base = np.zeros(buckets, np.int64)
        parts, done = [np.zeros(1, np.uint8)], 1
        for key, raw in zip(rows.column("key").to_pylist(), rows.column("data"), strict=True):
            part = np.frombuffer(raw.as_buffer(), np.uint8)
            self.size[key], self.base[key] = (len(part) * 8).bit_length() - 1 if len(part) else 0, done
            parts.append(part)
            done += len(part)
        self.bits = np.concatenate(parts)

    def has(self, w: np.ndarray) -> np.ndarray:
        bucket = (mix(w.copy()) % U(len(self.size))).astype(np.int64)
        size, base = self.size[bucket], self.base[bucket]
        ok = size > 0
        for at in _places(w, np.maximum(size, 6)):
            at = at.astype(np.int64)
            ok[ok] = self.bits[base[ok] + (at[ok] >> 3)] >> (at[ok] & 7).astype(np.uint8) & 1 > 0
        return ok


def _open_words(at: np.ndarray, doc: np.ndarray, first: np.ndarray, length: int, window: int):
    """(document, first word, word after the last) of the stretches that windows at the words ``at`` leave open."""
    n = int(first[-1])
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.maximum(at - (length - window), first[doc]), 1)
    np.add.at(edge, np.minimum(at + length, first[doc + 1]), -1)
    on = np.cumsum(edge[:-1]) > 0
    begins = np.zeros(n + 1, bool)
    begins[first] = True  # a stretch ends with its document
    start = np.flatnonzero(on & (begins[:-1] | ~np.append(False, on[:-1])))
    end = np.flatnonzero(on & (begins[1:] | ~np.append(on[1:], False))) + 1
    long = end - start >= length
    return np.searchsorted(first, start[long], side="right") - 1, start[long], end[long]


def _stretches(length: int, window: int, shared=None):
    """(id, start, words): the stretches of a document that its repeated windows leave open; these are found by the
    filters, or are in the column ``anchors``."""

    def run(batches):
        for batch, i, j, data, offsets in batch_blocks(batches, "text"):
            _, _, first, h = words(data, offsets, SPACE)
            doc = np.repeat(np.arange(j - i), np.diff(first))
            if shared is not None:
                at, w = anchors(h, doc, length, window)
                at = at[shared.value.has(w)]
            else:
                own = [np.frombuffer(x.as_buffer(), U).astype(np.int64) for x in batch.column("anchors").slice(i, j - i)]
                at = np.concatenate([x + f for x, f in zip(own, first[:-1], strict=True)])
            h = np.maximum(h, U(1))
            which, lo, hi = _open_words(at, doc[at], first, length, window)
            parts = [h[a:b].tobytes() for a, b in zip(lo, hi, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(which + i)), pa.array((lo - first[which]).astype(np.int64)), pa.array(parts, pa.binary())], names=["id", "start", "words"])

    return run


def _blobs(batches):
    """(key, data, ids, starts, places): stretches one after another, each ended by one to three zeros so that all
    begin at a multiple of 3. A key is the partition and a count, so keys follow the order of documents; the
    more blobs a partition has, the longer the next ones are, so that 2**11 hold whatever a task can."""
    from pyspark import TaskContext

    part, count = TaskContext.get().partitionId(), 0
    held: list[np.ndarray] = []
    ids, starts, places, size = [], [], [], 0

    def out():
        nonlocal held, ids, starts, places, size, count
        cols = [pa.array([(part << 11) + count]), pa.array([np.concatenate(held).tobytes()], pa.binary()), *(pa.array([x], pa.list_(pa.int64())) for x in (ids, starts, places))]
        held, ids, starts, places, size, count = [], [], [], [], 0, count + 1
        return pa.RecordBatch.from_arrays(cols, names=["key", "data", "ids", "starts", "places"])

    for batch in batches:
        for id_, start, raw in zip(batch.column("id").to_pylist(), batch.column("start").to_pylist(), batch.column("words"), strict=True):
            w = np.frombuffer(raw.as_buffer(), U)
            held += [w, np.zeros(3 - len(w) % 3, U)]
            ids.append(id_)
            starts.append(start)
            places.append(size)
            size += len(w) + 3 - len(w) % 3
            if size >= BLOB << (count >> 8) and count < (1 << 11) - 1:
                yield out()
    if held:
        yield out()


def bucket_of(splits: np.ndarray, t0: np.ndarray, t1: np.ndarray, t2: np.ndarray) -> np.ndarray:
    """Number of splitters (rows of three) that are at or below each triple."""
    lo = np.searchsorted(splits[:, 0], t0, side="left")
    hi = np.searchsorted(splits[:, 0], t0, side="right")
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) // 2
        s1, s2 = splits[mid, 1], splits[mid, 2]
        below = (s1 < t1[open_]) | ((s1 == t1[open_]) & (s2 <= t2[open_]))
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def _sampled(stride: int):
    def run(batches):
        for batch in batches:
            for raw in batch.column("data"):
                v = np.append(np.frombuffer(raw.as_buffer(), U), np.zeros(2, U))
                at = np.arange(stride // 2, len(v) - 2, stride)
                at = at[v[at] != 0]
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([_pack(v[at], v[at + 1], v[at + 2])], pa.binary())], names=["key", "data"])

    return run


def splitters(level: DataFrame, letters: int, width: int) -> np.ndarray:
    """Triples that cut the string's suffixes into buckets of about BUCKET bytes at ``width`` bytes each."""
    buckets = -(-letters * width // BUCKET)
    if buckets < 2:
        return np.zeros((0, 3), U)
    rows = level.select("key", "data").mapInArrow(_sampled(max(1, letters // (64 * buckets))), _PACKED).select("data").toArrow()
    t = _unpack(rows, 3)
    t = t[:, np.lexsort((t[2], t[1], t[0]))]
    return np.unique(t[:, (np.arange(1, buckets) * t.shape[1]) // buckets].T, axis=0) if t.shape[1] else np.zeros((0, 3), U)


def _triples(splits: np.ndarray):
    """The sample's triples by bucket."""

    def run(batches):
        for batch in batches:
            for key, raw in zip(batch.column("key").to_pylist(), batch.column("data"), strict=True):
                v = np.append(np.frombuffer(raw.as_buffer(), U), np.zeros(2, U))
                n = len(v) - 2
                at = np.arange(n)
                at = at[(at % 3 != 0) & ((v[:n] != 0) | (at == n - 1))]  # the last place tells the length
                t0, t1, t2 = v[at], v[at + 1], v[at + 2]
                yield _rows(bucket_of(splits, t0, t1, t2), U(key << 32) + at.astype(U), t0, t1, t2)

    return run


def _named(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Names of a bucket's triples in order, back by blob; 0 for the triples of ends."""
    pos, t0, t1, t2 = _unpack(table, 4)
    order = np.lexsort((t2, t1, t0))
    pos, t0, t1, t2 = pos[order], t0[order], t1[order], t2[order]
    new = np.ones(len(pos), bool)
    new[1:] = (t0[1:] != t0[:-1]) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])
    name = (U((key[0].as_py() + 1) << 40) + np.cumsum(new).astype(U)) * (t0 != 0)
    return pa.Table.from_batches([_rows(pos >> U(32), pos & _LOW, name)])


def _next_string(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Names of positions 1 modulo 3, a zero, those of positions 2, zeros up to a multiple of 3."""
    at, name = _unpack(table, 2)
    at = at.astype(np.int64)
    m = (int(at.max()) + 1) // 3
    out = np.zeros(((2 * m + 1) // 3 + 1) * 3, U)
    out[np.where(at % 3 == 1, at // 3, m + 1 + at // 3)] = name
    return pa.table({"key": pa.array([key[0].as_py()]), "data": pa.array([out.tobytes()], pa.binary())})


def _suffixes(splits: np.ndarray, length: int):
    """Every suffix by bucket with what its comparisons need, from a level's string and the ranks of the
    next level's. With a length (at level 0): only suffixes that have so many words, and their hash."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = {k.as_py(): np.frombuffer(raw.as_buffer(), U) for k, raw in zip(table.column("kind"), table.column("data"), strict=True)}
        n = len(parts[0])
        v, m = np.append(parts[0], np.zeros(2, U)), n // 3
        r = np.append(parts[1], np.zeros(max(0, 2 * m + 1 - len(parts[1])), U))
        rank = np.zeros(n + 2, U)
        rank[1:n:3], rank[2:n:3] = r[:m], r[m + 1 : 2 * m + 1]
        at = np.flatnonzero(v[:n])
        further = []
        if length:
            zeros = np.append(0, np.cumsum(v[:n] == 0))
            at = at[at + length <= n]
            at = at[zeros[at + length] == zeros[at]]
            further = [windows(v[:n], length)[at]] if len(at) else [np.zeros(0, U)]
        c = at % 3
        ra = np.where(c == 0, rank[at + 1], rank[at])
        rb = np.where(c == 1, rank[at + 1], rank[at + 2])
        key_ = bucket_of(splits, v[at], v[at + 1], v[at + 2])
        return pa.Table.from_batches([_rows(key_, U(key[0].as_py() << 32) + at.astype(U), v[at], v[at + 1], ra, rb, *further)])

    return run


def merged(pos: np.ndarray, v0: np.ndarray, v1: np.ndarray, ra: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """Order of a bucket's suffixes: the sample by rank, the others put among them by comparison."""
    c = (pos & _LOW) % U(3)
    s, x = np.flatnonzero(c != 0), np.flatnonzero(c == 0)
    s = s[np.argsort(ra[s], kind="stable")]
    x = x[np.lexsort((ra[x], v0[x]))]
    lo, hi = np.zeros(len(x), np.int64), np.full(len(x), len(s), np.int64)
    go = np.flatnonzero(lo < hi)
    while len(go):
        mid = (lo[go] + hi[go]) // 2
        y, z = s[mid], x[go]
        by_one = rb[y] < ra[z]  # a sample at 1 modulo 3: one letter, then the ranks that follow
        by_two = (v1[y] < v1[z]) | ((v1[y] == v1[z]) & (rb[y] < rb[z]))
        below = (v0[y] < v0[z]) | ((v0[y] == v0[z]) & np.where(c[y] == 1, by_one, by_two))
        lo[go[below]] = mid[below] + 1
        hi[go[~below]] = mid[~below]
        go = go[lo[go] < hi[go]]
    lo = np.maximum.accumulate(lo) if len(lo) else lo
    return np.concatenate([s, x])[np.argsort(np.concatenate([2 * np.arange(len(s)) + 1, 2 * lo]), kind="stable")]


def _ranked(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    cols = _unpack(table, 5)
    pos = cols[0][merged(*cols)]
    rank = U((key[0].as_py() + 1) << 40) + np.arange(1, len(pos) + 1, dtype=U)
    return pa.Table.from_batches([_rows(pos >> U(32), pos & _LOW, rank)])


def _rank_array(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    at, rank = _unpack(table, 2)
    out = np.zeros(int(at.max()) + 1, U)
    out[at.astype(np.int64)] = rank
    return pa.table({"key": pa.array([key[0].as_py()]), "data": pa.array([out.tobytes()], pa.binary())})


def _compared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Places of the suffixes whose first words equal those of an earlier one."""
    *cols, same = _unpack(table, 6)
    order = merged(*cols)
    pos, same = cols[0][order], same[order]
    group = np.cumsum(np.append(True, same[1:] != same[:-1])[: len(same)])
    by_place = np.lexsort((pos, group))
    again = np.append(False, group[by_place][1:] == group[by_place][:-1])[: len(pos)]
    late = pos[by_place][again]
    return pa.Table.from_batches([_rows(late >> U(32), late & _LOW)])


def _spans(length: int):
    """(doc_id, start, end) of the words that repeats cover, from a blob's places of repeats."""

    def run(table: pa.Table) -> pa.Table:
        meta = table.filter(pc.is_valid(table.column("ids"))).slice(0, 1).to_pylist()[0]
        late = [np.frombuffer(x.as_buffer(), U) for x in table.column("data") if x.is_valid]
        ids, starts, places = (np.array(meta[c]) for c in ("ids", "starts", "places"))
        out: tuple[list, list, list] = ([], [], [])
        if late:
            at = np.sort(np.concatenate(late)).astype(np.int64)
            owner = np.searchsorted(places, at, side="right") - 1
            new = np.ones(len(at), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (at[1:] > at[:-1] + length)
            a, b = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(at)) - 1
            shift = starts[owner[a]] - places[owner[a]]
            out = (ids[owner[a]].tolist(), (at[a] + shift).tolist(), (at[b] + length + shift).tolist())
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "end"])

    return run


def _free(*tables: Spooled) -> None:
    """Removes tables, and lets Spark remove the shuffles of plans that are no longer held."""
    for t in tables:
        t.drop()
    gc.collect()
    if tables:
        tables[0].spark.sparkContext._jvm.System.gc()


def _counted(batches):
    for batch, i, j, data, offsets in batch_blocks(batches, "text"):
        n = np.diff(words(data, offsets, SPACE)[2])
        yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(np.zeros(j - i, np.int64)), pa.array(n.astype(np.int64))], names=["doc_id", "start", "end"])


def _sort(blobs: Spooled, letters: int, length: int) -> DataFrame:
    """(key, data) with the packed places of repeats of each blob."""
    levels, covers, n = [blobs], 1, letters
    sizes = [n]
    while covers < length:
        now = levels[-1].df
        by_bucket = now.select("key", "data").mapInArrow(_triples(splitters(now, n, 32)), _PACKED)
        back = by_bucket.groupBy("key").applyInArrow(_named, _PACKED)
        levels.append(Spooled(back.groupBy("key").applyInArrow(_next_string, _PACKED)))
        _free()
        covers, n = covers * 3, n * 2 // 3
        sizes.append(n)
    ranks = levels.pop()  # its letters order what they cover
    while len(levels) > 1:
        now, n = levels.pop(), sizes[len(levels)]
        both = now.df.select("key", F.lit(0).alias("kind"), "data").unionByName(ranks.df.select("key", F.lit(1).alias("kind"), "data"))
        by_bucket = both.groupBy("key").applyInArrow(_suffixes(splitters(now.df, n, 40), 0), _PACKED)
        done = Spooled(by_bucket.groupBy("key").applyInArrow(_ranked, _PACKED).groupBy("key").applyInArrow(_rank_array, _PACKED))
        _free(now, ranks)
        ranks = done
    both = blobs.df.select("key", F.lit(0).alias("kind"), "data").unionByName(ranks.df.select("key", F.lit(1).alias("kind"), "data"))
    return both.groupBy("key").applyInArrow(_suffixes(splitters(blobs.df, letters, 48), length), _PACKED).groupBy("key").applyInArrow(_compared, _PACKED)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, window: int = WINDOW, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(doc_id, start, end): words from ``start`` to ``end`` repeat passages that occur before."""
    src = docs.select(number(docs, id_col).alias("id"), column(docs, text_col).alias("text")).where("id is not null and text is not null")
    known = Spooled(src.select("id", F.md5("text").alias("sum")).groupBy("id").agg(F.min("sum").alias("sum"), F.count("*").alias("rows")))
    copy = Spooled(equals(known.df.select("id", "sum"), "sum").select("id"))
    text = src
    clash = known.df.where("rows > 1").select("id", "sum")
    if clash.limit(1).count():  # ids that more than one row has
        single = src.join(hinted(clash.select("id")), "id", "left_anti")
        chosen = src.withColumn("sum", F.md5("text")).join(hinted(clash), ["id", "sum"]).groupBy("id", "sum").agg(F.min("text").alias("text"))
        text = single.unionByName(chosen.select("id", "text"))
    copies = hinted(copy.df)
    once = text.join(copies, "id", "left_anti")
    rows = known.df.count()
    buckets = max(1, rows // 10_000)
    open_ = Spooled(once.mapInArrow(_distinct_anchors(buckets, length, window), _PACKED).groupBy("key").applyInArrow(_filter, _PACKED))
    stretched = "id long, start long, words binary"
    if (open_.df.agg(F.sum(F.length("data"))).first()[0] or 0) <= filter_bytes:
        shared = docs.sparkSession.sparkContext.broadcast(Repeated(buckets, open_.df.toArrow()))
        stretches = once.mapInArrow(_stretches(length, window, shared), stretched)
    else:  # the filters are too large to send around: the windows themselves, by document
        found = once.mapInArrow(_anchored(buckets, length, window), _PACKED).groupBy("key").applyInArrow(_repeated(buckets), _PACKED)
        listed = Spooled(found.groupBy("key").applyInArrow(_by_document, "id long, anchors binary"))
        stretches = once.join(listed.df, "id").mapInArrow(_stretches(length, window), stretched)
    whole = text.join(copies, "id").mapInArrow(_counted, "doc_id long, start long, end long").where(F.col("end") >= length)
    ordered = stretches.repartitionByRange("id").sortWithinPartitions("id", "start")
    blobs = Spooled(ordered.mapInArrow(_blobs, "key long, data binary, ids array<long>, starts array<long>, places array<long>"))
    _free(open_)
    letters = blobs.df.agg(F.sum(F.length("data"))).first()[0]
    if not letters:
        return whole
    late = _sort(blobs, letters // 8, length)
    none = F.lit(None)
    meta = blobs.df.select("key", none.cast("binary").alias("data"), "ids", "starts", "places")
    lists = "array<long>"
    both = meta.unionByName(late.select("key", "data", none.cast(lists).alias("ids"), none.cast(lists).alias("starts"), none.cast(lists).alias("places")))
    return both.groupBy("key").applyInArrow(_spans(length), "doc_id long, start long, end long").unionByName(whole)


def _cut(texts: pa.Array, spans_: pa.Array) -> pa.Array:
    """Texts without the words of their spans, and without the white space before these."""
    frugal()
    out = []
    for k in range(len(texts)):  # text by text: a batch's texts may be long
        data, offsets = buffers(texts.slice(k, 1))
        _, ends, _ = spans(data, offsets, SPACE)
        raw, at, parts = data.tobytes(), 0, []
        for lo, hi in sorted((s["start"], s["end"]) for s in spans_[k].as_py()):
            lo = int(ends[lo - 1]) if lo else 0
            parts.append(raw[at : max(at, lo)])
            at = max(at, int(ends[min(hi, len(ends)) - 1]))
        out.append(b"".join([*parts, raw[at:]]).decode().strip())
    return pa.array(out, pa.string())


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """docs without their repeats; a document of which nothing is left goes. Other columns stay as they are, whatever
    their names.

    Of rows that share an id only those with the text that was compared are cut."""
    found = repeats(docs, id_col, text_col, length)
    key, at, sum_ = (fresh(docs, n) for n in ("__id", "__spans", "__sum"))
    each = Spooled(found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias(at)).withColumnRenamed("doc_id", key)).df
    own, text = number(docs, id_col), column(docs, text_col)
    many = docs.where(own.isNotNull() & text.isNotNull()).groupBy(own.alias(key)).agg(F.min(F.md5(text)).alias(sum_), F.count("*").alias("n")).where("n > 1").select(key, sum_)
    each = Spooled(each.join(many, key, "left")).df
    # broadcast by the number of spans, which are two longs each; text that stays as it is never meets Python
    if (each.agg(F.sum(F.size(at))).first()[0] or 0) + each.count() <= BROADCAST_ROWS // 2:
        each = F.broadcast(each)
    on = (own == each[key]) & text.isNotNull() & (each[sum_].isNull() | (F.md5(text) == each[sum_]))
    less = F.arrow_udf(_cut, "string")(text, each[at])
    some = docs.join(each, on).select(*(less.alias(c) if c == text_col else column(docs, c) for c in docs.columns))
    some = Spooled(some).df  # read back, so that the test below doesn't cut the text a second time
    return docs.join(each.select(key, sum_), on, "left_anti").unionByName(some.where(F.length(column(some, text_col)) > 0))
