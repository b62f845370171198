"""Vectorised text kernels on Arrow buffers: words, 64-bit hashes, windows.

Texts are handled as UTF-8 bytes. Hashes are polynomial modulo 2**64 with a final
mix; two different words or windows share one with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that a block of whole documents holds, unless one document is longer.
BLOCK = 500_000
#: Entries of the tables of powers that a worker keeps from one batch to the next.
KEPT = 1 << 20
#: Rows of a batch that are taken at once.
ROWS = 512
_R = 0x9E3779B97F4A7C15
_Q = 0xD1342543DE82EF95
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that end a word where punctuation doesn't count: all of ASCII but letters and digits.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    NOT_ALNUM[_a:_b] = False


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length()) if n else 1 << 16
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, U)
            x[0] = 1
            made.append(np.cumprod(x, dtype=U))
        known = _powers[base] = (made[0], made[1])
    return known


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x *= U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; a null counts as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, off, data = texts.buffers()
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``size`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def frugal(bytes_: int = 1 << 20) -> None:
    """Lets this worker give the memory of arrays beyond ``bytes_`` back as soon as they are freed. Workers are
    many and idle ones keep what they have; by default that is the most that they ever needed."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, bytes_)  # beyond it arrays are mapped, so that freeing unmaps them
        libc.mallopt(-1, 2 * bytes_)  # and so much may stay free at the end of the heap
    except (OSError, AttributeError):  # another C library: more memory, nothing else
        return
    pa.set_memory_pool(pa.system_memory_pool())


def batch_blocks(batches, text: str, lower: bool = False, size: int = BLOCK):
    """(record batch, its first row, row after its last, bytes, offsets) for each block.

    A batch is taken ROWS rows at a time, so that only these are copied, and what is kept for hashing long
    texts goes after it.
    """
    frugal()
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            col = batch.column(text).slice(at, ROWS)
            if lower:
                col = pc.utf8_lower(col)
            data, offsets = buffers(col)
            for i, j in blocks(offsets, size):
                yield batch, at + i, at + j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        for base in [b for b, t in _powers.items() if len(t[0]) > KEPT]:
            del _powers[base]


def spans(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACE):
    """Starts and ends of the words of a block, and each document's first word (n+1 numbers)."""
    inside = ~sep[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def byte_prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of (byte + 1) * R**i, from which hash_spans takes the hash of any span."""
    out = np.zeros(len(data) + 1, U)
    x = data.astype(U)
    x += U(1)
    x *= powers(_R, len(data) + 1)[0][: len(data)]
    np.cumsum(x, out=out[1:])
    return out


def hash_spans(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((prefix[ends] - prefix[starts]) * powers(_R, len(prefix))[1][starts])


def words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACE):
    """spans() and the words' hashes."""
    starts, ends, first = spans(data, offsets, sep)
    return starts, ends, first, hash_spans(byte_prefix(data), starts, ends)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of hashes[i:i+k] for each i; empty if there are fewer than k."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U)
    up, down = powers(_Q, n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(hashes * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def within(first: np.ndarray, k: int) -> np.ndarray:
    """Indices i whose k-word window stays inside one document. first: as of spans()."""
    n = int(first[-1])
    if n < k:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    for d in range(1, k):  # the last k-1 words of each document start no window
        last = first[1:] - d
        ok[last[last >= first[:-1]]] = False
    return np.flatnonzero(ok[: n - k + 1])


def owner(first: np.ndarray) -> np.ndarray:
    """Document index of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
