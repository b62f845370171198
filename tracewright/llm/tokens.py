"""Subword ids of whole texts, at the cost of one tokenizer call a distinct piece.

A text is cut at ASCII white space as the byte-level vocabulary's own pattern would: a piece is a run
of other characters with the one space before it; what is left of a run of white space is a piece by
itself. No token spans two pieces, so the ids of a text are those of its pieces, and a piece that was
seen before needs only a lookup by hash. The vocabulary's path is a parameter; it must be readable on
every node.
"""

from __future__ import annotations

import base64

import numpy as np

from .kernels import SPACE, U, byte_prefix, hash_spans

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers; beyond it starts anew. It bounds memory and changes no result.
REMEMBERED = 400_000


def encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of the pieces of a block, and each document's first piece (n+1 numbers)."""
    n = len(data)
    space = SPACE[data]
    new_doc = np.zeros(n + 1, bool)
    new_doc[offsets] = True
    start = new_doc[:n].copy()
    if n:
        before = np.empty(n, bool)  # white space before this byte, in the same document
        before[0], before[1:] = False, space[:-1]
        before &= ~new_doc[:n]
        next_solid = np.zeros(n, bool)
        next_solid[:-1] = ~space[1:] & ~new_doc[1:n]
        start |= (data == 32) & next_solid  # the space that goes with the word after it
        after_other = before.copy()
        after_other[1:] &= data[:-1] != 32
        start |= ~space & after_other
        start |= space & ~before  # a run of white space begins
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets)


class Tokenizer:
    """Ids by piece; keeps what it has seen as arrays sorted by hash."""

    def __init__(self, path: str = VOCABULARY):
        self.encoder = encoding(path)
        self._forget()

    def _forget(self) -> None:
        self.hash = np.zeros(0, U)
        self.cut = np.zeros((0, 2), np.int64)  # where in ids, and how many
        self.ids = np.zeros(0, np.int32)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        if len(self.hash) + len(hashes) > REMEMBERED:
            self._forget()
        made = [self.encoder.encode_ordinary(x) for x in texts]
        n = np.fromiter(map(len, made), np.int64, len(made))
        at = len(self.ids) + np.cumsum(n) - n
        self.ids = np.concatenate([self.ids, np.fromiter((i for m in made for i in m), np.int32, int(n.sum()))])
        both = np.concatenate([self.hash, hashes])
        order = np.argsort(both, kind="stable")
        self.hash = both[order]
        self.cut = np.concatenate([self.cut, np.stack([at, n], 1)])[order]

    def _rows(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, first = pieces(data, offsets)
        h = hash_spans(byte_prefix(data), starts, ends)
        distinct, where, back = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hash, distinct)
        known = place < len(self.hash)
        known[known] = self.hash[place[known]] == distinct[known]
        if not known.all():
            fresh = ~known if len(self.hash) + int((~known).sum()) <= REMEMBERED else np.ones(len(distinct), bool)
            raw = data.tobytes()
            self._learn(distinct[fresh], [raw[starts[k] : ends[k]].decode("utf-8", "replace") for k in where[fresh]])
            place = np.searchsorted(self.hash, distinct)
        return self.cut[place], back, first

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of ids of each document of a block."""
        cut, back, first = self._rows(data, offsets)
        total = np.append(0, np.cumsum(cut[:, 1][back]))
        return total[first[1:]] - total[first[:-1]]

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """Ids of a block one after another, and each document's first (n+1 numbers)."""
        cut, back, first = self._rows(data, offsets)
        n = cut[:, 1][back]
        total = np.append(0, np.cumsum(n))
        at = np.arange(int(total[-1])) + np.repeat(cut[:, 0][back] - total[:-1], n)
        return self.ids[at], total[first]


_held: dict[str, Tokenizer] = {}


def tokenizer(path: str = VOCABULARY) -> Tokenizer:
    """One for each worker process."""
    if path not in _held:
        _held[path] = Tokenizer(path)
    return _held[path]
