"""Toxic documents by a subword-bag classifier, trained here in numpy.

A tile is ``TILE`` successive words. Its features are the byte n-grams (``GRAMS``) of its distinct lower-case
words with one space at either side, hashed to ``BUCKETS``; a tile is the mean of their embeddings (of at
least ``FLOOR``, the missing ones as zero, so that one word over and over isn't all there is),
followed by a two-class linear softmax. Embeddings and softmax are trained jointly. Misspellings and
new inflections of a known word share most of its n-grams, so they score alike.

Labels are of documents, so training chooses the tiles: at first all tiles of toxic documents count
as toxic; after each round only the highest-scored tiles of each do, against the highest-scored and
random tiles of clean ones. A document's score is that of its highest tile, so one insult in a long
text counts. The threshold is the one with the best F1, false alarms weighing ``FALSE_ALARM`` times, on
documents that the model which scores them wasn't trained on; ties take the highest.

The sample is bounded: at most ``SAMPLE // 2`` labelled documents of either class, those with the
smallest hash of id. Everything else covers all documents.

Defined cases: a null or blank text has score 0 and is never rejected; labels that are null, or
neither 0 nor 1, aren't used; a document with both labels counts as toxic; without labelled
documents of both classes nothing is rejected. Rows that share an id are scored each; the result has
each id once, with its highest score. A null id is scored by none. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spooled, column, hinted, number
from .kernels import SPACE, U, batch_blocks, blocks, byte_prefix, hash_spans, spans

SAMPLE = 2_400
TILE = 6
GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 18
DIM = 8
ROUNDS = 10
FLOOR = 64
#: Tiles of a step at most, and steps of a pass at least, as far as steps of 32 tiles go.
BATCH = 4096
STEPS = 32
RATE = 0.2
#: The threshold comes from one part of FOLDS that isn't trained on. Below CROSS documents that part would have too
#: few toxic ones: then each part is left out in turn, and in the end all are trained on.
FOLDS = 5
CROSS = 1_000
#: Weight of a clean document taken for toxic; the sample has far more toxic ones than a corpus.
FALSE_ALARM = 8
#: Bytes of text that are taken apart at once; n-grams need some hundred times as much memory.
BLOCK = 1_000_000


def _spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """The words one after another, each with a space at either side, and where each begins and ends."""
    n = ends - starts
    end = np.cumsum(n + 2)
    begin = end - n - 2
    out = np.full(int(end[-1]) if len(end) else 0, 32, np.uint8)
    src = np.repeat(starts - begin - 1, n) + _inner(begin, n)
    out[_inner(begin, n)] = data[src]
    return out, begin, end


def _inner(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.cumsum(n)
    return np.arange(int(total[-1]) if len(n) else 0) + np.repeat(begin + 1 - (total - n), n)


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """For each n of GRAMS: the buckets of all n-grams, and the word of each."""
    text, begin, end = _spaced(data, starts, ends)
    if not len(text):
        return
    prefix = byte_prefix(text)
    word = np.repeat(np.arange(len(begin), dtype=np.int64), end - begin)
    left = end[word] - np.arange(len(text))  # bytes from here to the word's end, spaces included
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        yield (hash_spans(prefix, at, at + n) >> U(64 - 18)).astype(np.int64), word[at]


def tiles(first: np.ndarray):
    """Tile of every word, and the document of every tile. first: as of spans()."""
    n = np.diff(first)
    per = -(-n // TILE)
    base = np.cumsum(per) - per
    doc = np.repeat(np.arange(len(n)), n)
    tile = base[doc] + (np.arange(int(first[-1])) - first[:-1][doc]) // TILE
    return tile, np.repeat(np.arange(len(n)), per)


def tiled(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends, tile and hash of each word, but for those that a tile has before; the document of every tile."""
    starts, ends, first = spans(data, offsets, SPACE)
    tile, doc = tiles(first)
    h = hash_spans(byte_prefix(data), starts, ends)
    order = np.lexsort((h, tile))
    keep = np.ones(len(h), bool)
    keep[order[1:]] = (h[order[1:]] != h[order[:-1]]) | (tile[order[1:]] != tile[order[:-1]])
    return starts[keep], ends[keep], tile[keep], h[keep], doc


def tile_scores(weights: np.ndarray, bias: float, data: np.ndarray, offsets: np.ndarray):
    """Toxic probability of each tile, and the document of each. weights: by bucket."""
    starts, ends, tile, h, doc = tiled(data, offsets)
    _, where, word = np.unique(h, return_index=True, return_inverse=True)  # a word's n-grams are summed once a block
    total, count = np.zeros(len(where)), np.zeros(len(where))
    for bucket, of in grams(data, starts[where], ends[where]):
        total += np.bincount(of, weights[bucket], len(where))
        count += np.bincount(of, minlength=len(where))
    mean = np.bincount(tile, total[word], len(doc)) / np.maximum(np.bincount(tile, count[word], len(doc)), FLOOR)
    return 1 / (1 + np.exp(-np.clip(mean + bias, -30, 30))), doc


def doc_scores(weights: np.ndarray, bias: float, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    p, doc = tile_scores(weights, bias, data, offsets)
    out = np.zeros(len(offsets) - 1)
    np.maximum.at(out, doc, p)
    return out


def _ragged(cut: np.ndarray, which: np.ndarray):
    """Places in a ragged array of all entries of the rows ``which``, and for each entry the index of its row."""
    n = cut[which + 1] - cut[which]
    row = np.repeat(np.arange(len(which)), n)
    return np.arange(int(n.sum())) + np.repeat(cut[which] - (np.cumsum(n) - n), n), row


class Tiles:
    """The words of many tiles and the n-grams of each distinct word, as ragged arrays."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        docs, found, hashes, sizes = [np.zeros(0, np.int64)], [np.zeros(0, U)], [np.zeros(0, U)], [np.zeros(0, np.int64)]
        buckets, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        known = np.zeros(0, U)
        for i, j in blocks(offsets, BLOCK):
            own = data[offsets[i] : offsets[j]]
            starts, ends, tile, h, doc = tiled(own, offsets[i : j + 1] - offsets[i])
            order = np.argsort(tile, kind="stable")
            hashes.append(h[order])
            sizes.append(np.bincount(tile, minlength=len(doc)))
            docs.append(doc + i)
            new, where = np.unique(h, return_index=True)
            fresh = ~np.isin(new, known)
            new, where = new[fresh], where[fresh]
            parts = list(grams(own, starts[where], ends[where]))
            word = np.concatenate([np.zeros(0, np.int64), *(w for _, w in parts)])
            order = np.argsort(word, kind="stable")
            buckets.append(np.concatenate([np.zeros(0, np.int32), *(x.astype(np.int32) for x, _ in parts)])[order])
            counts.append(np.bincount(word, minlength=len(new)))
            found.append(new)
            known = np.concatenate([known, new])
            known.sort()
        self.doc, self.bucket = np.concatenate(docs), np.concatenate(buckets)
        self.cut = np.append(0, np.cumsum(np.concatenate(sizes)))
        self.grams = np.append(0, np.cumsum(np.concatenate(counts)))
        names = np.concatenate(found)
        order = np.argsort(names)
        self.word = order[np.searchsorted(names[order], np.concatenate(hashes))].astype(np.int32)
        upto = np.append(0, np.cumsum(np.diff(self.grams)[self.word]))
        self.size = np.maximum(upto[self.cut[1:]] - upto[self.cut[:-1]], FLOOR)  # n-grams of a tile

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        upto = np.append(0.0, np.cumsum(weights[self.bucket]))
        of_word = upto[self.grams[1:]] - upto[self.grams[:-1]]
        upto = np.append(0.0, np.cumsum(of_word[self.word]))
        return (upto[self.cut[1:]] - upto[self.cut[:-1]]) / self.size + bias


class Model:
    """Mean of embeddings into a two-class softmax; Adagrad on both."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.1, (BUCKETS, DIM))
        self.u = rng.normal(0, 0.1, (DIM, 2))
        self.b = np.zeros(2)
        self.ge, self.gu, self.gb = np.full(BUCKETS, 1e-6), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)

    def step(self, t: Tiles, which: np.ndarray, y: np.ndarray, rate: float) -> None:
        n = len(y)
        at, row = _ragged(t.cut, which)
        words, word = np.unique(t.word[at], return_inverse=True)
        at, of_word = _ragged(t.grams, words)
        used, local = np.unique(t.bucket[at], return_inverse=True)
        vec = self.e[used]
        share = 1.0 / t.size[which][row]
        by_word = np.stack([np.bincount(of_word, vec[local, k], len(words)) for k in range(DIM)], 1)
        bag = np.stack([np.bincount(row, by_word[word, k] * share, n) for k in range(DIM)], 1)
        z = bag @ self.u + self.b
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1  # gradient by the logits
        pos = max(1, int(y.sum()))
        p *= np.where(y == 1, 0.5 / pos, 0.5 / max(1, n - pos))[:, None]  # both classes weigh the same
        gu, gb, back = bag.T @ p, p.sum(axis=0), p @ self.u.T
        gw = np.stack([np.bincount(word, back[row, k] * share, len(words)) for k in range(DIM)], 1)
        ge = np.stack([np.bincount(local, gw[of_word, k], len(used)) for k in range(DIM)], 1)
        self.ge[used] += (ge**2).mean(axis=1)
        self.e[used] -= rate * ge / np.sqrt(self.ge[used])[:, None]
        self.gu += gu**2
        self.u -= rate * gu / np.sqrt(self.gu)
        self.gb += gb**2
        self.b -= rate * gb / np.sqrt(self.gb)

    def folded(self) -> tuple[np.ndarray, float]:
        """Logit difference by bucket, and of the bias: averaging is linear, so it can come first."""
        return self.e @ (self.u[:, 1] - self.u[:, 0]), float(self.b[1] - self.b[0])


def top_tile(score: np.ndarray, doc: np.ndarray, n: int, rank: int = 1) -> np.ndarray:
    """The ``rank`` highest tiles of each document."""
    order = np.lexsort((-score, doc))
    d = doc[order]
    place = np.arange(len(d)) - np.searchsorted(d, d)
    return order[place < rank]


def fit(t: Tiles, y: np.ndarray, trained: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """(weight by bucket, bias) from the documents marked in ``trained``."""
    rng, n = np.random.default_rng(seed), len(y)
    toxic, trained = y[t.doc] == 1, trained[t.doc]
    clean = np.flatnonzero(~toxic & trained)
    model = Model(seed)
    chosen = keep = np.flatnonzero(toxic & trained)
    hard = np.zeros(0, np.int64)
    for turn in range(ROUNDS):
        easy = rng.choice(clean, min(len(clean), max(2000, 2 * len(chosen))), replace=False)
        all_ = np.concatenate([chosen, hard, easy])
        for _ in range(2):
            rng.shuffle(all_)
            size = min(BATCH, max(32, len(all_) // STEPS))
            for k in range(0, len(all_), size):
                part = all_[k : k + size]
                model.step(t, part, toxic[part].astype(np.int64), RATE)
        score = t.scores(*model.folded())
        chosen = keep[top_tile(score[keep], t.doc[keep], n, 2 if turn < ROUNDS - 2 else 1)]
        hard = clean[top_tile(score[clean], t.doc[clean], n)]
    return model.folded()


def train(data: np.ndarray, offsets: np.ndarray, y: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float, float]:
    """(weight by bucket, bias, threshold) from lower-case texts and their labels."""
    t, n = Tiles(data, offsets), len(y)
    fold = np.random.default_rng(seed).integers(0, FOLDS, n)
    if n < CROSS:  # dealt by class, so that no fold lacks one that it could have
        for k in (0, 1):
            own = np.flatnonzero(y == k)
            fold[own[np.argsort(fold[own], kind="stable")]] = np.arange(len(own)) % FOLDS
    best, held, model = np.full(n, -30.0), np.zeros(n, bool), None
    for k in range(FOLDS if n < CROSS else 1):
        out = fold == k
        if len({*y[~out]}) == 2 and out.any():
            model = fit(t, y, ~out, seed + k)
            mine = out[t.doc]
            np.maximum.at(best, t.doc[mine], t.scores(*model)[mine])
            held |= out
    if n < CROSS or model is None:
        model = fit(t, y, np.ones(n, bool), seed)
    weights, bias = model
    if len({*y[held]}) < 2:
        held[:], best[:] = True, -30.0
        np.maximum.at(best, t.doc, t.scores(weights, bias))
    s, truth = best[held], y[held]
    order = np.argsort(-s, kind="stable")
    hits = np.cumsum(truth[order])
    false = np.arange(1, len(s) + 1) - hits
    f1 = 2 * hits / (hits + FALSE_ALARM * false + truth.sum())
    k = int(np.argmax(f1))
    after = s[order][k + 1] if k + 1 < len(s) else s[order][k] - 1
    cut = (s[order][k] + after) / 2
    return weights.astype(np.float32), bias, float(1 / (1 + np.exp(-np.clip(cut, -30, 30))))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, bound: int = SAMPLE) -> DataFrame:
    """(id, text, y) of at most ``bound`` labelled documents, half of them of either class, by hash of id."""
    known = labels.select(number(labels, "doc_id").alias("id"), column(labels, "toxic").alias("y")).where("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.max("y").cast("int").alias("y"))
    ids = docs.select(number(docs, id_col).alias("id"), column(docs, text_col).isNotNull().alias("some")).where("some").select("id").distinct()
    known = known.join(ids, "id", "left_semi")
    first = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(bound // 2) for y in (0, 1)]
    picked = Spooled(first[0].union(first[1]))
    src = docs.select(number(docs, id_col).alias("id"), column(docs, text_col).alias("text")).where("text is not null")
    return src.join(F.broadcast(picked.df), "id").groupBy("id", "y").agg(F.min("text").alias("text"))


def _train(batches):
    tables = [b for b in batches if b.num_rows]
    empty = not tables
    if not empty:
        import pyarrow.compute as pc

        from .kernels import buffers

        t = pa.Table.from_batches(tables).sort_by("id")
        y = t["y"].to_numpy().astype(np.int64)
        empty = len({*y}) < 2
    if empty:
        weights, bias, cut = np.zeros(BUCKETS, np.float32), 0.0, 2.0
    else:
        data, offsets = buffers(pc.utf8_lower(t["text"]))
        weights, bias, cut = train(data, offsets, y)
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias]), pa.array([cut])], names=["weights", "bias", "cut"])


def model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE) -> tuple[bytes, float, float]:
    """Trained in one task; the model is BUCKETS floats whatever the data."""
    row = sample(docs, labels, id_col, text_col, bound).repartition(1).mapInArrow(_train, "weights binary, bias double, cut double").first()
    if row is None:  # no labelled document, so no task ran
        return np.zeros(BUCKETS, np.float32).tobytes(), 0.0, 2.0
    return bytes(row["weights"]), row["bias"], row["cut"]


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE) -> DataFrame:
    """(doc_id, score, toxic) of every row with an id."""
    raw, bias, cut = model(docs, labels, id_col, text_col, bound)
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def run(batches):
        weights = np.frombuffer(shared.value, np.float32).astype(np.float64)
        for batch, i, j, data, offsets in batch_blocks(batches, "text", lower=True, size=BLOCK):
            s = doc_scores(weights, bias, data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(s), pa.array((s >= cut) & (s > 0))], names=["doc_id", "score", "toxic"])

    src = docs.select(number(docs, id_col).alias("id"), column(docs, text_col).alias("text")).where("id is not null")
    return src.mapInArrow(run, "doc_id long, score double, toxic boolean")


def rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE) -> DataFrame:
    """(doc_id, score) of the documents at or above the threshold."""
    s = scores(docs, labels, id_col, text_col, bound).where("toxic")
    return s.groupBy("doc_id").agg(F.max("score").alias("score"))
