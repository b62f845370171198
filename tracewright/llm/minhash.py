"""Near-duplicates by ProbMinHash, banding and verification.

A document is the bag of its shingles (``SHINGLE`` successive words, lower case, ASCII
punctuation ignored); a shingle's weight is its count. ProbMinHash draws for every shingle a
Poisson process whose rate is the weight: each arrival falls into one register, and a register
keeps its earliest arrival's shingle. A shingle stops as soon as its next arrival is later than
every register's earliest. Two documents agree in a register with the probability of their
probability Jaccard similarity.

``BANDS`` bands of ``ROWS`` registers give buckets. A group is a connected component of the pairs
that share a bucket and are similar; its smallest id stays. All members of a bucket are compared
with its smallest id, the hub. Those like it are one group, so pairs among them need no comparison.
Each member unlike the hub is compared with every other member of the bucket, but for those already
in its group and those that can't be similar: one minus the similarity is a metric, so two members
whose similarities to the hub differ by more than 1 - threshold are farther apart than it allows.
No candidate is left out because a bucket is large. A comparison takes the exact probability
Jaccard similarity of the two bags (shingles as 32-bit hashes).

Defined cases: a null id or text is in no group; a text with no word is in no group; a text with
fewer than ``SHINGLE`` words is one shingle; rows that share an id are one document, whose text is
that of the row with the smallest text hash; equal bags are one group without comparison. An empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spooled, column, equals, hinted, number
from .kernels import NOT_ALNUM, U, batch_blocks, frugal, mix, owner, windows, within, words

SHINGLE = 2
BANDS = 16
ROWS = 4
REGISTERS = BANDS * ROWS
THRESHOLD = 0.6


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE):
    """Document index and hash of every shingle of a block of lower-case texts, in text order."""
    _, _, first, h = words(data, offsets, NOT_ALNUM)
    at = within(first, k)
    docs, hashes = owner(first)[at], windows(h, k)[at] if len(at) else np.zeros(0, U)
    counts = np.diff(first)
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        docs, hashes = np.append(docs, d), np.append(hashes, windows(h[first[d] : first[d + 1]], int(counts[d])))
    return docs, hashes


def bags(docs: np.ndarray, hashes: np.ndarray):
    """Distinct (document, shingle) with counts, sorted; a shingle keeps the top 40 bits of its hash."""
    key = (docs.astype(U) << U(40)) | (hashes >> U(24))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return (key[at] >> U(40)).astype(np.int64), key[at] & U((1 << 40) - 1), np.diff(np.append(at, len(key)))


def prob_minhash(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """Signatures (n, m) of n bags; a bag without shingles has only zeros."""
    arrival, held = np.full(n * m, np.inf), np.zeros(n * m, U)
    live = np.arange(len(doc))
    t = np.zeros(len(doc))
    state = mix(shingle + U(0x632BE59BD9B4E019))
    while len(live):
        state = mix(state + U(0x9E3779B97F4A7C15))
        u = ((state >> U(11)).astype(np.float64) + 0.5) * 2.0**-53
        t = t - np.log(u) / weight[live]
        cell = doc[live] * m + (mix(state ^ U(0xA0761D6478BD642F)) >> U(40)).astype(np.int64) % m
        np.minimum.at(arrival, cell, t)
        won = arrival[cell] == t
        held[cell[won]] = shingle[live[won]]
        late = arrival.reshape(n, m).max(axis=1)
        go = t < late[doc[live]]
        live, t, state = live[go], t[go], state[go]
    return held.reshape(n, m)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two bags, each sorted shingles and counts.

    sum over shared d of 1 / sum_e max(x_e / x_d, y_e / y_d), for all shared d at once: an element e
    takes the first branch where y_e / x_e <= y_d / x_d, so sorted ratios and prefix sums give each sum.
    """
    sa, wa = a
    sb, wb = b
    if len(sa) == len(sb) and np.array_equal(sa, sb) and np.array_equal(wa * wb.sum(), wb * wa.sum()):
        return 1.0 if len(sa) else 0.0
    ia, ib = np.searchsorted(sb, sa), np.searchsorted(sa, sb)
    in_b = (ia < len(sb)) & (sb[np.minimum(ia, len(sb) - 1)] == sa)
    x, y = wa[in_b].astype(float), wb[ia[in_b]].astype(float)
    if not len(x):
        return 0.0
    only_a = float(wa[~in_b].sum())
    only_b = float(wb.sum() - y.sum())
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    upto = np.searchsorted(ratio, ratio, side="right")
    px, py = np.append(0.0, np.cumsum(x)), np.append(0.0, np.cumsum(y))
    return float(np.sum(1.0 / ((px[upto] + only_a) / x + (py[-1] - py[upto] + only_b) / y)))


def _bag_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.frombuffer(raw, np.uint32), return_counts=True)


def _signed(batches):
    for batch, i, j, data, offsets in batch_blocks(batches, "text", lower=True):
        doc, shingle, weight = bags(*shingles(data, offsets))
        sig = prob_minhash(doc, shingle, weight, j - i)
        some = np.zeros(j - i, bool)
        some[doc] = True
        whole = np.zeros(j - i, U)
        np.add.at(whole, doc, mix(shingle * U(0x9FB21C651E98DF25) + weight.astype(U)))
        band = sig.reshape(j - i, BANDS, ROWS)
        key = np.zeros((j - i, BANDS), U)
        for r in range(ROWS):
            key = mix(key * U(31) + band[:, :, r])
        key += np.arange(BANDS, dtype=U)
        keys = pa.ListArray.from_arrays(np.arange(0, (j - i) * BANDS + 1, BANDS, dtype=np.int32), pa.array(mix(key).view(np.int64).ravel()))
        out = pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(whole.view(np.int64)), keys], names=["id", "whole", "bands"])
        yield out.filter(pa.array(some))


def _packed(batches):
    for batch, i, j, data, offsets in batch_blocks(batches, "text", lower=True):
        docs, hashes = shingles(data, offsets)
        key = (docs.astype(U) << U(32)) | (hashes >> U(32))
        key.sort()
        cut = np.searchsorted(key, np.arange(j - i + 1, dtype=U) << U(32))
        low = key.astype(np.uint32)
        bag = pa.array([low[cut[d] : cut[d + 1]].tobytes() for d in range(j - i)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), bag], names=["id", "bag"])


def _compared(batches):
    frugal()
    last, bag = None, None
    for batch in batches:
        sims = []
        a, raw_a, raw_b = (batch.column(c) for c in ("a", "bag_a", "bag_b"))
        for k, hub in enumerate(a.to_pylist()):
            if hub != last:
                last, bag = hub, _bag_of(raw_a[k].as_py())
            sims.append(similarity(bag, _bag_of(raw_b[k].as_py())))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())], names=["a", "b", "sim"])


def _verified(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, sim) for each pair."""
    va = vectors.select(F.col("id").alias("a"), F.col("bag").alias("bag_a"))
    vb = vectors.select(F.col("id").alias("b"), F.col("bag").alias("bag_b"))
    both = pairs.join(vb, "b").join(va, "a").select("a", "b", "bag_a", "bag_b")
    return both.mapInArrow(_compared, "a long, b long, sim double")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) with the smallest id of each connected component, for ids that aren't it. edges: (a, b)."""
    flat = edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct()
    now = Spooled(flat)
    while True:
        # large star: neighbours above u go to its smallest neighbour
        e = now.df
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its neighbours below go to the smallest of them
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = Spooled(small.where("u <> v").distinct())
        changed = after.df.join(now.df, ["u", "v"], "left_anti").limit(1).count() or now.df.join(after.df, ["u", "v"], "left_anti").limit(1).count()
        now.drop()
        now = after
        if not changed:
            return now.df.select(F.col("u").alias("id"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, duplicate_of): each document that goes, and the one of its group that stays."""
    src = docs.select(number(docs, id_col).alias("id"), column(docs, text_col).alias("text")).where("id is not null and text is not null")
    signed = Spooled(src.mapInArrow(_signed, "id long, whole long, bands array<long>"))
    one = signed.df.groupBy("id").agg(F.min_by("bands", "whole").alias("bands"), F.min("whole").alias("whole"))
    same = Spooled(equals(Spooled(one.select("id", "whole")).df, "whole"))
    reps = signed.df.join(hinted(same.df.select("id")), "id", "left_anti")
    buckets = reps.select("id", F.explode("bands").alias("band")).distinct()
    sizes = buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    open_ = Spooled(buckets.join(sizes.select("band"), "band"))
    ids = Spooled(open_.df.select("id").distinct())
    vectors = Spooled(src.join(hinted(ids.df), "id").mapInArrow(_packed, "id long, bag binary").groupBy("id").agg(F.min("bag").alias("bag")))
    hub = open_.df.groupBy("band").agg(F.min("id").alias("a"))
    held = open_.df.join(hub, "band").where("id > a").select("band", "a", F.col("id").alias("b"))
    star = Spooled(_verified(held.select("a", "b").distinct(), vectors.df))
    ok = star.df.where(F.col("sim") >= threshold).select("a", "b").union(same.df.select(F.col("root").alias("a"), F.col("id").alias("b")))
    roots = Spooled(components(ok))
    root_of = hinted(roots.df)
    # members of a bucket that aren't like its hub: with all other members that the bound leaves
    seen = Spooled(held.join(star.df, ["a", "b"]).join(root_of, F.col("b") == root_of["id"], "left").select("band", "b", "sim", F.coalesce("root", "b").alias("root")))
    x, y = seen.df.alias("x"), seen.df.where(F.col("sim") < threshold).alias("y")
    open_pairs = y.join(x, "band").where((F.col("x.root") != F.col("y.root")) & (F.col("x.sim") - F.col("y.sim") <= 1 - threshold + 1e-9))
    pairs = open_pairs.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct()
    rest = Spooled(_verified(pairs.join(star.df.select("a", "b"), ["a", "b"], "left_anti"), vectors.df))
    edges = rest.df.where(F.col("sim") >= threshold).select("a", "b").union(roots.df.select(F.col("root").alias("a"), F.col("id").alias("b")))
    return components(edges).select(F.col("id").alias("doc_id"), F.col("root").alias("duplicate_of"))
