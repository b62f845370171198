"""The suffix sort against every window of every document."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tracewright.llm import suffix


def brute(docs, length):
    """Spans of words whose window occurs at a smaller (id, position)."""
    chosen, out = {}, {}
    for key, text in docs:
        if key is not None and text is not None:
            import hashlib

            digest = hashlib.md5(text.encode()).hexdigest()
            if key not in chosen or digest < chosen[key][0]:
                chosen[key] = (digest, text)
    seen, text_of = {}, {}
    for key in sorted(chosen):
        words = chosen[key][1].split()
        copy = chosen[key][1] in text_of
        text_of.setdefault(chosen[key][1], key)
        if copy:
            if len(words) >= length:
                out[key] = set(range(len(words)))
            continue
        for p in range(len(words) - length + 1):
            w = tuple(words[p : p + length])
            if w in seen:
                out.setdefault(key, set()).update(range(p, p + length))
            else:
                seen[w] = (key, p)
    return out


def covered(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    return out


def corpus(seed, n=120, vocabulary=2000):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    shared = [[word() for _ in range(rng.randrange(8, 60))] for _ in range(6)]
    docs = []
    for k in range(n):
        words = [word() for _ in range(rng.randrange(0, 80))]
        for s in rng.sample(shared, rng.randrange(0, 3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = s
        docs.append((k * 3, " ".join(words)))
    docs += [(1000 + k, t) for k, (_, t) in enumerate(rng.sample(docs, 10))]  # copies
    docs.append((5000, "x " * 400))  # repeats itself
    docs.append((5001, " ".join(f"a{i % 7}" for i in range(300))))
    return docs


@pytest.mark.parametrize(("seed", "filter_bytes"), [(1, suffix.FILTER_BYTES), (2, suffix.FILTER_BYTES), (2, 0)])
def test_equals_brute_force(spark, seed, filter_bytes, monkeypatch):
    monkeypatch.setattr(suffix, "BUCKET", 20_000)  # several buckets
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(suffix, "BLOB", 200)  # and blobs of growing size
    assert covered(suffix.repeats(df, length=12, window=8, filter_bytes=filter_bytes)) == brute(docs, 12)


def test_nulls_clashes_and_empty(spark):
    long = " ".join(f"q{i}" for i in range(60))
    rows = [(None, long, 1), (1, None, 2), (2, "", 3), (3, long, 4), (4, long + " tail", 5), (4, "short", 6), (6, long, 7), (6, long, 7), (7, "ü" * 5, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long")
    assert covered(suffix.repeats(df)) == brute([r[:2] for r in rows], 51)
    assert suffix.repeats(df.limit(0)).collect() == []


def test_buckets_are_lexicographic():
    rng = np.random.default_rng(0)
    t = rng.integers(1, 5, (3, 500)).astype(np.uint64)
    splits = np.unique(rng.integers(1, 5, (9, 3)).astype(np.uint64), axis=0)
    want = [sum(tuple(s) <= tuple(x) for s in splits.tolist()) for x in t.T.tolist()]
    assert suffix.bucket_of(splits, *t).tolist() == want


def test_anchors_hold_every_window():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 1 << 60, 400).astype(np.uint64)
    doc = np.repeat([0, 1, 2], [150, 40, 210])
    at, _ = suffix.anchors(h, doc, 30, 20)
    for a in range(400 - 30 + 1):
        if doc[a] == doc[a + 29]:
            assert ((at >= a) & (at <= a + 10)).any()


def test_filters_miss_nothing_and_pass_little():
    rng = np.random.default_rng(2)
    w = rng.integers(1, 1 << 63, 20_000).astype(np.uint64)
    twice, once = w[:6000], w[6000:]
    rows = []
    for key in range(8):
        own = np.concatenate([twice, twice, once])
        own = own[suffix.mix(own.copy()) % np.uint64(8) == key]
        table = pa.table({"key": [key], "data": pa.array([suffix._pack(own)], pa.binary())})
        rows.append(suffix._filter((pa.scalar(key),), table))
    known = suffix.Repeated(8, pa.concat_tables(rows))
    assert known.has(twice).all() and known.has(once).mean() < 0.05
    assert not suffix.Repeated(8, pa.table({"key": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})).has(w).any()
