"""Trained models by held-out figures, near duplicates by brute force, the pipeline stage by stage."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tracewright.llm import lm, minhash, packing, suffix, toxicity
from tracewright.llm.kernels import buffers, byte_prefix, hash_spans
from tracewright.llm.tokens import encoding

from .edge import documents
from .test_small_operators import naive_best_fit, naive_matches
from .test_suffix import brute

WORDS = [a + b for a in "ba ko mi ru te so ni la ve pu".split() for b in "ren dal mos tik lum".split()]


def blocks(texts):
    return buffers(pa.array(texts))


# toxicity


def toxic_corpus(seed, n):
    rng = random.Random(seed)
    y = [int(rng.random() < 0.3) for _ in range(n)]
    texts = []
    for t in y:
        w = [rng.choice(WORDS) for _ in range(rng.randrange(20, 120))]
        if t:
            w.insert(rng.randrange(len(w)), rng.choice(["scumbag", "dimwit", "loathsome"]))
        texts.append(" ".join(w))
    return texts, np.array(y)


def test_toxicity_on_held_out_texts_and_misspellings():
    texts, y = toxic_corpus(1, 700)
    weights, bias, cut = toxicity.train(*blocks(texts), y)
    more, truth = toxic_corpus(2, 500)
    score = toxicity.doc_scores(weights.astype(float), bias, *blocks(more))
    assert ((score >= cut) == (truth == 1)).mean() > 0.95
    wrong = ["scumbagg", "sscumbag", "dimwitt", "loathesome", "loathsomely"]
    rng = random.Random(3)
    filler = [" ".join(rng.choice(WORDS) for _ in range(5)) for _ in wrong]
    spelt = toxicity.doc_scores(weights.astype(float), bias, *blocks([f"{w} {f}" for w, f in zip(wrong, filler)]))
    clean = toxicity.doc_scores(weights.astype(float), bias, *blocks([f"{WORDS[k]} {f}" for k, f in enumerate(filler)]))
    assert spelt.min() > clean.max()


def test_toxicity_edges(spark):
    df = documents(spark)
    labels = spark.createDataFrame([(1, 0, 1), (5, 1, 0), (7, 1, 0), (7, 1, None), (None, 1, 1), (3, 0, 7), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.scores(df, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in df.collect() if r["doc_id"] is not None)
    assert not any(r["toxic"] for r in got if r["doc_id"] in (2, 3, 4))
    assert toxicity.rejected(df, labels.limit(0)).collect() == [] and toxicity.rejected(df.limit(0), labels).collect() == []


# LM


def windows(v, ids, first, stride=lm.STRIDE):
    return lm.windows_of(v.place[ids], first, *lm.context(first, stride))


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    ids, first = rng.integers(0, 300, 500), np.array([0, 0, 130, 131, 500])
    v = lm.Vocabulary(*np.unique(ids, return_counts=True))
    p = {k: x.astype(np.float64) + rng.normal(0, 0.05, x.shape) for k, x in lm.start(v).items()}
    x, y, at = windows(v, ids, first)
    assert sorted(y.tolist()) == sorted(v.place[ids].tolist())  # each once
    _, whole, rows = lm.gradients(v, p, x, y, at)
    d = dict(whole)
    for k, (r, by_row) in rows.items():
        d[k] = np.zeros_like(p[k])
        d[k][r] = by_row
    assert d.keys() == p.keys()
    for k in p:
        for i in (np.unravel_index(np.abs(d[k]).argmax(), d[k].shape), tuple(rng.integers(0, n) for n in d[k].shape)):
            q = {a: b.copy() for a, b in p.items()}
            q[k][i] += 1e-6
            up = lm.losses(v, q, x, y, at).mean()
            q[k][i] -= 2e-6
            assert math.isclose((up - lm.losses(v, q, x, y, at).mean()) / 2e-6, d[k][i], rel_tol=1e-3, abs_tol=1e-8)


def plain_losses(v, p, places):
    """-log p of each place of one text, one window and one position after another."""
    p = {k: x.astype(float) for k, x in p.items()}
    out = []
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    for k in range(len(places)):
        begin = 0 if k < lm.WINDOW else (k - lm.WINDOW) // lm.STRIDE * lm.STRIDE + lm.STRIDE
        seen = [places[j - 1] + lm._INPUTS if j else lm._BEGIN for j in range(begin, k + 1)]
        e = p["emb"][seen] + p["pos"][: len(seen)]
        q, key, value = np.split(e @ p["qkv"], 3, axis=1)
        h = e[-1] + softmax(key @ q[-1]) @ value @ p["o"]
        g = np.append(h + np.maximum(h @ p["w1"] + p["b1"], 0) @ p["w2"], 1)
        c = v.of[places[k]]
        steps = ((g @ p["wc"], c), (p["wp"][v.starts[c] : v.ends[c]] @ g, places[k] - v.starts[c]))
        out.append(sum(np.log(np.exp(z - z.max()).sum()) + z.max() - z[i] for z, i in steps))
    return np.array(out)


@pytest.mark.parametrize("large", [0, 2])
def test_scores_are_those_of_plain_attention(large):
    rng = np.random.default_rng(3)
    ids, first = rng.integers(0, 90, 320), np.array([0, 1, 1, 65, 320])
    v = lm.Vocabulary(*np.unique(ids, return_counts=True))
    p = {k: (x + rng.normal(0, 0.3 + large, x.shape)).astype(np.float32) for k, x in lm.start(v).items()}
    table = pa.table({"id": pa.array(range(4), pa.int64()), "ids": pa.array([ids[a:b].astype(np.uint16).tobytes() for a, b in zip(first, first[1:])], pa.binary())})

    class Shared:
        value = (v, p)

    got = pa.Table.from_batches(lm._scored(Shared)(iter(table.to_batches()))).to_pylist()
    for r, a, b in zip(got, first, first[1:]):
        assert r["n_tokens"] == b - a
        want = plain_losses(v, p, v.place[ids[a:b]]).mean() if b > a else None
        assert (r["nll"] is None) == (want is None) and (want is None or math.isclose(r["nll"], want, rel_tol=1e-3))


def test_ids_are_the_tokenizers_beside_any_white_space():
    texts = ["", "a \u3000b", "word \xa0\n next", "a\u2003\u2003 b", "\x85 \t", " plain text ", "\n\n x", "a line\n\xa0\xa0and an indented one\n\xa0"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    made = pa.Table.from_batches(lm._tokenized(lm.VOCABULARY)(iter([batch])))
    enc = encoding()
    assert [np.frombuffer(x, np.uint16).tolist() for x in made["ids"].to_pylist()] == [enc.encode_ordinary(t) for t in texts]


def test_attention_stays_finite_whatever_the_sums_of_weights():
    rng = np.random.default_rng(11)
    ids, first = rng.integers(0, 40, 128), np.array([0, 64, 128])
    v = lm.Vocabulary(*np.unique(ids, return_counts=True))
    x, y, at = windows(v, ids, first)
    for scale in (1, 30, 300):  # logits from small ones to thousands, of either sign
        p = {k: a.astype(np.float32) for k, a in lm.start(v).items()}
        p["qkv"][:, : 2 * lm.DIM] *= scale
        want = np.concatenate([plain_losses(v, p, v.place[ids[a:b]]) for a, b in zip(first, first[1:])])
        cost, whole, rows = lm.gradients(v, p, x, y, at)
        assert np.allclose(cost, want, atol=2e-2 if scale > 30 else 2e-3)
        assert all(np.isfinite(g).all() for g in whole.values()) and all(np.isfinite(g).all() for _, g in rows.values())


def test_classes_of_one_id_wherever_they_are(monkeypatch):
    rng = np.random.default_rng(12)
    ids, first = rng.integers(0, 20, 100), np.array([0, 40, 100])
    for starts in ([0, 1, 2, 10, 20], [0, 4, 5, 9, 10], range(21), [0]):  # among them a last class of one id, and all
        monkeypatch.setattr(lm, "class_starts", lambda counts: np.array(starts))  # noqa: B023
        v = lm.Vocabulary(*np.unique(ids, return_counts=True))
        p = {k: a + rng.normal(0, 0.05, a.shape) for k, a in lm.start(v).items()}
        x, y, at = windows(v, ids, first)
        want = np.concatenate([plain_losses(v, p, v.place[ids[a:b]]) for a, b in zip(first, first[1:])])
        cost, _, rows = lm.gradients(v, p, x, y, at)
        assert np.allclose(cost, want, atol=1e-6)
        assert set(rows["wp"][0].tolist()) <= set(range(21)) and len(set(rows["wp"][0].tolist())) == len(rows["wp"][0])


def test_every_id_has_its_own_place():
    for n in (1, 63, 64, 4095, 9000):
        ids = np.arange(n) * 5
        v = lm.Vocabulary(ids, np.arange(1, n + 1))
        p = lm.start(v)
        assert len(set(v.place[ids].tolist())) == n and v.place.max() == len(v.of) - 1 == v.ends[-1] - 1
        rare = v.place[ids[:200]].astype(int)
        x, y, at = lm.windows_of(rare, np.array([0, len(rare)]), *lm.context(np.array([0, len(rare)])))
        assert len(p["emb"]) > x.max() and len(set(x[x > lm._PAD].tolist())) == min(n, 200) - 1
        assert np.allclose(lm.losses(v, p, x, y, at), -np.log(p_of(v))[y], atol=1e-4)


def p_of(v):
    """Probability of each place by the counts alone, as an untrained model has it."""
    return np.exp(v.class_bias.astype(float)[v.of] + v.place_bias.astype(float))


def sentences(seed, n):
    rng = random.Random(seed)
    follow = {w: random.Random(w).sample(WORDS, 2) for w in WORDS}
    out = []
    for k in range(n):
        w = [rng.choice(WORDS)]
        while len(w) < rng.randrange(20, 300):
            w.append(rng.choice(follow[w[-1]]))
        out.append((k, " ".join(w)))
    return out


def test_every_token_trains_once(spark):
    rows = sentences(6, 60) + [(7, "the same row again and again " * 9)] * 40  # the copies fill shards
    tokens = lm.tokenized(documents(spark, rows).repartition(3))
    total = tokens.selectExpr("sum(length(ids)) / 2 as n").first()["n"]
    dealt = [[(r["id"], bytes(r["ids"]), r["shard"]) for r in own.collect()] for own in lm.rounds(tokens, total, 600)]
    assert sorted(r[:2] for own in dealt for r in own) == sorted((r["id"], bytes(r["ids"])) for r in tokens.collect())
    for own, share in zip(dealt, lm.SHARES):
        sizes = Counter()
        for _, ids, shard in own:
            sizes[shard] += len(ids) // 2
        assert sizes.total() < 2 * total * share / 16 + 600 and max(sizes.values()) < 4 * 600
    assert sum(any(r[0] == 7 for r in own) for own in dealt) > 1
    ids, first = lm._ids_of(tokens.toArrow())
    v = lm.Vocabulary(*np.unique(ids, return_counts=True))
    win = lm.context(first, lm.WINDOW)
    x, y, _ = lm.windows_of(v.place[ids], first, *win)
    assert len(y) == total and lm.trained(v, lm.start(v), ids, first, 1)[0] == len(x)


def test_scores_beat_counts_and_do_not_depend_on_partitions(spark):
    rows = sentences(4, 300)
    shuffled = [(1000 + k, " ".join(random.Random(k).sample(t.split(), len(t.split())))) for k, (_, t) in enumerate(rows[:60])]
    enc = encoding()
    for shard in (lm.SHARD, 9_000):  # one shard a round, and many
        runs = []
        for parts in (2, 8, 32):
            got = {r["doc_id"]: r for r in lm.scores(documents(spark, rows + shuffled).repartition(parts), shard=shard).collect()}
            runs.append([got[k]["nll"] for k in sorted(got)])
        assert np.allclose(runs[0], runs[1], atol=1e-4) and np.allclose(runs[0], runs[2], atol=1e-4)
        ids = Counter(i for _, t in rows + shuffled for i in enc.encode_ordinary(t))
        unigram = -sum(n * math.log(n / ids.total()) for n in ids.values()) / ids.total()
        weight = np.array([got[k]["n_tokens"] for k in sorted(got)])
        assert (np.array(runs[0]) * weight).sum() / weight.sum() < unigram - 0.5
        mean = lambda keys: sum(got[k]["nll"] for k in keys) / len(keys)
        assert mean(range(60)) < mean(range(1000, 1060)) - 0.3
    assert all(got[k]["n_tokens"] == len(enc.encode_ordinary(t)) for k, t in rows)


def test_lm_edges(spark):
    edge = {(r["doc_id"], r["n_tokens"]): r["nll"] for r in lm.scores(documents(spark)).collect()}
    assert edge[2, 0] is None and edge[3, 0] is None and all(v is None or math.isfinite(v) for v in edge.values())
    assert lm.scores(documents(spark).limit(0)).collect() == []


# near duplicates


def bag(text):
    data, offsets = blocks([text.lower()])
    _, h = minhash.shingles(data, offsets)
    return Counter(h.tolist())


def probability_jaccard(a, b):
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())


def near_corpus(seed):
    rng = random.Random(seed)
    rows, key = [], 0
    for _ in range(25):
        base = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, 7)):
            w = [x if rng.random() > rng.choice([0, 0.01, 0.02, 0.05, 0.3]) else "zz" + str(rng.randrange(99)) for x in base]
            rows.append((key := key + rng.randrange(1, 4), " ".join(w)))
    return rows + [(key + 1, rows[0][1].upper() + "!"), (key + 2, "one"), (key + 3, "one"), (key + 4, ""), (key + 5, None), (None, rows[0][1]), (rows[3][0], rows[3][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_brute_force(spark, seed):
    rows = near_corpus(seed)
    texts = {k: t for k, t in rows if k is not None and t}
    bags = {k: bag(t) for k, t in texts.items()}
    bags = {k: b for k, b in bags.items() if b}
    root = {k: k for k in bags}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    pairs = [(a, b) for a, b in itertools.combinations(sorted(bags), 2) if probability_jaccard(bags[a], bags[b]) >= minhash.THRESHOLD]
    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    got = {r["doc_id"]: r["duplicate_of"] for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    want = {k: top(k) for k in bags if top(k) != k}
    group = lambda k: got.get(k, k)
    assert sum(group(a) == group(b) for a, b in pairs) >= 0.9 * len(pairs) and len(pairs) > 20
    assert all(top(k) == top(v) for k, v in got.items()) and len(got) <= len(want)


def test_similarity_and_signature():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = (Counter(rng.integers(0, 12, rng.integers(1, 30)).tolist()) for _ in "ab")
        x, y = ((np.array(sorted(c), np.uint32), np.array([c[k] for k in sorted(c)])) for c in (a, b))
        assert math.isclose(minhash.similarity(x, y), probability_jaccard(a, b), abs_tol=1e-9)
    a, b = Counter(range(40)), Counter(range(10, 50))
    sig = []
    for c in (a, b):
        key = np.array(sorted(c), np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sig.append(minhash.prob_minhash(np.zeros(len(key), np.int64), key, np.array([c[k] for k in sorted(c)]), 1, 4096)[0])
    assert abs((sig[0] == sig[1]).mean() - probability_jaccard(a, b)) < 0.03


def test_near_duplicates_edges(spark):
    got = {r["doc_id"]: r["duplicate_of"] for r in minhash.near_duplicates(documents(spark)).collect()}
    assert got == {6: 5}
    assert minhash.near_duplicates(documents(spark).limit(0)).collect() == []


# the pipeline


def test_cut_takes_repeats_out_and_nothing_else(spark):
    passage, far = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("p", 60), ("far", 30_000)))
    rows = [(1, f"start one\n{passage} fin one"), (2, f"begin two  {passage}\n\nend two"), (3, passage), (4, "clean text  with  spaces "), (5, None), (None, passage), (6, far), (7, "x " + far), (3, "other text of three")]
    df = documents(spark, rows).withColumnsRenamed({"row": "__id", "key": "__spans", "data": "__sum", "rank": "__ID_"})
    out = suffix.cut(df)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert (1, rows[0][1]) in got and (2, "begin two\n\nend two") in got and (4, rows[3][1]) in got and (None, passage) in got and (5, None) in got
    assert (3, "other text of three") in got and (6, far) in got and (7, "x") in got
    assert suffix.cut(df.limit(0)).collect() == []


def small_tables(tmp_path, spark):
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "a", "o", "x"]) for _ in range(n))
    passage, exam = prose(70), "what is the tallest mountain on that far planet"
    docs, labels = [], []
    for k in range(240):
        bad = k % 4 == 0
        w = prose(rng.randrange(60, 120)).split()
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["scumbag", "dimwit", "loathsome"]))
        docs.append([k, " ".join(w)])
        labels.append((k, 1, int(bad)))
    docs[11][1] = docs[10][1] + " almost"
    docs[21][1] = docs[21][1] + " " + passage
    docs[22][1] = passage + " " + docs[22][1]
    docs[31][1] = docs[31][1] + f" What is the TALLEST mountain, on that far planet? " + prose(20)
    rows = [(k, t, "en", "s", len(t)) for k, t in docs] + [(500, None, "en", "s", 0), (501, "", "en", "s", 0), (None, "no id", "en", "s", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, exam)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return docs, passage


def plain_toxicity(text, weights, bias):
    """Highest probability of a tile, n-gram by n-gram."""
    w, best = text.lower().split(), 0.0
    for a in range(0, len(w), toxicity.TILE):
        grams = []
        for x in {*w[a : a + toxicity.TILE]}:
            raw = np.frombuffer(f" {x} ".encode(), np.uint8)
            for n in toxicity.GRAMS:
                for k in range(len(raw) - n + 1):
                    h = hash_spans(byte_prefix(raw[k : k + n]), np.array([0]), np.array([n]))[0]
                    grams.append(weights[int(h) >> (64 - 18)])
        best = max(best, 1 / (1 + math.exp(-(sum(grams) / max(len(grams), toxicity.FLOOR) + bias))))
    return best


def plain_cut(text, words):
    out, last = [], 0
    for k, m in enumerate(re.finditer(r"\S+", text)):
        if k not in words:
            out.append(text[last : m.end()])
        last = m.end()
    return ("".join(out) + text[last:]).strip()


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, _ = small_tables(tmp_path, spark)
    whole, labels = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("documents", "labels"))
    raw, bias, cut = toxicity.model(whole, labels)
    weights = np.frombuffer(raw, np.float32).astype(float)
    texts = {k: t for k, t in docs if plain_toxicity(t, weights, bias) < cut}
    bags = {k: bag(t) for k, t in texts.items()}
    for b in sorted(bags):
        if any(a < b and probability_jaccard(bags[a], bags[b]) >= minhash.THRESHOLD for a in texts):
            del texts[b]
    texts |= {501: ""}
    again = brute(sorted(texts.items()), suffix.LENGTH)
    texts = {k: plain_cut(t, again[k]) if k in again else t for k, t in texts.items()}
    leaks = naive_matches(list(texts.items()), [(r["item_id"], r["text"]) for r in spark.read.parquet(str(tmp_path / "benchmark.parquet")).collect()])
    texts = {k: t for k, t in texts.items() if k not in {d for d, *_ in leaks}}
    enc, want, lengths = encoding(), Counter(), []
    for k, t in [*texts.items(), (None, "no id")]:
        n = len(enc.encode_ordinary(t))
        pieces = [packing.CAPACITY] * (n // packing.CAPACITY) + [n % packing.CAPACITY] * (n % packing.CAPACITY > 0)
        want.update((k, at * packing.CAPACITY, x) for at, x in enumerate(pieces))
        lengths += pieces
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["start"], r["length"]) for r in got) == want and leaks and again
    bins: dict = {}
    for r in got:
        bins.setdefault(r["bin"], []).append((r["place"], r["length"]))
    assert Counter(tuple(n for _, n in sorted(own)) for own in bins.values()) == naive_best_fit(lengths, packing.CAPACITY)


def test_pipeline_edges(spark, tmp_path):
    """Nulls, ties, equal rows, one id with two texts, long texts, columns named as the stages' own; then nothing at all."""
    extra = {"row": "__id", "key": "__spans", "data": "__sum", "rank": "hash", "bin": "part", "start": "band"}
    docs = documents(spark).withColumnsRenamed(extra)
    labels = spark.createDataFrame([(1, 0, 0), (7, 1, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "word1 word2 word3 word4 word5 word6 word7"), (None, "x"), (2, None)], "item_id long, text string")
    for name, rows in (("full", docs), ("none", docs.limit(0))):
        where = tmp_path / name
        for table, df in (("documents", rows), ("labels", labels), ("benchmark", bench)):
            df.write.parquet(str(where / f"{table}.parquet"))
        now = spark.read.parquet(str(where / "documents.parquet"))
        for stage, f in corpus_pipeline.STAGES:
            before, now = now, f(spark, now, str(where))
            now.write.parquet(str(where / stage))
            now = spark.read.parquet(str(where / stage))
            if stage != "packing":
                assert now.columns == before.columns
            if stage == "decontamination" and name == "full":
                left = Counter(r["doc_id"] for r in now.collect())
        assert name == "full" or now.count() == 0
    # the copy of 5 is a near duplicate, 5 holds the item; rows that can't be judged stay, as do the rows of 1
    assert left == Counter({1: 3, 2: 1, None: 1, 3: 1, 4: 1, 7: 1, 8: 1, 9: 1})


def test_stages_take_effect(spark, tmp_path):
    docs, passage = small_tables(tmp_path, spark)
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        before, df = df, stage(spark, df, str(tmp_path))
        df.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert df.columns == before.columns
            left[name] = {r["doc_id"]: r["text"] for r in df.collect()}
    toxic = {k for k, _ in docs if k % 4 == 0}
    gone = {k for k, _ in docs} - left["toxicity"].keys()
    whole, labels = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("documents", "labels"))
    assert gone == {r["doc_id"] for r in toxicity.rejected(whole, labels).collect()}
    assert len(gone & toxic) >= 0.9 * len(toxic) and len(gone - toxic) < 9
    assert left["toxicity"].keys() - left["near_duplicates"].keys() == {11} - gone
    changed = {k for k, t in left["repeated_passages"].items() if t != left["near_duplicates"][k]}
    assert changed == {22} and passage not in left["repeated_passages"][22] and {500, None} <= left["repeated_passages"].keys()
    assert left["repeated_passages"].keys() - left["decontamination"].keys() == {31} - gone
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, df.collect()))
