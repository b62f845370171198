"""WARC chunks, chat spans, decontamination, packing, I-Match and licences against plain versions."""

import gzip
import hashlib
import io
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import chat, decontaminate, imatch, licenses, packing, tokens, warc
from tracewright.llm.kernels import buffers

from .edge import LONG, documents


# WARC


def test_chunks_carry_the_digest_on(spark):
    pages = [(1, "a" * 10 + "ü"), (2, ""), (3, None), (None, "x"), (1, "again"), (4, LONG)]
    df = spark.createDataFrame([(*p, 5, "z") for p in pages], "page_id long, html string, record int, payload string")
    got = {}
    for r in sorted(warc.chunked(df, "page_id", "html", size=4).collect(), key=lambda r: (r["record"], r["chunk"])):
        got.setdefault((r["record"]), []).append(r)
    assert set(got) == {1, 2, 4}
    for key, text in ((2, ""), (4, LONG)):
        raw, rows = text.encode(), got[key]
        assert b"".join(bytes(r["data"]) for r in rows) == raw
        assert [r["digest"] for r in rows[:50]] == [hashlib.sha256(raw[: r["offset"] + r["length"]]).hexdigest() for r in rows[:50]]
        assert [r["last"] for r in rows] == [False] * (len(rows) - 1) + [True]
        assert rows[-1]["digest"] == hashlib.sha256(raw).hexdigest()
    assert warc.chunked(df.limit(0), "page_id", "html").collect() == []


def test_files_round_trip(spark, tmp_path):
    rows = [(k, f"http://x/{k}", t) for k, t in enumerate(["", "short", LONG, "ü\r\n\r\nWARC/1.0\r\n", None])]
    df = spark.createDataFrame(rows, "id long, url string, html string").repartition(2)
    assert warc.write(df, str(tmp_path / "w"), "id", "html", "url") == 4
    back = warc.read(spark, str(tmp_path / "w"), size=1000).orderBy("record", "chunk").collect()
    got = {}
    for r in back:
        got[r["record"], r["target"]] = got.get((r["record"], r["target"]), b"") + bytes(r["data"])
        assert len(r["data"]) <= 1000
    assert got == {(f"<urn:record:{k}>", u): t.encode() for k, u, t in rows if t is not None}


def record(name, target, body):
    return warc.record_head(name, target, len(body)) + body + b"\r\n\r\n"


def test_reader_holds_one_chunk_and_stops_at_a_cut():
    body = bytes(range(256)) * 4000
    whole = record("<a>", None, body) + record("<b>", "u", b"")
    for raw in (whole, gzip.compress(whole)):
        seen = [(h["warc-record-id"], [(at, len(p), last) for _, at, p, _, last in chunks]) for h, chunks in warc.records(io.BytesIO(raw), 5000)]
        assert [s[0] for s in seen] == ["<a>", "<b>"] and sum(n for _, n, _ in seen[0][1]) == len(body) and seen[1][1] == [(0, 0, True)]
    cut = [c for _, chunks in warc.records(io.BytesIO(whole[:50_000]), 5000) for c in chunks]
    assert not any(c[4] for c in cut) and sum(len(c[2]) for c in cut) < 50_000
    assert [h for h, _ in warc.records(io.BytesIO(b"not a warc"))] == [{"error": "bytes that are no record"}]
    assert list(warc.records(io.BytesIO(b""))) == [] and list(warc.records(io.BytesIO(b"\r\n\r\n"))) == []


def read_all(raw):
    out = []
    for head, chunks in warc.records(io.BytesIO(raw), 5000):
        parts = list(chunks)
        out.append(("error", "") if "error" in head else (head["warc-record-id"], b"".join(c[2] for c in parts) if parts[-1:] and parts[-1][4] else None))
    return out


def test_reader_goes_on_after_what_is_broken():
    noise = random.Random(1).randbytes(200_000)
    a, b, c = (record(n, None, t) for n, t in (("<a>", b"one"), ("<b>", b"two WARC/1.1 two"), ("<c>", noise)))
    short = b"WARC/1.1\r\nWARC-Record-ID: <x>\r\n\r\nbody\r\n"
    long = b"WARC/1.1\r\nx: " + b"y" * (3 << 20) + b"\r\n\r\n"
    want = [("<a>", b"one"), ("error", ""), ("<b>", b"two WARC/1.1 two"), ("<c>", noise)]
    for junk in (short, long, b"\x00\x01 junk\nmore\n", b"WARC/1.1\r\nContent-Length: none\r\n\r\n"):
        assert read_all(a + junk + b + c) == want
        assert read_all(gzip.compress(a) + gzip.compress(junk) + gzip.compress(b) + gzip.compress(c)) == want
    # bytes that aren't gzip between members, and a member that is damaged within
    assert read_all(gzip.compress(a) + b"\x00" * 70_000 + gzip.compress(b) + gzip.compress(c)) == want
    hurt = bytearray(gzip.compress(c))
    hurt[100_000:100_050] = b"\xff" * 50
    got = read_all(gzip.compress(a) + bytes(hurt) + gzip.compress(b))
    assert got[0] == ("<a>", b"one") and got[-1] == ("<b>", b"two WARC/1.1 two") and ("error", "") in got and ("<c>", noise) not in got
    assert [r[0] for r in read_all(gzip.compress(a) + gzip.compress(c)[:1000])] == ["<a>", "<c>"]


def test_chunk_table_makes_files(spark, tmp_path):
    rows = [(k, random.Random(k).randbytes(n)) for k, n in enumerate((0, 10, 5000, 300_000))]
    df = spark.createDataFrame(rows, "id long, raw binary").repartition(3)
    assert warc.write(df, str(tmp_path / "bin" / "deep"), "id", "raw") == 4  # not UTF-8
    read = warc.read(spark, str(tmp_path / "bin"), size=700)
    assert {r["error"] for r in read.select("error").collect()} == {None}
    assert warc.write_chunks(read.withColumn("record", F.regexp_extract("record", r"(\d+)", 1)).orderBy(F.rand(1)), str(tmp_path / "again")) == 4
    got = {}
    for r in warc.read(spark, str(tmp_path / "again")).orderBy("record", "chunk").collect():
        got[r["record"]] = got.get(r["record"], b"") + bytes(r["data"])
    assert got == {f"<urn:record:{k}>": t for k, t in rows}
    with pytest.raises(Exception, match="chunks missing"):
        warc.write_chunks(read.where("chunk <> 3"), str(tmp_path / "holes"))


# chat


def test_spans_find_turns_and_rewriting(spark):
    turns = [("user", "hi"), ("assistant", "think\nyes"), ("user", "more"), ("assistant", "a\nb")]
    for f in (chat.chatml, chat.instruct):
        out = f(turns)
        s = chat.spans(turns, f)
        assert "".join(out[a:b] for a, b, _ in s) == out and not any(w for *_, w in s)
    s = chat.spans(turns, chat.last_answer_only)
    assert [w for *_, w in s] == [False, False, False, True]
    first = chat.last_answer_only(turns[:3])
    assert chat.last_answer_only(turns).startswith(first[: s[3][0]]) and not chat.last_answer_only(turns).startswith(first[: s[3][0] + 1])
    assert not any(w for *_, w in chat.spans(turns, chat.closed, "]")) and all(w for *_, w in chat.spans(turns, chat.closed)[1:])


def test_template_that_refuses_prefixes(spark):
    def strict(turns):
        if not turns or turns[-1][0] != "assistant":
            raise ValueError("ends with the user")
        return chat.chatml(turns)

    turns = [("user", "hi"), ("assistant", "yes"), ("user", "more"), ("assistant", "no")]
    n = len(chat.chatml(turns[:2]))
    want = [(None, None, None), (0, n, False), (None, None, None), (n, len(chat.chatml(turns)), False)]
    assert chat.spans(turns, strict) == want
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn int, role string, text string")
    got = chat.turn_spans(df, {"strict": (strict, "")}).orderBy("turn").collect()
    assert [(r["start"], r["end"], r["rewrites"]) for r in got] == want


def test_ids_that_are_no_numbers_count_as_null(spark):
    df = spark.createDataFrame([("12", "alpha beta gamma delta epsilon zeta"), ("x7", "alpha beta gamma delta epsilon zeta"), (None, "other")], "doc_id string, text string")
    items = spark.createDataFrame([("3", "alpha beta gamma delta epsilon zeta"), ("q", "beta gamma delta epsilon zeta eta")], "item_id string, text string")
    assert [r["doc_id"] for r in decontaminate.matches(df, items).collect()] == [12]
    assert {r["doc_id"] for r in packing.packed(df).collect()} == {12, None}
    assert [r["doc_id"] for r in imatch.duplicates(df).collect()] == [12]
    assert licenses.found(df).collect() == [] and {r["record"] for r in warc.chunked(df, "doc_id", "text").collect()} == {12}


def test_conversations_with_gaps(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 1, "user", "y"), (2, 1, "assistant", LONG)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    got = chat.turn_spans(df, {"chatml": chat.TEMPLATES["chatml"]}).collect()
    assert Counter(r["conv_id"] for r in got) == {1: 3, 2: 1}
    first = sorted((r["turn"], r["role"], r["start"], r["end"]) for r in got if r["conv_id"] == 1)
    assert [f[1] for f in first] == ["", "user", "user"] and all(a[3] == b[2] for a, b in zip(first, first[1:]))
    assert chat.turn_spans(df.limit(0)).collect() == []


# decontamination


def naive_matches(docs, items):
    word = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    low = lambda t: "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
    shapes = {}
    for i, t in items:
        w = tuple(word.findall(low(t or "")))
        if i is not None and len(w) >= 6:
            shapes[w] = min(i, shapes.get(w, i))
    out = set()
    for d, t in docs:
        spans = [(m.group(), m.start(), m.end()) for m in word.finditer(low(t))] if d is not None and t else []
        for w, i in shapes.items():
            for k in range(len(spans) - len(w) + 1):
                if tuple(s[0] for s in spans[k : k + len(w)]) == w:
                    out.add((d, i, spans[k][1], spans[k + len(w) - 1][2]))
    return out


def test_decontamination_equals_naive(spark):
    rng = random.Random(3)
    words = ["Äpfel", "the", "cat", "été", "sat", "on", "mat", "日本"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 9)))) for k in range(12)] + [(99, None), (None, "a b c d e f g"), (50, "The CAT, sat: on the mat!"), (51, "the cat sat on the mat")]
    docs = []
    for k in range(60):
        t = [rng.choice(words) + rng.choice(["", ",", ".", "\n", "  "]) for _ in range(rng.randrange(0, 30))]
        t.insert(rng.randrange(len(t) + 1), rng.choice(items)[1] or "")
        docs.append((k, " ".join(t).upper() if k % 3 else " ".join(t)))
    docs += [(100, None), (None, "the cat sat on the mat"), (101, ""), (102, "the-cat...sat\ton the MAT the cat sat on the mat"), (102, "the cat sat on the mat")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontaminate.matches(documents(spark, docs), bench).collect()}
    assert got == naive_matches(docs, items) and any(d == 102 for d, *_ in got)
    assert decontaminate.matches(documents(spark).limit(0), bench).collect() == []
    assert decontaminate.matches(documents(spark), bench.limit(0)).collect() == []


def test_automata_split_when_long(spark, monkeypatch):
    items = [(k, f"alpha beta gamma delta word{k} end") for k in range(20)] + [(30, "ALPHA beta, gamma delta word3 end")]
    docs = [(k, f"so {t} so {items[(k + 1) % 20][1]}") for k, t in items]
    bench, made, real = spark.createDataFrame(items, "item_id long, text string"), [], decontaminate._scanned
    monkeypatch.setattr(decontaminate, "_scanned", lambda shared: (made.append(shared.value), real(shared))[1])
    got = [{tuple(r) for r in decontaminate.matches(documents(spark, docs), bench, chars=chars).collect()} for chars in (10_000, 100)]
    assert got[0] == got[1] == naive_matches(docs, items)
    assert len(made[0]) == 20 and len(made) > 4 and sum(map(len, made[1:])) == 20


# packing


def naive_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        room = [capacity - sum(b) for b in bins]
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            bins[min(fits, key=lambda k: room[k])].append(n)
        else:
            bins.append([n])
    return Counter(tuple(b) for b in bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 100])
    lengths = [min(capacity, int(rng.paretovariate(1) * 2)) for _ in range(rng.randrange(0, 300))]
    counts = sorted((n, s, c) for (n, s), c in Counter((n, rng.randrange(32)) for n in lengths).items())
    known = packing._lookup(counts, capacity)
    bins: dict = {}
    for n, s, c in counts:
        at, place = packing._at(known, capacity, np.full(c, n), np.full(c, s), np.arange(c))
        for b, p in zip(at.tolist(), place.tolist()):
            bins.setdefault(b, []).append((p, n))
    for own in bins.values():
        own.sort()
        assert all(p + n == q for (p, n), (q, _) in zip(own, own[1:])) and own[0][0] == 0 and own[-1][0] + own[-1][1] <= capacity
    assert Counter(tuple(n for _, n in own) for own in bins.values()) == naive_best_fit(lengths, capacity)
    assert sorted(bins) == list(range(len(bins)))


def test_packed_rows_are_best_fit_decreasing(spark):
    rng = random.Random(11)
    docs = [(k % 90, " ".join(rng.choice(["one", "two", "three"]) for _ in range(min(700, int(rng.paretovariate(0.9) * 6))))) for k in range(150)]
    enc, lengths = tokens.encoding(), []
    for _, t in docs:
        n = len(enc.encode_ordinary(t))
        lengths += [64] * (n // 64) + [n % 64] * (n % 64 > 0)
    for together in (packing.TOGETHER, 3):
        bins: dict = {}
        for r in packing.packed(documents(spark, docs), capacity=64, together=together).collect():
            bins.setdefault(r["bin"], []).append((r["place"], r["length"]))
        for own in bins.values():
            own.sort()
            assert own[0][0] == 0 and all(p + n == q for (p, n), (q, _) in zip(own, own[1:]))
        assert Counter(tuple(n for _, n in own) for own in bins.values()) == naive_best_fit(lengths, 64)


def test_segment_tree_finds_the_tightest():
    tree, open_ = packing.SegmentTree(100), set()
    rng = random.Random(0)
    for _ in range(500):
        k = rng.randrange(101)
        open_ ^= {k}
        tree.set(k, int(k in open_))
        at = rng.randrange(101)
        assert tree.least(at) == min((x for x in open_ if x >= at), default=-1)


def test_every_token_is_packed_once(spark):
    df = documents(spark)
    got = packing.packed(df, capacity=64).collect()
    enc = tokens.encoding()
    want = Counter()
    for r in df.collect():
        if r["text"]:
            want[r["doc_id"]] += len(enc.encode_ordinary(r["text"]))
    have = Counter()
    for r in got:
        have[r["doc_id"]] += r["length"]
        assert r["place"] + r["length"] <= 64
    assert have == want
    fives = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == 5)
    assert all(a + n == b for (a, n), (b, _) in zip(fives, fives[1:]))
    assert packing.packed(df.limit(0)).collect() == []


def test_cached_ids_are_the_tokenizers():
    import pyarrow as pa

    texts = ["", " ", "Hello  world\n\n it's 12,5 ü 中文 …", "a\tb \n c", "  lead", "trail  ", "x" * 500, "same same  same", "\n\n\n"]
    data, offsets = buffers(pa.array(texts))
    tok, enc = tokens.Tokenizer(), tokens.encoding()
    ids, first = tok.encode(data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [enc.encode_ordinary(t) for t in texts]
    assert tok.counts(data, offsets).tolist() == [len(enc.encode_ordinary(t)) for t in texts]
    forgetful, tokens.REMEMBERED = tokens.REMEMBERED, 3
    try:
        assert tokens.Tokenizer().counts(data, offsets).tolist() == [len(enc.encode_ordinary(t)) for t in texts]
    finally:
        tokens.REMEMBERED = forgetful


# I-Match


def test_shuffled_lexicon_gives_the_same(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(f"t{rng.randrange(300)}" for _ in range(rng.randrange(0, 40)))) for k in range(150)]
    rows += [(200 + k, rows[k][1].upper()) for k in range(20)] + [(3, "other words t1 t2 t3 t4 t5"), (7, rows[7][1]), (None, "t1 t2"), (900, None)]
    df = documents(spark, rows)
    near = sorted(map(tuple, imatch.duplicates(df).collect()), key=str)
    assert near == sorted(map(tuple, imatch.duplicates(df, lexicon_chars=-1).collect()), key=str)
    same = {r[0]: r[-1] for r in near}
    assert all(same[200 + k] == same[k] <= k for k in range(20) if k in same and k != 3) and len(same) > 100
    assert imatch.duplicates(df.limit(0)).collect() == []
    imatch.duplicates(documents(spark)).collect()


def test_every_exact_copy_is_found(spark):
    rng = random.Random(11)
    rows = [(k, " ".join(f"t{rng.randrange(300)}" for _ in range(20))) for k in range(100)]
    few = ["the same few words", "THE " * 300, "short", "…!?", "t1 t2 unheard", " 中文 "]
    rows += [(1000 + 10 * k + c, t) for k, t in enumerate(few) for c in range(3)] + [(2000, "--"), (2001, " \n"), (2002, ""), (2003, "the same few")]
    df = documents(spark, rows)
    found = imatch.duplicates(df).collect()
    same = {r["doc_id"]: r["same_as"] for r in found}
    assert sorted(r["doc_id"] for r in found) == sorted(k for k, t in rows if t.strip())
    assert all(same[1000 + 10 * k + c] == 1000 + 10 * k for k in range(len(few)) for c in range(3))
    assert same[2000] == 2000 and same[2003] == 2003
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, imatch.duplicates(df, lexicon_chars=-1).collect()), key=str)


# licences


def naive_licenses(text):
    low = "".join(c.lower() for c in text)
    parts = [p for p in re.split(r"(?<=\n)|(?<=\.)(?=[ \n])", low)]
    pairs = lambda t: Counter(zip(w := licenses.words_of(t), w[1:]))
    out = {}
    for a in range(len(parts)):
        for b in range(a + 1, len(parts) + 1):
            bag = pairs("".join(parts[a:b]))
            for name, t in licenses.TEMPLATES:
                d = licenses.dice(bag, pairs(t))
                if d >= licenses.THRESHOLD:
                    out[name] = max(out.get(name, 0), d)
    return out


def test_licences_equal_naive(spark):
    rng = random.Random(2)
    rows = []
    for k in range(80):
        parts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 12))) + rng.choice([".", "\n", ". "]) for _ in range(rng.randrange(1, 6))]
        for _ in range(rng.randrange(0, 3)):
            w = rng.choice(licenses.TEMPLATES)[1].split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = "changed"
            if rng.random() < 0.3:
                w[len(w) // 2] += "\n"
            parts.insert(rng.randrange(len(parts) + 1), " ".join(w) + rng.choice(["\n", " "]))
        rows.append((k, "".join(parts)))
    got = {}
    for r in licenses.found(documents(spark, rows)).collect():
        got.setdefault(r["doc_id"], {})[r["license"]] = r["dice"]
        text = dict(rows)[r["doc_id"]][r["start"] : r["end"]]
        assert text.strip()
    want = {k: n for k, t in rows if (n := naive_licenses(t))}
    assert {k: {n: round(d, 9) for n, d in v.items()} for k, v in got.items()} == {k: {n: round(d, 9) for n, d in v.items()} for k, v in want.items()}
    assert len(want) > 30
    assert licenses.found(documents(spark)).collect() == [] and licenses.found(documents(spark).limit(0)).collect() == []


def best_windows(text, templates):
    """By every window of words, grown word by word."""
    w, out = licenses.words_of(text), {}
    pairs = list(zip(w, w[1:]))
    for name, t in templates:
        bag = Counter(zip(v := licenses.words_of(t), v[1:]))
        if not bag.keys() & {*pairs}:
            continue  # nothing shared, so 0 everywhere
        places, until = {}, np.zeros(len(pairs), np.int64)  # a pair counts in windows that begin before this
        for j, pair in enumerate(pairs):
            places.setdefault(pair, []).append(j)
            k = len(places[pair]) - 1 - bag[pair]  # as many later ones as the template has count already
            until[j] = places[pair][k] + 1 if k >= 0 else 0
        for a in range(len(pairs)):
            shared = np.cumsum(until[a:] <= a)
            d = (2 * shared / (np.arange(1, len(shared) + 1) + bag.total())).max()
            if d >= licenses.THRESHOLD:
                out[name] = max(out.get(name, 0), float(d))
    return out


def test_licences_in_any_lines_equal_all_windows(spark):
    import textwrap

    rng = random.Random(8)
    dotted = ("Dotted", "First you may copy this.\nThen you may change that.\nLast you may sell both.\n")
    templates = licenses.TEMPLATES + licenses.FULL_TEXTS + (dotted,)
    fill = lambda n: " ".join(rng.choice(["of the", "this", "license", "w1", "w2", "to the", "rights reserved"]) for _ in range(rng.randrange(n)))
    rows = [(k, "\n".join(textwrap.wrap(t, width)) if k % 2 else "\n\n".join(textwrap.wrap(t, width))) for k, (width, (_, t)) in enumerate((w, t) for w in (30, 50) for t in templates)]
    whole = len(rows)
    for k in range(whole, whole + 60):
        text = rng.choice(templates)[1].split()
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = rng.choice(["changed", "the", text[0], "two words", "."])
        at = rng.randrange(len(text) + 1)
        text[at:at] = fill(4).split()
        rows.append((k, f"{fill(12)} {rng.choice([' ', chr(10)]).join(text)}\n{fill(12)} {rng.choice(templates)[1]} {fill(5)}"))
    got = {}
    for r in licenses.found(documents(spark, rows), templates=templates, anywhere=True).collect():
        got.setdefault(r["doc_id"], {})[r["license"]] = round(r["dice"], 9)
        part = dict(rows)[r["doc_id"]][r["start"] : r["end"]]
        assert round(best_windows(part, [t for t in templates if t[0] == r["license"]])[r["license"]], 9) == round(r["dice"], 9)
    assert got == {k: {n: round(d, 9) for n, d in v.items()} for k, t in rows if (v := best_windows(t, templates))}
    assert all(got[k][templates[k % len(templates)][0]] == 1 for k in range(whole))
    assert licenses.found(documents(spark), anywhere=True).collect() == []
