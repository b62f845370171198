"""Scores of documents by a causal self-attention model on subword ids, trained here in numpy.

A token is embedded with its place in the window; one causal self-attention block with a residual and a
ReLU layer follows; the next id is predicted in two steps, its class, then the id within the class, with
weights of that class. Classes come from the counts of all ids of the corpus: ids are ordered by count and
successive ones form a class, few frequent ones or many rare ones, such that a prediction takes few outputs;
every id has its own place, embedding and output weights. The output biases start from these counts, so
training starts at the unigram model.

Training is one pass over every token of every row. Rows are dealt, by a hash of id and tokens, to rounds (of
growing ``SHARES``) and within a round to shards of about ``SHARD`` tokens, so that a shard is the same
whatever the partitions, and there are as many as the corpus has tokens. In a round every shard trains from the
same parameters on its windows, in an order drawn from its number; the results are averaged by the number of
windows, in a way that doesn't depend on the order of summing. A row that fills shards by its copies is dealt
by place instead, as its copies are alike.

A context window holds ``WINDOW`` tokens and the next one begins ``STRIDE`` later; a window scores only what
the one before did not, so each token is scored once and, but at the beginning of a text, with at least
WINDOW - STRIDE tokens before it. Windows are scored in batches under one causal mask, with padding masked.
For training, windows follow one another without overlap, so each token is a target once there, too.

Defined cases: a null id has no score; a null or empty text has 0 tokens and a null score; the first token
is predicted from a mark of the text's beginning; rows that share an id are scored each. An empty table gives
no rows; further columns are ignored. Ids of the vocabulary must be below 65,536.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spooled, column, hinted, number
from .kernels import batch_blocks, frugal
from .tokens import VOCABULARY, tokenizer

WINDOW, STRIDE = 64, 48
DIM, HIDDEN = 16, 32
#: Sixteenths of the rows that each round takes: the first ones only find the way.
SHARES = (1, 3, 12)
#: Tokens of a shard, about.
SHARD = 4_000_000
#: Windows of a training step at most, and steps of a pass at least, as far as steps of 8 windows go.
BATCH = 128
STEPS = 500
RATE = 0.08
_BEGIN, _PAD, _INPUTS = 0, 1, 2  # inputs: the beginning, padding, then the places
_F = np.float32
#: Windows whose attention is done at once, so that what they need stays in the cache, and queries at once.
BLOCK, QUERIES = 32, 32
_LOWER = np.tril(np.ones((WINDOW, WINDOW), _F))
#: Beyond this no exponential is taken of a logit itself, but of its difference to the row's largest.
_SAFE = 60.0
#: So, too, in attention, where a query's weights sum to more than this or to less than its inverse.
_RANGE = 1e25


def class_starts(counts: np.ndarray) -> np.ndarray:
    """Where classes of ids begin, from counts in descending order, so that a prediction takes few outputs: the
    classes, and with its probability each class's ids. Some of the first ids are classes by themselves."""
    n, best, least = len(counts), np.zeros(1, np.int64), np.inf
    upto = np.append(0, np.cumsum(counts)) / max(1, counts.sum())
    for single in range(0, min(n, 256) + 1, 8):
        for size in (8, 16, 32, 64, 128):
            for growth in (1.0, 1.25, 1.5, 2.0):
                cut, step, at = list(range(single)), float(size), single
                while at < n:
                    cut.append(at)
                    at += int(step)
                    step *= growth
                cut = np.array(cut, np.int64)
                wide = np.diff(np.append(cut, n))
                share = np.diff(np.append(upto[cut], 1.0))
                cost = 1.2 * len(cut) + float((share * wide * (wide > 1)).sum())  # a class costs some calls besides
                if cost < least:
                    best, least = cut, cost
    return best


class Vocabulary:
    """Places of ids by count, and the classes that successive places form."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        order = np.lexsort((ids, -counts))
        ids, counts = ids[order].astype(np.int64), counts[order].astype(np.float64)
        counts = np.append(counts, 0.0) + 1.0  # a place is left for ids that the corpus lacks
        self.place = np.full(int(ids.max(initial=0)) + 2, len(ids), np.int32)
        self.place[ids] = np.arange(len(ids))
        self.starts = class_starts(counts)
        self.ends = np.append(self.starts[1:], len(counts))
        self.of = np.repeat(np.arange(len(self.starts)), self.ends - self.starts)  # class of each place
        in_class = np.add.reduceat(counts, self.starts)
        self.class_bias = np.log(in_class / counts.sum()).astype(_F)
        self.place_bias = np.log(counts / in_class[self.of]).astype(_F)


def start(v: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters before training; the last of the output weights is the bias."""
    rng, places = np.random.default_rng(seed), len(v.of)
    w = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(_F)
    wc, wp = np.zeros((DIM + 1, len(v.starts)), _F), np.zeros((places, DIM + 1), _F)
    wc[DIM], wp[:, DIM] = v.class_bias, v.place_bias
    qk = _F(DIM**-0.25)  # both together scale the product by the root of DIM
    return {
        "emb": rng.normal(0, 0.3, (places + _INPUTS, DIM)).astype(_F), "pos": rng.normal(0, 0.1, (WINDOW, DIM)).astype(_F),
        "qkv": np.concatenate([w(DIM, DIM) * qk, w(DIM, DIM) * qk, w(DIM, DIM)], 1), "o": w(DIM, DIM),
        "w1": w(DIM, HIDDEN), "b1": np.zeros(HIDDEN, _F), "w2": w(HIDDEN, DIM), "wc": wc, "wp": wp,
    }


def hidden(p: dict[str, np.ndarray], x: np.ndarray, begin: int = 0, out: np.ndarray | None = None):
    """(states, what the way back needs) of inputs (n, t) at the positions from ``begin`` on, one after another; a
    column of ones follows the states. Queries go in blocks that see only the keys up to their end. Padding is at
    the end, where no token looks. out: where the states go."""
    n, t = x.shape
    kind = p["emb"].dtype
    e = p["emb"].take(x.ravel(), 0)
    by_window = e.reshape(n, t * DIM)
    by_window += p["pos"][:t].ravel()
    qkv = np.empty((n, t, 3 * DIM + 1), kind)
    np.matmul(e, p["qkv"], out=qkv.reshape(n * t, -1)[:, : 3 * DIM])
    qkv[:, :, 3 * DIM] = 1  # the ones sum the weights
    q, k, v = qkv[:, :, :DIM], qkv[:, :, DIM : 2 * DIM], qkv[:, :, 2 * DIM :]
    m = np.empty((n, t - begin, DIM + 1), kind)
    for safe in (False, True):
        weights = []
        for lo in range(begin, t, QUERIES):
            hi = min(t, lo + QUERIES)
            a = q[:, lo:hi] @ k[:, :hi].transpose(0, 2, 1)
            if safe:
                a[:, _LOWER[lo:hi, :hi] == 0] = -np.inf
                a -= a.max(-1, keepdims=True)
            with np.errstate(over="ignore", invalid="ignore"):
                np.exp(a, out=a)
                a *= _LOWER[lo:hi, :hi]
                np.matmul(a, v[:, :hi], out=m[:, lo - begin : hi - begin])
            weights.append((lo, hi, a))
        total = m[:, :, DIM:]
        if float(total.min(initial=1)) > 1 / _RANGE and float(total.max(initial=1)) < _RANGE:  # neither holds of what isn't a number
            break
    mixed = (m[:, :, :DIM] / total).reshape(-1, DIM)
    h = mixed @ p["o"]
    h += e if not begin else e.reshape(n, t, DIM)[:, begin:].reshape(-1, DIM)
    r = h @ p["w1"]
    r += p["b1"]
    np.maximum(r, 0, out=r)
    g = np.empty((len(h), DIM + 1), kind) if out is None else out
    np.add(r @ p["w2"], h, out=g[:, :DIM])
    g[:, DIM] = 1
    return g, (x, e, q, k, v, weights, total, mixed, h, r)


def _exponentials(z: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the logits z, in place, less what keeps them finite: their sums, and -log softmax at one column of each row."""
    chosen = z[np.arange(len(z)), at]
    if float(z.max(initial=0)) > _SAFE:
        top = z.max(-1)
        z -= top[:, None]
        chosen = chosen - top
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    return total, np.log(total) - chosen


class Output:
    """The two steps of a prediction of the places y from the rows ``at`` of the hidden states g (with ones). Tokens
    are taken in the order of their classes, ``order``, so that those of a class follow one another."""

    def __init__(self, v: Vocabulary, p: dict[str, np.ndarray], g: np.ndarray, at: np.ndarray, y: np.ndarray):
        self.p, wide = p, v.ends - v.starts
        turns = np.argsort(wide > 1, kind="stable")  # classes of one id come first, which have no second step
        turn_of = np.argsort(turns)
        turn = turn_of.take(v.of.take(y)).astype(np.uint16)
        order = np.argsort(turn, kind="stable")
        turn, y = turn.take(order), y.take(order)
        self.order, self.y_class = order, turns.take(turn)
        self.g = g.take(at.take(order), 0)
        self.z = self.g @ p["wc"]
        self.total, cost = _exponentials(self.z, self.y_class)
        cut = np.searchsorted(turn, np.arange(len(turns) + 1, dtype=np.int64))
        single = int((wide == 1).sum())
        self.second = int(cut[single])  # the first token with a second step
        some = single + np.flatnonzero(np.diff(cut[single:]))
        classes, cut, n = turns[some], cut[some], np.diff(cut)[some]
        size = n * wide[classes]
        flat = self.flat = np.empty(int(size.sum()), g.dtype)
        first = np.cumsum(size) - size
        #: of each class: its first and last token and place, and its logits
        self.parts = [(a, a + k, lo, lo + w, flat[f : f + k * w].reshape(k, w)) for a, k, lo, w, f in zip(cut.tolist(), n.tolist(), v.starts[classes].tolist(), wide[classes].tolist(), first.tolist(), strict=True)]
        for a, b, lo, hi, z in self.parts:
            np.matmul(self.g[a:b], p["wp"][lo:hi].T, out=z)
        begin = np.repeat(first - cut * wide[classes] - v.starts[classes], n)
        self.at = np.arange(self.second, len(y)) * np.repeat(wide[classes], n) + begin + y[self.second :]
        chosen = flat.take(self.at)
        if float(flat.max(initial=0)) > _SAFE:
            for a, b, _, _, z in self.parts:
                top = z.max(-1)
                z -= top[:, None]
                chosen[a - self.second : b - self.second] -= top
        np.exp(flat, out=flat)
        self.total_p = np.empty(len(y) - self.second, g.dtype)
        ones = np.ones(int(wide.max(initial=1)), g.dtype)
        for a, b, lo, hi, z in self.parts:
            np.matmul(z, ones[: hi - lo], out=self.total_p[a - self.second : b - self.second])
        cost[self.second :] += np.log(self.total_p) - chosen
        self.cost = np.empty_like(cost)
        self.cost[order] = cost

    def back(self):
        """Gradients of the mean loss by g in the order of classes, by wc, and by wp for the places of the classes that occur."""
        p, n = self.p, len(self.g)
        inv = self.g.dtype.type(1 / max(1, n))
        self.z *= (inv / self.total)[:, None]
        self.z[np.arange(n), self.y_class] -= inv
        dg = self.z @ p["wc"][:DIM].T
        # within a class, what all logits of a token are to be divided by is taken to its state
        share = (inv / self.total_p)[:, None]
        self.flat[self.at] -= self.total_p
        gs = self.g[self.second :] * share
        of_place = np.empty((len(gs), DIM), dg.dtype)
        rows = np.concatenate([np.zeros(0, np.int64), *(np.arange(lo, hi) for _, _, lo, hi, _ in self.parts)])
        dwp, done = np.empty((len(rows), DIM + 1), dg.dtype), 0
        for a, b, lo, hi, z in self.parts:
            np.matmul(z.T, gs[a - self.second : b - self.second], out=dwp[done : done + hi - lo])
            np.matmul(z, p["wp"][lo:hi, :DIM], out=of_place[a - self.second : b - self.second])
            done += hi - lo
        of_place *= share
        dg[self.second :] += of_place
        return dg, self.g.T @ self.z, rows, dwp


def back(p: dict[str, np.ndarray], kept: tuple, dh: np.ndarray, d: dict[str, np.ndarray]) -> np.ndarray:
    """Adds to the gradients d what follows from dh, by the hidden states; returns that by the embeddings."""
    x, e, q, k, v, weights, total, mixed, h, r = kept
    n, t = x.shape
    d["w2"] += r.T @ dh
    dr = dh @ p["w2"].T
    dr *= r > 0
    d["w1"] += h.T @ dr
    d["b1"] += np.ones(len(dr), dr.dtype) @ dr
    dh += dr @ p["w1"].T
    d["o"] += mixed.T @ dh
    dm = np.empty((n, t, DIM + 1), dh.dtype)  # by the unnormalised sums, then by their total
    np.divide((dh @ p["o"].T).reshape(n, t, DIM), total, out=dm[:, :, :DIM])
    dm[:, :, DIM] = -np.einsum("ijk,ijk->ij", dm[:, :, :DIM], mixed.reshape(n, t, DIM))
    dqkv = np.empty((n, t, 3 * DIM), dh.dtype)
    dq, dk, dv = dqkv[:, :, :DIM], dqkv[:, :, DIM : 2 * DIM], dqkv[:, :, 2 * DIM :]
    for lo, hi, a in reversed(weights):  # the last block sees all keys
        da = dm[:, lo:hi] @ v[:, :hi].transpose(0, 2, 1)
        da *= a
        np.matmul(da, k[:, :hi], out=dq[:, lo:hi])
        if hi == t:
            np.matmul(da.transpose(0, 2, 1), q[:, lo:hi], out=dk)
            np.matmul(a.transpose(0, 2, 1), dm[:, lo:hi, :DIM], out=dv)
        else:
            dk[:, :hi] += da.transpose(0, 2, 1) @ q[:, lo:hi]
            dv[:, :hi] += a.transpose(0, 2, 1) @ dm[:, lo:hi, :DIM]
    dqkv = dqkv.reshape(-1, 3 * DIM)
    d["qkv"] += e.T @ dqkv
    dh += dqkv @ p["qkv"].T
    d["pos"][:t] += dh.reshape(n, t * DIM).sum(0).reshape(t, DIM)
    return dh


def losses(v: Vocabulary, p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, at: np.ndarray, begin: int = 0) -> np.ndarray:
    """-log p of the places y at the flat positions ``at`` of the windows x, none of them before ``begin``."""
    t = x.shape[1]
    row, col = np.divmod(at, t)
    t -= begin
    g = np.empty((len(x) * t, DIM + 1), p["emb"].dtype)
    for a in range(0, len(x), BLOCK):
        hidden(p, x[a : a + BLOCK], begin, g[a * t : (a + BLOCK) * t])
    return Output(v, p, g, row * t + col - begin, y).cost


def gradients(v: Vocabulary, p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Losses, the gradients of their mean, and those of ``emb`` and ``wp`` by the rows that occur: (rows, gradients)."""
    t = x.shape[1]
    g = np.empty((x.size, DIM + 1), p["emb"].dtype)
    kept = [hidden(p, x[a : a + BLOCK], 0, g[a * t : (a + BLOCK) * t])[1] for a in range(0, len(x), BLOCK)]
    out = Output(v, p, g, at, y)
    dg, dwc, used, dwp = out.back()
    dh = np.zeros((len(g), DIM), dg.dtype) if len(at) < len(g) else np.empty((len(g), DIM), dg.dtype)
    dh[at.take(out.order)] = dg
    d = {k: np.zeros_like(p[k]) for k in ("pos", "qkv", "o", "w1", "b1", "w2")}
    done = 0
    for own in kept:
        back(p, own, dh[done : done + own[0].size], d)
        done += own[0].size
    ids = x.ravel()
    order = np.argsort(ids.astype(np.uint32 if len(p["emb"]) > 1 << 16 else np.uint16), kind="stable")  # of 16 bits, sorted by radix
    cut = np.flatnonzero(np.diff(ids[order], prepend=-1))
    return out.cost, d | {"wc": dwc}, {"emb": (ids[order[cut]], np.add.reduceat(dh[order], cut, 0)), "wp": (used, dwp)}


class Trainer:
    """Adagrad, which needs no schedule where shards see different amounts."""

    def __init__(self, v: Vocabulary, p: dict[str, np.ndarray], rate: float = RATE):
        self.v, self.rate = v, _F(rate)
        self.p = {k: x.copy() for k, x in p.items()}
        self.g = {k: np.full(x.shape, 1e-8, _F) for k, x in p.items()}

    def step(self, x: np.ndarray, y: np.ndarray, at: np.ndarray) -> float:
        cost, whole, rows = gradients(self.v, self.p, x, y, at)
        for k, v in whole.items():
            self.g[k] += v * v
            self.p[k] -= self.rate * v / np.sqrt(self.g[k])
        for k, (r, v) in rows.items():
            seen = self.g[k][r] + v * v
            self.g[k][r] = seen
            v *= self.rate
            v /= np.sqrt(seen)
            self.p[k][r] -= v
        return float(cost.mean())


def context(first: np.ndarray, stride: int = STRIDE):
    """Windows of many texts: (text, begin, scored from, end) of each, in the text's tokens. ids of text k are
    first[k]:first[k+1]."""
    n = np.diff(first)
    count = np.where(n > WINDOW, -(-(n - WINDOW) // stride) + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), count)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = turn * stride
    end = np.minimum(begin + WINDOW, n[text])
    return text, begin, np.where(turn > 0, begin + WINDOW - stride, 0), end


def windows_of(places: np.ndarray, first: np.ndarray, text: np.ndarray, begin: np.ndarray, scored: np.ndarray, end: np.ndarray):
    """Inputs, each position holding the token before the one to predict; the places of targets and their flat positions."""
    col = np.arange(WINDOW)
    at = begin[:, None] + col
    inside = at < end[:, None]
    source = first[text][:, None] + at
    x = np.full(at.shape, _PAD, np.int64)
    before = inside & (at > 0)
    x[before] = places[(source - 1)[before]] + _INPUTS
    x[inside & (at == 0)] = _BEGIN
    flat = np.flatnonzero(inside & (at >= scored[:, None]))
    return x, places[source.ravel()[flat]].astype(np.int64), flat


def _ids_of(batch: pa.RecordBatch | pa.Table):
    ids = batch.column("ids")
    n = np.array([len(x.as_buffer()) // 2 for x in ids], np.int64) if len(ids) else np.zeros(0, np.int64)
    raw = b"".join(x.as_py() for x in ids)
    return np.frombuffer(raw, np.uint16).astype(np.int64), np.append(0, np.cumsum(n))


def _tokenized(vocabulary: str):
    def run(batches):
        encoder = tokenizer(vocabulary).encoder
        for batch, i, j, data, offsets in batch_blocks(batches, "text"):
            raw, parts = data.tobytes(), []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                ids = encoder.encode_ordinary(raw[a:b].decode("utf-8", "replace"))  # of the whole text: by pieces, new ones cost more than is saved
                if max(ids, default=0) >= 1 << 16:
                    raise ValueError("ids must be below 65536")
                parts.append(array("H", ids).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(parts, pa.binary())], names=["id", "ids"])

    return run


def _counted(batches):
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        total += np.bincount(_ids_of(batch)[0], minlength=1 << 16)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["token", "n"])


def trained(vocabulary: Vocabulary, p: dict[str, np.ndarray], ids: np.ndarray, first: np.ndarray, seed: int) -> tuple[int, dict[str, np.ndarray]]:
    """Number of windows of a shard, and the parameters after one pass over them."""
    win = context(first, WINDOW)
    places = vocabulary.place[ids]
    order = np.random.default_rng(seed).permutation(len(win[0]))
    size = min(BATCH, max(8, len(order) // STEPS))
    trainer = Trainer(vocabulary, p)
    for k in range(0, len(order), size):
        trainer.step(*windows_of(places, first, *(w[order[k : k + size]] for w in win)))
    return len(order), trainer.p


#: Parameters are rounded to this before they are averaged, and weights are whole numbers, so sums are exact in any order.
_GRAIN = 2.0**24


def _trained(shared, turn: int):
    def run(batches):
        from pyspark import TaskContext

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        frugal(32 << 20)  # arrays of some MB come and go: mapping them anew would take much of the time
        table = pa.Table.from_batches(batches).sort_by([("h", "ascending"), ("id", "ascending")])
        vocabulary, p = shared.value
        n, after = trained(vocabulary, p, *_ids_of(table), turn * 1_000_003 + TaskContext.get().partitionId())
        if n:
            weight = max(1, round(n * WINDOW * 256 / SHARD))
            raw = np.concatenate([after[k].ravel() for k in sorted(after)]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([(np.rint(raw * _GRAIN) * weight).tobytes()], pa.binary())], names=["n", "p"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(raw.as_buffer(), np.float64) for raw in table.column("p"))
    return pa.table({"n": pa.array([sum(table.column("n").to_pylist())]), "p": pa.array([total.tobytes()], pa.binary())})


def _unflat(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    at, out = 0, {}
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(_F)
        at += like[k].size
    return out


def dealt(tokens: DataFrame, shard: int = SHARD) -> DataFrame:
    """tokens with ``u``, a hash that deals rows to rounds and shards. The copies of a row that together are larger
    than a quarter of a shard are dealt apart; there are at most four such rows a shard."""
    heavy = tokens.groupBy("h").agg((F.sum(F.length("ids")) / 2).alias("size")).where(F.col("size") > shard / 4)
    heavy = Spooled(heavy.select("h", F.ceil(F.col("size") * 4 / shard).alias("parts"))).df
    if not heavy.limit(1).count():
        return tokens.withColumn("u", F.xxhash64("h", F.lit(0)))
    turn = F.coalesce(F.pmod("turn", F.col("parts")), F.lit(0))
    return tokens.join(hinted(heavy), "h", "left").withColumn("u", F.xxhash64("h", turn)).drop("parts")


def rounds(tokens: DataFrame, total: int, shard: int = SHARD) -> list[DataFrame]:
    """(id, ids, h, shard) of each round, a shard a partition. tokens: as of tokenized(), with ``total`` tokens."""
    rows, low, out = dealt(tokens, shard).withColumn("slot", F.pmod("u", F.lit(sum(SHARES)))), 0, []
    for share in SHARES:
        parts = max(1, round(total * share / sum(SHARES) / shard))
        own = rows.where((F.col("slot") >= low) & (F.col("slot") < low + share))
        out.append(own.select("id", "ids", "h", F.pmod(F.shiftright("u", 8), F.lit(parts)).cast("int").alias("shard")).repartitionById(parts, "shard"))
        low += share
    return out


def train(tokens: DataFrame, shard: int = SHARD) -> tuple[Vocabulary, dict[str, np.ndarray]]:
    """Vocabulary from all ids, and parameters from all tokens. tokens: as of tokenized()."""
    sc = tokens.sparkSession.sparkContext
    counts = tokens.mapInArrow(_counted, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    vocabulary = Vocabulary(counts["token"].to_numpy().astype(np.int64), counts["n"].to_numpy())
    p = start(vocabulary)
    for turn, own in enumerate(rounds(tokens, int(counts["n"].sum()), shard)):
        made = own.mapInArrow(_trained(sc.broadcast((vocabulary, p)), turn), "n long, p binary")
        # a tree: groups of shards first, so that no task reads all
        some = made.withColumn("g", F.pmod(F.xxhash64("p"), F.lit(16))).groupBy("g").applyInArrow(_summed, "n long, p binary")
        row = some.withColumn("g", F.lit(0)).groupBy("g").applyInArrow(_summed, "n long, p binary").first()
        if row is not None:  # else no row fell to this round
            p = _unflat(np.frombuffer(row["p"], np.float64) / (row["n"] * _GRAIN), p)
    return vocabulary, p


def _scored(shared):
    def run(batches):
        frugal(32 << 20)  # arrays of some MB come and go: mapping them anew would take much of the time
        vocabulary, p = shared.value
        for batch in batches:
            ids, first = _ids_of(batch)
            total = np.zeros(len(first) - 1)
            win = context(first)
            places = vocabulary.place[np.minimum(ids, len(vocabulary.place) - 1)]
            for begin in (0, WINDOW - STRIDE):  # texts' first windows, then the others, whose first tokens are scored already
                group = np.flatnonzero(win[2] == 0 if begin == 0 else win[2] > 0)
                order = group[np.argsort((win[3] - win[1])[group], kind="stable")]  # windows of like length together
                for k in range(0, len(order), BATCH):
                    part = [w[order[k : k + BATCH]] for w in win]
                    x, y, at = windows_of(places, first, *part)
                    t = max(begin + 1, int((part[3] - part[1]).max()))
                    row, col = np.divmod(at, WINDOW)
                    total += np.bincount(part[0][row], losses(vocabulary, p, x[:, :t], y, row * t + col, begin), len(total))
            n = np.diff(first)
            mean = pa.array(np.divide(total, n, out=np.zeros(len(n)), where=n > 0), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n.astype(np.int64)), mean], names=["doc_id", "n_tokens", "nll"])

    return run


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids, h, turn), written once: the tokens of every row, two bytes each, a hash of both, and the row's number."""
    src = docs.select(number(docs, id_col).alias("id"), F.coalesce(column(docs, text_col), F.lit("")).alias("text")).where("id is not null")
    return Spooled(src.mapInArrow(_tokenized(vocabulary), "id long, ids binary").withColumn("h", F.xxhash64("id", "ids")).withColumn("turn", F.monotonically_increasing_id())).df


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_tokens, nll): mean negative log-probability of a token."""
    tokens = tokenized(docs, id_col, text_col, vocabulary)
    model = train(tokens, shard)
    return tokens.select("id", "ids").mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, n_tokens long, nll double")
