"""A gated recurrent language model in numpy: class-factored softmax, truncated back-propagation, state carried on.

P(word | before) = P(class | state) P(word | class, state). The most frequent words (SOFTMAX) lie in classes of equal size
by frequency and have a softmax within their class; all other words lie in tail classes by their last two bytes, within
which they have smoothed counts, and one place for words never seen. So every text has a probability.

1. Spark counts every training token; words with few counts stay in that table, only a bounded head comes to the driver.
2. Training is one pass over every training document: first a share of them (WARM), then the others; in each round
   every task trains its copy over its documents, and Spark averages the copies by their tokens. A round's model has a
   fixed size. Gradients go back WINDOW tokens; the state goes on to a document's end.
3. Scoring carries the state through whole documents, many side by side. Counts of words beyond the head are joined.

Edge cases: a null or empty text is its end token alone; very long texts run in a lane of their own, in training too;
equal texts and repeated rows score alike up to rounding, and ties in counts are ordered by the word; without training
rows the model is uniform over classes and every word is unseen; an empty table gives no rows; extra columns are left
out, whatever their names.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import cut
from .common import claim, record_batch, slices, texts, words

END = b"\n"  # no word has a line end
SOFTMAX, CLASSES, TAILS = 1024, 32, 32
PER = SOFTMAX // CLASSES
START = SOFTMAX + TAILS
EMBED, HIDDEN = 12, 16
WINDOW, LANES = 32, 512
#: Words whose counts travel to the tasks at most.
HEAD = 1 << 17
WARM = 16
SLICE = 24 << 20

Params = dict[str, np.ndarray]


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


@dataclass
class Vocabulary:
    """The head of the counts, in order: softmax words first. Arrays by head number."""

    words: list[bytes]
    counts: np.ndarray
    n: int  # training tokens
    v: int  # distinct ones
    tail_n: np.ndarray  # tokens and distinct words of each tail class
    tail_v: np.ndarray

    def __post_init__(self) -> None:
        self.soft = min(SOFTMAX, len(self.words))
        tails = np.array([tail_class(w) for w in self.words], np.int64)
        i = np.arange(len(self.words))
        self.input = np.where(i < self.soft, i, SOFTMAX + tails)
        self.cls = np.where(i < self.soft, i // PER, CLASSES + tails)
        self.base = np.log10(self.counts + 0.5) - self.log_total
        self.inner = np.where(i < self.soft, 0.0, np.log10(self.counts + 0.5) - self.log_tail[tails])

    @property
    def log_total(self) -> float:
        return math.log10(self.n + 0.5 * (self.v + 1))

    @property
    def log_tail(self) -> np.ndarray:
        return np.log10(self.tail_n + 0.5 * (self.tail_v + 1))

    def __getstate__(self) -> tuple:
        return (b" ".join(self.words), self.counts, self.n, self.v, self.tail_n, self.tail_v)

    def __setstate__(self, s: tuple) -> None:
        self.__init__(s[0].split(b" ") if s[0] else [], *s[1:])
        self.ids = Ids(zip(self.words, range(len(self.words)), strict=True))


class Ids(dict):
    """Head number of a word; of a word beyond the head, minus one minus its tail class."""

    def __missing__(self, word: bytes) -> int:
        return -1 - tail_class(word)


def count_words(docs: DataFrame) -> DataFrame:
    """(word string, c) of all tokens of (doc_id, text bytes), the end token of each text included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])
        seen: Counter = Counter()
        for batch in slices(batches, "text"):
            for t in batch.column("text").to_pylist():
                seen.update(words(t))
                seen[END] += 1
            if len(seen) > 400_000:
                yield record_batch({"word": list(seen), "c": list(seen.values())}, schema)
                seen = Counter()
        yield record_batch({"word": list(seen), "c": list(seen.values())}, schema)

    return docs.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _tail(word: Column) -> Column:
    return F.crc32(F.substring(word, -2, 2)) % TAILS


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """The words from some count on, at most `head` of them, and the totals of all words."""
    step = F.floor(F.log2("c") * 16).cast("int")
    rows = counts.groupBy(_tail(F.col("word")).alias("t"), step.alias("s")).agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.min("c").alias("low")).collect()  # TAILS x logarithmic steps
    tail_n, tail_v = np.zeros(TAILS), np.zeros(TAILS)
    per_step: dict[int, list[int]] = {}
    for r in rows:
        tail_n[r.t] += r.n
        tail_v[r.t] += r.v
        n, low = per_step.setdefault(r.s, [0, r.low])
        per_step[r.s] = [n + r.v, min(low, r.low)]
    room, least = head, None
    for s in sorted(per_step, reverse=True):
        if per_step[s][0] > room:
            break
        room, least = room - per_step[s][0], per_step[s][1]
    found = counts.where(F.col("c") >= least).collect() if least is not None else []  # `head` rows at most
    found = sorted(((r.c, bytes(r.word)) for r in found), key=lambda x: (-x[0], x[1]))
    n, v = int(tail_n.sum()), int(tail_v.sum())
    for c, w in found[:SOFTMAX]:
        tail_n[tail_class(w)] -= c
        tail_v[tail_class(w)] -= 1
    return Vocabulary([w for _, w in found], np.array([c for c, _ in found], np.float64), n, v, tail_n, tail_v)


def initial(vocab: Vocabulary, seed: int = 0) -> Params:
    """Weights that give every word its smoothed frequency, whatever the state."""
    rng, h = np.random.default_rng(seed), HIDDEN
    c = vocab.counts[: vocab.soft]
    word_bias = np.full(SOFTMAX, -30.0)
    word_bias[: vocab.soft] = np.log((c + 0.5) / max(1.0, c.sum()))
    per_class = np.r_[np.bincount(np.arange(vocab.soft) // PER, c, minlength=CLASSES)[:CLASSES], vocab.tail_n]
    p = {
        "e": rng.normal(0, 0.3, (START + 1, EMBED)), "x": rng.normal(0, EMBED**-0.5, (EMBED, 3 * h)), "g": np.r_[np.ones(h), np.zeros(2 * h)],
        "u": rng.normal(0, h**-0.5, (h, 3 * h)), "c": np.zeros((h, CLASSES + TAILS)), "d": np.log((per_class + 0.5) / (per_class + 0.5).sum()), "w": np.zeros((SOFTMAX, h)), "b": word_bias,
    }
    return {k: a.astype(np.float32) for k, a in p.items()}


@dataclass
class Lanes:
    """Documents laid end to end in lanes, the fullest lane first. At step t, the first active[t] lanes have a token."""

    x: np.ndarray  # (steps, lanes): inputs; START at the first token of a document
    y: np.ndarray  # head numbers or tail marks, as in Ids
    doc: np.ndarray  # row of the document
    active: np.ndarray


def lay(docs: list[np.ndarray], inputs: np.ndarray, most: int = LANES) -> Lanes:
    sizes = np.array([len(d) for d in docs])
    # as many lanes as the longest document leaves full
    lanes = max(1, min(most, len(docs), max(64, int(sizes.sum()) // int(sizes.max()))))
    heap, held = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        load, k = heapq.heappop(heap)
        held[k].append(i)
        heapq.heappush(heap, (load + int(sizes[i]), k))
    loads = np.array([sum(int(sizes[i]) for i in k) for k in held])
    order = np.argsort(-loads, kind="stable")
    steps = int(loads.max())
    x, y, doc = np.full((steps, lanes), START, np.int32), np.zeros((steps, lanes), np.int32), np.full((steps, lanes), -1, np.int32)
    for j, k in enumerate(order.tolist()):
        at = 0
        for i in held[k]:
            d, n = docs[i], len(docs[i])
            y[at : at + n, j] = d
            x[at + 1 : at + n, j] = np.where(d[:-1] >= 0, inputs[np.maximum(d[:-1], 0)], SOFTMAX - 1 - d[:-1]) if len(inputs) else SOFTMAX - 1 - d[:-1]
            doc[at : at + n, j] = i
            at += n
    return Lanes(x, y, doc, (loads[order][None, :] > np.arange(steps)[:, None]).sum(1))


def forward(p: Params, gates: np.ndarray, x: np.ndarray, h: np.ndarray, kept: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States (steps, lanes, HIDDEN) over inputs (steps, lanes), and the last. A document's first step starts at zero.

    kept gets what backward needs of all steps: states before, z and r, h @ u, n.
    """
    u, kind = p["u"], np.result_type(p["u"], gates, h)
    out = np.empty((*x.shape, HIDDEN), kind)
    a, first = gates[x], x == START
    fresh = first.any(1)
    steps = len(x) if kept is not None else 1  # rows of the buffers
    zrs, hus, ns = (np.empty((steps, x.shape[1], k * HIDDEN), kind) for k in (2, 3, 1))
    before = np.empty_like(out) if kept is not None else None
    for t in range(len(x)):
        if fresh[t]:
            h = np.where(first[t][:, None], kind.type(0), h)
        at = t if kept is not None else 0
        hu = np.matmul(h, u, out=hus[at])
        zr = np.add(a[t, :, : 2 * HIDDEN], hu[:, : 2 * HIDDEN], out=zrs[at])
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.multiply(r, hu[:, 2 * HIDDEN :], out=ns[at])
        n += a[t, :, 2 * HIDDEN :]
        np.tanh(n, out=n)
        new = np.subtract(h, n, out=out[t])
        new *= z
        new += n
        if before is not None:
            before[t] = h
        h = new
    if kept is not None:
        kept.extend((before, zrs[..., :HIDDEN], zrs[..., HIDDEN:], hus[..., 2 * HIDDEN :], ns))
    return out, h


def targets(vocab: Vocabulary, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class, and softmax word or -1, of tokens."""
    if not vocab.words:
        return CLASSES - 1 - y, np.full(len(y), -1)
    cls = np.where(y >= 0, vocab.cls[np.maximum(y, 0)], CLASSES - 1 - y)
    return cls, np.where((y >= 0) & (y < vocab.soft), y, -1)


def output(p: Params, h: np.ndarray, cls: np.ndarray, word: np.ndarray, grads: Params | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log-probabilities of classes and, where there is one, softmax words; and gradients of their negative sum."""
    a = h @ p["c"]
    a += p["d"]
    np.minimum(a, 80, out=a)
    i = np.arange(len(h))
    gold = a[i, cls]
    np.exp(a, out=a)
    total = a @ np.ones(a.shape[1], np.float32)  # as a product: sums along short rows are slow
    out = gold - np.log(total)
    dh = None
    if grads is not None:
        a /= total[:, None]
        a[i, cls] -= 1
        grads["c"] += h.T @ a
        grads["d"] += np.ones(len(a), np.float32) @ a
        dh = a @ p["c"].T
    soft = np.flatnonzero(word >= 0)
    order = soft[np.argsort((word[soft] // PER).astype(np.int16), kind="stable")]
    sorted_word, hs = word[order], h[order]
    ends, found, ds = np.searchsorted(sorted_word // PER, np.arange(CLASSES + 1)), np.empty(len(order), a.dtype), np.empty(hs.shape, a.dtype)
    row = np.ones(PER, np.float32)
    for k in range(CLASSES):
        here = slice(ends[k], ends[k + 1])
        if here.start == here.stop:
            continue
        own, hk = slice(k * PER, (k + 1) * PER), hs[here]
        b = hk @ p["w"][own].T
        b += p["b"][own]
        np.minimum(b, 80, out=b)
        j, at = np.arange(len(hk)), sorted_word[here] - k * PER
        gold = b[j, at]
        np.exp(b, out=b)
        total = b @ row
        found[here] = gold - np.log(total)
        if grads is not None:
            b /= total[:, None]
            b[j, at] -= 1
            grads["w"][own] += b.T @ hk
            grads["b"][own] += np.ones(len(b), np.float32) @ b
            np.matmul(b, p["w"][own], out=ds[here])
    out[order] += found
    if grads is not None:
        dh[order] += ds
    return out, dh


def backward(p: Params, x: np.ndarray, kept: list, dout: np.ndarray, grads: Params) -> None:
    """Gradients through the steps of one window; they end at its first step and at each document's first."""
    ut, dh, first = p["u"].T.copy(), np.zeros_like(dout[0]), x == START
    h, z, r, hn, n = kept
    to_n, to_z, to_r = (1 - z) * (1 - n * n), (h - n) * z * (1 - z), hn * r * (1 - r)
    dx = np.empty((*x.shape, 3 * HIDDEN), np.float32)
    da = np.empty_like(dx)
    fresh = first.any(1)
    for t in range(len(x) - 1, -1, -1):
        dh += dout[t]
        d = dx[t]
        np.multiply(dh, to_n[t], out=d[:, 2 * HIDDEN :])
        np.multiply(dh, to_z[t], out=d[:, :HIDDEN])
        np.multiply(d[:, 2 * HIDDEN :], to_r[t], out=d[:, HIDDEN : 2 * HIDDEN])
        da[t] = d
        da[t, :, 2 * HIDDEN :] *= r[t]
        dh *= z[t]
        dh += da[t] @ ut
        if fresh[t]:
            dh[first[t]] = 0
    flat = dx.reshape(-1, 3 * HIDDEN)
    grads["u"] += h.reshape(-1, HIDDEN).T @ da.reshape(-1, 3 * HIDDEN)
    grads["g"] += flat.sum(0)
    ids = x.ravel()
    grads["x"] += p["e"][ids].T @ flat
    de = flat @ p["x"].T
    for k in range(EMBED):
        grads["e"][:, k] += np.bincount(ids, de[:, k], minlength=START + 1)


class Adam:
    def __init__(self, p: Params, rate: float = 0.01):
        self.m, self.v, self.t, self.rate = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0, rate

    def step(self, p: Params, grads: Params) -> None:
        self.t += 1
        rate = self.rate / math.sqrt(1 + self.t / 50)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            p[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-6)


def learn(p: Params, vocab: Vocabulary, docs: list[np.ndarray], adam: Adam) -> int:
    """Train p over the documents, window by window; returns their tokens."""
    lanes, seen = lay(docs, vocab.input), 0
    h = np.zeros((lanes.x.shape[1], HIDDEN), np.float32)
    for s in range(0, len(lanes.x), WINDOW):
        k = int(lanes.active[s])
        x, y = lanes.x[s : s + WINDOW, :k], lanes.y[s : s + WINDOW, :k].ravel()
        live = np.flatnonzero(lanes.doc[s : s + WINDOW, :k].ravel() >= 0)
        seen += len(live)
        gates, kept = p["e"] @ p["x"] + p["g"], []
        states, h = forward(p, gates, x, h[:k], kept)
        grads = {n: np.zeros_like(a) for n, a in p.items()}
        flat = states.reshape(-1, HIDDEN)
        cls, word = targets(vocab, y[live])
        dout = np.zeros_like(flat)
        dout[live] = output(p, flat[live], cls, word, grads)[1]
        backward(p, x, kept, dout.reshape(states.shape), grads)
        for g in grads.values():
            g /= len(live)
        adam.step(p, grads)
    return seen


def log10_probabilities(p: Params, vocab: Vocabulary, docs: list[np.ndarray]) -> np.ndarray:
    """Of each document's classes and softmax words, under the states of the whole document."""
    lanes, out = lay(docs, vocab.input), np.zeros(len(docs))
    h, gates = np.zeros((lanes.x.shape[1], HIDDEN), np.float32), p["e"] @ p["x"] + p["g"]
    for s in range(0, len(lanes.x), WINDOW):
        k = int(lanes.active[s])
        states, h = forward(p, gates, lanes.x[s : s + WINDOW, :k], h[:k])
        doc = lanes.doc[s : s + WINDOW, :k].ravel()
        live = np.flatnonzero(doc >= 0)
        cls, word = targets(vocab, lanes.y[s : s + WINDOW, :k].ravel()[live])
        found, _ = output(p, states.reshape(-1, HIDDEN)[live], cls, word)
        out += np.bincount(doc[live], found, minlength=len(docs))
    return out / math.log(10)


def _numbers(ids: Ids, text: bytes) -> np.ndarray:
    return np.fromiter(map(ids.__getitem__, [*words(text), END]), np.int32)


def _round(docs: DataFrame, vocab: Vocabulary, p: Params) -> Params:
    """p, trained by every task on its documents and averaged by tokens."""
    sent = docs.sparkSession.sparkContext.broadcast((vocab, p))  # of bounded size
    names, sizes = list(p), [a.size for a in p.values()]
    part = 4096

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        v, own = sent.value[0], {k: a.copy() for k, a in sent.value[1].items()}
        adam, n = Adam(own), 0
        for batch in slices(batches, "text", SLICE):
            rows = [_numbers(v.ids, t) for t in batch.column("text").to_pylist()]
            n += learn(own, v, rows, adam)
        if n:
            flat = np.concatenate([own[k].ravel() for k in names]).astype(np.float64) * n
            cuts = [flat[s : s + part] for s in range(0, len(flat), part)]
            yield record_batch({"part": np.arange(len(cuts)), "sums": [c.tobytes() for c in cuts], "n": [n] * len(cuts)}, SUMS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        tokens: Counter = Counter()
        for batch in batches:
            for i, raw, n in zip(*(batch.column(c).to_pylist() for c in ("part", "sums", "n")), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(raw)
                tokens[i] += n
        yield record_batch({"part": list(sums), "sums": [a.tobytes() for a in sums.values()], "n": [tokens[i] for i in sums]}, SUMS)

    ddl = "part int, sums binary, n long"
    rows = docs.mapInArrow(train, ddl).repartition("part").mapInArrow(add, ddl).collect()  # one model
    if not rows:
        return p
    flat = np.concatenate([np.frombuffer(r.sums) / r.n for r in sorted(rows, key=lambda r: r.part)]).astype(np.float32)
    at = np.cumsum([0, *sizes])
    return {k: flat[a:b].reshape(p[k].shape) for k, a, b in zip(names, at, at[1:], strict=False)}


SUMS = pa.schema([("part", pa.int32()), ("sums", pa.binary()), ("n", pa.int64())])


@dataclass
class Model:
    vocab: Vocabulary
    params: Params
    counts: DataFrame


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """From all texts of docs."""
    own = texts(docs, id_col, text_col)
    counts = cut(count_words(own))
    vocab = vocabulary(counts)
    p = initial(vocab)
    if vocab.words:
        vocab.__setstate__(vocab.__getstate__())
        share = F.pmod(F.xxhash64("text"), F.lit(WARM))
        tasks = max(1, own.rdd.getNumPartitions() // WARM)  # as full as the others
        for some in (own.where(share == 0).coalesce(tasks), own.where(share != 0)):
            p = _round(some, vocab, p)
    return Model(vocab, p, counts)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    vocab = model.vocab
    sent = docs.sparkSession.sparkContext.broadcast((vocab, model.params))
    log_total, log_tail = vocab.log_total, vocab.log_tail
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("own", pa.float64()), ("rare", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = sent.value
        ids = getattr(v, "ids", Ids())
        for batch in slices(batches, "text", SLICE):
            docs_, rare, n, known, base, own = [], [], [], [], [], []
            for t in batch.column("text").to_pylist():
                w = [*words(t), END]
                y = np.fromiter(map(ids.__getitem__, w), np.int32)
                docs_.append(y)
                head, beyond = y[y >= 0], np.flatnonzero(y < 0)
                rare.append(b" ".join([w[i] for i in beyond.tolist()]))
                n.append(len(y)), known.append(len(head))
                base.append(float(v.base[head].sum()) - len(beyond) * log_total)
                own.append(float(v.inner[head].sum()) - float(log_tail[-1 - y[beyond]].sum()))
            own = np.array(own) + log10_probabilities(p, v, docs_)
            yield record_batch({"doc_id": batch.column("doc_id"), "n_tokens": n, "n_known": known, "base": base, "own": own, "rare": rare}, schema)

    rows = texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base double, own double, rare binary")
    rows = cut(rows.select(F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("key"), "n_tokens", "n_known", "base", "own", "rare"))
    beyond = rows.where("length(rare) > 0").select(F.col("key.row").alias("row"), F.explode(F.split(F.col("rare").cast("string"), " ")).alias("word"))
    # counts of one word in a row are joined once
    beyond = beyond.join(model.counts.select(F.col("word").cast("string").alias("word"), "c"), "word", "left")
    sums = beyond.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.count("c").alias("also"))
    joined = rows.select("key.*", "n_tokens", "n_known", "base", "own").join(sums, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return joined.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(vocab.n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("own") + more).alias("score"))
