"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, calibrated by temperature.

Word vectors: Spark counts the tokens of all documents; each of the VOCABULARY most frequent is a row of its own, the rest
share BUCKETS rows by a hash. A row has a sparse ternary index vector by rule, and its word vector is the sum of the index
vectors of the tokens next to it over all documents, scaled to unit length. Spark sums the partial tables of the tasks;
the whole table has a fixed size.
Documents are pooled as the mean, the deviation and the mean product of neighbours of their token vectors.

The network is fitted on a bounded sample of labelled rows (TRAIN_ROWS, by a hash of the id), a quarter of which is held
back to set the temperature. Labels, language, source and id are never inputs.

Edge cases: null and empty texts have the zero vector and a score; very long texts are pooled whole; rows with a null id or
label are not learnt from; of several labels of an id the largest counts, of several texts one chosen by its hash, so
repeated rows are learnt once; ties in token counts are ordered by the token; with no labelled rows or one class only the
score is the smoothed share of label 1; equal texts have equal scores; an empty table gives no rows; extra columns are left
out, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, claim, hashed_share, map_slices, record_batch, slices, texts

#: Tokens with a word vector of their own, the most frequent ones; and vectors that all others share.
VOCABULARY = 1 << 13
BUCKETS = 1 << 13
ROWS = VOCABULARY + BUCKETS
DIM = 32
NONZERO = 4
#: Labelled rows that the network is fitted on, but for a tenth.
TRAIN_ROWS = 20_000
HIDDEN = 24
#: Rows of the word-vector table that travel together.
TABLE_ROWS = 256
_TOKEN = re.compile(rb"[0-9]+|[!-/:-@\[-`{-~]+|[^\x00-\x20!-/0-9:-@\[-`{-~\x7f]+")


def _key(token: bytes) -> bytes:
    """A word in capitals counts as such, and a number, whatever it is."""
    if len(token) > 1 and token.isupper():
        return b"\x00capitals"
    return b"\x00digits" if token.isdigit() else token.lower()


class Rows(dict):
    """Row of each token in the table, kept while there are not too many."""

    def __init__(self, words: tuple[bytes, ...]):
        self.own = {w: i for i, w in enumerate(words)}

    def __missing__(self, token: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        key = _key(token)
        self[token] = b = self.own[key] if key in self.own else VOCABULARY + zlib.crc32(key) % BUCKETS
        return b


@lru_cache(maxsize=1)
def rows_of(words: tuple[bytes, ...]) -> Rows:
    return Rows(words)


CACHES["quality"] = rows_of.cache_clear
COUNTS = pa.schema([("key", pa.binary()), ("n", pa.int64())])


def frequent(docs: DataFrame, most: int = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> tuple[bytes, ...]:
    """The most frequent tokens of all documents, in order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            found: Counter = Counter()
            for t, n in seen.items():
                found[_key(t)] += n
            seen.clear()
            return record_batch({"key": list(found), "n": list(found.values())}, COUNTS)

        for batch in slices(batches, "text", 1 << 20):
            for t in batch.column("text").to_pylist():
                seen.update(_TOKEN.findall(t))
            if len(seen) > 400_000:
                yield flush()
        yield flush()

    counts = texts(docs, id_col, text_col).mapInArrow(count, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return tuple(bytes(r.key) for r in counts.orderBy(F.desc("n"), "key").limit(most).collect())


def token_rows(text: bytes, rows: Rows) -> np.ndarray:
    return np.fromiter(map(rows.__getitem__, _TOKEN.findall(text)), np.int64)


def index_vectors(seed: int = 0) -> np.ndarray:
    """Sparse ternary vectors, a rule of the seed."""
    rng = np.random.default_rng(seed)
    out = np.zeros((ROWS, DIM), np.float32)
    at = rng.permuted(np.tile(np.arange(DIM), (ROWS, 1)), axis=1)[:, :NONZERO]
    out[np.arange(ROWS)[:, None], at] = rng.choice([-1.0, 1.0], (ROWS, NONZERO))
    return out


PARTS = pa.schema([("part", pa.int32()), ("sums", pa.binary())])


def word_vectors(docs: DataFrame, words: tuple[bytes, ...], id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """(ROWS, DIM) unit vectors from the neighbours, left and right, of every token of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        own = index_vectors()
        sums, rows = np.zeros(ROWS * DIM), rows_of(words)
        dims = np.argsort(own == 0, axis=1, kind="stable")[:, :NONZERO]
        signs = np.take_along_axis(own, dims, axis=1).astype(np.float64)
        for batch in slices(batches, "text", 1 << 20):
            pairs = []
            for t in batch.column("text").to_pylist():
                b = token_rows(t, rows)
                pairs += [b[:-1] * ROWS + b[1:]]
            # equal pairs of neighbours once, with their count
            pair, n = np.unique(np.concatenate(pairs), return_counts=True)
            left, right = pair // ROWS, pair % ROWS
            for k in range(NONZERO):
                sums += np.bincount(left * DIM + dims[right, k], signs[right, k] * n, minlength=ROWS * DIM)
                # a word to the left counts with its vector turned by one place
                sums += np.bincount(right * DIM + (dims[left, k] + 1) % DIM, signs[left, k] * n, minlength=ROWS * DIM)
        table = sums.reshape(-1, TABLE_ROWS * DIM)
        yield record_batch({"part": np.arange(len(table)), "sums": [r.astype(np.float32).tobytes() for r in table]}, PARTS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, raw in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                found[p] = found.get(p, 0) + np.frombuffer(raw, np.float32).astype(np.float64)
        yield record_batch({"part": list(found), "sums": [v.tobytes() for v in found.values()]}, PARTS)

    partial = texts(docs, id_col, text_col).mapInArrow(count, "part int, sums binary")
    total = np.zeros((ROWS // TABLE_ROWS, TABLE_ROWS * DIM))
    for r in partial.repartition("part").mapInArrow(add, "part int, sums binary").collect():  # ROWS x DIM numbers
        total[r.part] += np.frombuffer(r.sums, np.float64)
    out = total.reshape(ROWS, DIM)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(batch: list[bytes], vectors: np.ndarray, rows: Rows) -> np.ndarray:
    """(texts, 3 * DIM + 1): mean, deviation, mean product of neighbours; log of the number of tokens."""
    out = np.zeros((len(batch), 3 * DIM + 1), np.float32)
    for i, t in enumerate(batch):
        b = token_rows(t, rows)
        if not len(b):
            continue
        kinds, n = np.unique(b, return_counts=True)
        v, w = vectors[kinds], (n / len(b)).astype(np.float32)
        mean = w @ v
        out[i, :DIM] = mean
        out[i, DIM : 2 * DIM] = np.sqrt(np.maximum(w @ (v * v) - mean * mean, 0))
        if len(b) > 1:
            at = np.searchsorted(kinds, b)
            out[i, 2 * DIM : 3 * DIM] = np.einsum("ij,ij->j", v[at[:-1]], v[at[1:]]) / (len(b) - 1)
        out[i, -1] = np.log1p(len(b)) / 10
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 0, epochs: int = 60) -> Network:
    """Adam on the log loss of three quarters of the rows; the other quarter sets the temperature."""
    d = x.shape[1] if x.ndim == 2 and len(x) else 3 * DIM + 1
    if len(y) < 8 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(d), np.ones(d), np.zeros((d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, order = order[: len(y) // 4], order[len(y) // 4 :]
    x64 = x.astype(np.float64)
    net = Network(x64.mean(0), x64.std(0) + 1e-3, rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    p = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    best, kept = np.inf, [a.copy() for a in p]
    z = (x64 - net.mean) / net.scale
    loss = lambda rows: np.mean(np.logaddexp(0, -(2 * y[rows] - 1) * (np.tanh(z[rows] @ p[0] + p[1]) @ p[2] + p[3])))
    for _ in range(epochs):
        rng.shuffle(order)
        for s in range(0, len(order), 64):
            i = order[s : s + 64]
            h = np.tanh(z[i] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[i]) / len(i)
            gh = np.outer(g, p[2]) * (1 - h * h)
            grads = [z[i].T @ gh + 1e-3 * p[0], gh.sum(0), h.T @ g + 1e-3 * p[2], np.array([g.sum()])]
            step += 1
            for k, gr in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * gr
                v[k] = 0.999 * v[k] + 0.001 * gr * gr
                p[k] -= 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if (now := loss(held)) < best:
            best, kept = now, [a.copy() for a in p]
    net.w1, net.b1, net.w2, net.b2 = kept[0], kept[1], kept[2], float(kept[3][0])
    logits = net.logits(x64[held])
    at = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    net.temperature = float(min(at, key=lambda t: np.mean(np.logaddexp(0, -(2 * y[held] - 1) * logits / t))))
    return net


@dataclass
class Model:
    words: tuple[bytes, ...]
    vectors: np.ndarray
    network: Network

    def features(self, batch: list[bytes]) -> np.ndarray:
        return pooled(batch, self.vectors, rows_of(self.words))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Word vectors from all of docs; the network from about `rows` of the labelled ones, chosen by a hash of the id."""
    words = frequent(docs, id_col=id_col, text_col=text_col)
    model = Model(words, word_vectors(docs, words, id_col, text_col), fit(np.zeros((0, 3 * DIM + 1)), np.zeros(0)))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chosen = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = hashed_share(chosen, F.col("doc_id"), rows, chosen.count())
    sample = own.join(F.broadcast(chosen), "doc_id")  # `rows` ids and labels at most
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sample = sample.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), text.alias("text"))).alias("t"), F.max("label").alias("label")).select("doc_id", "t.text", "label")

    def features(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "x": list(model.features(batch.column("text").to_pylist()))}

    found = map_slices(sample, features, "doc_id long, label int, x array<float>", own="quality").toArrow().to_pydict()
    order = np.argsort(found["doc_id"], kind="stable") if found["doc_id"] else np.zeros(0, int)
    x = np.array(found["x"], np.float32).reshape(-1, 3 * DIM + 1)[order]
    model.network = fit(x, np.array(found["label"], np.float64)[order])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score double, predicted int, text_md5)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batch: pa.RecordBatch) -> dict:
        s = sent.value.network.score(sent.value.features(batch.column("text").to_pylist()).astype(np.float64))
        return {"doc_id": batch.column("doc_id"), "score": s, "predicted": (s >= 0.5).astype(np.int32), "text_md5": [hashlib.md5(t).hexdigest() for t in batch.column("text").to_pylist()]}

    return map_slices(texts(docs, id_col, text_col), run, "doc_id long, score double, predicted int, text_md5 string", own="quality")
