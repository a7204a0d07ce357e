"""Language identification: an interpolated Kneser-Ney model of characters per language, in sorted arrays of hashes.

A text counts as its letters and marks in lower case, with one blank for anything between words. Spark counts the n-grams of
ORDER characters of a sample of labelled texts; the driver turns them into discounted probabilities with continuation counts
below the highest order. The arrays hold the grams of all languages, sorted by hash, with the finished probability in each
language beside each gram and the interpolation weight beside each context: a seen gram takes one look, an unseen one goes on
with the weight of its context and the next shorter gram.

The language of the lowest cross-entropy per character is chosen. A part of the sample is kept from the counts: it sets the
temperature of the posterior (the score), and for each language how far above its usual cross-entropy, for its length, a text
may lie: REJECTED of the language's own texts lie further. What lies further is not accepted (`und` where rejection is asked for).

Bounds: TRAIN_ROWS different texts a language, chosen by a hash of the text; the most frequent grams of each language up to
GRAMS, fewer where many languages share the arrays (NUMBERS); LANGUAGES most frequent languages. All else reads whole tables.

Edge cases: a null text and one without a letter are `und` with score 0; very long texts are read in windows and scored whole;
equal texts have equal results, and are learnt once; rows with a null id, text or language are not learnt from; ties go to
the language that sorts first; one learnt language has score 1; nothing learnt makes every text `und`; an empty table gives
no rows; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, map_slices, record_batch, slices, texts

ORDER = 5
TRAIN_ROWS = 3000
GRAMS = 150_000
NUMBERS = 8_000_000
LANGUAGES = 200
#: One in so many texts of the sample calibrates.
KEPT_BACK = 6
REJECTED = 0.01
#: Characters that are scored at a time.
WINDOW = 1 << 18
START = 0x110001
FACTOR, MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@lru_cache(maxsize=1)
def alphabet() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-case letter or mark (0: neither), and whether it is a letter."""
    lower, letter = np.zeros(sys.maxunicode + 1, np.uint32), np.zeros(sys.maxunicode + 1, bool)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(c := chr(i))[0]
        if kind in "LM":
            lower[i], letter[i] = ord(c.lower()[0]), kind == "L"
    return lower, letter


def characters(text: bytes) -> tuple[np.ndarray, bool]:
    """Letters with a 0 before, after and between words; whether there is a letter."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    lower, letter = alphabet()
    c = np.concatenate([[0], lower[points], [0]])
    return c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])], bool(letter[points].any())


def rolled(c: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """Hashes of the 1 to `order` characters that end at each place."""
    c = c.astype(np.uint64)
    out = [c]
    for _ in range(1, order):
        h = np.zeros_like(c)
        h[1:] = out[-1][:-1] * FACTOR + c[1:]
        out.append(h)
    return out


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    h = (h + np.uint64(k)) * MIX_1
    h ^= h >> np.uint64(29)
    h *= MIX_2
    return h ^ (h >> np.uint64(32))


def padded(c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.full(ORDER - 1, START, np.uint32), c])


COUNTED = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("chain", pa.list_(pa.int64())), ("n", pa.int64())])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, chain, n): each gram of ORDER characters, with the hashes of its endings and of their contexts."""
    claim()
    for batch in slices(batches, "text", 1 << 20):
        langs = np.array(batch.column("lang").to_pylist(), object)
        found = [padded(characters(t)[0]) for t in batch.column("text").to_pylist()]
        for lang in sorted(set(langs.tolist())):
            own = [f for f, x in zip(found, langs, strict=True) if x == lang]
            hashes = rolled(np.concatenate(own))
            ends = np.concatenate([[True] * 0, *[np.arange(len(f)) >= ORDER for f in own]]).astype(bool)
            at = np.flatnonzero(ends)
            gram, first, n = np.unique(mixed(hashes[-1][at], ORDER), return_index=True, return_counts=True)
            at = at[first]
            chain = [mixed(hashes[k - 1][at], k) for k in range(ORDER - 1, 0, -1)] + [mixed(hashes[k - 1][at - 1], k) for k in range(ORDER - 1, 0, -1)]
            rows = pa.ListArray.from_arrays(np.arange(len(gram) + 1, dtype=np.int32) * len(chain), pa.array(np.stack(chain, 1).ravel().view(np.int64)))
            yield record_batch({"lang": [lang] * len(gram), "gram": gram.view(np.int64), "chain": rows, "n": n}, COUNTED)


@dataclass
class Sorted:
    """Ascending hashes with a row of numbers each, found through the start of each leading-bits bucket."""

    keys: np.ndarray
    values: np.ndarray
    starts: np.ndarray = field(init=False)
    shift: int = field(init=False)

    def __post_init__(self) -> None:
        bits = max(int(len(self.keys)).bit_length(), 1)
        self.shift = 64 - bits
        self.starts = np.searchsorted(self.keys >> np.uint64(self.shift), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def __getstate__(self) -> tuple:
        return self.keys, self.values

    def __setstate__(self, s: tuple) -> None:
        self.keys, self.values = s
        self.__post_init__()

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Row of each wanted hash, or -1."""
        out = np.full(len(wanted), -1, np.int32)
        bucket = (wanted >> np.uint64(self.shift)).astype(np.int64)
        at, end, left = self.starts[bucket], self.starts[bucket + 1], np.arange(len(wanted))
        while len(left := left[(live := at < end)]):
            at, end, wanted = at[live], end[live], wanted[live]
            here = self.keys[at]
            hit = here == wanted
            out[left[hit]] = at[hit]
            on = here < wanted
            left, at, end, wanted = left[on], at[on] + 1, end[on], wanted[on]
        return out


@dataclass
class Models:
    """Log probabilities of grams and log weights of contexts by order, a column a language; `unseen`: of a character never seen."""

    langs: list[str]
    grams: list[Sorted]
    contexts: list[Sorted]
    unseen: np.ndarray
    temperature: float = 1.0
    #: By language: usual cross-entropy, its variance and that times length, and how many deviations are accepted.
    usual: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))

    def log_probabilities(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(len(at), languages) of the characters at these places of c."""
        hashes, out, rows = rolled(c), np.zeros((len(at), len(self.langs)), np.float32), np.arange(len(at))
        for k in range(ORDER, 0, -1):
            found = self.grams[k - 1].find(mixed(hashes[k - 1][at], k))
            hit = found >= 0
            out[rows[hit]] += self.grams[k - 1].values[found[hit]]
            rows, at = rows[~hit], at[~hit]
            if k > 1 and len(at):
                found = self.contexts[k - 1].find(mixed(hashes[k - 2][at - 1], k - 1))
                hit = found >= 0
                out[rows[hit]] += self.contexts[k - 1].values[found[hit]]
        out[rows] += self.unseen
        return out

    def entropies(self, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, languages) cross-entropy per character; scored characters; whether a text has a letter."""
        sums, n, letters = np.zeros((len(batch), len(self.langs))), np.zeros(len(batch), np.int64), np.zeros(len(batch), bool)
        waiting: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            parts = [p for _, p in waiting]
            starts = np.cumsum([len(p) for p in parts]) - [len(p) for p in parts]
            at = np.concatenate([s + np.arange(ORDER, len(p)) for s, p in zip(starts, parts, strict=True)])
            found = self.log_probabilities(np.concatenate(parts), at).astype(np.float64)
            edges = np.cumsum([len(p) - ORDER for p in parts])
            for (i, p), s in zip(waiting, np.add.reduceat(found, edges - [len(p) - ORDER for p in parts]), strict=True):
                sums[i] += s
                n[i] += len(p) - ORDER
            waiting.clear()

        size = 0
        for i, text in enumerate(batch):
            c, letters[i] = characters(text)
            if not letters[i] or not self.langs:
                continue
            p = padded(c)
            for s in range(0, len(p) - ORDER, WINDOW):
                waiting.append((i, p[s : s + WINDOW + ORDER]))
                size += len(waiting[-1][1])
                if size >= WINDOW:
                    flush()
                    size = 0
        if waiting:
            flush()
        return -sums / np.maximum(n, 1)[:, None], n, letters

    def decide(self, entropy: np.ndarray, n: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number (-1: none), posterior of it, and whether it is accepted."""
        if not self.langs:
            return np.full(len(n), -1), np.zeros(len(n)), np.zeros(len(n), bool)
        best = np.where(letters, entropy.argmin(1), -1)
        own = np.take_along_axis(entropy, entropy.argmin(1)[:, None], 1)
        score = 1 / np.exp(-(entropy - own) * np.sqrt(n)[:, None] / self.temperature).sum(1)
        middle, variance, by_length, most = self.usual[entropy.argmin(1)].T
        far = (own[:, 0] - middle) / np.sqrt(variance + by_length / np.maximum(n, 1))
        return best, np.where(letters, score, 0.0), letters & (far <= most)


def discount(counts: np.ndarray) -> float:
    """From grams counted once and twice."""
    once, twice = (counts == 1).sum(), (counts == 2).sum()
    return float(np.clip(once / (once + 2 * twice), 0.1, 0.9)) if once and twice else 0.5


def estimate(langs: list[str], lang: np.ndarray, grams: np.ndarray, chains: np.ndarray, n: np.ndarray) -> Models:
    """Models from counted grams: `lang` is a number, chains as counted() makes them, all as unsigned hashes."""
    size, keys, contexts = len(langs), [], []
    # by order: union of grams, with the place of each one's ending and context
    level = {"key": grams, "lang": lang, "n": n.astype(np.float64)}
    levels = []
    for k in range(ORDER, 0, -1):
        if k < ORDER:  # distinct longer grams that end in this one
            endings = chains[:, ORDER - 1 - k]
            pairs = np.unique(np.stack([level["lang"].astype(np.uint64), endings], 1), axis=0, return_index=True, return_counts=True)
            level = {"key": pairs[0][:, 1], "lang": pairs[0][:, 0].astype(np.int64), "n": pairs[2].astype(np.float64)}
            chains = chains[pairs[1]]
        context = chains[:, ORDER - 1 + ORDER - k] if k > 1 else np.zeros(len(chains), np.uint64)
        levels.append((level, context, chains[:, ORDER - k] if k > 1 else None))
    tables, weights, unseen, below = [], [], None, None
    for k, (level, context, ending) in enumerate(reversed(levels), 1):
        keys, first, place = np.unique(level["key"], return_index=True, return_inverse=True)
        contexts, inner = np.unique(context, return_inverse=True)
        p, weight = np.zeros((len(keys), size)), np.ones((len(contexts), size))
        for i in range(size):
            own = level["lang"] == i
            if not own.any():
                continue
            d = discount(level["n"][own])
            total, kinds = np.bincount(inner[own], level["n"][own], len(contexts)), np.bincount(inner[own], minlength=len(contexts))
            p[place[own], i] = (level["n"][own] - d) / total[inner[own]]
            weight[:, i] = np.where(kinds > 0, d * kinds / np.maximum(total, 1), 1)
        if k == 1:
            unseen = weight[0] / (len(keys) + 1)
            p += unseen
        else:
            p += weight[inner[first]] * below[1][np.searchsorted(below[0], ending[first])]
        below = keys, p
        tables.append(Sorted(keys, np.log(p).astype(np.float32)))
        weights.append(Sorted(contexts, np.log(weight).astype(np.float32)))
    return Models(langs, tables, weights, np.log(unseen).astype(np.float32) if unseen is not None else np.zeros(size, np.float32))


def calibrate(models: Models, entropy: np.ndarray, n: np.ndarray, lang: np.ndarray) -> None:
    """Temperature by the log loss of the kept-back texts; limits by language from its own texts."""
    size = len(models.langs)
    models.usual = np.tile([0.0, 1.0, 0.0, np.inf], (size, 1))
    if not len(n):
        return
    at = np.exp(np.linspace(math.log(0.02), math.log(5), 80))
    gap = (entropy - entropy[np.arange(len(n)), lang][:, None]) * np.sqrt(n)[:, None]
    models.temperature = float(min(at, key=lambda t: np.logaddexp.reduce(-gap / t, axis=1).mean() + 1e-3 / t))
    for i in range(size):
        own = lang == i
        if own.sum() < 8:
            continue
        h, length = entropy[own, i], n[own]
        middle = np.median(h)
        spread = (h - middle) ** 2
        # variance a + b / n by least squares, kept positive
        a, b = np.linalg.lstsq(np.stack([np.ones(len(h)), 1 / length], 1), spread, rcond=None)[0]
        a, b = max(a, spread.mean() / 10, 1e-9), max(b, 0.0)
        models.usual[i] = middle, a, b, np.quantile((h - middle) / np.sqrt(a + b / length), 1 - REJECTED)


def train(docs: DataFrame, rows: int = TRAIN_ROWS, grams: int = GRAMS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Models:
    """Models of the languages of docs, from at most about `rows` different texts of each."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    own = own.withColumn("h", F.xxhash64("text"))
    kinds = own.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id"))  # a text once, however often it is copied
    totals = kinds.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    langs = sorted(r.lang for r in totals)
    if not langs:
        return Models([], [], [], np.zeros(0, np.float32))
    share = F.create_map(*[F.lit(v) for r in totals for v in (r.lang, min(1.0, rows / r["count"]))])
    place = F.shiftrightunsigned(F.xxhash64("h", F.lit(1)), 1) / F.lit(float(1 << 63))
    chosen = F.broadcast(kinds.where(place < share[F.col("lang")]))  # about `rows` ids a language
    sample = own.join(chosen, ["doc_id", "lang", "h"]).dropDuplicates(["lang", "h"]).select("h", "lang", F.col("text").cast("binary").alias("text"))
    back = F.pmod(F.xxhash64("h", F.lit(2)), F.lit(KEPT_BACK)) == 0
    most = max(min(grams, NUMBERS // len(langs) ** 2), 1000)
    counts = sample.where(~back).select("lang", "text").mapInArrow(counted, "lang string, gram long, chain array<long>, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.first("chain").alias("chain"))
    found = counts.selectExpr("*", "row_number() over (partition by lang order by n desc, gram) place").where(F.col("place") <= most).select("lang", "gram", "chain", "n").toArrow()
    number = {x: i for i, x in enumerate(langs)}
    chains = found.column("chain").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, 2 * (ORDER - 1))
    models = estimate(langs, np.array([number[x] for x in found.column("lang").to_pylist()], np.int64), found.column("gram").to_numpy().view(np.uint64), chains, found.column("n").to_numpy())
    sent = docs.sparkSession.sparkContext.broadcast(models)  # of bounded size

    def entropies(batch: pa.RecordBatch) -> dict:
        e, n, letters = sent.value.entropies(batch.column("text").to_pylist())
        return {"h": batch.column("h"), "lang": batch.column("lang"), "n": np.where(letters, n, 0), "e": list(e)}

    kept = map_slices(sample.where(back), entropies, "h long, lang string, n long, e array<double>").where("n > 0").orderBy("h", "lang").toArrow()
    e = np.array(kept.column("e").to_pylist(), np.float64).reshape(-1, len(langs))
    calibrate(models, e, kept.column("n").to_numpy(), np.array([number[x] for x in kept.column("lang").to_pylist()], np.int64))
    return models


def predict(docs: DataFrame, models: Models, reject: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, accepted, entropy per character); with reject, what is not accepted is `und` too."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batch: pa.RecordBatch) -> dict:
        m = sent.value
        entropy, n, letters = m.entropies(batch.column("text").to_pylist())
        best, score, accepted = m.decide(entropy, n, letters)
        shown = np.where(accepted, best, -1) if reject else best
        return {
            "doc_id": batch.column("doc_id"), "lang_pred": ["und" if b < 0 else m.langs[b] for b in shown], "score": score, "accepted": accepted,
            "entropy": [float(e[b]) if b >= 0 else None for e, b in zip(entropy, best, strict=True)],
        }

    return map_slices(texts(docs, id_col, text_col), run, "doc_id long, lang_pred string, score double, accepted boolean, entropy double", most=1 << 20)
