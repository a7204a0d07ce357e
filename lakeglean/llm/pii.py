"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions trained in numpy.

The patterns give base spans of four kinds. The tagger is trained on windows of labelled characters, on a bounded sample
(TRAIN_WINDOWS, by a hash) around base spans and around other digits. A text is cut into windows that overlap by half; each
window with a digit or an @ (no kind can do without), and each that a span goes on into, is decoded by Viterbi, each character takes its tag from the window
in which it lies most centrally, and spans are read off the reconciled tags, so that they may reach across windows. Spans
of the tagger that touch no base span and hold what their kind needs are added.

Edge cases: null and empty texts have no spans; very long texts are decoded in blocks of windows; base spans of different
kinds may overlap; equal texts and repeated rows have equal spans; of tied tags the first wins; a corpus without any base
span, or an empty table, leaves the tagger untrained, adding none; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import cut
from .common import hashed_share, map_slices, texts

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # O; first and later characters of each kind
WINDOW, STRIDE = 96, 48
HIDDEN = 16
TRAIN_WINDOWS = 3000
SYMBOLS = 99  # 95 printable ASCII, line ends and other controls, other letters, all else, outside the text

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]")

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the patterns, leftmost and non-overlapping for each kind, by start and kind."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:  # each local part reaches back to the last match at most, so this is linear in the text
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if _DIGITS.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = "".join(_DIGITS.findall(m[0])) if len(m[0]) < 60 else ""
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def said(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def symbols(text: str) -> np.ndarray:
    """A small number for each character."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(code < 32, 95, np.where(code < 127, code - 32, np.where((code >= 0xC0) & (code < 0x2000), 96, 97)))


def tags_of(spans: list[Span], n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for kind, a, b in reversed(spans):
        k = KINDS.index(kind)
        out[a:b] = 2 + 2 * k
        out[a : a + 1] = 1 + 2 * k
    return out


def read_off(tags: np.ndarray) -> list[Span]:
    """Spans of a tag sequence: a first tag or a change of kind begins one."""
    inside = np.flatnonzero(tags)
    out: list[Span] = []
    for i in inside.tolist():
        kind, first = KINDS[(tags[i] - 1) // 2], tags[i] % 2 == 1
        if out and out[-1][2] == i and out[-1][0] == kind and not first:
            out[-1] = (kind, out[-1][1], i + 1)
        else:
            out.append((kind, i, i + 1))
    return out


@dataclass
class Tagger:
    """Two LSTMs over symbols, a projection to tags, and CRF transitions. Arrays by name, so that Adam walks over them."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 0) -> Tagger:
        rng, h = np.random.default_rng(seed), HIDDEN
        p = {}
        for d in "fb":
            p[f"x{d}"] = rng.normal(0, 0.1, (SYMBOLS, 4 * h))
            p[f"u{d}"] = rng.normal(0, h**-0.5, (h, 4 * h))
            p[f"c{d}"] = np.r_[np.ones(h), np.zeros(3 * h)]  # forget, input, output gates, candidate
        p |= {"w": rng.normal(0, (2 * h) ** -0.5, (2 * h, TAGS)), "b": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS)), "s": np.zeros(TAGS)}
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states (steps, rows, HIDDEN) over symbols (rows, steps), and what the way back needs."""
        n, steps = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, kept = np.empty((steps, n, HIDDEN), np.float32), []
        gates, u = self.p[f"x{d}"] + self.p[f"c{d}"], self.p[f"u{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = gates[x[:, t]] + h @ u
            s = 0.5 + 0.5 * np.tanh(0.5 * a[:, : 3 * HIDDEN])
            g = np.tanh(a[:, 3 * HIDDEN :])
            f, i, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            before, c0 = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            kept.append((t, before, c0, f, i, o, g, tc))
        return out, kept

    def back(self, x: np.ndarray, d: str, kept: list, dout: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        ut, dh, dc = self.p[f"u{d}"].T, 0.0, 0.0
        flat = np.empty((len(kept), len(x), 4 * HIDDEN), dout.dtype)
        for j, (t, _, c0, f, i, o, g, tc) in reversed(list(enumerate(kept))):
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc * tc)
            da = flat[j]
            da[:, :HIDDEN], da[:, HIDDEN : 2 * HIDDEN] = dc * c0 * f * (1 - f), dc * g * i * (1 - i)
            da[:, 2 * HIDDEN : 3 * HIDDEN], da[:, 3 * HIDDEN :] = dh * tc * o * (1 - o), dc * i * (1 - g * g)
            dh, dc = da @ ut, dc * f
        flat = flat.reshape(-1, 4 * HIDDEN)
        seen = np.concatenate([x[:, k[0]] for k in kept])
        grads[f"x{d}"] += (seen[:, None] == np.arange(SYMBOLS)).astype(flat.dtype).T @ flat
        grads[f"c{d}"] += flat.sum(0)
        grads[f"u{d}"] += np.concatenate([k[1] for k in kept]).T @ flat

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list, list]:
        f, kf = self.lstm(x, "f")
        b, kb = self.lstm(x, "b")
        both = np.concatenate([f, b], axis=2)
        return both @ self.p["w"] + self.p["b"], both, kf, kb

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags y (rows, steps) under the CRF, and its gradients."""
        n, steps = x.shape
        e, both, kf, kb = self.emissions(x)
        t, s = self.p["t"].astype(np.float64), self.p["s"].astype(np.float64)
        e = e.astype(np.float64)
        alpha = np.empty_like(e)
        alpha[0] = e[0] + s
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        for k in range(1, steps):
            alpha[k] = lse(alpha[k - 1][:, :, None] + t, 1) + e[k]
        beta = np.zeros_like(e)
        for k in range(steps - 2, -1, -1):
            beta[k] = lse(t + (e[k + 1] + beta[k + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[:, None])
        rows = np.arange(n)
        gold = s[y[:, 0]] + e[0, rows, y[:, 0]]
        dt, ds = np.zeros_like(t), de[0].sum(0)
        np.add.at(ds, y[:, 0], -1)
        for k in range(1, steps):
            gold += t[y[:, k - 1], y[:, k]] + e[k, rows, y[:, k]]
            dt += np.exp(alpha[k - 1][:, :, None] + t + (e[k] + beta[k] - z[:, None])[:, None, :]).sum(0)
            np.add.at(dt, (y[:, k - 1], y[:, k]), -1)
        for k in range(steps):
            de[k, rows, y[:, k]] -= 1
        de = (de / n).astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["t"], grads["s"] = (dt / n).astype(np.float32), (ds / n).astype(np.float32)
        flat, dflat = both.reshape(-1, 2 * HIDDEN), de.reshape(-1, TAGS)
        grads["w"], grads["b"] = flat.T @ dflat, dflat.sum(0)
        dboth = de @ self.p["w"].T
        self.back(x, "f", kf, dboth[:, :, :HIDDEN], grads)
        self.back(x, "b", kb, dboth[:, :, HIDDEN:], grads)
        return float((z - gold).mean()), grads

    def loss(self, x: np.ndarray, y: np.ndarray) -> float:
        """Mean negative log-likelihood of tags y."""
        e = self.emissions(x)[0].astype(np.float64)
        alpha, rows = e[0] + self.p["s"], np.arange(len(x))
        gold = self.p["s"][y[:, 0]] + e[0, rows, y[:, 0]]
        for k in range(1, len(e)):
            a = alpha[:, :, None] + self.p["t"]
            top = a.max(1)
            alpha = top + np.log(np.exp(a - top[:, None, :]).sum(1)) + e[k]
            gold = gold + self.p["t"][y[:, k - 1], y[:, k]] + e[k, rows, y[:, k]]
        top = alpha.max(1)
        return float((top + np.log(np.exp(alpha - top[:, None]).sum(1)) - gold).mean())

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags (rows, steps) by Viterbi."""
        e = self.emissions(x)[0]
        steps, n, _ = e.shape
        v, best = e[0] + self.p["s"], np.empty((steps, n, TAGS), np.int8)
        for k in range(1, steps):
            all_ = v[:, :, None] + self.p["t"]
            best[k] = all_.argmax(1)
            v = all_.max(1) + e[k]
        out = np.empty((n, steps), np.int64)
        out[:, -1] = v.argmax(1)
        for k in range(steps - 1, 0, -1):
            out[:, k - 1] = best[k, np.arange(n), out[:, k]]
        return out


def fit(x: np.ndarray, y: np.ndarray, batch: int = 64, rate: float = 0.01, every: int = 25, least: int = 300, most: int = 3000, patience: int = 7, seed: int = 0) -> Tagger:
    """Adam on windows at chance places of four fifths of the stretches x, until the loss on the rest has not fallen at `patience` looks, `every` steps apart.

    The rate is cut at every look without a fall. Steps, not epochs, are counted, so a small sample is learnt as well
    as a large one; `least` and `most` bound them.
    """
    model, rng = Tagger.new(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(a) for k, a in m.items()}
    order = rng.permutation(len(x))
    held, own = (order[: min(512, len(x) // 5)], order[min(512, len(x) // 5) :]) if len(x) >= 20 else (order, order)
    best, kept, idle, at = np.inf, model.p, 0, len(own)
    crop = lambda a, rows, start: np.take_along_axis(a[rows], start[:, None] + np.arange(WINDOW), axis=1)
    shift = np.random.default_rng(seed + 1).integers(0, x.shape[1] - WINDOW + 1, len(held))
    held_x, held_y = crop(x, held, shift), crop(y, held, shift)
    for t in range(1, most + 1):
        if at >= len(own):
            own, at = rng.permutation(own), 0
        rows, at = own[at : at + batch], at + batch
        shift = rng.integers(0, x.shape[1] - WINDOW + 1, len(rows))
        _, grads = model.step(crop(x, rows, shift), crop(y, rows, shift))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        for k, g in grads.items():
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            model.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        if t % every == 0:
            if (now := model.loss(held_x, held_y)) < best:
                best, kept, idle = now, {k: a.copy() for k, a in model.p.items()}, 0
            else:
                idle += 1
                rate *= 0.75
                if idle >= patience and t >= least:
                    break
    return Tagger(kept)


def _cut(x: np.ndarray, starts: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Windows of x; outside the text is a symbol of its own."""
    wide = np.r_[x, np.full(width, SYMBOLS - 1)]
    return wide[starts[:, None] + np.arange(width)]


def tagged(model: Tagger, text: str, block: int = 512) -> list[Span]:
    """Spans of the tagger over the whole text."""
    n = len(text)
    near = sorted({w for m in _TRIGGER.finditer(text) for w in (m.start() // STRIDE - 1, m.start() // STRIDE) if w >= 0} | ({0} if _TRIGGER.search(text, 0, STRIDE) else set()))
    if not near:
        return []
    x, out, seen, decoded = symbols(text), np.zeros(n, np.int64), np.zeros(n, bool), {}
    while near:
        for s in range(0, len(near), block):
            starts = np.array(near[s : s + block]) * STRIDE
            decoded |= dict(zip(starts.tolist(), model.decode(_cut(x, starts)), strict=True))
        for start in sorted(decoded):
            a = start + STRIDE // 2 if start else 0  # the central half, but at the ends of the text
            b = min(n, start + STRIDE // 2 + STRIDE if start + WINDOW < n else n)
            out[a:b] = decoded[start][a - start : b - start]
            seen[a:b] = True
        inside = (out > 0) & seen
        beyond = np.r_[np.flatnonzero(inside[:-1] & ~seen[1:]) + 1, np.flatnonzero(inside[1:] & ~seen[:-1])]  # where a span leaves what is decoded
        near = sorted({max(0, (i - STRIDE // 2) // STRIDE) for i in beyond.tolist()})
    return read_off(out)


def plausible(span: Span, text: str) -> bool:
    """Whether the span has what the rules of its kind ask for: so the tagger adds other shapes, not what they have refused."""
    body = text[span[1] : span[2]]
    digits = "".join(_DIGITS.findall(body))
    if span[0] == "email":
        name, _, host = body.partition("@")
        return bool(name.strip()) and "." in host.strip(". ")
    if span[0] == "ip":
        parts = re.split(r"[^0-9]+", body)
        return len(parts) == 4 and all(0 < len(p.lstrip("0") or "0") <= 3 and int(p[-4:] or 256) <= 255 for p in parts)
    return 14 <= len(digits) <= 19 and _luhn(digits) if span[0] == "card" else 10 <= len(digits) <= 15


def spans_of(model: Tagger | None, text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all."""
    base = base_spans(text)
    taken = np.zeros(len(text) + 1, bool)
    for _, a, b in base:
        taken[a:b] = True
    more = [s for s in tagged(model, text) if not taken[s[1] : s[2]].any() and plausible(s, text)] if model else []
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SAMPLE = "key long, other boolean, symbols binary, tags binary"


def train(docs: DataFrame, windows: int = TRAIN_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> Tagger | None:
    """A tagger from stretches of two windows around base spans (two thirds of the sample) and around other digits."""

    def run(batch: pa.RecordBatch) -> dict:
        keys, others, xs, ys = [], [], [], []
        for raw in batch.column("text").to_pylist():
            text = raw.decode("utf-8", "replace")
            first = _TRIGGER.search(text)
            if not first:
                continue
            spans = base_spans(text)
            x, y = symbols(text), tags_of(spans, len(text))
            digest = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
            for i, at in enumerate([a for _, a, _ in spans] or [first.start()]):
                h = (digest + i * 0x9E3779B97F4A7C15) & (1 << 63) - 1
                start = max(0, at - WINDOW + 12)
                tags = np.zeros(2 * WINDOW, np.uint8)
                own = y[start : start + 2 * WINDOW]
                tags[: len(own)] = own
                keys.append(h), others.append(not spans), xs.append(_cut(x, np.array([start]), 2 * WINDOW)[0].astype(np.uint8).tobytes()), ys.append(tags.tobytes())
        return {"key": keys, "other": others, "symbols": xs, "tags": ys}

    found = cut(map_slices(texts(docs, id_col, text_col), run, SAMPLE).dropDuplicates(["key"]))
    totals = {r.other: r.n for r in found.groupBy("other").agg(F.count("*").alias("n")).collect()}
    chosen = []
    for other, n in ((False, windows * 2 // 3), (True, windows // 3)):
        chosen += hashed_share(found.where(F.col("other") == other), F.col("key"), n, totals.get(other, 0)).collect()  # bounded
    chosen.sort(key=lambda r: r.key)
    x, tags = (np.array([np.frombuffer(r[c], np.uint8) for r in chosen], np.int64).reshape(-1, 2 * WINDOW) for c in ("symbols", "tags"))
    return fit(x, tags) if tags.any() else None


def find(docs: DataFrame, model: Tagger | None, id_col: str = "doc_id", text_col: str = "text", redact: bool = True) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), and if asked for redacted (the text with every span as
    [kind], null where there is none) and text_md5, by which it goes back to its row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in (*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted", "text_md5")}
        for raw in batch.column("text").to_pylist():
            text = raw.decode("utf-8", "replace")
            base, every = spans_of(sent.value, text) if _TRIGGER.search(text) else ([], [])
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(said(base).encode()).hexdigest())
            out["spans"].append(said(every))
            if redact:
                out["redacted"].append(redacted(text, every) if every else None)
                out["text_md5"].append(hashlib.md5(raw).hexdigest())
        return {"doc_id": batch.column("doc_id")} | out

    more = ", redacted string, text_md5 string" if redact else ""
    return map_slices(texts(docs, id_col, text_col), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + more)


def redacted(text: str, spans: list[Span]) -> str:
    """Overlapping spans are one, named after the first."""
    out, end = [], 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]]) if spans else text
