"""Vector bin packing of tokenised documents into training sequences.

Each example is a vector of demands: tokens, segments (one a piece) and loss-bearing tokens. A bin has limits on all three.
The dot-product heuristic fills one bin at a time: of the examples that still fit, the one whose demands have the
largest product with what the bin has left goes in. When none fits whole, an example is cut so that the bin ends full.
What is left over at the end of a task is cut at powers of two, so that no sequence there needs padding.

A task packs what it has read, window by window, so no shuffle is needed, memory is bounded by the window, and a lost task
is packed again in the same way from the same rows.

Edge cases: a null text is empty and still has its end token; very long texts fill sequences of their own; equal rows are
packed each; an empty table gives no rows; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import CACHES, _arrow_schema, claim, record_batch, slices, texts

CAPACITY = 4096
SEGMENTS = 256
END = 2
#: Tokens that are held back and packed together.
WINDOW_TOKENS = 2 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class WordIds(dict):
    """Ids of a text, by the tokenizer, a white-space-parted chunk at a time.

    The tokenizer drops white space and no token, nor its Unicode normal form, reaches across ASCII white space, so the
    ids of a text are those of its chunks in turn. Chunks recur, so each is tokenised once while it is kept.
    """

    def __init__(self, path: str, most: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.flat, self.starts = array("I"), array("q", [0])

    def __missing__(self, chunk: bytes) -> int:
        ids = self.tokenizer.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids
        self.flat.extend(ids)
        self.starts.append(len(self.flat))
        self[chunk] = code = len(self.starts) - 2
        return code

    def encode(self, batch: list[bytes], end: int) -> list[np.ndarray]:
        if len(self) > self.most:
            self.reset()
        # the tokenizer lower-cases all but the names of its special tokens
        codes = [np.fromiter(map(self.__getitem__, (t if b"<|" in t else t.lower()).split()), np.int64) for t in batch]
        flat, starts = np.append(np.array(self.flat, "<u4"), np.array([end], "<u4")), np.array(self.starts)
        out = []
        for c in codes:
            n = starts[c + 1] - starts[c]
            at = np.cumsum(n)
            take = np.repeat(starts[c] - at + n, n) + np.arange(at[-1] if len(at) else 0)
            out.append(np.append(flat[take], flat[-1:]))
        return out


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


CACHES["pack"] = word_ids.cache_clear


def borne(rate: float, start: int, size: int) -> int:
    """Loss-bearing tokens of a piece, where every token bears its example's share: those of its pieces add up to the example's."""
    return math.floor((start + size) * rate + 1e-9) - math.floor(start * rate + 1e-9)


def fill(demands: np.ndarray, limits: np.ndarray) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full bins of (example, start, tokens), and the open last bin.

    demands: a row (tokens, loss-bearing tokens) for each example, tokens at most the limit; limits: tokens, segments,
    loss-bearing tokens. A piece of an example has its proportion of loss-bearing tokens, see borne().
    """
    tokens, loss = demands[:, 0].astype(np.float64), demands[:, 1].astype(np.float64)
    start = np.zeros(len(tokens), np.int64)
    rate = np.divide(loss, tokens, out=np.zeros_like(loss), where=tokens > 0)
    order = np.lexsort((np.arange(len(tokens)), -loss, -tokens))
    live = order[tokens[order] > 0]
    bins: list[list[tuple[int, int, int]]] = []
    inverse = 1.0 / limits
    while len(live):
        left, now = limits.astype(np.float64), []
        t, s = tokens[live] * inverse[0], loss[live] * inverse[2]
        open_ = np.ones(len(live), bool)
        while left[0] > 0 and left[1] >= 1:
            fits = open_ & (tokens[live] <= left[0]) & (loss[live] <= left[2])
            if not fits.any():
                break
            r = left * inverse
            score = np.where(fits, t * r[0] + inverse[1] * r[1] + s * r[2], -1.0)
            k = int(score.argmax())
            now.append((int(live[k]), int(start[live[k]]), int(tokens[live[k]])))
            left -= (tokens[live[k]], 1, loss[live[k]])
            open_[k] = False
        if left[0] > 0 and left[1] >= 1 and left[2] >= 1 and open_.any():
            k = int(np.flatnonzero(open_)[0])  # the largest
            x = live[k]
            take, s0 = min(int(left[0]), int(tokens[x]) - 1), int(start[x])
            if borne(rate[x], s0, take) > left[2]:
                take = math.ceil((math.floor(s0 * rate[x] + 1e-9) + left[2] + 1) / rate[x] - 1e-6) - 1 - s0
            if take > 0:
                now.append((int(x), s0, take))
                start[x] += take
                loss[x] -= borne(rate[x], s0, take)
                tokens[x] -= take
                left[0] -= take
        live = live[open_]
        if len(live) or left[0] <= 0:
            bins.append(now)
        else:
            return bins, now
    return bins, []


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cut one open bin into bins whose sizes are powers of two."""
    total, out, at, rest = sum(p[2] for p in pieces), [], 0, list(pieces)
    while total:
        room, now = 1 << (total.bit_length() - 1), []
        total -= room
        while room:
            x, s, n = rest[at]
            take = min(n, room)
            now.append((x, s, take))
            room -= take
            rest[at] = (x, s + take, n - take)
            at += take == n
        out.append(now)
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_limit: int | None = None, end: int = END, loss_of: Callable[[np.ndarray], int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    loss_of: the loss-bearing tokens of an example's ids; all but its first, unless given. capacity is a power of two.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    limits = np.array([capacity, segments, loss_limit or capacity])
    arrow = _arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pack")
        n, coder = TaskContext.get().partitionId() << 36, word_ids(path)
        held: list[tuple[int, int, int, np.ndarray]] = []  # id, tokens before, tokens of the document, ids

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal n, held
            demands = np.array([[len(x[3]), min(len(x[3]), (loss_of or _all_but_first)(x[3]))] for x in held]).reshape(-1, 2)
            bins, rest = fill(demands, limits)
            rows = []
            for pieces in [*bins, *(powers(rest) if last else [])]:
                # a bin that a limit other than tokens has closed is cut at powers of two too
                for part in [pieces] if sum(p[2] for p in pieces) == capacity else powers(pieces):
                    offset = 0
                    for x, start, size in part:
                        doc, before, total, ids = held[x]
                        rows.append((doc, before + start, size, zlib.crc32(ids[start : start + size].tobytes()), total, n, offset, borne(demands[x, 1] / max(1, demands[x, 0]), start, size)))
                        offset += size
                    n += 1
            held = [] if last else [(held[x][0], held[x][1] + s, held[x][2], held[x][3][s : s + k]) for x, s, k in rest]
            if rows:
                yield record_batch(dict(zip((f.name for f in arrow), zip(*rows, strict=True), strict=True)), arrow)

        for batch in slices(batches, "text"):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text").to_pylist(), end), strict=True):
                for s in range(0, len(ids), capacity):
                    held.append((doc, s, len(ids), ids[s : s + capacity]))
            if sum(len(x[3]) for x in held) >= WINDOW_TOKENS:
                yield from flush(False)
        yield from flush(True)

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def _all_but_first(ids: np.ndarray) -> int:
    return max(0, len(ids) - 1)
