"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items.

Texts are normalised once (A-Z lower-cased; every other ASCII character that is no digit or letter parts words), and
scanned once; hits are mapped back to word numbers and to code points of the text as it was given.

Edge cases: a null or word-less text has no hits; a null or word-less item has no windows; equal and tied items each count;
rows of the same id, repeated or not, are each judged; very long texts are scanned whole; extra columns are left out,
whatever their names; an empty benchmark leaves every document clean, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, map_slices, texts

WINDOW = 10
#: Bytes of benchmark text in one automaton; a larger benchmark is scanned in several blocks.
BLOCK_BYTES = 8 << 20
_KEEP = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, n_words long, hits array<int>, items array<string>, starts array<int>, ends array<int>, text_md5 string"


def normalised(text: bytes) -> str:
    """Words parted and enclosed by single spaces, one character a byte; one space if there are none."""
    found = b" ".join(text.translate(_KEEP).split()).decode("latin-1")
    return f" {found} " if found else " "


def windows(text: bytes, size: int = WINDOW) -> list[str]:
    found = normalised(text).split()
    k = min(size, len(found))
    return [f" {' '.join(found[i : i + k])} " for i in range(len(found) - k + 1)] if k else []


class Items:
    """Items that travel to the tasks; each Python worker builds the automaton once."""

    def __init__(self, rows: list[tuple[str, bytes]], size: int):
        self.rows, self.size = sorted(rows), size
        self.key = hashlib.sha256(repr((self.rows, size)).encode()).hexdigest()

    def __hash__(self) -> int:
        return hash(self.key)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Items) and other.key == self.key


@lru_cache(maxsize=2)
def automaton(items: Items) -> ahocorasick.Automaton | None:
    of: dict[str, list[str]] = {}
    for item, text in items.rows:
        for w in dict.fromkeys(windows(text, items.size)):
            of.setdefault(w, []).append(item)
    if not of:
        return None
    found = ahocorasick.Automaton()
    for w, ids in of.items():
        found.add_word(w, (w.count(" ") - 1, tuple(ids)))
    found.make_automaton()
    return found


CACHES["decontaminate"] = automaton.cache_clear


def _scan(items: Items, keyed: bool = False):
    def scan(batch: pa.RecordBatch) -> dict:
        search = automaton(items)
        n_words, hits, ids, starts, ends = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            norm = normalised(text)
            n_words.append(norm.count(" ") - 1)
            found = list(search.iter(norm)) if search else []
            if not found:
                hits.append([]), ids.append([]), starts.append([]), ends.append([])
                continue
            at = np.flatnonzero(np.frombuffer(norm.encode("latin-1"), np.uint8) == 32)
            hit = np.zeros(n_words[-1] + 1, np.int64)
            for end, (k, _) in found:
                j = int(np.searchsorted(at, end))
                hit[j - k] += 1
                hit[j] -= 1
            covered = np.flatnonzero(np.cumsum(hit)[:-1])
            hits.append(covered)
            ids.append(sorted({x for _, (_, names) in found for x in names}))
            spans = [m.span() for m in _WORD.finditer(text.decode("utf-8", "replace"))]
            # of runs; or, where other blocks may have more of a run, of each word
            first = covered if keyed else covered[np.r_[True, np.diff(covered) > 1]]
            last = covered if keyed else covered[np.r_[np.diff(covered) > 1, True]]
            starts.append([spans[i][0] for i in first])
            ends.append([spans[i][1] for i in last])
        out = {"doc_id": batch.column("doc_id"), "n_words": n_words, "hits": hits, "items": ids, "starts": starts, "ends": ends, "text_md5": [hashlib.md5(t).hexdigest() for t in batch.column("text").to_pylist()]}
        return out | {"h": batch.column("h")} if keyed else out

    return scan


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, hits: word numbers, items: ids, starts, ends: code points of hit runs, text_md5) for each document.

    The benchmark is the stated query set: it is measured, and travels to the tasks in blocks of at most about
    `block_bytes`. One block is one pass over the text; with more, the passes are merged by document.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("binary").alias("body")).where("item is not null and body is not null").distinct()
    total = items.agg(F.sum(F.length("body") + F.length("item"))).head()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    source = texts(docs, id_col, text_col)
    if blocks > 1:
        source = source.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "text").select("key.*", "text")
    passes = []
    for b in range(blocks):
        rows = [(r.item, bytes(r.body)) for r in items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == b).collect()]
        passes.append(map_slices(source, _scan(Items(rows, size), blocks > 1), SCHEMA + ", h long" * (blocks > 1), own="decontaminate"))
    if blocks == 1:
        return passes[0]
    union = passes[0]
    for p in passes[1:]:
        union = union.unionByName(p)
    # rows of one id and text have one result; each pass saw all copies
    hit = F.arrays_zip("hits", "starts", "ends")
    merged = union.withColumn("hit", hit).groupBy("doc_id", "h").agg(
        F.max("n_words").alias("n_words"),
        F.max("text_md5").alias("text_md5"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("hit")))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        (F.count("*") / blocks).cast("int").alias("copies"),
    )
    before, after = (lambda i: F.get("hit", i - 1)["hits"]), (lambda i: F.get("hit", i + 1)["hits"])
    first = F.filter("hit", lambda x, i: (i == 0) | (before(i) < x["hits"] - 1))
    last = F.filter("hit", lambda x, i: (i == F.size("hit") - 1) | (after(i) > x["hits"] + 1))
    merged = merged.select("doc_id", "n_words", F.col("hit.hits").alias("hits"), "items", first["starts"].alias("starts"), last["ends"].alias("ends"), "text_md5", F.sequence(F.lit(1), "copies").alias("copies"))
    return merged.withColumn("copy", F.explode("copies")).drop("copies", "copy")


def report(found: DataFrame) -> DataFrame:
    """The digest columns of op9."""
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


_W = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce({_W}, []) AS w FROM documents),
b AS (SELECT item_id, {_W} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS s
       FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS k FROM b WHERE len(w) > 0), unnest(range(1, len(w) - k + 2)) AS t(i)),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i+k-1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - k + 2)) AS t(i)),
h AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, s)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + k)) AS t(p) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
