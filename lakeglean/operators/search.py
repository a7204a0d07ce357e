"""Weighted queries against positional postings: each task keeps its own best hits, so no query meets a document in a shuffle.

Clauses of a block of queries are broadcast to partitions of documents. A first pass counts the documents of the asked terms.
In the second, a task holds some thousand documents at a time as positional postings of the asked terms only. A query is
skipped for such a block when the bound of its score there (its clauses whose terms the block has, each at its most) cannot
reach the k-th best score so far. Else the rare, heavy clauses are added first; documents that the rest could not lift
over that score are out before common terms and the positions of phrases are looked at. Results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .catalog import top_k
from .components import cut, spread

K1, B = 1.2, 0.75
#: Clauses of queries that are held by the driver and broadcast together, about; tokens and documents that a task indexes together.
BLOCK_CLAUSES = 200_000
BLOCK_TOKENS, BLOCK_DOCS = 2_000_000, 4096
#: Places between the terms of a near clause.
NEAR = 2
#: Scores this close are equal while bounds are compared.
SLACK = 1e-5


@dataclass
class Query:
    """terms and weights of single-term clauses; those of kind `term` count for `need`; sequences: (places between, terms, weight)."""

    terms: np.ndarray
    weights: np.ndarray
    counted: np.ndarray
    sequences: list[tuple[int, tuple[int, ...], float]]
    need: int


@dataclass
class Block:
    """Queries of a block with the numbers of their terms, and what the first pass found of the corpus."""

    ids: list
    terms: list[str]
    queries: list[Query]
    fields: list[str]
    boosts: np.ndarray
    how: str
    mode: str
    k: int | None
    digits: int
    #: By query: chunks that are scored whatever their rank.
    kept: list[np.ndarray | None]
    n: np.ndarray = field(default_factory=lambda: np.zeros(0))
    average: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: (fields, terms) idf, by boost.
    idf: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def weigh(self, n: np.ndarray, length: np.ndarray, df: np.ndarray) -> None:
        self.n, self.average = n, length / np.maximum(n, 1)
        own = np.log(1 + (n[:, None] - df + 0.5) / (df + 0.5))
        if self.how == "presence":
            own = own / np.log(1 + (np.maximum(n, 1)[:, None] - 0.5) / 1.5)
        self.idf = np.where(df > 0, np.ones_like(own) if self.how == "weight" else own, 0.0) * self.boosts[:, None]


class Postings:
    """Places of the asked terms in some documents' field, by term, document and place."""

    def __init__(self, words: pa.ListArray, asked: pa.Array):
        lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
        self.lengths = lengths
        ids = pc.fill_null(pc.index_in(words.flatten(), value_set=asked), -1).to_numpy()
        doc = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        live = np.flatnonzero(ids >= 0)
        live = live[np.argsort(ids[live], kind="stable")]
        term, doc = ids[live], doc[live]
        self.places = doc.astype(np.int64) << 32 | place[live]
        self.place_starts = np.searchsorted(term, np.arange(len(asked) + 1))
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])) if len(term) else np.zeros(0, np.int64)
        self.docs, self.tf = doc[first], np.diff(np.append(first, len(term)))
        self.starts = np.searchsorted(term[first], np.arange(len(asked) + 1))

    def has(self, terms: np.ndarray) -> np.ndarray:
        return self.starts[terms + 1] > self.starts[terms]

    def gather(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(posting numbers, number within `terms`) of all postings of these terms."""
        starts, counts = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        which = np.repeat(np.arange(len(terms)), counts)
        return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(which)), which

    def sequence(self, between: int, terms: tuple[int, ...]) -> np.ndarray:
        """Documents where each term follows the one before with at most `between` places between them."""
        at = self.places[self.place_starts[terms[0]] : self.place_starts[terms[0] + 1]]
        for t in terms[1:]:
            here = self.places[self.place_starts[t] : self.place_starts[t + 1]]
            if not len(at) or not len(here):
                return np.zeros(0, np.int64)
            before = np.searchsorted(at, here) - 1  # the nearest one before
            at = here[(before >= 0) & (here - at[before] <= 1 + between)]
        return np.unique(at >> 32)


class Best:
    """The k best of a query so far, by rounded score and then by id; or all, for k = None."""

    def __init__(self, k: int | None, digits: int):
        self.k, self.scale = k, 10.0**digits
        self.rows: list[tuple] = []  # arrays: key, ids, scores, hits
        self.floor = -math.inf

    def add(self, ids: np.ndarray, scores: np.ndarray, hits: np.ndarray) -> None:
        key = np.floor(scores * self.scale + 0.5)
        if self.rows:
            key, ids, scores, hits = (np.concatenate(x) for x in zip(self.rows[0], (key, ids, scores, hits), strict=True))
        if self.k is not None and len(key) > self.k:
            order = np.lexsort((ids, -key))[: self.k]
            key, ids, scores, hits = key[order], ids[order], scores[order], hits[order]
        if self.k is not None and len(key) == self.k:
            self.floor = float(key.min() / self.scale)
        self.rows = [(key, ids, scores, hits)]


def scored(block: Block, q: Query, posts: list[Postings], floor: float, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents of the block that may be among the best of q: (documents, scores, hits)."""
    none = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    plans, bounds = [], []
    for f, p in enumerate(posts):
        there = p.has(q.terms)
        terms, most = q.terms[there], q.weights[there] * block.idf[f, q.terms[there]] * (K1 + 1 if block.how == "bm25" else 1)
        order = np.argsort(-most, kind="stable")
        chains = [(b, t, w * block.idf[f, list(t)].sum()) for b, t, w in q.sequences if p.has(np.array(t)).all()]
        plans.append((terms[order], most[order], q.counted[there][order], q.weights[there][order], chains))
        bounds.append(most.sum() + sum(c[2] for c in chains) * (K1 + 1 if block.how == "bm25" else 1))
    together = max if block.mode == "max" else sum
    if not any(len(p[0]) for p in plans) or together(bounds) < floor - SLACK or max(int(p[2].sum()) for p in plans) < q.need:
        return none
    totals, hits, bound_left = [], [], []
    for f, (p, (terms, most, counted, weights, chains)) in enumerate(zip(posts, plans, strict=True)):
        score, hit = np.zeros(size), np.zeros(size, np.int64)
        rest = sum(c[2] for c in chains) * (K1 + 1 if block.how == "bm25" else 1)
        # clauses that by themselves could reach the floor come first, if the field stands alone
        after = np.append(np.cumsum(most[::-1])[::-1][1:], 0.0) + rest if len(most) else np.zeros(0)
        cutoff = int(np.searchsorted(-after, SLACK - floor, side="right")) + 1 if len(posts) == 1 and q.need <= 1 and math.isfinite(floor) else len(terms)
        for part in (slice(0, cutoff), slice(cutoff, len(terms))):
            if len(terms[part]):
                at, which = p.gather(terms[part])
                docs = p.docs[at]
                add = (weights[part] * block.idf[f, terms[part]])[which]
                if block.how == "bm25":
                    tf, length = p.tf[at], p.lengths[docs]
                    add = add * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / block.average[f]))
                score += np.bincount(docs, add, size)
                hit += np.bincount(docs, counted[part][which], size).astype(np.int64)
            if part.start == 0 and cutoff < len(terms) and not (score + after[cutoff - 1] >= floor - SLACK)[hit > 0].any():
                return none  # what has only the lighter clauses cannot reach the floor either
        totals.append(score)
        hits.append(hit)
        bound_left.append(rest)
    upper = np.max(np.stack(totals) + np.array(bound_left)[:, None], axis=0) if block.mode == "max" else np.sum(totals, axis=0) + sum(bound_left)
    enough = np.max(hits, axis=0) >= q.need
    chosen = enough & (np.any([t > 0 for t in totals], axis=0) | np.any([h > 0 for h in hits], axis=0)) & (upper >= floor - SLACK)
    if not chosen.any():
        return none
    for f, (p, (*_, chains)) in enumerate(zip(posts, plans, strict=True)):
        for between, terms, weight in chains:
            docs = p.sequence(between, terms)
            totals[f][docs] += weight
    docs = np.flatnonzero(chosen)
    own = np.stack(totals)[:, docs]
    return docs, own.max(0) if block.mode == "max" else own.sum(0), np.max(hits, axis=0)[docs]


def pieces(batches: Iterator[pa.RecordBatch], fields: int) -> Iterator[tuple[pa.Array, list[pa.ListArray]]]:
    """(ids, words of each field) of some documents at a time; rows without an id are left out."""
    for batch in batches:
        batch = batch.filter(batch.column(0).is_valid())
        total = sum(pc.fill_null(pc.list_value_length(batch.column(1 + f)), 0).to_numpy() for f in range(fields))
        group = np.maximum(np.cumsum(total) // BLOCK_TOKENS, np.arange(batch.num_rows) // BLOCK_DOCS) if batch.num_rows else np.zeros(0, np.int64)
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            part = batch.slice(at[0], len(at))
            yield part.column(0), [part.column(1 + f) for f in range(fields)]


def counted(block: Block, asked: pa.Array, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(field, term, n): documents of each asked term; of term -1, documents with any word, and -2, their words."""
    fields, found = len(block.fields), None
    for _, words in pieces(batches, fields):
        now = np.zeros((fields, len(asked) + 2), np.int64)
        for f, w in enumerate(words):
            p = Postings(w, asked)
            now[f, :-2] = np.diff(p.starts)
            now[f, -2:] = (p.lengths > 0).sum(), p.lengths.sum()
        found = now if found is None else found + now
    if found is not None:
        f, t = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(np.where(t < len(asked), t, len(asked) - 1 - t), pa.int32()), pa.array(found[f, t], pa.int64())], names=["field", "term", "n"])


def best_of_block(block: Block, asked: pa.Array, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, chunk_id, score, hits): the best of each query among these documents."""
    best = [Best(block.k, block.digits) for _ in block.queries]
    more: list[tuple] = []

    def rows() -> Iterator[pa.RecordBatch]:
        found = [(q, *b.rows[0][1:], False) for q, b in zip(block.ids, best, strict=True) if b.rows] + [(*m, True) for m in more]
        more.clear()
        for q, ids, scores, hits, kept in found:
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([q] * n, schema[0].type), pa.array(ids, schema[1].type), pa.array(scores), pa.array(hits), pa.array([kept] * n)], schema=schema)

    for ids, words in pieces(batches, len(block.fields)):
        own = ids.to_numpy(zero_copy_only=False)
        posts = [Postings(w, asked) for w in words]
        for name, q, b, all_kept in zip(block.ids, block.queries, best, block.kept, strict=True):
            keep = None if all_kept is None or not len(own) or not np.isin(own, all_kept).any() else all_kept
            docs, scores, hits = scored(block, q, posts, b.floor if keep is None else -math.inf, len(own))
            if len(docs):
                b.add(own[docs], scores, hits)
                if keep is not None and (at := np.flatnonzero(np.isin(own[docs], keep))).size:
                    more.append((name, own[docs[at]], scores[at], hits[at]))
        if block.k is None:
            yield from rows()
            best = [Best(None, block.digits) for _ in block.queries]
    yield from rows()


def search(
    queries: DataFrame, chunks: DataFrame, fields: dict[str, Column], k: int | None = 10, how: str = "presence", boosts: dict[str, float] | None = None,
    mode: str = "max", share: float = 0.0, least: int = 1, digits: int = 6, corpus: DataFrame | None = None, keep: DataFrame | None = None,
) -> DataFrame:
    """(query_id, chunk_id, score, hits) of query rows (query_id, kind, text, weight) on chunks (chunk_id and what `fields` are made of).

    Rows are as query_rows makes them: kinds term and syn score by weight and idf of the term, phrase (terms in turn) and
    near (in turn, within NEAR places) by weight and the sum of the idfs; a sequence lifts a hit and makes none. A hit has at least `least` and share * (terms of
    its query) terms, in one field. k best by score, rounded to `digits`, and chunk_id; k = None: all hits. `corpus`: the
    chunks that document frequencies are counted over, if not those searched (which may be filtered). `keep`: pairs (query_id,
    chunk_id) that are returned with their score whatever their rank, if they hit at all; a few for each query.
    how: presence or bm25 of the terms, or weight alone.
    Null ids of chunks are left out, null texts have no words, queries without rows have no hits.
    """
    names, total = list(fields), queries.count()
    parts = max(1, -(-total // BLOCK_CLAUSES))
    words = [tokens(c).alias(f"_{i}") for i, c in enumerate(fields.values())]
    docs = spread(chunks).select("chunk_id", *words)
    counted_over = docs if corpus is None else spread(corpus).select("chunk_id", *words)
    kinds = [{f.name: f.dataType.simpleString() for f in df.schema}[c] for df, c in ((queries, "query_id"), (chunks, "chunk_id"))]
    schema = f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double, hits long, kept boolean"
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    arrow = pa.schema([("query_id", types[kinds[0]]), ("chunk_id", types[kinds[1]]), ("score", pa.float64()), ("hits", pa.int64()), ("kept", pa.bool_())])
    out = None
    for i in range(parts):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).select("query_id", "kind", "text", F.col("weight").cast("double").alias("weight")).collect()  # a block
        if not own:
            continue
        also = {} if keep is None else {r.query_id: r.ids for r in keep.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).groupBy("query_id").agg(F.collect_set("chunk_id").alias("ids")).collect()}
        block = planned(own, names, boosts or {}, how, mode, k, share, least, digits, also)
        asked = pa.array(block.terms, pa.string())
        found = counted_over.mapInArrow(lambda it, b=block, a=asked: counted(b, a, it), "field int, term int, n long").groupBy("field", "term").agg(F.sum("n").alias("n"))
        table = np.zeros((len(names), len(asked) + 2))
        for r in found.collect():  # asked terms and two numbers of each field
            table[r.field, r.term if r.term >= 0 else len(asked) - 1 - r.term] = r.n
        block.weigh(table[:, -2], table[:, -1], table[:, :-2])
        hits = docs.mapInArrow(lambda it, b=block, a=asked: best_of_block(b, a, arrow, it), schema)
        hits = hits if parts == 1 else cut(hits)  # the driver holds one block at a time
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = queries.sparkSession.createDataFrame([], schema)
    best = out.where("not kept").drop("kept")
    best = best if k is None else top_k(best, "query_id", F.round("score", digits), k, "chunk_id").drop("rank")
    return best if keep is None else best.unionByName(out.where("kept").drop("kept")).dropDuplicates(["query_id", "chunk_id"])


def frequencies(terms: DataFrame, chunks: DataFrame, text: Column, most: int = BLOCK_CLAUSES) -> DataFrame:
    """(term, freq, df) of the asked terms in all chunks: how often, and in how many. Terms go to the tasks in blocks; only counts are shuffled."""
    asked_for = cut(terms.select("term").distinct())
    parts = max(1, -(-asked_for.count() // most))
    words, out = spread(chunks).select("chunk_id", tokens(text).alias("_0")), None
    for i in range(parts):
        block = sorted(r.term for r in asked_for.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == i).collect())
        asked = pa.array(block, pa.string())

        def count(batches: Iterator[pa.RecordBatch], asked: pa.Array = asked) -> Iterator[pa.RecordBatch]:
            found = np.zeros((2, len(asked)), np.int64)
            for _, (own,) in pieces(batches, 1):
                p = Postings(own, asked)
                found += np.stack([np.diff(p.place_starts), np.diff(p.starts)])
            at = np.flatnonzero(found[0])
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(at)), pa.array(found[0, at]), pa.array(found[1, at])], names=["term", "freq", "df"])

        now = words.mapInArrow(count, "term string, freq long, df long")
        out = now if out is None else out.unionByName(now)
    return out.groupBy("term").agg(F.sum("freq").alias("freq"), F.sum("df").alias("df"))


def planned(rows: list, names: list[str], boosts: dict[str, float], how: str, mode: str, k: int | None, share: float, least: int, digits: int, also: dict) -> Block:
    by: dict = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
    numbers: dict[str, int] = {}

    def number(term: str) -> int:
        return numbers.setdefault(term, len(numbers))

    queries = []
    for own in by.values():
        single = sorted((r.kind != "term", r.text, r.weight) for r in own if r.kind in ("term", "syn") and r.text)
        sequences = sorted((NEAR if r.kind == "near" else 0, tuple(map(number, r.text.split(" "))), r.weight) for r in own if r.kind in ("phrase", "near") and r.text)
        n = len({t for syn, t, _ in single if not syn})
        queries.append(Query(np.array([number(t) for _, t, _ in single], np.int64), np.array([w for *_, w in single], np.float64), np.array([not syn for syn, *_ in single], bool), sequences, max(math.floor(n * share), least)))
    return Block(list(by), list(numbers), queries, names, np.array([boosts.get(f, 1.0) for f in names], np.float64), how, mode, k, digits, [np.array(also[q]) if q in also else None for q in by])


def term_rows(terms: DataFrame) -> DataFrame:
    """Query rows of (query_id, term), each of weight 1."""
    return terms.select("query_id", F.lit("term").alias("kind"), F.col("term").alias("text"), F.lit(1.0).alias("weight"))
