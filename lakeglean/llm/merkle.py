"""Merkle manifest of a table: a tree of ternary SHA-256 nodes per source, and one over the sources.

A child's digest counts as hex text, 64 bytes, which is one block of SHA-256. A parent is thus hashed block by block, and
keeps a copy of the hash state before each child slot. To fold a changed leaf, each parent on its way resumes the state of
the child's slot with the replacement and hashes the right siblings only; what lies to the left is in the state.

Spark sorts the leaves by source and id in ranges, numbers them, and groups BLOCK neighbours at a time (a bound for a task,
however large a source is); a block climbs LEVELS levels at once, so the tree over any table takes a few rounds. On the way
down each node gets its path to the root: per level the retained state, the slot and the siblings. Nothing passes through
the driver but the largest number of leaves of a source.

Edge cases: a null source is a source of its own, before all others; null values hash as `-`, so they differ from empty ones;
a null id comes first and is never tampered with; rows of one id are ordered by their leaf, and repeated rows are leaves of
their own; a source with one row has that leaf as its subroot, a table with one source has its subroot as root; long texts
are hashed whole by the JVM; an empty table gives no rows; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import cut
from .common import record_batch

WAYS = 3
#: Levels that a block of nodes climbs in one task, and the nodes of a block.
LEVELS = 7
BLOCK = WAYS**LEVELS
#: Nodes that are hashed side by side, about.
TOGETHER = 4 * BLOCK


def primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def root_fraction(p: int, degree: int) -> int:
    """First 32 bits of the fraction of the square or cube root of p."""
    whole = p << 32 * degree
    low, high = 0, 1 << (whole.bit_length() // degree + 1)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if mid**degree <= whole else (low, mid)
    return low & 0xFFFFFFFF


START = np.array([root_fraction(p, 2) for p in primes(8)], np.uint32)
ROUND = np.array([root_fraction(p, 3) for p in primes(64)], np.uint32)
HEX = np.frombuffer(b"".join(b"%02x" % i for i in range(256)), np.uint8).reshape(256, 2)


def turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def absorbed(states: np.ndarray, blocks: np.ndarray, wide: int = 2048) -> np.ndarray:
    """States (m, 8) after one 64-byte block each, (m, 16) words: SHA-256's compression, all rows side by side."""
    out = np.empty_like(states)
    for s in range(0, len(states), wide):
        w = np.empty((64, min(wide, len(states) - s)), np.uint32)
        w[:16] = blocks[s : s + wide].T
        for t in range(16, 64):
            x, y = w[t - 15], w[t - 2]
            w[t] = w[t - 16] + (turned(x, 7) ^ turned(x, 18) ^ (x >> np.uint32(3))) + w[t - 7] + (turned(y, 17) ^ turned(y, 19) ^ (y >> np.uint32(10)))
        a, b, c, d, e, f, g, h = first = np.ascontiguousarray(states[s : s + wide].T)
        for t in range(64):
            more = h + (turned(e, 6) ^ turned(e, 11) ^ turned(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[t] + w[t]
            less = (turned(a, 2) ^ turned(a, 13) ^ turned(a, 22)) + ((a & b) | (c & (a | b)))
            a, b, c, d, e, f, g, h = more + less, a, b, c, d + more, e, f, g
        out[s : s + wide] = (first + np.stack([a, b, c, d, e, f, g, h])).T
    return out


def hex_bytes(digests: np.ndarray) -> np.ndarray:
    """(m, 32) bytes as (m, 64) hex characters."""
    return HEX[digests].reshape(len(digests), 64)


def child_block(digests: np.ndarray) -> np.ndarray:
    return hex_bytes(digests).view(">u4").astype(np.uint32)


def finished(states: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Digests (m, 32) of nodes with so many children, all of which their states have taken in."""
    last = np.zeros((len(states), 16), np.uint32)
    last[:, 0], last[:, 15] = 1 << 31, children * 512
    return absorbed(states, last).astype(">u4").view(np.uint8).reshape(-1, 32)


@dataclass
class Level:
    """Parents over `nodes` of one level: each node's parent and slot; each parent's first child, children, and states before its slots."""

    nodes: np.ndarray
    parent: np.ndarray
    slot: np.ndarray
    first: np.ndarray
    children: np.ndarray
    states: np.ndarray


#: Of a run of three, the others of each slot.
OTHERS = np.array([[1, 2], [0, 2], [0, 1]])


@dataclass
class Steps:
    """One level of the way up from m nodes: retained state, slot, children and the run's other nodes. children = 0: nothing on this level."""

    state: np.ndarray
    slot: np.ndarray
    children: np.ndarray
    others: np.ndarray

    RECORD = np.dtype([("state", "u1", 32), ("slot", "u1"), ("children", "u1"), ("others", "u1", (2, 32))])

    def rows(self) -> np.ndarray:
        out = np.zeros(len(self.slot), self.RECORD)
        out["state"], out["slot"], out["children"], out["others"] = self.state.astype(">u4").view(np.uint8), self.slot, self.children, self.others
        return out

    @classmethod
    def of(cls, rows: np.ndarray) -> Steps:
        return cls(np.ascontiguousarray(rows["state"]).view(">u4").astype(np.uint32), rows["slot"].astype(np.int64), rows["children"].astype(np.int64), rows["others"])

    def fold(self, values: np.ndarray) -> np.ndarray:
        """The parents' digests if the nodes had these digests: each resumes the state of the slot, then right siblings."""
        out, live = values.copy(), np.flatnonzero(self.children)
        slot, children, others = self.slot[live], self.children[live], self.others[live]
        states = absorbed(self.state[live], child_block(values[live]))
        for k in range(WAYS - 1):
            right = np.flatnonzero(slot + k + 1 < children)
            states[right] = absorbed(states[right], child_block(others[right, slot[right] + k]))
        out[live] = finished(states, children)
        return out


def raised(nodes: np.ndarray, counts: np.ndarray, rising: np.ndarray) -> tuple[Level, np.ndarray, np.ndarray]:
    """One level over runs of `counts` nodes: (level, parents' digests, their counts); runs that do not rise stay as they are."""
    offset = np.cumsum(counts) - counts
    run = np.repeat(np.arange(len(counts)), counts)
    index = np.arange(len(nodes)) - offset[run]
    up = np.where(rising, -(-counts // WAYS), counts)
    above = np.cumsum(up) - up
    parent = above[run] + np.where(rising[run], index // WAYS, index)
    slot = np.where(rising[run], index % WAYS, 0)
    first = np.flatnonzero(slot == 0)
    hashed = np.repeat(rising, up)
    children = np.where(hashed, np.bincount(parent, minlength=len(first)), 0)
    states = np.zeros((len(first), WAYS, 8), np.uint32)
    digests = nodes[first].copy()
    at = np.flatnonzero(hashed)
    state = np.tile(START, (len(at), 1))
    for k in range(WAYS):
        has = np.flatnonzero(children[at] > k)
        states[at[has], k] = state[has]
        state[has] = absorbed(state[has], child_block(nodes[first[at[has]] + k]))
    digests[at] = finished(state, children[at])
    return Level(nodes, parent, slot, first, children, states), digests, up


def climbed(nodes: np.ndarray, counts: np.ndarray, levels: np.ndarray) -> tuple[list[Level], np.ndarray]:
    """Levels over each run of nodes, as many as it is to climb, and the one node left of each run."""
    found = []
    for t in range(int(levels.max(initial=0))):
        level, nodes, counts = raised(nodes, counts, levels > t)
        found.append(level)
    return found, nodes


def ways_up(levels: list[Level], at: np.ndarray) -> list[Steps]:
    """Level by level the steps of the nodes at these places of the lowest level."""
    found = []
    for level in levels:
        parent, slot = level.parent[at], level.slot[at]
        children = level.children[parent]
        others = np.minimum(level.first[parent][:, None] + OTHERS[slot], len(level.nodes) - 1)
        found.append(Steps(level.states[parent, slot], slot, children, level.nodes[others]))
        at = parent
    return found


@lru_cache(maxsize=4096)
def height(n: int) -> int:
    """Levels until n nodes are one."""
    k = 0
    while n > 1:
        n, k = -(-n // WAYS), k + 1
    return k


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """(key, doc_id, leaf, altered): sha256 over the columns of documents; altered: with the text `changed`, null where it is null. key orders sources."""

    def leaf(text: Column) -> Column:
        return F.unhex(F.sha2(F.concat(*map(field, (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))).cast("binary"), 256))

    key = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit(":"), F.col("source").cast("string")))
    altered = F.when(changed.isNotNull(), leaf(changed)) if changed is not None else F.lit(None).cast("binary")
    return docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("leaf"), altered.alias("altered"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos (from 0 within key, by `order`) and n (rows of the key). Ranges of rows are numbered apart and then moved by the rows before them."""
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = ", ".join(f"{n} {t.simpleString()}" for n, t in kinds.items()) + ", part int, pos long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for k in batch.column("key").to_pylist():
                key, at = k, at + 1 if k == key else 0
                places.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], names=[*batch.schema.names, "part", "pos"])

    by = ["key", *order, "tie"]
    ranged = cut(rows).withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("tie")
    placed = cut(ranged.mapInArrow(count, schema))
    counts = placed.groupBy("key", "part").agg(F.count("*").alias("rows"))
    before = "sum(rows) over (partition by key order by part rows between unbounded preceding and 1 preceding)"  # one row a range
    moved = counts.selectExpr("key", "part", f"coalesce({before}, 0L) moved", "sum(rows) over (partition by key) n")
    return placed.join(moved, ["key", "part"]).withColumn("pos", F.col("pos") + F.col("moved")).drop("part", "moved")


BLOCKS = "key string, block long, n long, digest binary"


class Tree:
    """Nodes (key, pos, n, digest, other columns of `kept`) in blocks, round by round; `tops` (key, round, digest) are the last nodes."""

    def __init__(self, nodes: DataFrame, kept: tuple[str, ...] = ()):
        most = (nodes := cut(nodes)).agg(F.max("n")).head()[0]  # one number
        self.rounds: list[DataFrame] = []
        tops = []
        while most:
            items = F.array_sort(F.collect_list(F.struct("pos", "digest", *(kept if not self.rounds else ()))))
            blocks = nodes.groupBy("key", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.max("n").alias("n"), items.alias("items"))
            self.rounds.append(blocks := cut(blocks))
            up = blocks.select("key", "block", "n", F.col("items.digest").alias("digests")).mapInArrow(self.climb, BLOCKS)
            up = cut(up.select("key", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), "digest"))
            tops.append(up.where("n = 1").select("key", F.lit(len(tops)).alias("round"), "digest"))
            nodes, most = up.where("n > 1"), -(-most // BLOCK) if most > BLOCK else 0
        self.tops = tops[0] if tops else None
        for t in tops[1:]:
            self.tops = self.tops.unionByName(t)

    @staticmethod
    def grown(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[Level], np.ndarray, np.ndarray]]:
        """Some block rows at a time: the rows, their levels, their last nodes, and the row of each lowest node."""
        sizes = np.array([len(v) for v in batch.column("digests")], np.int64)
        group = np.cumsum(sizes) // TOGETHER
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            part = batch.slice(rows[0], len(rows))
            nodes = np.frombuffer(b"".join(part.column("digests").flatten().to_pylist()), np.uint8).reshape(-1, 32)
            levels = np.array([min(LEVELS, height(n)) for n in part.column("n").to_pylist()])
            yield part, *climbed(nodes, sizes[rows], levels), np.repeat(np.arange(len(rows)), sizes[rows])

    @staticmethod
    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, tops, _ in Tree.grown(batch):
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("block"), part.column("n"), pa.array([t.tobytes() for t in tops], pa.binary())], names=["key", "block", "n", "digest"])

    def parents(self) -> DataFrame:
        """(key, level, pos, digest, states): every node above the nodes, with the hash states it keeps before its child slots."""
        schema = "key string, level int, pos long, digest binary, states array<binary>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                low = batch.column("round")[0].as_py() * LEVELS if batch.num_rows else 0
                for part, levels, tops, row in Tree.grown(batch):
                    keys, block, nodes = part.column("key").to_pylist(), part.column("block").to_pylist(), [*[level.nodes for level in levels[1:]], tops]
                    for t, level in enumerate(levels):
                        row = row[level.first]
                        place = np.arange(len(row)) - np.searchsorted(row, row)
                        live = np.flatnonzero(level.children)
                        yield record_batch(
                            {
                                "key": [keys[r] for r in row[live]], "level": [low + t + 1] * len(live), "pos": [block[r] * WAYS ** (LEVELS - t - 1) + p for r, p in zip(row[live], place[live].tolist(), strict=True)],
                                "digest": [d.tobytes() for d in nodes[t][live]], "states": [[s.astype(">u4").tobytes() for s in level.states[i, : level.children[i]]] for i in live],
                            },
                            pa.schema([("key", pa.string()), ("level", pa.int32()), ("pos", pa.int64()), ("digest", pa.binary()), ("states", pa.list_(pa.binary()))]),
                        )

        found = [b.select("key", "block", "n", F.col("items.digest").alias("digests"), F.lit(i).alias("round")).mapInArrow(run, schema) for i, b in enumerate(self.rounds)]
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out

    def down(self, ends: DataFrame) -> DataFrame:
        """Blocks of the lowest nodes with what `ends` (key, round, path, subroot, root) says of their last node: the path goes on from there."""
        schema = "key string, block long, path binary, subroot binary, root binary"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, levels, _, row in Tree.grown(batch):
                    steps = [s.rows() for s in ways_up(levels, np.arange(len(row)))]
                    places = np.arange(len(row)) - np.searchsorted(row, row)
                    block, paths = part.column("block").to_pylist(), part.column("path").to_pylist()
                    own = np.stack(steps, 1) if steps else np.zeros((len(row), 0), Steps.RECORD)
                    take = pa.array(row)
                    yield record_batch(
                        {
                            "key": part.column("key").take(take), "block": [block[r] * BLOCK + p for r, p in zip(row, places.tolist(), strict=True)],
                            "path": [own[i][own[i]["children"] > 0].tobytes() + paths[r] for i, r in enumerate(row)], "subroot": part.column("subroot").take(take), "root": part.column("root").take(take),
                        },
                        pa.schema([("key", pa.string()), ("block", pa.int64()), ("path", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary())]),
                    )

        below = None
        for r in range(len(self.rounds) - 1, -1, -1):
            paths = ends.where(F.col("round") == r).select("key", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
            paths = paths if below is None else paths.unionByName(below)
            both = self.rounds[r].join(paths, ["key", "block"])
            if r:
                below = both.select("key", "block", "n", F.col("items.digest").alias("digests"), "path", "subroot", "root").mapInArrow(run, schema)
        return both


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_PROOFS = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])


def as_text(digests: np.ndarray) -> pa.Array:
    return pa.array(hex_bytes(digests).view("S64").ravel()).cast(pa.string())


def bytes_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaf by leaf of blocks with their paths: siblings up to the root, and the root folded from the altered leaf, else from the leaf."""
    for batch in batches:
        for part, levels, _, row in Tree.grown(batch):
            nodes = bytes_of(part.column("digests").flatten())
            values = np.frombuffer(b"".join(a or n.tobytes() for a, n in zip(part.column("altered").flatten().to_pylist(), nodes, strict=True)), np.uint8).reshape(-1, 32)
            steps = ways_up(levels, np.arange(len(row)))
            paths = [np.frombuffer(p, Steps.RECORD) for p in part.column("path").to_pylist()]
            longest = max(map(len, paths), default=0)
            padded = np.zeros((len(paths), longest), Steps.RECORD)
            for i, p in enumerate(paths):
                padded[i, : len(p)] = p
            steps += [Steps.of(padded[row, t]) for t in range(longest)]
            siblings = np.zeros((len(row), 2 * len(steps), 64), np.uint8)
            there = np.zeros(siblings.shape[:2], bool)
            for t, s in enumerate(steps):
                values = s.fold(values)
                for k in range(WAYS - 1):
                    there[:, 2 * t + k] = s.children > k + 1
                    siblings[:, 2 * t + k] = hex_bytes(np.ascontiguousarray(s.others[:, k]))
            take = pa.array(row)
            roots = bytes_of(part.column("root").take(take))
            yield record_batch(
                {
                    "doc_id": part.column("ids").flatten(), "leaf": as_text(nodes), "subroot": as_text(bytes_of(part.column("subroot").take(take))), "root": as_text(roots),
                    "proof_sha256": [hashlib.sha256(s[h].tobytes()).hexdigest() for s, h in zip(siblings, there, strict=True)], "folded_root": as_text(values), "verified": (values == roots).all(1),
                },
                _PROOFS,
            )


@dataclass
class Manifest:
    """Trees over the leaves of each source and over the sources' subroots; `subroots`: (key, round, subroot, path, root)."""

    sources: Tree
    top: Tree
    subroots: DataFrame

    def proofs(self) -> DataFrame:
        """One row a leaf, PROOFS."""
        blocks = self.sources.down(self.subroots)
        return blocks.select("n", F.col("items.doc_id").alias("ids"), F.col("items.digest").alias("digests"), F.col("items.altered").alias("altered"), "path", "subroot", "root").mapInArrow(proved, PROOFS)


def build(rows: DataFrame) -> Manifest | None:
    """Of leaves (key, doc_id, leaf, altered); None where there are none."""
    placed = numbered(rows, ["doc_id", "leaf"]).withColumnRenamed("leaf", "digest")
    sources = Tree(placed, ("doc_id", "altered"))
    if sources.tops is None:
        return None
    subroots = sources.tops.select(F.lit("").alias("key"), F.col("key").alias("source"), "round", "digest")
    top = Tree(numbered(subroots, ["source"]), ("source", "round"))
    root = top.tops.select("key", "round", F.lit(b"").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    schema = "key string, round int, path binary, subroot binary, root binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, levels, _, row in Tree.grown(batch):
                steps, paths, take = [s.rows() for s in ways_up(levels, np.arange(len(row)))], part.column("path").to_pylist(), pa.array(row)
                own = np.stack(steps, 1) if steps else np.zeros((len(row), 0), Steps.RECORD)
                yield record_batch(
                    {
                        "key": part.column("source").flatten(), "round": part.column("round").flatten(), "path": [own[i][own[i]["children"] > 0].tobytes() + paths[r] for i, r in enumerate(row)],
                        "subroot": part.column("digests").flatten(), "root": part.column("root").take(take),
                    },
                    pa.schema([("key", pa.string()), ("round", pa.int32()), ("path", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary())]),
                )

    ends = top.down(root).select("n", F.col("items.digest").alias("digests"), F.col("items.source").alias("source"), F.col("items.round").alias("round"), "path", "root").mapInArrow(run, schema)
    return Manifest(sources, top, cut(ends))


def prove(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """PROOFS of the rows of docs (doc_id, source, lang, n_chars, text), those with a text `changed` folded from that."""
    manifest = build(leaves(docs, changed))
    return manifest.proofs() if manifest else docs.sparkSession.createDataFrame([], PROOFS)


def _oracle(most: int = 16) -> str:
    """SQL that climbs `most` levels, and as many over the sources."""
    crc = "list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda d, z: xor(d >> 1, (d & 1) * 3988292384)))"
    value = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
    leaf = "sha256(" + " || ".join(value.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {})"
    changed = "CASE WHEN coalesce((" + crc + ") % 2 = 1, false) THEN replace(text, chr(10), '') ELSE text END"  # the last step, not -1, turns the lowest bit
    out = [
        f"WITH d AS MATERIALIZED (SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE ':' || source END AS key, {leaf.format(value.format('text'))} AS leaf, {leaf.format(value.format(f'({changed})'))} AS altered FROM documents)",
        "a0 AS MATERIALIZED (SELECT key, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n, leaf AS h, doc_id, altered FROM d)",
        "f0 AS MATERIALIZED (SELECT doc_id, h AS leaf, key, pos, altered AS v, '' AS p FROM a0)",
    ]

    def climb(a: str, f: str, rest: str) -> None:
        for i in range(most):
            side = "coalesce({}(h, 2) OVER w, '') || coalesce({}(h, 1) OVER w, '')"
            left = side.format("lag", "lag")
            right = "coalesce(lead(h, 1) OVER w, '') || coalesce(lead(h, 2) OVER w, '')"
            out.append(f"{a}s{i} AS MATERIALIZED (SELECT key, pos, n, {left} AS l, {right} AS r FROM {a}{i} WINDOW w AS (PARTITION BY key, pos // 3 ORDER BY pos))")
            out.append(f"{f}{i + 1} AS MATERIALIZED (SELECT {rest}, key, pos // 3 AS pos, CASE WHEN n = 1 THEN v ELSE sha256(l || v || r) END AS v, p || l || r AS p FROM {f}{i} JOIN {a}s{i} USING (key, pos))")
            out.append(f"{a}{i + 1} AS MATERIALIZED (SELECT key, pos // 3 AS pos, (max(n) + 2) // 3 AS n, CASE WHEN max(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {a}{i} GROUP BY key, pos // 3)")

    climb("a", "f", "doc_id, leaf")
    out.append(f"b0 AS MATERIALIZED (SELECT 'all' AS key, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n, h, key AS source FROM a{most})")
    out.append(f"g0 AS MATERIALIZED (SELECT doc_id, leaf, h AS subroot, b0.key AS key, b0.pos AS pos, v, p FROM f{most} JOIN b0 ON f{most}.key = source)")
    climb("b", "g", "doc_id, leaf, subroot")
    return ", ".join(out) + f" SELECT doc_id, leaf, subroot, h AS root, sha256(p) AS proof_sha256, v AS folded_root, v = h AS verified FROM g{most} JOIN b{most} USING (key)"


ORACLE = _oracle()
