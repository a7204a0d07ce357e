"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 3 of 64 bits meet at variants. Half of 3 is 1, and two balls of radius 1 meet up to
2 bits apart, so the odd bit is masked: the 64 bits are dealt into blocks, one of which has one of 3 differing bits at
least; each fingerprint emits, for each block left out, all variants of the rest within 1 bit. Distinct fingerprints
emit, variants are shuffled, and each run of equal variants is verified on whole fingerprints; of a run only links that
span its groups go on, nearest first, never all its pairs. Components of the links are found by star rounds.

`near_duplicate_texts` is for a similarity of word shingles: fingerprints of damped word counts under several hashes give
the candidates, and each candidate link is checked on the exact sets of shingles.

Edge cases: no words give fingerprint zero, which is linked like any other; a null text has no words; fewer words than a
shingle are one shingle; repeated shingles count each time; equal rows and ties share a fingerprint; null ids get no
component of others (none is smaller); very long texts are hashed whole; an empty table gives no rows; extra columns are
left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components, cut, tidy
from .common import map_slices, record_batch, texts, words

SEED = 42
RADIUS = 3
BLOCKS = 2
#: Eight one-byte counters from the eight bits of a byte.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_hashes(text: bytes, size: int) -> list[int]:
    found = words(text)
    if not found:
        return []
    whole, h = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= size:
        return [h(whole, SEED)]
    ends = list(accumulate(map(len, found), lambda a, n: a + n + 1))  # of each word, first to last
    starts = [0, *(e + 1 for e in ends)]
    return [h(whole[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)]


def fingerprints(batch: list[bytes], size: int) -> np.ndarray:
    """Of each text, as signed 64-bit numbers."""
    hashes = [shingle_hashes(t, size) for t in batch]
    n = np.array([len(x) for x in hashes], np.int64)
    out = np.zeros(len(batch), np.uint64)
    has = np.flatnonzero(n)
    if len(has):
        flat = np.array([x for h in hashes for x in h], np.uint64).view(np.uint8).reshape(-1, 8)
        sizes = n[has]
        parts = -(-sizes // 255)  # byte counters hold up to 255
        first = np.repeat(np.cumsum(sizes) - sizes, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        sums = np.empty((len(first), 64), np.int64)
        for b in range(8):
            sums[:, b * 8 : b * 8 + 8] = np.add.reduceat(_SPREAD[flat[:, b]], first)[:, None].view(np.uint8)
        counts = np.add.reduceat(sums, np.cumsum(parts) - parts, axis=0)
        bits = (counts * 2 > sizes[:, None]).astype(np.uint8)
        out[has] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out.view(np.int64)


def fingerprint(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long)."""
    return map_slices(texts(docs, id_col, text_col), lambda b: {"doc_id": b.column("doc_id"), "fp": fingerprints(b.column("text").to_pylist(), size)}, "doc_id long, fp long")


def variant_masks(blocks: int = BLOCKS, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each variant: the bits kept, the bit flipped (or none), and a mark of the block left out in its bits."""
    edges = np.linspace(0, bits, blocks + 1).round().astype(int)
    keep, flip, mark = [], [], []
    for b in range(blocks):
        dropped = sum(1 << i for i in range(edges[b], edges[b + 1]))
        kept = [i for i in range(bits) if not edges[b] <= i < edges[b + 1]]
        for f in [None, *kept]:
            keep.append(~dropped & (1 << 64) - 1)
            flip.append(0 if f is None else 1 << f)
            mark.append(b << int(edges[b]))  # the dropped bits are free for it
    return np.array(keep, np.uint64), np.array(flip, np.uint64), np.array(mark, np.uint64)


def meeting_key(x: np.ndarray, y: np.ndarray, blocks: int = BLOCKS, bits: int = 64) -> np.ndarray:
    """Of the variants that each pair of fingerprints within 3 bits shares, one: the least of the first block that serves."""
    edges = np.linspace(0, bits, blocks + 1).round().astype(int)
    out, open_ = np.zeros(len(x), np.uint64), np.ones(len(x), bool)
    one = np.uint64(1)
    for b in range(blocks):
        keep = np.uint64(~sum(1 << i for i in range(edges[b], edges[b + 1])) & (1 << 64) - 1)
        u, v = x & keep, y & keep
        d = u ^ v
        n = np.bitwise_count(d)
        low = d & (~d + one)  # one of two differing bits
        z = np.where(n == 2, np.minimum(u ^ low, v ^ low), np.minimum(u, v)) | np.uint64(b << int(edges[b]))
        here = open_ & (n <= 2)
        out[here], open_ = z[here], open_ & ~here
    return out


def spanning(fps: np.ndarray, radius: int, key: np.uint64, blocks: int = BLOCKS, bits: int = 64, rows: int = 256) -> list[tuple[int, int]]:
    """Links between distinct fingerprints of one run, at most one a fingerprint, that join what is within the radius.

    A pair counts in the run of its meeting key alone, so that no other run links it again.
    """
    root = np.arange(len(fps))
    out = []
    for s in range(0, len(fps), rows):
        apart = np.bitwise_count(fps[s : s + rows, None] ^ fps[None, :])
        i, j = np.nonzero(apart <= radius)
        i, j = i[i + s < j], j[i + s < j]
        mine = meeting_key(fps[i + s], fps[j], blocks, bits) == key
        i, j = i[mine], j[mine]
        near = np.argsort(apart[i, j], kind="stable")
        i += s
        for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True):
            x, y = a, b
            while root[x] != x:
                x = root[x] = root[root[x]]
            while root[y] != y:
                y = root[y] = root[root[y]]
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(fps[a].astype(np.int64)), int(fps[b].astype(np.int64))))
    return out


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, bits: int = 64) -> DataFrame:
    """(a, b): enough pairs of the distinct fingerprints in column fp within the radius to join their components."""
    if radius > 3:
        raise ValueError("the variants reach 3 differing bits")
    keep, flip, mark = variant_masks(blocks, bits)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for s in range(0, len(all_), 2048):
                f = all_[s : s + 2048]
                key = ((f[:, None] & keep) ^ flip) | mark
                yield record_batch({"key": key.ravel().view(np.int64), "fp": np.repeat(f, len(keep)).view(np.int64)}, pa.schema([("key", pa.int64()), ("fp", pa.int64())]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            if len(first) > 1:  # the last run may go on in the next batch
                yield from runs(key, fp, first)
                key, fp = key[first[-1] :], fp[first[-1] :]
        if len(key):
            yield from runs(key, fp, np.array([0, len(fp)]))

    def runs(key: np.ndarray, fp: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = np.diff(first)
        two = first[:-1][n == 2]
        near = (np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius) & (meeting_key(fp[two], fp[two + 1], blocks, bits).view(np.int64) == key[two])
        a, b = [fp[two][near].view(np.int64)], [fp[two + 1][near].view(np.int64)]
        for s, k in zip(first[:-1][n > 2].tolist(), n[n > 2].tolist(), strict=True):
            if found := spanning(fp[s : s + k], radius, key[s : s + 1].view(np.uint64)[0], blocks, bits):
                x, y = zip(*found, strict=True)
                a.append(np.array(x, np.int64)), b.append(np.array(y, np.int64))
        a_, b_ = np.concatenate(a), np.concatenate(b)
        if len(a_):
            pair = np.unique(np.stack([np.minimum(a_, b_), np.maximum(a_, b_)], axis=1), axis=0)
            yield record_batch({"a": pair[:, 0], "b": pair[:, 1]}, LINKS)

    variants = fps.select("fp").distinct().mapInArrow(emit, "key long, fp long")
    return variants.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id reachable by links."""
    found = cut(fingerprint(docs, size, id_col, text_col))
    first = cut(found.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    pairs = links(first, radius)
    ends = pairs.join(first.select(F.col("fp").alias("a"), F.col("rep").alias("src")), "a").join(first.select(F.col("fp").alias("b"), F.col("rep").alias("dst")), "b")
    component = connected_components(ends.select("src", "dst"))
    of = first.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return found.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SIMILAR = 0.8
SHINGLE = 5
HASHES = 3
#: Of a fingerprint of words: fewer than 64, since 3 of them are then more, and pairs at the least similarity differ in about one of 15.
BITS = 56
_MIX = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another hash of each hash."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        h = (h ^ _MIX[k]) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_fingerprints(text: bytes, hashes: int = HASHES) -> list[int]:
    """Of the distinct words, each with weight 1 + log of its count, under several hashes."""
    counts: dict[bytes, int] = {}
    for w in words(text):
        counts[w] = counts.get(w, 0) + 1
    if not counts:
        return [0] * hashes
    h = np.array([xxhash.xxh64_intdigest(w, SEED) for w in counts], np.uint64)
    weight = 1 + np.log(np.fromiter(counts.values(), np.float32))
    half = weight.sum() / 2
    out = []
    for k in range(hashes):
        bits = np.unpackbits(_mixed(h, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :BITS]
        out.append(int(np.packbits(np.r_[weight @ bits > half, np.zeros(64 - BITS, bool)], bitorder="little").view(np.int64)[0]))
    return out


def shingle_set(text: bytes, size: int = SHINGLE) -> set[int]:
    return set(shingle_hashes(text, size))


#: Documents of a cloud that are compared together, on average at most, with as many others; and bytes of their shingle sets.
TOGETHER, TOGETHER_BYTES = 1024, 16 << 20


def alike(sets_a: list[np.ndarray], sets_b: list[np.ndarray], columns: int = 1 << 14) -> np.ndarray:
    """Jaccard similarity of each of the first sets with each of the second; two empty sets are equal."""
    n_a, n_b = (np.array([len(x) for x in s], np.int64) for s in (sets_a, sets_b))
    both = np.zeros((len(sets_a), len(sets_b)), np.float32)
    a, b = (np.concatenate([*s, np.zeros(0, np.uint64)]) for s in (sets_a, sets_b))
    shared = np.intersect1d(a, b)
    at_a, at_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
    (a, at_a), (b, at_b) = ((x[keep], at[keep]) for x, at, keep in ((x, at, np.isin(x, shared)) for x, at in ((a, at_a), (b, at_b))))
    a, b = np.searchsorted(shared, a), np.searchsorted(shared, b)
    for s in range(0, len(shared), columns):  # few columns at a time
        one = []
        for x, at, n in ((a, at_a, len(n_a)), (b, at_b, len(n_b))):
            here = (x >= s) & (x < s + columns)
            m = np.zeros((n, min(columns, len(shared) - s)), np.float32)
            m[at[here], x[here] - s] = 1
            one.append(m)
        both += one[0] @ one[1].T
    every = n_a[:, None] + n_b[None, :] - both
    return np.where(every > 0, both / np.maximum(every, 1), 1.0)


LINK = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("similarity", pa.float64())])


def linked(similar: float):
    """Of two blocks of documents (doc_id, c, set): enough pairs of at least `similar` to join what they join of the groups c."""

    def link(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return LINK.empty_table()
        sets = [[np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()] for t in (a, b)]
        found = alike(*sets)
        ids, groups = ([t.column(n).to_pylist() for t in (a, b)] for n in ("doc_id", "c"))
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.get(x, x)) != x:
                x = up
            return x

        out: list[tuple] = []
        i, j = np.nonzero(found >= similar)
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            u, v = top(groups[0][x]), top(groups[1][y])
            if u != v:
                root[max(u, v)] = min(u, v)
                out.append((ids[0][x], ids[1][y], float(found[x, y])))
        return pa.table(dict(zip(LINK.names, zip(*out, strict=True), strict=True)), LINK) if out else LINK.empty_table()

    return link


def within_clouds(members: DataFrame, similar: float, together: int = TOGETHER) -> DataFrame:
    """(src, dst, similarity) that join what is similar in each cloud, from (cloud, doc_id, c: group so far, set).

    The documents of a cloud's largest group are not compared with each other, as they are joined; all others are, with
    each other and with those. Blocks of about `together` documents or TOGETHER_BYTES meet in pairs, so that a task holds two
    blocks; a set is shipped once for each block that its own meets, so a cloud of one block's size ships it once a side.
    """
    groups = members.groupBy("cloud", "c").agg(F.count("*").alias("n"), F.sum(F.length("set")).alias("bytes"))
    main = groups.groupBy("cloud").agg(F.max(F.struct("n", "c", "bytes")).alias("m"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("k")).where("k > 1")
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / together), F.ceil(size / TOGETHER_BYTES)).cast("int")
    sizes = main.select("cloud", F.col("m.c").alias("main"), blocks(F.col("n") - F.col("m.n"), F.col("bytes") - F.col("m.bytes")).alias("rest"), blocks(F.col("m.n"), F.col("m.bytes")).alias("most"))
    spread, is_main = F.xxhash64("doc_id"), F.col("c") == F.col("main")
    own = members.join(sizes, "cloud").withColumn("block", F.when(is_main, F.col("rest") + F.pmod(spread, "most")).otherwise(F.pmod(spread, "rest")).cast("int"))
    own = cut(own.withColumn("is_main", is_main))
    left = own.where("not is_main").select("cloud", "doc_id", "c", "set", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("rest") + F.col("most") - 1)).alias("j"))
    right = own.select(*(F.col(x).alias(x) for x in ("cloud", "doc_id", "c", "set")), F.explode(F.sequence(F.lit(0), F.least("block", F.col("rest") - 1))).alias("i"), F.col("block").alias("j"))
    key = ["cloud", "i", "j"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(linked(similar), "src long, dst long, similarity double")


#: Rounds in which the members of a cloud are judged against one of them.
STARS = 2


def hub(members: DataFrame, bits: int = BITS) -> DataFrame:
    """(cloud, hub) of (cloud, doc_id, fp): the member whose fingerprint is nearest to the majority of each bit; combined before the shuffle."""
    bit = lambda i: F.shiftright("fp", i).bitwiseAND(F.lit(1))
    most = members.groupBy("cloud").agg(*(F.avg(bit(i)).alias(f"b{i}") for i in range(bits)))
    centre = F.lit(0).cast("long")
    for i in range(bits):
        centre = centre + F.when(F.col(f"b{i}") > 0.5, F.lit(1 << i)).otherwise(F.lit(0))
    most = most.select("cloud", centre.alias("centre"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("centre")))
    return members.join(most, "cloud").groupBy("cloud").agg(F.min(F.struct(apart.alias("apart"), "doc_id")).alias("h")).select("cloud", F.col("h.doc_id").alias("hub"))


def near_duplicate_texts(docs: DataFrame, similar: float = SIMILAR, size: int = SHINGLE, hashes: int = HASHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_md5, component_id, first): components of equal texts and of links with at least `similar` common word shingles.

    A row for each of docs. component_id is the smallest doc_id of the component (null if it has none), and the rows of
    the smallest doc_id and text are first; texts without words are equal. Distinct texts are told apart by a number, so
    ids may be null or have several texts. Each link is exact. What links of fingerprints within 3 bits join is a cloud,
    mostly the copies of one text; its hub is the member next to the majority of its fingerprints, and every member is
    judged against it; those apart from it have a hub of their own, STARS times. Then what is still apart in a cloud is
    compared on whole shingle sets, block by block, and only the links that join groups are rows. So only pairs that
    verified links join are never judged, and a cloud's pairs are never emitted.
    """
    source = texts(docs, id_col, text_col)

    def marks(batch: pa.RecordBatch) -> dict:
        own = batch.column("text").to_pylist()
        return {"doc_id": batch.column("doc_id"), "h": [hashlib.md5(t).hexdigest() for t in own], "fps": [word_fingerprints(t, hashes) for t in own]}

    keyed = cut(map_slices(source, marks, "doc_id long, h string, fps array<long>"))
    first = cut(keyed.groupBy("h").agg(F.first("fps").alias("fps")).withColumn("rep", F.monotonically_increasing_id()))
    fps = first.select(F.col("rep").alias("doc_id"), F.posexplode("fps").alias("k", "fp"))
    # the number of the hash stands above a fingerprint's bits, which no variant touches there: so all are linked in one pass
    marked = fps.select("doc_id", F.col("fp").bitwiseOR(F.shiftleft(F.col("k").cast("long"), BITS)).alias("fp"))
    lead = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    near = links(lead, bits=BITS)
    near = near.join(lead.select(F.col("fp").alias("a"), F.col("rep").alias("src")), "a").join(lead.select(F.col("fp").alias("b"), F.col("rep").alias("dst")), "b").select("src", "dst")
    candidates = marked.join(lead, "fp").where("doc_id <> rep").select(F.col("rep").alias("src"), F.col("doc_id").alias("dst")).unionByName(near).where("src <> dst")
    candidates = cut(candidates.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    tidy(docs.sparkSession)  # of the variants
    ends = candidates.select(F.explode(F.array("src", "dst")).alias("doc_id")).distinct()
    # the only shuffle of all texts; those of candidates are kept packed
    wanted = first.select("h", F.col("rep").alias("doc_id")).join(ends, "doc_id")
    chosen = source.select(F.md5("text").alias("h"), "text").join(wanted, "h").dropDuplicates(["h"]).select("doc_id", "text")
    bodies = cut(map_slices(chosen, lambda b: {"doc_id": b.column("doc_id"), "body": [zlib.compress(t, 1) for t in b.column("text").to_pylist()]}, "doc_id long, body binary"))
    tidy(docs.sparkSession)

    def judge(batch: pa.RecordBatch) -> dict:
        out, known = [], {}
        for i, x, y in zip(batch.column("src").to_pylist(), batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            if i not in known:
                known = {i: shingle_set(zlib.decompress(x), size)}
            a, b = known[i], shingle_set(zlib.decompress(y), size)
            both = len(a & b)
            out.append(1.0 if not a and not b else both / (len(a) + len(b) - both))
        return {"src": batch.column("src"), "dst": batch.column("dst"), "similarity": out}

    def checked(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(bodies.select(F.col("doc_id").alias("src"), F.col("body").alias("x")), "src").join(bodies.select(F.col("doc_id").alias("dst"), F.col("body").alias("y")), "dst")
        return cut(map_slices(sides, judge, "src long, dst long, similarity double", column="x"))

    joined = F.col("similarity") >= similar
    cloud = cut(connected_components(candidates).select(F.col("node").alias("doc_id"), F.col("component").alias("cloud")))
    # c: the hub that a member has joined, or itself; open: neither joined nor a hub yet
    members = cloud.join(fps.where("k = 0").select("doc_id", "fp"), "doc_id").withColumns({"c": F.col("doc_id"), "open": F.lit(True)})
    judged = None
    for _ in range(STARS):
        members = cut(members)
        tidy(docs.sparkSession)
        hubs = cut(hub(members.where("open")))
        stars = members.where("open").join(hubs, "cloud").where("doc_id <> hub").select(F.col("hub").alias("src"), F.col("doc_id").alias("dst"))
        now = checked(stars).where(joined)
        judged = now if judged is None else judged.unionByName(now)
        settled = now.select(F.col("dst").alias("doc_id"), F.col("src").alias("hub")).unionByName(hubs.select(F.col("hub").alias("doc_id"), "hub"))
        members = members.join(settled, "doc_id", "left").withColumns({"c": F.coalesce("hub", "c"), "open": F.col("open") & F.col("hub").isNull()}).drop("hub")
    apart = members.select("cloud", "doc_id", "c")
    several = apart.groupBy("cloud").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("cloud")
    apart = cut(apart.join(several, "cloud", "left_semi"))
    tidy(docs.sparkSession)

    def shingled(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "set": [np.unique(np.array(shingle_hashes(t, size), np.uint64)).tobytes() for t in map(zlib.decompress, batch.column("body").to_pylist())]}

    sets = map_slices(bodies.join(apart.select("doc_id"), "doc_id", "left_semi"), shingled, "doc_id long, set binary", column="body")
    more = within_clouds(apart.join(sets, "doc_id"), similar)
    component = connected_components(judged.unionByName(more).select("src", "dst"))
    of_text = first.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("h", F.coalesce("component", "rep").alias("c"))
    rows = keyed.join(of_text, "h")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    least = rows.groupBy("c").agg(F.min(own).alias("least"))
    return rows.join(least, "c").select("doc_id", F.col("h").alias("text_md5"), F.col("least.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("h") == F.col("least.h"))).alias("first"))
