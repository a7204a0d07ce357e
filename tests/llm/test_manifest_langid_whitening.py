"""Merkle manifests, language identification and whitening: brute force, held-out accuracy, edge cases."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeglean.llm import langid, merkle, queries, whiten


# 11
def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def proof(nodes, at):
    """The root over nodes and, per level, (left siblings, right siblings) of the node."""
    path = []
    while len(nodes) > 1:
        run = at // 3 * 3
        path.append((nodes[run:at], nodes[at + 1 : run + 3]))
        nodes, at = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], at // 3
    return nodes[0], path


def expected(rows):
    """rows: (doc_id, source, lang, n_chars, text). Sorted PROOFS with newlines taken out of even checksums' texts."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r, H(*map(field, r))))
    subroots = {}
    for s, own in by.items():
        own.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        subroots[s] = proof([x[1] for x in own], 0)[0]
    order = sorted(subroots, key=lambda s: (s is not None, (s or "").encode()))
    out = []
    for s in order:
        leaves = [x[1] for x in by[s]]
        root, above = proof([subroots[x] for x in order], order.index(s))
        for at, (r, leaf) in enumerate(by[s]):
            path = proof(leaves, at)[1] + above
            v = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                v = H(*map(field, (*r[:4], r[4].replace("\n", ""))))
            for left, right in path:
                v = H(*left, v, *right)
            out.append((r[0], leaf, subroots[s], root, H(*[x for p in path for side in p for x in side]), v, v == root))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, key string, pos long"


def manifest(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], DOCS)
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", ""))
    return sorted((tuple(r) for r in merkle.prove(docs, changed).collect()), key=str)


def test_manifest_edges(spark):
    long = "zeile\n" * 50_000
    rows = [(1, None, None, None, None), (2, "", "en", 0, ""), (2, "", "en", 0, ""), (3, "é", "fr", 3, "a\nb"), (None, "b", None, 1, "\n"), (4, "b", "en", 5, long), (5, "b", "x:1", -3, "5:\n"), (6, "ab", "de", 1, "q"), (6, "ab", "de", 1, "p")]
    assert manifest(spark, rows) == expected(rows)
    assert manifest(spark, rows[:1]) == expected(rows[:1])
    assert manifest(spark, []) == []


def test_manifest_of_a_hot_source_in_several_blocks(spark):
    rows = [(i, "hot" if i % 7 else f"s{i % 10}", "en", i, f"t{i}\n") for i in range(8000)]
    assert manifest(spark, rows) == expected(rows)


@pytest.mark.parametrize("n", range(1, 31))
def test_trees_of_all_shapes(n):
    rng = np.random.default_rng(n)
    nodes = rng.integers(0, 256, (n, 32), np.uint8)
    levels, top = merkle.climbed(nodes, np.array([n]), np.array([merkle.height(n)]))
    texts = [x.tobytes().hex() for x in nodes]
    assert top[0].tobytes().hex() == proof(texts, 0)[0]
    other = rng.integers(0, 256, (n, 32), np.uint8)
    v = other
    for s in merkle.ways_up(levels, np.arange(n)):
        v = merkle.Steps.of(s.rows()).fold(v)
    for i in range(n):
        assert v[i].tobytes().hex() == proof([*texts[:i], other[i].tobytes().hex(), *texts[i + 1 :]], 0)[0]


def test_parents_keep_the_state_before_each_child(spark):
    docs = spark.createDataFrame([(i, "s", "en", i, f"t{i}") for i in range(11)], "doc_id long, source string, lang string, n_chars long, text string")
    leaves = [H(*map(field, (i, "s", "en", i, f"t{i}"))) for i in range(11)]
    built = merkle.build(merkle.leaves(docs))
    parents = {(r.level, r.pos): r for r in built.sources.parents().collect()}
    assert {k for k in parents} == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (3, 0)}
    assert [len(parents[1, p].states) for p in range(4)] == [3, 3, 3, 2] and len(parents[2, 1].states) == 1
    for p in range(4):
        own = leaves[3 * p : 3 * p + 3]
        assert bytes(parents[1, p].digest).hex() == H(*own)
        for k, raw in enumerate(parents[1, p].states):  # resumed with the same child and those right of it
            s = np.frombuffer(raw, ">u4").astype(np.uint32)[None]
            for c in own[k:]:
                s = merkle.absorbed(s, merkle.child_block(np.frombuffer(bytes.fromhex(c), np.uint8)[None]))
            assert merkle.finished(s, np.array([len(own)]))[0].tobytes().hex() == H(*own)


# 12
def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op12_kneser_ney_langid(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert len(got) == len(docs)
    both = got.merge(docs, on="doc_id")
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id]).all()
    assert both.score.between(0, 1).all()
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98
    assert held.accepted.mean() > 0.9


def brute(texts, order):
    """Interpolated Kneser-Ney by dictionaries: p(history, character) with the discounts of the operator."""
    level = Counter()
    for t in texts:
        c = tuple(langid.padded(langid.characters(t.encode())[0]).tolist())
        level.update(c[i - order + 1 : i + 1] for i in range(order, len(c)))
    levels = [level]
    for _ in range(order - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))

    def p(g):
        if not g:
            return 1 / (len(levels[-1]) + 1)
        counts = levels[order - len(g)]
        n = np.array(list(counts.values()))
        d = langid.discount(n)
        total = sum(v for k, v in counts.items() if k[:-1] == g[:-1])
        if not total:
            return p(g[1:])
        kinds = sum(k[:-1] == g[:-1] for k in counts)
        return (max(counts[g] - d, 0) + d * kinds * p(g[1:])) / total

    return p


def test_kneser_ney_against_dictionaries(spark):
    own = {"aa": ["die katze sitzt auf der matte", "der hund und die katze"], "bb": ["the cat sat on the mat", "a dog and the cat"]}
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate((x, t) for x, ts in own.items() for t in ts)], "doc_id long, text string, lang string")
    rows = docs.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(langid.counted, "lang string, gram long, chain array<long>, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.first("chain").alias("chain")).toPandas()
    langs = sorted(own)
    m = langid.estimate(langs, np.array([langs.index(x) for x in rows["lang"]]), rows["gram"].to_numpy().view(np.uint64), np.array(rows["chain"].tolist(), np.int64).view(np.uint64), rows["n"].to_numpy())
    text = b"the katze und xylophone sat"
    entropy, n, letters = m.entropies([text, b"", b"123"])
    c = tuple(langid.padded(langid.characters(text)[0]).tolist())
    assert n.tolist() == [len(c) - langid.ORDER, 0, 0] and letters.tolist() == [True, False, False]
    # an unseen character has the share of the union of characters
    union = len({x for ts in own.values() for t in ts for x in langid.characters(t.encode())[0].tolist()})
    for i, x in enumerate(langs):
        p = brute(own[x], langid.ORDER)
        alone = len({y for t in own[x] for y in langid.characters(t.encode())[0].tolist()})
        if alone == union:
            want = -sum(math.log(p(c[j - langid.ORDER + 1 : j + 1])) for j in range(langid.ORDER, len(c))) / n[0]
            assert math.isclose(entropy[0, i], want, rel_tol=1e-4)
    points = sorted({y for ts in own.values() for t in ts for y in langid.characters(t.encode())[0].tolist()})
    history = langid.padded(langid.characters(b"the ca")[0])[:-1]
    for i in range(2):  # a distribution over all characters and one for the rest
        total = sum(math.exp(m.log_probabilities(np.append(history, np.uint32(y)), np.array([len(history)]))[0, i]) for y in [*points, 0x4E00])
        assert abs(total - 1) < 1e-4


def test_language_windows_and_copies(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    m = langid.train(docs)
    batch = [t.encode() for t in docs.toPandas().text.head(20)]
    whole = m.entropies(batch)
    monkeypatch.setattr(langid, "WINDOW", 97)
    assert np.allclose(whole[0], m.entropies(batch)[0], rtol=1e-6) and (whole[1] == m.entropies(batch)[1]).all()
    again = langid.train(docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10_000)))
    assert np.allclose(again.entropies(batch)[0], whole[0], rtol=1e-6)  # copies are learnt once


def test_language_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", "c"), (2, "", "en", "c"), (3, "12 !? \n", "de", "c"), (4, "the cat and the dog " * 40_000, "en", "c"), (5, "der hund und die katze", "de", "c"), (5, "der hund und die katze", "de", "c"), (None, "the cat", "en", "c"), (6, "の本", None, "c")],
        "doc_id long, text string, lang string, score string",
    )
    m = langid.train(docs)
    assert m.langs == ["de", "en"]
    got = sorted(langid.predict(docs, m).select("doc_id", "lang_pred", "score").collect(), key=lambda r: (r.doc_id or 0, r.lang_pred))
    assert len(got) == 8 and [r.lang_pred for r in got if r.doc_id in (1, 2, 3)] == ["und"] * 3
    assert all(r.score == 0 for r in got if r.lang_pred == "und") and {r.lang_pred for r in got if r.doc_id == 5} == {"de"}
    assert next(r for r in got if r.doc_id == 6).lang_pred in m.langs
    none = langid.train(docs.where("false"))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.where("false"), m).count() == 0
    one = langid.train(docs.where("lang = 'en'"))
    assert {(r.lang_pred, r.score) for r in langid.predict(docs.where("doc_id = 5"), one).collect()} == {("en", 1.0)}


def test_foreign_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = langid.train(docs.where("lang in ('en', 'de')"))
    got = langid.predict(docs, m, reject=True).join(docs.select("doc_id", "lang", F.length("text").alias("size")), "doc_id").where("size > 400").toPandas()
    assert (got[got.lang.isin(["es", "fr"])].lang_pred == "und").mean() > 0.95
    assert (got[got.lang.isin(["en", "de"])].lang_pred == "und").mean() < 0.1


# 13
def test_whitening_against_numpy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = whiten.whiten(rows, whiten.train(rows)).toPandas()
    own = {r.vec_id: r.embedding for r in rows.collect() if r.embedding is not None and np.isfinite(np.array(r.embedding, float)).all()}
    x = {i: np.floor(64 * np.array(v, np.float64)).astype(np.int64) + 1_000_000 for i, v in own.items()}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(0)
    values, vectors = np.linalg.eigh(np.cov((fit - s // n).astype(float).T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 16 * len(x) and set(got.n) == {n}
    for k, part in got.groupby("component"):
        part = part.set_index("vec_id").whitened
        want = {i: (v - s / n) @ vectors[:, k - 1] / math.sqrt(values[k - 1]) for i, v in x.items()}
        sign = np.sign(sum(part[i] * w for i, w in want.items()))
        assert max(abs(part[i] * sign - w) for i, w in want.items()) < 1e-8
    assert {(r.vec_id, r.deviation) for r in got.itertuples()} == {(i, sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True))) for i, v in x.items()}
    explained = got.drop_duplicates("component").sort_values("component").explained
    assert np.allclose(explained, values[:16] / values.sum(), rtol=1e-10)
    assert set(got.identity_error) == {got.identity_error[0]} and got.identity_error[0] < 1e-10


@pytest.mark.parametrize("values", [[3, 3, 3, 1, 0.5, 0], [3 + 1e-9, 3, 3 - 1e-9, 2, 2 + 1e-13, 1], [1, 1e-3, 1e-6, 1e-8, 1e-8 + 1e-15, 0], [5] * 6])
def test_refinement_of_clustered_eigenvalues(values):
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(6, 6)))[0].astype(np.longdouble)
    a = whiten.symmetric((q * np.array(values, np.longdouble)) @ q.T)
    e, x = whiten.refined(a)
    assert (np.diff(e) <= 0).all()
    assert np.abs(a @ x - x * e).max() < 1e-17 * max(values) and np.abs(x.T @ x - np.eye(6)).max() < 1e-17


def test_exact_sums_of_large_entries(spark):
    rows = spark.createDataFrame([(i, [float(1 << (45 + i % 3)) * (-1) ** i, i / 64.0]) for i in range(9)], "vec_id long, embedding array<double>")
    m = whiten.train(rows)
    y = [[min(max(64 * (1 << (45 + i % 3)) * (-1) ** i, -(1 << 53)), 1 << 53), i] for i in range(9)]
    assert m.sums == [sum(v[0] for v in y), sum(v[1] for v in y)]
    got = {r.vec_id: r.deviation for r in whiten.whiten(rows, m).collect()}
    want = {i: sum((9 * a - b) ** 2 for a, b in zip(v, m.sums, strict=True)) for i, v in enumerate(y)}
    assert got == {i: v if v < 1 << 63 else None for i, v in want.items()}


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>, component string"
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, "c"), (2, [1.0, None, 2.0], "c"), (3, [1.0, nan, 2.0], "c"), (4, [inf, 1.0, 2.0], "c"), (5, [1.0, 2.0, 3.0], "c"), (5, [1.0, 2.0, 3.0], "c"), (None, [0.5, 0.25, -1.0], "c"), (7, [], "c"), (8, [1.0], "c")]
    df = spark.createDataFrame(rows, schema)
    got = whiten.whiten(df, whiten.train(df)).collect()
    assert Counter(r.vec_id for r in got) == {5: 6, None: 3}
    assert {r.n for r in got} == {2}
    assert all((r.whitened is None) == (r.component > 1) and (r.explained == (r.component == 1)) for r in got)
    assert max(r.identity_error for r in got) < 1e-12
    alone = whiten.whiten(df.where("vec_id = 5"), whiten.train(df.where("vec_id = 5"))).collect()
    assert len(alone) == 6 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 for r in alone)
    none = df.where("vec_id < 5")
    assert whiten.whiten(none, whiten.train(none)).collect() == []
