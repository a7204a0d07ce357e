"""Query rows against postings: brute force on random texts, fields, filters, kept pairs, blocks, and the whole retrieval path."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeglean.functions.text import strip_question_words, tokens
from lakeglean.operators import postings as P
from lakeglean.operators import search as S
from lakeglean.plans import retrieval as R
from lakeglean.plans.registry import register_sql

ROWS = "query_id string, kind string, text string, weight double"


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(3)
    words = [f"w{int(r.paretovariate(0.7)) % 40}" for _ in range(400)]
    docs = [(i, " ".join(r.choices(words, k=r.randint(0, 30))), " ".join(r.choices(words, k=3))) for i in range(300)]
    docs += [(300, None, None), (301, "", "w1"), (None, "w1 w2", "w1"), (302, docs[0][1], docs[0][2])]
    rows = []
    for q in range(12):
        own = r.sample(words, 6)
        rows += [(f"q{q}", "term", w, r.random()) for w in own] + [(f"q{q}", "syn", f"w{r.randint(0, 45)}", 0.1)]
        rows += [(f"q{q}", "phrase", f"{a} {b}", r.random()) for a, b in zip(own, own[1:])] + [(f"q{q}", "near", " ".join(r.sample(words, 3)), 1.5)]
    return docs, rows, spark.createDataFrame(docs, "chunk_id long, text string, title string"), spark.createDataFrame(rows, ROWS)


def follows(words, terms, between):
    at = {i for i, w in enumerate(words) if w == terms[0]}
    for t in terms[1:]:
        at = {i for i, w in enumerate(words) if w == t and any(i - 1 - between <= j < i for j in at)}
    return bool(at)


def brute(docs, rows, fields, how="presence", boosts=None, mode="max", share=0.0, least=1, searched=lambda d: True):
    """{(query, chunk): (score, hits)}."""
    texts = {f: {d[0]: (d[1 + i] or "").split() for d in docs if d[0] is not None} for i, f in enumerate(fields)}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = {}
    for f in fields:
        own, boost = texts[f], (boosts or {}).get(f, 1.0)
        n = sum(bool(w) for w in own.values())
        average = sum(map(len, own.values())) / max(n, 1)
        df = Counter(t for w in own.values() for t in set(w))
        idf = lambda t: (math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) / (math.log(1 + (n - 0.5) / 1.5) if how == "presence" else 1)) * boost if df[t] else 0.0
        for q, clauses in by.items():
            need = max(math.floor(len({r[2] for r in clauses if r[1] == "term"}) * share), least)
            for d, w in own.items():
                if not searched(d):
                    continue
                score, hits, any_hit = 0.0, 0, False
                for _, kind, text, weight in clauses:
                    if kind in ("term", "syn"):
                        tf = w.count(text)
                        if tf:
                            any_hit = True
                            hits += kind == "term"
                            score += weight * idf(text) * (1 if how == "presence" else tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / average)))
                    elif follows(w, text.split(), 2 if kind == "near" else 0):
                        score += weight * sum(idf(t) for t in text.split())
                old = out.get((q, d), (0.0, 0, need, False))
                out[q, d] = (max(old[0], score) if mode == "max" else old[0] + score, max(old[1], hits), need, old[3] or any_hit)
    return {k: (score, hits) for k, (score, hits, need, single) in out.items() if single and hits >= need}  # a sequence alone is no hit


def best(found, k):
    by = defaultdict(list)
    for (q, d), (s, h) in found.items():
        by[q].append((-math.floor(s * 1e6 + 0.5), d, h))
    return {q: sorted(v)[:k] for q, v in by.items()}


def rows_of(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.query_id].append((-math.floor(r.score * 1e6 + 0.5), r.chunk_id, r.hits))
    return {q: sorted(v) for q, v in out.items()}


FIELDS = {"text": "text", "title": "title"}


@pytest.mark.parametrize("how", ["presence", "bm25"])
@pytest.mark.parametrize("k", [1, 7, None])
@pytest.mark.parametrize(("least", "share"), [(0, 0.0), (1, 0.0), (1, 0.5)])
def test_rows_against_brute_force(corpus, how, k, least, share):
    docs, rows, d, q = corpus
    got = S.search(q, d, {"text": F.col("text")}, k, how, least=least, share=share)
    assert rows_of(got) == best(brute(docs, rows, ["text"], how, least=least, share=share), k)


@pytest.mark.parametrize("mode", ["max", "sum"])
def test_fields_blocks_and_small_pieces(corpus, monkeypatch, mode):
    docs, rows, d, q = corpus
    monkeypatch.setattr(S, "BLOCK_CLAUSES", 40)  # several blocks of queries
    boosts = {"text": 2.0, "title": 10.0}
    got = S.search(q, d.coalesce(1), {f: F.col(f) for f in FIELDS}, 5, boosts=boosts, mode=mode)
    assert rows_of(got) == best(brute(docs, rows, list(FIELDS), boosts=boosts, mode=mode), 5)


def test_bounds_skip_and_stay_exact(corpus, monkeypatch):
    """Many blocks of documents in one task, by the functions themselves: the floor rises, results stay."""
    docs, rows, d, q = corpus
    table = d.where("chunk_id is not null").select("chunk_id", tokens(F.col("text")).alias("_0")).toArrow()
    batches = table.combine_chunks().to_batches(max_chunksize=7)
    schema = pa.schema([("query_id", pa.string()), ("chunk_id", pa.int64()), ("score", pa.float64()), ("hits", pa.int64()), ("kept", pa.bool_())])
    whole, looked_at = S.Postings.gather, Counter()
    for k in (3, None):
        block = S.planned(q.collect(), ["text"], {}, "presence", "max", k, 0.0, 1, 6, {})
        asked = pa.array(block.terms)
        counts = np.zeros((1, len(asked) + 2))
        for b in S.counted(block, asked, iter(batches)):
            for f, t, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                counts[f, t if t >= 0 else len(asked) - 1 - t] += n
        block.weigh(counts[:, -2], counts[:, -1], counts[:, :-2])

        def gather(self, terms, k=k):
            at, which = whole(self, terms)
            looked_at[k] += len(at)
            return at, which

        monkeypatch.setattr(S.Postings, "gather", gather)
        found = defaultdict(list)
        for b in S.best_of_block(block, asked, schema, iter(batches)):
            for r in b.to_pylist():
                found[r["query_id"]].append((-math.floor(r["score"] * 1e6 + 0.5), r["chunk_id"], r["hits"]))
        assert {x: sorted(v) for x, v in found.items()} == best(brute(docs, rows, ["text"]), k)
    assert looked_at[3] < 0.8 * looked_at[None]  # bounds left postings out


def test_filtered_search_counts_the_whole_corpus_and_keeps_pairs(spark, corpus):
    docs, rows, d, q = corpus
    even = lambda i: i % 2 == 0
    want = brute(docs, rows, ["text"], searched=even)
    keep = spark.createDataFrame([("q0", i) for i in range(20)] + [("nobody", 1)], "query_id string, chunk_id long")
    got = S.search(q, d.where("chunk_id % 2 = 0"), {"text": F.col("text")}, 2, corpus=d, keep=keep)
    expected = best(want, 2)
    expected["q0"] = sorted(set(expected["q0"]) | {(-math.floor(s * 1e6 + 0.5), c, h) for (x, c), (s, h) in want.items() if x == "q0" and c < 20})
    assert rows_of(got) == expected


def test_empty_sides(spark, corpus):
    _, _, d, q = corpus
    fields = {"text": F.col("text")}
    assert S.search(q.where("false"), d, fields).count() == 0
    assert S.search(q, d.where("false"), fields).count() == 0
    assert S.frequencies(q.select(F.col("text").alias("term")), d.where("false"), F.col("text")).count() == 0


def test_frequencies(spark, corpus):
    docs, _, d, _ = corpus
    own = [w for i, t, _ in docs if i is not None for w in (t or "").split()]
    per = Counter(w for i, t, _ in docs if i is not None for w in set((t or "").split()))
    terms = spark.createDataFrame([("w1",), ("w2",), ("none",), ("w1",)], "term string")
    got = {r.term: (r.freq, r.df) for r in S.frequencies(terms, d, F.col("text")).collect()}
    assert got == {w: (own.count(w), per[w]) for w in ("w1", "w2") if per[w]}


def test_retrieve_filters_pages_and_asks_again(spark):
    e = lambda *x: [float(v) for v in x]
    chunks = spark.createDataFrame(
        [(1, "red apple tree", e(1, 0), "a"), (2, "red apple pie", e(1, 0.1), "b"), (3, "blue sea", e(0, 1), "a"), (4, None, e(-1, 0), "a"), (5, "green apple tree and red apple", e(0.9, 0.2), "a")],
        "chunk_id long, text string, vector array<double>, kind string",
    )
    ask = lambda i, text, *v: spark.createDataFrame([(i, text, e(*v))], "query_id long, text string, vector array<double>")
    got = R.retrieve(ask(7, "red apple tree", 1, 0), chunks, payload=("kind",)).collect()
    assert [r.chunk_id for r in sorted(got, key=lambda r: r.rank)][0] == 1 and {r.total for r in got} == {len(got)} and got[0].kind is not None
    got = R.retrieve(ask(7, "red apple tree", 1, 0), chunks, where=F.col("kind") == "b").collect()
    assert [r.chunk_id for r in got] == [2]
    page = R.retrieve(ask(7, "red apple tree", 1, 0), chunks, R.Config(page=2, page_size=1)).collect()
    assert len(page) == 1 and page[0].rank == 2 and page[0].total > 1
    # no vector is near and one of eight terms is there: only the second pass finds it
    far = ask(8, "blue one two three four five six seven", 0, 0)
    assert [r.chunk_id for r in R.retrieve(far, chunks).collect()] == [3]
    assert R.retrieve(far, chunks, R.Config(relaxed=(0.9, 0.99))).count() == 0


def test_tokens_of_all_scripts_in_sql_too(spark):
    register_sql(spark)
    texts = ["日本語テスト of x", "привет мир", "ภาษาไทย ok", "ＡＢ's c\\d 東", "plain old Text-1", "ລາວ", "မြန်မာ", "ខ្មែរ", "", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens(F.col("t")).alias("w"), F.expr("text_tokens(t)").alias("s"), F.expr("token_match(t, t, 1.0D)").alias("m"))
    got = {r.t: r for r in d.collect()}
    assert all(r.w == r.s for r in got.values()) and all(r.m == bool(r.w) for r in got.values())
    assert got["ภาษาไทย ok"].w[:2] == ["ภา", "าษ"] and got["привет мир"].w == ["привет", "мир"] and got["ＡＢ's c\\d 東"].w == ["ab", "s", "c", "d", "東"]


def test_chinese_question_words(spark):
    d = spark.createDataFrame([("请问苹果多少",), ("什么",), ("what is the price of 苹果吗",)], "t string")
    assert [r.s for r in d.select(strip_question_words(F.col("t")).alias("s")).collect()] == ["苹果", "什么", " the price 苹果"]


def test_query_rows_run_from_text(spark):
    chunks = spark.createDataFrame([(1, "the quick brown fox"), (2, "brown quick dogs"), (3, "foxes")], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "who saw that quick brown fox")], "query_id long, text string")
    freq = S.frequencies(P.query_terms(queries), chunks, F.col("text"))
    syn = spark.createDataFrame([("fox", "foxes")], "term string, synonym string")
    got = {r.chunk_id: r.score for r in S.search(P.query_rows(queries, freq, syn), chunks, {"text": F.col("text")}, least=0).collect()}
    assert got[1] > got[2] > 0 and got[3] > 0  # phrases lift the first, a synonym finds the last
