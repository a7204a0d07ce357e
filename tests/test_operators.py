"""Formulas and folds on tiny inputs, against plain Python."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeglean.functions import text as T
from lakeglean.operators import catalog as C
from lakeglean.operators import chunking as K
from lakeglean.operators import graph as G
from lakeglean.operators import postings as P
from lakeglean.operators.components import connected_components
from lakeglean.plans import retrieval as R
from lakeglean.sources import io as S
from lakeglean.streaming import jobs as J


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=40), st.integers(1, 80))
def test_groups_fit(sizes, limit):
    g = K.groups(sizes, limit, over=False)
    assert len(g) == len(sizes) and all(b - a in (0, 1) for a, b in zip(g, g[1:], strict=False))
    for k in set(g):
        own = [n for n, x in zip(sizes, g, strict=True) if x == k]
        assert sum(own) <= limit or len([n for n in own if n]) == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40), st.integers(1, 80))
def test_groups_over(sizes, limit):
    g = K.groups(sizes, limit, over=True)
    for k in set(g):
        own = [n for n, x in zip(sizes, g, strict=True) if x == k]
        assert sum(own[:-1]) <= limit


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6), (7, 7), (None, 9), (2, 1)], "src long, dst long")
    assert {tuple(r) for r in connected_components(e).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (7, 7)}
    chain = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.component for r in connected_components(chain).collect()} == {0}
    assert connected_components(e.where("false")).count() == 0


def test_pagerank_sums_to_one(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (3, 4, 1.0), (1, 4, 5.0), (6, 7, 1.0), (7, 7, 1.0)], "src long, dst long, weight double")
    r = {x.id: x.pagerank for x in G.pagerank(e).collect()}
    assert math.isclose(sum(r.values()), 1, abs_tol=1e-6) and r[7] > r[6]
    assert G.pagerank(e.where("false")).count() == 0


def test_communities_respect_size(spark):
    e = [(a, b, 1.0) for s in (0, 10) for a in range(s, s + 5) for b in range(a + 1, s + 5)] + [(4, 10, 0.1)]
    c = G.communities(spark.createDataFrame(e, "src long, dst long, weight double"), max_size=6).where("level = 0").collect()
    groups = {}
    for r in c:
        groups.setdefault(r.community, set()).add(r.id)
    assert max(map(len, groups.values())) <= 6 and any({10, 11, 12, 13, 14} <= g or {0, 1, 2, 3, 4} <= g for g in groups.values())


def test_text_functions(spark):
    df = spark.createDataFrame([("Ｈｅｌｌｏ　w", "what is the cat", "a/b c", "(ID: 1) and [ID:7] ref0", "x<think>y</think>z")], "a string, b string, c string, d string, e string")
    r = df.select(
        T.to_half_width(F.col("a")).alias("a"), T.strip_question_words(F.col("b")).alias("b"), T.fine_tokens(F.col("c")).alias("c"), T.fix_citations(F.col("d"), 3).alias("d"), T.strip_think(F.col("e")).alias("e"),
        T.space_latin_cjk(F.lit("abc中文def")).alias("f"), T.between(F.lit("<a>1</a><a>2</a>"), "<a>", "</a>").alias("g"), T.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("h"),
        T.similar_name(F.lit("colour"), F.lit("color")).alias("i"), T.similar_name(F.lit("part 1"), F.lit("part 2")).alias("j"),
    ).head()
    assert r.a == "Hello w" and "cat" in r.b and r.c == ["a", "b", "c"] and r.d == "[ID:1] and [ID:7] [ID:0]" and r.e == "z"
    assert r.f == "abc 中文 def" and r.g == ["1", "2"] and r.h == 0 and r.i and not r.j


def test_upsert_twice_is_once(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, x string, v int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 2)], "id long, x string, v int")
    once = C.upsert(base, new, "id", "v")
    assert sorted(map(tuple, C.upsert(once, new, "id", "v").collect())) == sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "d", 3), (3, "e", 2)]


def test_fences_hide_headings(spark):
    md = "# A\ntext\n## B\nmore\n```\n# no\n```\n# C\nend"
    own = K.heading_path(K.lines(spark.createDataFrame([(1, md)], "doc_id long, text string"))).orderBy("line").collect()
    assert [r.path for r in own if r.text in ("text", "more", "# no", "end")] == [["A"], ["A", "B"], ["A", "B"], ["C"]]
    blocks = K.markdown_blocks(spark.createDataFrame([(1, md)], "doc_id long, text string")).orderBy("block").collect()
    assert [b.kind for b in blocks] == ["header", "paragraph", "header", "paragraph", "fence", "header", "paragraph"]


def test_qa_continuations(spark):
    own = spark.createDataFrame([(1, 0, "lost"), (1, 1, "Q: a\tA: b"), (1, 2, "more"), (1, 3, "c\td")], "doc_id long, line int, text string")
    assert [tuple(r) for r in K.chunk_qa(own).orderBy("q").collect()] == [(1, 1, "a", "b\nmore"), (1, 2, "c", "d")]


def test_citations_once_each(spark):
    p = spark.createDataFrame([(1, 0, 7, 0.5), (1, 1, 7, 0.9), (1, 1, 8, 0.895), (1, 2, 9, 0.2), (2, 0, 1, 0.33), (3, 0, 1, 0.1)], "answer_id long, i int, chunk_id long, sim double")
    got = {tuple(r) for r in R.attribute_citations(p).collect()}
    assert got == {(1, 1, 7), (1, 1, 8), (2, 0, 1)}


def test_delimited(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\n1\t2\nbad\n3\t\n")
    rows, bad = S.read_delimited(S.text_lines(spark, str(tmp_path / "a.tsv")))
    assert sorted(r.cells["x"] for r in rows.collect()) == ["1", "3"] and bad.count() == 1
    assert S.statements("[ID:1]select 1; select ${x};", {"x": 2}) == ["select 1", "select 2"]


def test_json_and_binary(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"12345")
    (tmp_path / "b.bin").write_bytes(b"1")
    assert S.read_binary(spark, str(tmp_path), 3).count() == 1
    f = spark.createDataFrame([("l", '{"a":1}\n{"a":2}\n{"a":3}\n{"a":4}\nbroken'), ("d", '{"a":\n3}'), ("n", None)], "path string, text string")
    got = S.read_json_any(f).select("path", F.try_variant_get("v", "$.a", "int").alias("a")).collect()
    assert sorted((r.path, r.a) for r in got) == [("d", 3), ("l", 1), ("l", 2), ("l", 3), ("l", 4)]


def test_progress_is_monotone():
    now, log = 0.0, ""
    for p in (0.2, 0.1, 0.5, -1, 0.9):
        now, log = J.accept(now, log, p, "m" * 20, 50)
    assert now == -1 and len(log) <= 50 and not log.startswith("\n")


def test_retrieve_hybrid_reads_whole_queries(spark, tmp_path):
    from lakeglean.plans.retrieval_queries import book

    tail = " ".join(f"x{i}" for i in range(30))
    spark.createDataFrame([(0, "a" * 210 + " " + tail), (1, tail), (2, "other words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, 0.5]) for i in range(3)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.chunk_id: r.tksim for r in book.queries["retrieve_hybrid"](spark, str(tmp_path)).collect()}
    assert got[1] > 0.5 and not got.get(2)


def test_graph_queries_read_all_of_lineitem(spark, tmp_path):
    from lakeglean.plans.graph_queries import book

    rows = [(p, p // 4, 1.0, 0.1) for p in range(12)] + [(12, 2, 50.0, 0.0)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    ids = {*range(13), -1, -2, -3}
    level = book.queries["communities"](spark, str(tmp_path)).where("level = 0").collect()
    assert {r.id for r in level} == ids and len(level) == len(ids)
    assert {int(r.word) for r in book.queries["node_embeddings"](spark, str(tmp_path)).collect()} == ids


def test_entity_candidates_are_all(spark, monkeypatch):
    """Blocks against all pairs, with names that differ at both ends, digits, other scripts and hot blocks."""
    r = random.Random(3)
    names = ["xabcdefy", "zzbcdeww", "a", "", "ab", "ba", "名字一二三", "名字一二四", "名字", "字名", "пример", "примера", "part 12", "part 12b", "part 13", "名a", "a名b", "aab", "baa"]
    for _ in range(150):
        w = list("".join(r.choice("abcde ") for _ in range(r.randrange(1, 14))))
        names += ["".join(w), "".join(r.sample(w, len(w))), "".join(r.choice("xyz1") if r.random() < 0.3 else c for c in w), "".join(r.choice("名字一二abп") for _ in range(r.randrange(1, 7)))]
    nodes = spark.createDataFrame([(i, n, f"t{i % 2}") for i, n in enumerate(names)], "id long, name string, type string").cache()
    monkeypatch.setattr(G, "HOT_BLOCK", 20)
    for new in (None, nodes.where("id % 3 = 0")):
        want = {tuple(x) for x in G.entity_candidates(nodes, new, block=False).collect()}
        got = [tuple(x) for x in G.entity_candidates(nodes, new).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert (0, 1) not in want and G.entity_candidates(nodes.where("id < 2").withColumn("type", F.lit("t"))).count() == 1


def test_summary_tree_has_every_text(spark, monkeypatch):
    """One root, clusters of bounded size, and the first sentence of every text in the summary above it; also by way of the split over tasks."""
    from lakeglean.operators import embed as M

    r = random.Random(4)
    rows = [(f"d{i:03}", f"Text {i} of group {i % 10}. More.", [float(10 * (i % 10 == j)) + r.gauss(0, 0.5) for j in range(10)]) for i in range(200)]
    docs = spark.createDataFrame(rows, "id string, text string, vector array<float>")
    tree = {x.id: x for x in M.summary_tree(docs).collect()}
    size = {}
    for x in tree.values():
        size[x.parent] = size.get(x.parent, 0) + 1
    assert size.pop(None) == 1 and max(size.values()) <= 64 and len(size) > 4
    assert all(f"Text {i} of group {i % 10}." in tree[tree[f"d{i:03}"].parent].text for i in range(200))
    monkeypatch.setattr(M, "LOCAL_ROWS", 150)
    few = M.bounded_clusters(docs, max_k=5, most=30).collect()
    sizes = {}
    for x in few:
        sizes[x.cluster] = sizes.get(x.cluster, 0) + 1
    assert len(few) == 200 and max(sizes.values()) <= 30
    assert M.gmm_clusters.__defaults__[0] == 64


def test_lsh_recall(spark, sf):
    from lakeglean.operators import vectors as V

    v = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id as chunk_id", "embedding as vector")
    q = v.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    pairs = lambda df: {(r.query_id, r.chunk_id) for r in df.collect()}
    exact, near = pairs(V.knn(q, v, 10)), pairs(V.knn_lsh(q, v, 10))
    assert len(exact & near) >= 0.9 * len(exact)


def test_phrases_against_brute_force(spark):
    from lakeglean.operators import postings as P

    texts = {1: "a b a b b c", 2: "b a", 3: "", 4: None, 5: "a x b b"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    asked = [("p", "a", "b"), ("q", "b", "b"), ("r", "c", "a")]
    for slop in (0, 2):
        want = set()
        for i, text in texts.items():
            w = (text or "").split()
            for name, x, y in asked:
                n = sum(w[p] == x and y in w[p + 1 : p + 2 + slop] for p in range(len(w)))
                want |= {(name, i, n)} if n else set()
        got = P.phrase_match(spark.createDataFrame(asked, "phrase_id string, first string, second string"), P.term_pairs(docs, "id", "text", slop))
        assert {tuple(r) for r in got.select("phrase_id", "chunk_id", "n").collect()} == want


def test_store_verbs(spark):
    from lakeglean.operators import catalog as C

    df = spark.createDataFrame([(1, ["a", "b", "a"], None), (2, None, "x"), (3, ["c"], "y")], "id long, tags array<string>, z string")
    by = lambda d: {r.id: r.tags for r in d.collect()}
    assert by(C.rename_tag(df, "tags", "a", "n")) == {1: ["b", "n"], 2: None, 3: ["c"]}
    assert by(C.remove_tags(df, "tags", ["a", "c"])) == {1: ["b"], 2: None, 3: []}
    assert C.project(df, ["z", "id", "none"]).columns == ["id", "z"]
    assert [r.row for r in C.row_dicts(df.drop("tags")).orderBy("id").collect()] == ['{"id":1}', '{"id":2,"z":"x"}', '{"id":3,"z":"y"}']
    assert C.get_row(df, "id", 9).count() == 0
    kept, seen = C.delete_counted(df, F.col("z") == "x")
    assert {r.id for r in kept.collect()} == {1, 3} and seen.get["deleted"] == 1


def test_heading_grammar(spark):
    from lakeglean.functions import text as T

    rows = [(0, "第一章 x\n第二条 y\n# z"), (1, "1. a\n2. b\n3 4"), (3, "PART ONE\nSection 2\n0 x"), (4, "  # a\n## b"), (-1, "plain"), (-1, None), (-1, "")]
    df = spark.createDataFrame(rows, "want int, text string")
    assert all(r.want == r.got for r in df.select("want", T.heading_grammar(F.split("text", "\n")).alias("got")).collect())


LAW = """Preface line
Contents
1. First part
2. Second part
1. First part
text under one
1.1 Inner heading
inner text
42
2. Second part
2.1 Bare heading
2.2 Another heading
last text"""


def by_hand_tree(rows, depth):
    """Chunks of (level, text) rows by a stack of nodes."""
    used = sorted({lv for lv, _ in rows})
    target = used[min(depth, len(used)) - 1]
    if target == max(used) and target == 7 and len(used) > 1:
        target = used[-2]
    nodes = [[0, []]]
    for lv, text in rows:
        if lv <= target:
            nodes.append([lv, [text]])
        else:
            nodes[-1][1].append(text)
    out, path = (["\n".join(nodes[0][1])] if nodes[0][1] else []), []
    for i, (lv, texts) in enumerate(nodes[1:], 1):
        while path and path[-1][0] >= lv:
            path.pop()
        path.append((lv, texts))
        if i + 1 == len(nodes) or nodes[i + 1][0] <= lv:
            out.append("\n".join(x for _, t in path for x in t))
    return out


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_chunk_tree(spark, depth):
    rng = random.Random(depth)
    heads = ["PART ONE", "Chapter IV", "Section 3", "Article 9"]
    docs, want = [], {}
    for i in range(30):
        levels = [rng.choice([1, 2, 3, 4, 7, 7, 7]) for _ in range(rng.randint(1, 14))] + [1]
        rows = [(lv, f"{heads[lv - 1]} h{j}" if lv < 7 else f"body {j}") for j, lv in enumerate(levels)]
        docs.append((i, "\n".join(t for _, t in rows)))
        want[i] = by_hand_tree(rows, depth)
    docs += [(98, None), (99, "")]
    got = {}
    for r in K.chunk_tree(spark.createDataFrame(docs, "doc_id long, text string"), depth).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == want


def test_contents_go_and_books_tell_paths(spark):
    novel = "Preface line\nPART ONE\ntext a\nChapter IV\nSection 1\ntext b\n42\nSection 2\nPART TWO\nChapter V"
    d = spark.createDataFrame([(1, LAW), (2, "plain words\nmore words"), (3, None), (4, novel)], "doc_id long, text string")
    kept = d.where("doc_id < 3").select("doc_id", T.without_contents(F.split("text", "\n")).alias("ls")).orderBy("doc_id").collect()
    assert kept[0].ls == ["Preface line", *LAW.split("\n")[4:]] and kept[1].ls == ["plain words", "more words"]
    book = {}
    for r in K.chunk_book(d.where("doc_id > 1")).orderBy("doc_id", "seq").collect():
        book.setdefault(r.doc_id, []).append(r.text)
    bare = ["PART ONE\nChapter IV\nSection 2", "Chapter V"]
    assert book == {2: ["plain words\nmore words"], 4: ["Preface line", "PART ONE\ntext a", "PART ONE\nChapter IV\nSection 1\ntext b", *bare]}


def test_tokens_of_other_scripts(spark):
    d = spark.createDataFrame([("iPhone手机壳 привет Ωmega x1",), ("猫",), ("コーヒー",), (None,)], "s string")
    got = [(r.t, r.n) for r in d.select(T.tokens(F.col("s")).alias("t"), T.n_tokens(F.col("s")).alias("n")).collect()]
    assert got == [(["iphone", "手机", "机壳", "привет", "ωmega", "x1"], 7), (["猫"], 1), (["コー", "ーヒ", "ヒー"], 4), ([], 0)]


def test_query_rows(spark):
    q = spark.createDataFrame([(1, "What is the Quick brown fox jump of b 42"), (2, "手机壳 价格"), (3, None)], "query_id long, text string")
    freq = spark.createDataFrame([("quick", 5, 2), ("fox", 100000, 5000)], "term string, freq long, df long")
    syn = spark.createDataFrame([("fox", "vixen"), ("手机", "电话")], "term string, synonym string")
    rows = P.query_rows(q, freq, syn).collect()
    of = lambda i, kind: {r.text: round(r.weight, 6) for r in rows if (r.query_id, r.kind) == (i, kind)}
    terms, phrases = of(1, "term"), of(1, "phrase")
    assert set(terms) == {"quick", "brown", "fox", "jump", "42"} and terms["42"] > terms["brown"] > terms["fox"]
    assert phrases["jump 42"] == pytest.approx(2 * terms["42"], abs=2e-6) and len(phrases) == 4
    assert of(1, "syn") == {"vixen": pytest.approx(terms["fox"] / 4, abs=2e-6)} and not of(1, "near")
    assert set(of(2, "term")) == {"手机", "机壳", "价格"} and of(2, "near") == {"手机 机壳": 1.5} and not of(2, "phrase")
    assert of(2, "syn") == {"电话": pytest.approx(of(2, "term")["手机"] / 5, abs=2e-6)} and of(2, "term")["价格"] == 1.0
    assert not [r for r in rows if r.query_id == 3]
