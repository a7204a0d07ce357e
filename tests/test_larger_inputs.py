"""Queries against their SQL on inputs that larger tables have and the smallest do not."""

import random

import duckdb
from compare import same
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lakeglean.operators import graph as G
from lakeglean.operators import kgsearch as K
from lakeglean.operators import vectors as V
from lakeglean.operators.catalog import roll_up
from lakeglean.operators.components import cut
from lakeglean.plans import BOOKS

QUERIES = {n: q for b in BOOKS for n, q in b.queries.items()}
ORACLES = {n: s for b in BOOKS for n, s in b.oracles.items()}


def agrees(spark, folder, name, **tables):
    """The query on tables (SQL that makes them) is the same as its SQL."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"create table {table} as {sql}")
        con.execute(f"copy {table} to '{folder}/{table}.parquet' (format parquet)")
    same(QUERIES[name](spark, str(folder)), con, ORACLES[name])


def test_names_with_the_same_pieces_are_not_equal(spark, tmp_path):
    supplier = "select i::bigint as s_suppkey, 'Supplier#' || lpad(n, 9, '0') as s_name, 3 as s_nationkey from (values (1, '11'), (2, '111'), (3, '111'), (4, '1110'), (5, NULL)) t(i, n)"
    agrees(spark, tmp_path, "similar_suppliers", supplier=supplier)


def test_summary_ratios_round_as_sql_does(spark, tmp_path):
    # 203 of 3200 is 0.0634375, a tie of six digits that only the shortest decimal has
    documents = "select i::bigint as doc_id, t as text from (values (1, repeat('a', 3200)), (2, NULL), (3, ''), (4, chr(160)), (5, 'a. b' || chr(8195) || '. . c'), (6, 'a b. c.')) t(i, t)"
    agrees(spark, tmp_path, "extractive_summary", documents=documents)
    for name in ("summary", "ratio"):
        con = duckdb.connect()
        con.execute(f"create table documents as {documents}")
        want = dict(con.execute(f"select doc_id, {name} from ({ORACLES['extractive_summary']})").fetchall())
        assert {r.doc_id: r[name] for r in QUERIES["extractive_summary"](spark, str(tmp_path)).collect()} == want


TEXTS = "select i::bigint as doc_id, t as text from (values (1, 'one. two' || chr(10) || 'three'), (2, NULL), (3, ''), (4, '  '), (5, chr(10) || chr(10)), (6, chr(160)), (7, '...'), (8, repeat('word ', 300) || '. ' || repeat('more ', 70) || chr(10) || chr(8195)), (9, repeat('a b。', 99))) t(i, t)"


def test_texts_without_chunks_are_counted_as_sql_does(spark, tmp_path):
    for name in ("chunk_in_sql", "chunk_merge"):
        agrees(spark, tmp_path, name, documents=TEXTS)


def test_texts_without_parts_are_counted_as_sql_does(spark, tmp_path):
    agrees(spark, tmp_path, "chunk_regex", documents=TEXTS)


def test_names_are_compared_once(spark, tmp_path):
    """Many parts of few names: as many pairs as the SQL has, from a few comparisons of names."""
    part = "select i::bigint as p_partkey, ['red bolt', 'red belt', 'cold anvil', 'hot ring', 'hot rings', NULL, 'old plate'][1 + i % 7] as p_name, 'b' || (i % 2) as p_brand from range(700) t(i)"
    agrees(spark, tmp_path, "entity_pairs", part=part)
    odd = {(r.a, r.b) for r in QUERIES["entity_pairs_blocked"](spark, str(tmp_path)).collect()}
    assert odd == {(r.a, r.b) for r in QUERIES["entity_pairs"](spark, str(tmp_path)).collect() if r.a % 2 == 0 or r.b % 2 == 0}


def test_comparisons_do_not_grow_with_the_nodes_of_a_name(spark):
    names = spark.range(3000).selectExpr("id", "concat('name ', id % 3) as name", "'t' as type").select("type", "name").distinct()
    assert G.similar_names(names).count() == 0  # a digit tells them apart
    nodes = spark.range(600).selectExpr("id", "element_at(array('red bolt', 'red belt'), cast(id % 2 as int) + 1) as name", "'t' as type")
    seen = []
    original, G.similar_names = G.similar_names, lambda n: seen.append(n.count()) or original(n)
    try:
        assert G.entity_candidates(nodes).count() == 600 * 599 // 2
    finally:
        G.similar_names = original
    assert seen == [2]


def test_an_odd_node_pairs_with_a_new_one_in_either_order(spark):
    nodes = spark.createDataFrame([(1, "red bolt", "t"), (2, "red belt", "t"), (3, "red bolt", "t"), (4, "red bolt", None), (5, None, "t")], "id long, name string, type string")
    assert {tuple(r) for r in G.entity_candidates(nodes, nodes.where("id = 2")).collect()} == {(1, 2), (2, 3)}
    twice = nodes.unionByName(spark.createDataFrame([(2, "red bolts", "t")], nodes.schema))
    assert sorted(tuple(r) for r in G.entity_candidates(twice).collect()) == [(1, 2), (1, 3), (2, 3)]


def test_estimates_do_not_multiply_over_rounds(spark):
    """A checkpoint keeps the product of a join's estimates; the driver was busy with numbers of millions of digits."""
    d = spark.range(9).withColumn("x", F.array("id"))
    for _ in range(12):
        d = cut(d.join(d.select("id"), "id"))
    assert d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 64
    assert sorted((r.id, r.x) for r in d.collect()) == [(i, [i]) for i in range(9)]


def test_communities_by_shuffles_are_the_same(spark, monkeypatch):
    edges = spark.range(200).selectExpr("id % 40 as src", "100 + (id * 7) % 23 as dst", "cast(1 + id % 5 as double) as weight").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    sent = sorted(map(tuple, G.communities(edges, levels=2, rounds=3).collect()))
    monkeypatch.setattr(G, "SENT_NODES", 0)
    assert sorted(map(tuple, G.communities(edges, levels=2, rounds=3).collect())) == sent and len(sent) == 126


def test_levels_of_a_tree_are_cut_from_their_lineage(spark):
    nodes = spark.range(1, 3000).selectExpr("id", "if(id > 1, id div 2, null) as parent")
    tree = roll_up(nodes)
    assert tree._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert {(r.ancestor, r.n) for r in tree.where("ancestor <= 2").groupBy("ancestor").agg(F.count("*").alias("n")).collect()} == {(1, 2999), (2, 1975)}


def test_graph_search_looks_at_few_edges_and_finds_the_best(spark, monkeypatch):
    """Hits beside a hub: its other edges cannot be among the best; without many edges of hits, all are looked at."""
    r = random.Random(5)
    vector = lambda x, y: [float(x), float(y)]
    nodes = spark.createDataFrame([(i, f"t{i % 3}", 1.0, "n", vector(1, i / 10) if i < 3 else None) for i in range(400)], "id long, type string, pagerank double, description string, vector array<double>")
    pairs = sorted({(i, 399) for i in range(399)} | {tuple(sorted(r.sample(range(60), 2))) for _ in range(150)})
    edges = spark.createDataFrame([(k, a, b, float(1 + k % 3), "e", None) for k, (a, b) in enumerate(pairs)], "rel long, src long, dst long, weight double, description string, vector array<double>")
    reports = spark.createDataFrame([], "community string, id long, weight double, text string")
    q, types = spark.createDataFrame([(7, vector(1, 0))], "query_id long, vector array<double>"), spark.createDataFrame([(7, "t1")], "query_id long, type string")
    hits = spark.createDataFrame([(7, i, 1 / (1 + (i / 10) ** 2) ** 0.5) for i in range(3)], "query_id long, id long, sim double")
    lent = {(x.f, x.t): x.lent for x in K.lent_by_hops(hits, edges).collect()}
    weight = {p: float(1 + k % 3) for k, p in enumerate(pairs)}
    best = sorted(((-round(v * (1 + (f % 3 == 1) + (t % 3 == 1)) * weight[min(f, t), max(f, t)], 9), f, t) for (f, t), v in lent.items()))
    seen, lend = [], K.lend
    monkeypatch.setattr(K, "lend", lambda starts, *rest: seen.append(starts.count()) or lend(starts, *rest))
    for n in (6, 2000):
        seen.clear()
        rows = K.search_graph(q, types, nodes, edges, reports, K.GraphSearch(relations=n, budget=10**6)).where("kind = 'relation'").orderBy("rank").collect()
        assert [(x.a, x.b) for x in rows] == [(f, t) for _, f, t in best[:n]] and len(best) > 400
        assert sum(seen) < 100 if n == 6 else sum(seen) >= len(best)


def test_lsh_pairs_are_not_shuffled(spark):
    """The pairs that meet in a bucket, as Spark's own join finds them, without a join of rows."""
    r = random.Random(2)
    some = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    v = spark.createDataFrame([*some, (300, [0.0] * 8)], "chunk_id long, vector array<double>")
    q = v.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    got = V.knn_lsh(q, v, 5, width=0.05, tables=3)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    unit = spark.createDataFrame([(i, Vectors.dense([y / sum(z * z for z in x) ** 0.5 for y in x])) for i, x in some], ["chunk_id", "u"])
    model = BucketedRandomProjectionLSH(inputCol="u", outputCol="h", bucketLength=0.05, numHashTables=3, seed=1).fit(unit)
    pairs = model.approxSimilarityJoin(unit.where("chunk_id % 20 = 0"), unit, 2.0, distCol="d").select("datasetA.chunk_id", "datasetB.chunk_id", "d").collect()
    best = {}
    for a, b, d in sorted(pairs, key=lambda x: (x[0], x[2])):
        best.setdefault(a, []).append(b)
    assert len(pairs) < 15 * 300 * 0.9 and {(x.query_id, x.chunk_id) for x in got.collect()} == {(a, b) for a, all_ in best.items() for b in all_[:5]}
