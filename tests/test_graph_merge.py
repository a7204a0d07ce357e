"""Graphs merged with their attributes, table functions of SQL against the operators, JDBC by partitions."""

import pytest
from pyspark.sql import functions as F

from lakeglean.operators import chunking as K
from lakeglean.operators import graph as G
from lakeglean.plans.sql_chunkers import register_chunkers
from lakeglean.sources import io

NODES = "seq int, id long, type string, description string, source_id array<string>"
EDGES = "seq int, src long, dst long, weight double, description string, keywords array<string>, source_id array<string>"


@pytest.fixture(scope="module")
def graphs(spark):
    n = spark.createDataFrame([(1, 1, "a", "one", ["d1"]), (2, 1, "b", "uno", ["d2"]), (2, 2, "b", None, ["d2"]), (3, 3, "c", "three", ["d3"]), (1, 2, "a", "two", ["d1"])], NODES)
    e = spark.createDataFrame([(2, 2, 1, 3.0, "late", ["y"], ["d2"]), (1, 1, 2, 1.0, "early", ["x"], ["d1"]), (3, 3, 3, 1.0, "loop", [], ["d3"])], EDGES)
    return n, e


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_union_keeps_all_attributes_in_order(graphs):
    n, e = G.union_graphs(*graphs)
    assert rows(n.select("id", "type", "description", "source_id", "rank")) == [(1, "a", "one<SEP>uno", ["d1", "d2"], 1), (2, "a", "two", ["d1", "d2"], 1), (3, "c", "three", ["d3"], 2)]
    assert rows(e) == [(1, 2, 4.0, "early<SEP>late", ["x", "y"], ["d1", "d2"]), (3, 3, 1.0, "loop", [], ["d3"])]


def test_rebuild_lets_the_latest_win(spark, graphs):
    gone = lambda *x: spark.createDataFrame([(s,) for s in x], "source string")
    n, e = G.rebuild_graphs(*graphs, gone("d3"))
    assert rows(n) == [(1, "b", "uno", ["d1", "d2"]), (2, "b", "two", ["d1", "d2"])] or rows(n) == [(1, "b", "uno", ["d1", "d2"]), (2, "b", None, ["d1", "d2"])]
    assert rows(e) == [(1, 2, 3.0, "late", ["y"], ["d2"])]
    n, e = G.rebuild_graphs(*graphs, gone("d2", "nobody"))
    assert rows(n) == [(1, "a", "one", ["d1"]), (2, "a", "two", ["d1"]), (3, "c", "three", ["d3"])] and len(rows(e)) == 2
    assert rows(G.rebuild_graphs(*graphs, gone("d1", "d2", "d3"))[0]) == []


def test_touched(spark, graphs):
    before, batch = (graphs[0].where(f"seq {x}") for x in ("= 1", "> 1"))
    assert rows(G.touched(before, batch, "id")) == [(1, "updated"), (2, "updated"), (3, "added")]


def test_contracted_nodes_bring_their_attributes(spark, graphs):
    n, e = G.union_graphs(*graphs)
    more = spark.createDataFrame([(1, 3, 2.0, "side", ["z"], ["d9"]), (2, 3, 5.0, "base", ["z"], ["d1"])], "src long, dst long, weight double, description string, keywords array<string>, source_id array<string>")
    n2, e2 = G.contract_graph(n.drop("rank"), e.unionByName(more), spark.createDataFrame([(1, 2), (2, 2)], "src long, dst long"))
    assert rows(n2) == [(2, "a", "two<SEP>one<SEP>uno", ["d1", "d2"]), (3, "c", "three", ["d3"])]
    assert rows(e2) == [(2, 3, 7.0, "side<SEP>base", ["z"], ["d1", "d9"])]  # the edge within the node and the loop are gone


def test_table_functions_are_the_operators(spark):
    register_chunkers(spark)
    texts = ["one two three. four\n" * 9, "a。b c d e f g h i！" * 5, "", None, "\n \n", "日本語テスト と ภาษาไทย words\nx"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    d.createOrReplaceTempView("some_docs")
    got = rows(spark.sql("SELECT doc_id, c.seq, c.text, c.n_tokens FROM some_docs, LATERAL chunk(text, 8) c"))
    assert got == rows(K.chunk_merge(d, 8)) and len(got) > 6
    t = spark.createDataFrame([(1, 2, "c d"), (1, 1, "a b"), (1, 3, "e"), (2, 1, "x"), (2, 2, None)], "k long, turn int, text string")
    t.createOrReplaceTempView("some_turns")
    got = rows(spark.sql("SELECT * FROM pack_rows(TABLE(SELECT k, text, turn FROM some_turns) PARTITION BY k ORDER BY (turn), 5)"))
    assert got == [(1, 0, "a b\nc d", 4), (1, 1, "e", 1), (2, 0, "x\n", 1)]


def test_jdbc_reads_in_partitions_with_its_filters(spark):
    """Through the in-process database that comes with Spark."""
    options = {"url": "jdbc:derby:memory:lakeglean;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(100).select(F.col("id").cast("int").alias("ID"), (F.col("id") % 7).cast("int").alias("KIND"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("NAME")).write.format("jdbc").options(**options, dbtable="THINGS").mode("overwrite").save()
    df = io.jdbc_table(spark, options, "THINGS", "ID", 4)
    assert df.rdd.getNumPartitions() == 4
    hit = df.where("KIND = 3 and ID >= 50").select("NAME")
    assert {r.NAME for r in hit.collect()} == {f"n{i}" for i in range(50, 100) if i % 7 == 3}
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(KIND,3)" in plan.replace("*", "") and "GreaterThanOrEqual(ID,50)" in plan.replace("*", "")
    assert sum(len(p) > 0 for p in df.select("ID").rdd.glom().collect()) == 4  # the bounds were those of the column
    assert [r.N for r in io.jdbc_query(spark, options, "SELECT count(*) AS N FROM THINGS WHERE KIND = ${k}", {"k": "3"})[0].collect()] == [14]
    empty = io.jdbc_table(spark, options, "(SELECT * FROM THINGS WHERE ID < 0) x", "ID", 4)
    assert empty.count() == 0


def test_jsonl_tsv_scan_and_report(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"docid": "d1", "text": "a"}\n{"docid": "d2"}\n')
    assert rows(io.load_jsonl(spark, str(tmp_path / "p.jsonl")).na.fill("-")) == [("d1", "a"), ("d2", "-")]
    (tmp_path / "t.tsv").write_text("q1\twhat is\nq2\twho\n")
    (tmp_path / "q.tsv").write_text("q1\t0\td1\t2\nq2\t0\td9\t1\n")
    assert rows(io.load_topics(spark, str(tmp_path / "t.tsv"))) == [("q1", "what is"), ("q2", "who")]
    assert rows(io.load_qrels(spark, str(tmp_path / "q.tsv"))) == [("q1", "d1", 2), ("q2", "d9", 1)]
    spark.createDataFrame([("a", 1), ("b", 2)], "id string, kb_id int").write.parquet(str(tmp_path / "one"))
    spark.createDataFrame([("c", 1, "x")], "id string, kb_id int, extra string").write.parquet(str(tmp_path / "two"))
    paths = [str(tmp_path / n) for n in ("one", "two", "missing")]
    assert rows(io.scan_chunks(spark, paths, [1], ["id", "extra"]).na.fill("-")) == [("a", "-"), ("c", "x")]
    assert [r.id for r in io.scan_chunks(spark, paths, order=[F.col("id").desc()]).collect()] == ["c", "b", "a"]
    run = spark.createDataFrame([("q1", "d1", 1, 0.9), ("q1", "d2", 2, 0.5)], "query_id string, chunk_id string, rank int, score double")
    io.write_run(run, str(tmp_path / "run"), "mine")
    assert sorted(line for f in (tmp_path / "run").glob("part-*") for line in f.read_text().splitlines()) == ["q1 Q0 d1 1 0.9 mine", "q1 Q0 d2 2 0.5 mine"]
    io.write_qrels(run.select("query_id", "chunk_id", F.lit(1).alias("rel")), str(tmp_path / "rel"))
    assert rows(io.load_qrels(spark, str(tmp_path / "rel"))) == [("q1", "d1", 1), ("q1", "d2", 1)]
    io.write_eval_report(run.groupBy("query_id").agg(F.avg("score").alias("x")), str(tmp_path / "report"))
    assert [r.x for r in spark.read.json(str(tmp_path / "report")).collect()] == [0.7]
