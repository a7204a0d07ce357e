"""Streams over several micro-batches: timers, time to live, buckets that a batch rewrites, restarts, last rows of updates."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from lakeglean.operators.graph import pagerank
from lakeglean.streaming import jobs as J
from lakeglean.streaming.snapshots import Snapshots

T0 = dt.datetime(2024, 1, 1)


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def running(df, folder, mode, got):
    return df.writeStream.foreachBatch(lambda b, i: got.append([tuple(r) for r in b.collect()])).outputMode(mode).option("checkpointLocation", f"{folder}/c").start()


def test_liveness_stream_and_its_batch_twin(spark, tmp_path):
    schema, source, got, beats = "worker long, ts timestamp", tmp_path / "in", [], []
    steps = [[(1, 0), (2, 0)], [(1, 100)], [(1, 200)], [(3, 400)]]
    put(spark, source, [(w, T0 + dt.timedelta(seconds=s)) for w, s in steps[0]], schema)
    q = running(J.liveness_stream(J.read_files(spark, str(source), schema, 1), 120_000), tmp_path, "append", got)
    try:
        for step in steps:
            if beats:
                put(spark, source, [(w, T0 + dt.timedelta(seconds=s)) for w, s in step], schema)
            beats += step
            q.processAllAvailable()
    finally:
        q.stop()
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    events = [(w, alive, (at - base) // 1000) for b in got for w, alive, at in b]
    assert sorted(events) == sorted([(1, True, 0), (2, True, 0), (1, True, 100), (1, True, 200), (2, False, 120), (3, True, 400), (1, False, 320)])
    # the last event of each worker says what the batch twin says at the end
    all_ = spark.createDataFrame([(w, T0 + dt.timedelta(seconds=s)) for w, s in beats], schema)
    twin = {r.worker: r.alive for r in J.liveness(all_, F.lit(T0 + dt.timedelta(seconds=400)), "120 seconds").collect()}
    last = {}
    for w, alive, _ in events:
        last[w] = alive
    assert twin == last == {1: False, 2: False, 3: True}


def cached(spark, folder, ttl_ms, files, pause=0.0):
    """Rows of a cache over files that come one by one. A stream by processing time has always more to do, so it is stopped once they are in."""
    schema, got = "key string, value string, ts timestamp", []
    put(spark, folder / "in", files[0], schema)
    out = J.ttl_cache(J.read_files(spark, str(folder / "in"), schema, 1), ttl_ms)
    q = out.writeStream.foreachBatch(lambda b, i: got.extend(tuple(r) for r in b.collect())).outputMode("update").option("checkpointLocation", f"{folder}/c").trigger(processingTime="500 milliseconds").start()
    try:
        for i in range(len(files)):
            want = sum(len({k for k, *_ in f}) for f in files[: i + 1])
            end = time.time() + 60
            while len(got) < want and time.time() < end:
                time.sleep(0.2)
            time.sleep(pause)
            if i + 1 < len(files):
                put(spark, folder / "in", files[i + 1], schema)
    finally:
        q.stop()
    return got


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_cache_stream_and_its_batch_twin(spark, tmp_path):
    files = [[("a", "old", at(1)), ("a", "new", at(5)), ("a", "mew", at(5)), ("b", "x", at(2))], [("a", "late", at(3)), ("c", "y", at(9))]]
    assert sorted(cached(spark, tmp_path, 600_000, files)) == [("a", "mew", False), ("a", "mew", True), ("b", "x", False), ("c", "y", False)]
    twin = J.valid_cache(spark.createDataFrame([r for f in files for r in f], "key string, value string, ts timestamp"), F.lit(at(10)), "60 seconds")
    assert {(r.key, r.value) for r in twin.collect()} == {("a", "mew"), ("b", "x"), ("c", "y")}


def test_cache_stream_forgets(spark, tmp_path):
    got = cached(spark, tmp_path, 1000, [[("a", "1", T0)], [("a", "2", T0)]], pause=2.5)
    assert got == [("a", "1", False), ("a", "2", False)]  # the first value was gone: no hit


def size(folder):
    return {v: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(os.path.join(folder, v)) for f in fs if f.endswith(".parquet")) for v in sorted(os.listdir(folder))}


def test_batches_rewrite_the_buckets_they_touch(spark, tmp_path):
    source, table = tmp_path / "in", Snapshots(spark, str(tmp_path / "t"), "id long, text string, version long", ["id"], 16)
    schema = "id long, text string, version long"
    run = lambda: J.ingest(J.read_files(spark, str(source), schema, 1), lambda b: b, table, str(tmp_path / "c")).awaitTermination()
    put(spark, source, [(i, f"text {i} " * 20, 1) for i in range(4000)], schema)
    run()
    put(spark, source, [(7, "changed", 2), (7, "older", 1)], schema)
    run()
    put(spark, source, [(5000, "added", 1)], schema)
    run()
    got = {r.id: r.text for r in table.read().collect()}
    assert len(got) == 4001 and got[7] == "changed" and got[5000] == "added" and got[8].startswith("text 8")
    first, *later = size(tmp_path / "t" / "data").values()
    assert all(x < first / 8 for x in later)  # one bucket of sixteen each
    assert len({r.at for r in spark.read.parquet(str(tmp_path / "t" / "manifest")).where("v = 2").collect()}) == 3


def test_a_failed_batch_runs_again_once(spark, tmp_path):
    source, graph, fails = tmp_path / "in", J.GraphTables.at(spark, str(tmp_path / "g"), 4), {"n": 0}
    schema = "src long, dst long, weight double, source long"
    stream = lambda: J.read_files(spark, str(source), schema, 1)
    put(spark, source, [(2, 1, 1.0, 10), (1, 3, 1.0, 10)], schema)
    J.graph_stream(stream(), graph, str(tmp_path / "c")).awaitTermination()
    whole = graph.sources.merge

    def broken(*args):
        fails["n"] += 1
        raise RuntimeError("lost")

    graph.sources.merge = broken  # the edges are written, then the batch fails
    put(spark, source, [(1, 2, 2.0, 11), (3, 4, 1.0, 11)], schema)
    with pytest.raises(Exception, match="lost"):
        J.graph_stream(stream(), graph, str(tmp_path / "c")).awaitTermination()
    graph.sources.merge = whole
    J.graph_stream(stream(), graph, str(tmp_path / "c")).awaitTermination()
    assert fails["n"] == 1
    assert sorted(map(tuple, graph.edges.read().collect())) == [(1, 2, 3.0), (1, 3, 1.0), (3, 4, 1.0)]
    assert sorted(map(tuple, graph.sources.read().collect())) == [(1, 2, 10), (1, 2, 11), (1, 3, 10), (3, 4, 11)]


def test_retention_over_batches_and_an_empty_table(spark, tmp_path):
    source, table = tmp_path / "in", Snapshots(spark, str(tmp_path / "t"), "user long, at long", ["user"], 4)
    assert table.read().count() == 0
    for rows in ([(1, i) for i in range(6)] + [(2, 1)], [(1, 9), (3, 1)], [(1, 3)]):
        put(spark, source, rows, "user long, at long")
        J.retain_stream(J.read_files(spark, str(source), "user long, at long", 1), table, str(tmp_path / "c"), "at", 3).awaitTermination()
    assert sorted(map(tuple, table.read().collect())) == [(1, 4), (1, 5), (1, 9), (2, 1), (3, 1)]


def test_ranks_start_from_the_last_ones(spark, tmp_path):
    schema = "src long, dst long, weight double, source long"
    source, graph = tmp_path / "in", J.GraphTables.at(spark, str(tmp_path / "g"), 4)
    batches = [[(i, i + 1, 1.0, 1) for i in range(6)] + [(0, 5, 2.0, 1), (1, 3, 1.0, 2)], [(0, 9, 1.0, 99)]]
    for rows in batches:
        put(spark, source, rows, schema)
        J.graph_stream(J.read_files(spark, str(source), schema, 1), graph, str(tmp_path / "c"), rank=True, tol=1e-5).awaitTermination()
    want = {r.id: r.pagerank for r in pagerank(graph.edges.read(), tol=1e-5).collect()}
    got = {r.id: r.pagerank for r in graph.ranks.read().collect()}
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 1e-3 and abs(sum(got.values()) - 1) < 1e-6


def test_updates_of_two_files_give_one_row_a_task(spark, tmp_path):
    schema = "task_id long, seq long, progress double, message string"
    put(spark, tmp_path / "in", [(1, 1, 0.2, "a"), (2, 1, 0.5, "x")], schema)
    put(spark, tmp_path / "in", [(1, 2, 0.9, "b")], schema)
    got = J.drain_files(J.progress_stream(J.read_files(spark, str(tmp_path / "in"), schema, 1)), str(tmp_path / "out"), "update", ["task_id"]).collect()
    assert sorted((r.task_id, r.progress, r.log) for r in got) == [(1, 0.9, "a\nb"), (2, 0.5, "x")]
    with pytest.raises(ValueError, match="keys"):
        J.drain_files(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "x"), "update")


def test_sliding_days(spark, tmp_path):
    schema = "ts timestamp, user_id long, value double"
    put(spark, tmp_path / "in", [(T0 + dt.timedelta(hours=h), h % 2, 1.0) for h in (1, 13, 25)], schema)
    got = J.drain_files(J.daily_stream(J.read_files(spark, str(tmp_path / "in"), schema), slide="12 hours"), str(tmp_path / "o"), "complete").collect()
    at = {(r.day - T0).total_seconds() / 3600: (r.pv, r.uv, r.total) for r in got}
    assert at == {-12.0: (1, 1, 1.0), 0.0: (2, 1, 2.0), 12.0: (2, 1, 2.0), 24.0: (1, 1, 1.0)}
