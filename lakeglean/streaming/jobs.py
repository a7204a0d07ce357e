"""Streaming jobs: ingest with upserts, de-duplication, liveness, progress, counters, windows, caches, retention.

Each takes a streaming DataFrame (or a batch one, where the operator allows both) and gives a DataFrame or a started query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.catalog import keep_latest, top_k, upsert
from .snapshots import Snapshots


def read_files(spark: SparkSession, path: str, schema: str, per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def order_batch(df: DataFrame) -> DataFrame:
    """Work of higher priority first, then by age."""
    return df.sortWithinPartitions(F.col("priority").desc(), "created")


def ingest(source: DataFrame, build: Callable[[DataFrame], DataFrame], table: Snapshots, checkpoint: str, version: str = "version") -> StreamingQuery:
    """Chunks of each micro-batch upserted by the table's key; only the buckets they fall into are written again."""

    def write(batch: DataFrame, n: int) -> None:
        table.merge(build(batch), n, lambda old, new: upsert(old, new, table.keys[0], version))

    return started(source, write, checkpoint)


def started(source: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_stream(df: DataFrame, key: str, ts: str, delay: str = "24 hours") -> DataFrame:
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def counter_stream(deltas: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return deltas.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in cols))


def daily_stream(events: DataFrame, ts: str = "ts", delay: str = "1 day", slide: str | None = None) -> DataFrame:
    """Daily counts, users (approximate in a stream), and sums; sliding if `slide` is given."""
    w = F.window(ts, "1 day", slide) if slide else F.window(ts, "1 day")
    return events.withWatermark(ts, delay).groupBy(w).agg(F.count("*").alias("pv"), F.approx_count_distinct("user_id").alias("uv"), F.sum("value").alias("total")).select(F.col("window.start").alias("day"), "pv", "uv", "total")


def session_stream(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


PROGRESS = "task_id long, progress double, log string"


def progress_stream(updates: DataFrame, most: int = 3000) -> DataFrame:
    """(task_id, progress, log): an update (task_id, seq, progress, message) counts if the task has not failed and it is a failure or larger.

    The log keeps its last `most` characters, from a line start.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, log = state.get if state.exists else (0.0, "")
        for u in pd.concat(list(parts)).sort_values("seq").itertuples():
            now, log = accept(now, log, u.progress, u.message, most)
        state.update((now, log))
        yield pd.DataFrame({"task_id": [key[0]], "progress": [now], "log": [log]})

    return updates.groupBy("task_id").applyInPandasWithState(fold, PROGRESS, "progress double, log string", "update", GroupStateTimeout.NoTimeout)


def accept(now: float, log: str, progress: float, message: str, most: int) -> tuple[float, str]:
    """One update of a task's progress and log."""
    if now != -1 and (progress == -1 or progress > now):
        now = progress
    log = f"{log}\n{message}" if log else message
    if len(log) > most:
        log = log[-most:]
        log = log[log.find("\n") + 1 :]
    return now, log


def progress_batch(updates: DataFrame, most: int = 3000) -> DataFrame:
    """The same over all updates of a task at once."""

    def fold(key: tuple, u: pd.DataFrame) -> pd.DataFrame:
        now, log = 0.0, ""
        for r in u.sort_values("seq").itertuples():
            now, log = accept(now, log, r.progress, r.message, most)
        return pd.DataFrame({"task_id": [key[0]], "progress": [now], "log": [log]})

    return updates.groupBy("task_id").applyInPandas(fold, PROGRESS)


class Liveness(StatefulProcessor):
    """A worker is alive with each beat, and dead once no beat came for the timeout (event time)."""

    def __init__(self, timeout_ms: int):
        self.timeout = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = max(int(pd.Timestamp(t).timestamp() * 1000) for part in rows for t in part["ts"])
        old = self.last.get()[0] if self.last.exists() else 0
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.last.update((max(seen, old),))
        self.handle.registerTimer(max(seen, old) + self.timeout)
        yield pd.DataFrame({"worker": [key[0]], "alive": [True], "at_ms": [max(seen, old)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.last.get()[0] if self.last.exists() else 0
        self.last.clear()
        yield pd.DataFrame({"worker": [key[0]], "alive": [False], "at_ms": [at + self.timeout]})

    def close(self) -> None:
        pass


def liveness_stream(beats: DataFrame, timeout_ms: int = 120_000, delay: str = "10 seconds") -> DataFrame:
    """(worker, alive, at_ms) events of beats (worker, ts)."""
    own = beats.withWatermark("ts", delay)
    return own.groupBy("worker").transformWithStateInPandas(Liveness(timeout_ms), "worker long, alive boolean, at_ms long", "append", "EventTime")


def liveness(beats: DataFrame, now, timeout: str = "120 seconds", history: str = "30 minutes") -> DataFrame:
    """(worker, last, alive, recent) at a moment: alive with a beat within the timeout; recent counts beats of the history."""
    last = beats.groupBy("worker").agg(F.max("ts").alias("last"), F.count_if(F.col("ts") >= now - F.expr(f"INTERVAL {history}")).alias("recent"))
    return last.select("worker", "last", (F.col("last") >= now - F.expr(f"INTERVAL {timeout}")).alias("alive"), "recent")


class Cache(StatefulProcessor):
    """The latest value of each key (of equal times the smallest), for a time to live since its last write."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "value string, at timestamp", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        hit = self.value.exists()
        held = [(self.value.get()[1], self.value.get()[0])] if hit else []
        found = held + [(pd.Timestamp(t), v) for part in rows for t, v in zip(part["ts"], part["value"], strict=True)]
        at = max(pd.Timestamp(t) for t, _ in found)
        value = min(v for t, v in found if pd.Timestamp(t) == at)
        self.value.update((value, at.to_pydatetime()))
        yield pd.DataFrame({"key": [key[0]], "value": [value], "hit": [hit]})

    def close(self) -> None:
        pass


def ttl_cache(df: DataFrame, ttl_ms: int) -> DataFrame:
    """(key, value, hit) of writes (key, value, ts): hit if the key was held when the batch came (processing time)."""
    return df.groupBy("key").transformWithStateInPandas(Cache(ttl_ms), "key string, value string, hit boolean", "update", "ProcessingTime")


def valid_cache(writes: DataFrame, now, ttl: str) -> DataFrame:
    """The batch twin: the latest write of each key, if it is young enough at a moment."""
    return keep_latest(writes, "key", "ts", 1, "value").where(F.col("ts") >= now - F.expr(f"INTERVAL {ttl}"))


def retain_stream(source: DataFrame, table: Snapshots, checkpoint: str, ts: str, n: int) -> StreamingQuery:
    """The newest n rows of each of the table's keys."""

    def write(batch: DataFrame, i: int) -> None:
        table.merge(batch, i, lambda old, new: keep_latest(old.unionByName(new.select(old.columns)), table.keys[0], ts, n))

    return started(source, write, checkpoint)


EDGES, SOURCES, RANKS = "src long, dst long, weight double", "src long, dst long, source long", "id long, pagerank double"


@dataclass
class GraphTables:
    """One graph in a folder: edges with their weights, the sources of each edge as rows, and ranks of the nodes."""

    edges: Snapshots
    sources: Snapshots
    ranks: Snapshots

    @classmethod
    def at(cls, spark: SparkSession, folder: str, buckets: int = 32) -> GraphTables:
        return cls(*(Snapshots(spark, f"{folder}/{name}", schema, keys, buckets) for name, schema, keys in (("edges", EDGES, ["src", "dst"]), ("sources", SOURCES, ["src", "dst"]), ("ranks", RANKS, ["id"]))))


def graph_stream(source: DataFrame, graph: GraphTables, checkpoint: str, rank: bool = False, tol: float = 1e-6) -> StreamingQuery:
    """Edges of arriving documents (src, dst, weight, source) merged into one graph, in the buckets of the edges they touch.

    With rank, each micro-batch ends with PageRank, started from the ranks before it, which a small batch hardly moves.
    """
    from ..operators.graph import canonical, pagerank

    def write(batch: DataFrame, i: int) -> None:
        new = canonical(batch)
        graph.edges.merge(new.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), i, lambda old, b: old.unionByName(b).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
        graph.sources.merge(new.select("src", "dst", "source").distinct(), i, lambda old, b: old.unionByName(b).distinct())
        if rank:
            found = pagerank(graph.edges.read(i + 1), tol=tol, start=graph.ranks.read(i))
            graph.ranks.merge(found, i, lambda old, b: b)

    return started(source, write, checkpoint)


def drain(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there into a table in memory, and return that. For tests and small results."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    (w.option("checkpointLocation", checkpoint) if checkpoint else w).start().awaitTermination()
    return df.sparkSession.table(name)


def drain_files(df: DataFrame, folder: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there into a shared folder, and read the result.

    All rows in append mode, those of the last micro-batch in complete mode; in update mode the last row of each of the keys.
    """
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys of a row")
    out = f"{folder}/out"
    last = {"i": -1}

    def write(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/v={i}")
        last["i"] = i

    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark = df.sparkSession
    if last["i"] < 0:
        return spark.createDataFrame([], df.schema)
    if mode == "complete":
        return spark.read.schema(df.schema).parquet(f"{out}/v={last['i']}")
    rows = spark.read.schema(df.schema.add("v", "long") if "v" not in df.columns else df.schema).option("basePath", out).parquet(out)
    return (top_k(rows, keys, F.col("v"), 1).drop("rank") if mode == "update" else rows).drop("v")
