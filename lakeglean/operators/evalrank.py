"""Ranking quality of run(query_id, chunk_id, rank) against qrels(query_id, chunk_id, rel). Queries without judgments are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _judged(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    own = run.join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    return own.where(F.col("rank") <= k).join(qrels, ["query_id", "chunk_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def ndcg(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    gain = lambda r: F.col("rel") / F.log2(F.col(r) + 1)
    best = qrels.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rel").desc()))).where(F.col("r") <= k)
    ideal = best.groupBy("query_id").agg(F.sum(gain("r")).alias("ideal"))
    return _judged(run, qrels, k).groupBy("query_id").agg(F.sum(gain("rank")).alias("dcg")).join(ideal, "query_id").select("query_id", (F.col("dcg") / F.col("ideal")).alias("ndcg"))


def average_precision(run: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    seen = F.sum((F.col("rel") > 0).cast("int")).over(Window.partitionBy("query_id").orderBy("rank"))
    total = qrels.groupBy("query_id").agg(F.count_if(F.col("rel") > 0).alias("n"))
    hits = _judged(run, qrels, k).withColumn("seen", seen)
    return hits.groupBy("query_id").agg(F.sum(F.when(F.col("rel") > 0, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("s")).join(total, "query_id").select("query_id", (F.col("s") / F.col("n")).alias("ap"))


def reciprocal_rank(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    first = F.min(F.when(F.col("rel") > 0, F.col("rank")))
    return _judged(run, qrels, k).groupBy("query_id").agg(F.coalesce(1 / first, F.lit(0.0)).alias("rr"))


def worst_queries(metrics: DataFrame, metric: str, n: int) -> DataFrame:
    """The n queries of the lowest value."""
    return metrics.orderBy(metric, "query_id").limit(n)
