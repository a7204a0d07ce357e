"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: the session's; where none is set, a temporary one in a local session, else an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


#: An estimated size in bytes that no real frame has.
ABSURD = 1 << 62


def cut(df: DataFrame) -> DataFrame:
    """df, computed and stored in the shared checkpoint folder.

    A checkpoint keeps the estimated size of its frame, and a join's is the product of its sides'. In a loop of joins the
    estimates so double their digits every round, until the driver is busy with multiplying them; an absurd one is forgotten.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    df = df.checkpoint()
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < ABSURD:
        return df
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), spark)


def tidy(spark: SparkSession) -> None:
    """Ask for a garbage collection: shuffle files and checkpoints that no frame needs are deleted after one only.

    A long job otherwise keeps the files of all its steps: a driver with enough memory may not collect before it ends.
    """
    spark.sparkContext._jvm.System.gc()


#: Bytes of an input that is dealt out to all cores at most.
SMALL = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """A small input that lies in few splits, over as many tasks as there are cores; a larger one as it is read."""
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > SMALL:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches.

    Self-loops, repeated edges and either direction are fine; rows with a null end are left out; no edges give no rows.
    Each round is two grouped minima and two joins on the node, so a node of any degree is a skewed join at most, and
    the number of rounds grows with the logarithm of the longest path. Edges are cut from their lineage every round.
    """
    e = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"), F.col(src).isNotNull().alias("s"), F.col(dst).isNotNull().alias("d"))
    e = cut(e.where("s and d").select("a", "b").distinct())
    loops = e.where("a = b").select("a", "b")
    e = e.where("a <> b")
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.unionByName(low.withColumnRenamed("m", "b")).distinct())
        tidy(e.sparkSession)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == before:
            break
        before = now
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component"))
    alone = loops.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
