"""Tables that streams keep: rows in buckets of their key, of which a micro-batch rewrites only those it touches.

A folder has data/v=<batch>/bucket=<b> and manifest/v=<batch>, one small file that names the batch whose data holds each bucket
and whose rename commits the batch. A batch that failed, or that runs again after a restart, starts from the last manifest
before it and overwrites its own data, so each batch counts once. Readers follow the last manifest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "bucket int, at long, v long"


class Snapshots:
    """Rows of `schema`, bucketed by the hash of `keys`, in a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], buckets: int = 32):
        self.spark, self.folder, self.schema, self.keys, self.buckets = spark, folder, schema, keys, buckets

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """{bucket: batch that wrote it} of the last committed batch (before another one); one row a bucket."""
        if not self._exists(f"{self.folder}/manifest"):
            return {}
        every = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest").where(F.lit(True) if before is None else F.col("v") < before)
        last = every.agg(F.max("v")).head()[0]
        return {} if last is None else {r.bucket: r.at for r in every.where(F.col("v") == last).collect() if r.bucket >= 0}

    def read(self, before: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The table, or some buckets of it."""
        paths = [f"{self.folder}/data/v={v}/bucket={b}" for b, v in sorted(self.manifest(before).items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def merge(self, batch: DataFrame, number: int, how: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Put how(rows of the touched buckets, batch) in place of those rows, as batch `number`."""
        batch = batch.persist()
        try:
            touched = {r.bucket for r in self.bucketed(batch).select("bucket").distinct().collect()}
            names = [f.split()[0] for f in self.schema.split(", ")]
            old = {b: v for b, v in self.manifest(number).items() if b not in touched}
            data = f"{self.folder}/data/v={number}"
            if touched:
                new = self.bucketed(how(self.read(number, touched), batch).select(*names))
                new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
                found = self.spark.read.schema(f"{self.schema}, bucket int").parquet(data).select("bucket").distinct().collect()
                old |= {r.bucket: number for r in found}
            rows = sorted(old.items()) or [(-1, -1)]  # an empty table has a manifest too
            self.spark.createDataFrame(rows, "bucket int, at long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/v={number}")
        finally:
            batch.unpersist()
