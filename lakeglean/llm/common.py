"""Helpers that the training-data operators share: tokens, splits, and Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one call of a batch function gets at most (a single longer text comes alone).
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id's decimal text, modulo k."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def py_fold(doc_id: int, k: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % k


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text as bytes); a null text is empty. Other columns are left out, whatever their names."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def hashed_share(df: DataFrame, key: Column, rows: int, total: int) -> DataFrame:
    """About `rows` of `total` rows, at most a tenth more: those with the smallest hashes of key, found without a sort."""
    if total <= rows:
        return df
    return df.where(F.shiftrightunsigned(F.xxhash64(key), 1) < int(rows / total * (1 << 63))).limit(rows + rows // 10 + 100)


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased; maximal runs without space, tab, line feed, vertical tab, form feed, return."""
    return text.lower().split()


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that `column` has about `most` bytes in each."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(lengths):
            yield batch.slice(start)


#: What operators keep in a Python worker between tasks, by their name; see claim().
CACHES: dict[str, Callable[[], None]] = {}


def claim(own: str | None = None) -> None:
    """Empty what other operators keep: workers serve one stage after the other, and one operator's memory is enough."""
    for name, clear in CACHES.items():
        if name != own:
            clear()


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)  # of glibc


def release() -> None:
    """Give freed memory back to the system: a worker that has built many arrays otherwise keeps the holes."""
    pa.default_memory_pool().release_unused()
    _TRIM(0)


def map_slices(df: DataFrame, func: Callable[[pa.RecordBatch], dict], schema: str, column: str = "text", most: int = SLICE_BYTES, own: str | None = None) -> DataFrame:
    """mapInArrow with bounded slices; func turns a record batch into columns named as in `schema`. own: the operator's cache."""
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(own)
        for part in slices(batches, column, most):
            yield record_batch(func(part), arrow)

    return df.mapInArrow(run, schema)


_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
    "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()), "array<double>": pa.list_(pa.float64()),
    "array<float>": pa.list_(pa.float32()),
}


def _arrow_schema(schema: str) -> pa.Schema:
    """Of a flat DDL string such as 'doc_id long, text binary'."""
    return pa.schema([(n, _TYPES[t]) for n, t in (f.split() for f in schema.split(","))])


def record_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = [c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(c, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
