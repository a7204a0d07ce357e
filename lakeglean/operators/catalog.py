"""Relational operators of the document catalog: joins, roll-ups, retention, ordering, set operations, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import cut


def rank_within(df: DataFrame, key: list[str] | str, score: Column, *ties: str, name: str = "rank") -> DataFrame:
    """1, 2, ... in each key by falling score, equal scores by the tie columns."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(score.desc(), *ties)))


def top_k(df: DataFrame, key: list[str] | str, score: Column, k: int, *ties: str) -> DataFrame:
    """The k best of each key; Spark cuts each task's rows before the shuffle."""
    return rank_within(df, key, score, *ties).where(F.col("rank") <= k)


def top1_per_group(df: DataFrame, group: str, score: str, *ties: str) -> DataFrame:
    return top_k(df, group, F.col(score), 1, *ties).drop("rank")


def keep_latest(df: DataFrame, key: str, ts: str, n: int, *ties: str) -> DataFrame:
    return top_k(df, key, F.col(ts), n, *ties).drop("rank")


def minmax_norm(df: DataFrame, key: str, score: str, tolerance: float = 1e-3) -> DataFrame:
    """Scores scaled to 0..1 in each key; 0 where all are as good as equal."""
    ends = df.groupBy(key).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    scaled = F.when(F.col("_hi") - F.col("_lo") < tolerance, 0.0).otherwise((F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return df.join(ends, key).withColumn(score, scaled).drop("_lo", "_hi")


def within_budget(df: DataFrame, key: str, order: list, tokens: str, budget: float, inclusive: bool = False) -> DataFrame:
    """Ranked rows while their tokens add up to the budget; inclusive keeps the row that crosses it."""
    run = F.sum(tokens).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    used = run - F.col(tokens) if inclusive else run
    return df.withColumn("_used", used).where(F.col("_used") < budget if inclusive else F.col("_used") <= budget).drop("_used")


def last_turns(turns: DataFrame, n: int, role: str | None = None) -> DataFrame:
    own = turns if role is None else turns.where(F.col("role") == role)
    return top_k(own, "conv_id", F.col("turn"), n).drop("rank")


def with_total(df: DataFrame, key: str) -> DataFrame:
    """Each row with the number of rows of its key, counted apart so that no key is gathered in one task."""
    return df.join(df.groupBy(key).agg(F.count("*").alias("total")), key)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))


def array_value_counts(df: DataFrame, col: str) -> DataFrame:
    return value_counts(df.select(F.explode(col).alias("v")).where(F.trim("v") != ""), "v")


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Page 1, 2, ... of the rows in a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def upsert(target: DataFrame, batch: DataFrame, key: str, latest: str) -> DataFrame:
    """Rows of target that the batch does not have, and the latest batch row of each key."""
    new = top_k(batch, key, F.col(latest), 1).drop("rank")
    return target.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def update_where(df: DataFrame, where: Column, set_: dict | None = None, remove: dict | None = None, add: dict | None = None) -> DataFrame:
    """Conditional update: set_ {col: value}; remove {col: element or None for null}; add {col: element}."""
    hit, cols = F.coalesce(where, F.lit(False)), {}
    for c, v in (set_ or {}).items():
        cols[c] = F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c))
    for c in {**(remove or {}), **(add or {})}:
        new = F.col(c)
        if c in (remove or {}):
            new = F.lit(None) if remove[c] is None else F.array_remove(new, remove[c])
        if c in (add or {}):
            new = F.array_append(new, F.lit(add[c]))
        cols[c] = F.when(hit, new).otherwise(F.col(c))
    return df.withColumns(cols)


def delete_where(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def not_in(df: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    return df.join(keep.select(key).distinct(), key, "left_anti")


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def merge_hits(steps: list[DataFrame], key: str) -> DataFrame:
    """Hits of several searches; of a repeated key the earliest step's stays."""
    all_ = union_all([s.withColumn("step", F.lit(i)) for i, s in enumerate(steps)])
    return top_k(all_, key, -F.col("step"), 1).drop("rank")


def with_cache(df: DataFrame, cache: DataFrame, key: Column, compute: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with value, cache to keep): a value is computed once for each key that the cache lacks."""
    keyed = df.withColumn("cache_key", key)
    missing = keyed.dropDuplicates(["cache_key"]).join(cache.select("cache_key"), "cache_key", "left_anti").select("cache_key", compute.alias("value"))
    full = cache.select("cache_key", "value").unionByName(missing)
    return keyed.join(full, "cache_key", "left"), full


def reuse_units(new: DataFrame, prev: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(units with chunk_ids where a finished unit with equal keys has them, chunk ids of old units that match none)."""
    done = prev.where((F.col("progress") == 1) & (F.coalesce(F.size("chunk_ids"), F.lit(0)) > 0))
    units = new.join(done.groupBy(*keys).agg(F.first("chunk_ids").alias("chunk_ids")), keys, "left").withColumn("reused", F.col("chunk_ids").isNotNull())
    stale = prev.join(new.select(*keys), keys, "left_anti").select(F.explode("chunk_ids").alias("chunk_id"))
    return units, stale


def doc_progress(tasks: DataFrame) -> DataFrame:
    """(doc_id, progress, status, priority, messages): -1 FAIL if all ended and some failed, 1 DONE if all succeeded, else the mean."""
    p = F.col("progress")
    agg = tasks.groupBy("doc_id").agg(
        F.avg(F.greatest(p, F.lit(0.0))).alias("mean"), F.bool_and((p == 1) | (p == -1)).alias("ended"), F.bool_or(p == -1).alias("failed"),
        F.max("priority").alias("priority"), F.array_join(F.array_sort(F.collect_set("message")), "\n").alias("messages"),
    )
    status = F.when(F.col("ended") & F.col("failed"), "FAIL").when(F.col("ended"), "DONE").otherwise("RUNNING")
    progress = F.when(F.col("ended") & F.col("failed"), -1.0).when(F.col("ended"), 1.0).otherwise(F.col("mean"))
    return agg.select("doc_id", progress.alias("progress"), status.alias("status"), "priority", "messages")


def apply_deltas(totals: DataFrame, deltas: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return totals.select(*keys, *cols).unionByName(deltas.select(*keys, *cols)).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in cols))


def invert_metadata(docs: DataFrame, id_col: str, props: Column) -> DataFrame:
    """(key, value, doc_id) of a map column, a row for each document; lists of ids are not gathered."""
    return docs.select(F.explode(props).alias("key", "value"), F.col(id_col).alias("doc_id")).where("value is not null")


def roll_up(nodes: DataFrame, max_depth: int = 64) -> DataFrame:
    """(id, ancestor, depth) of (id, parent): one self-join a level, until no row has a parent left.

    Each level is cut from its lineage: else the plan of a level holds the joins of all before, and their sides' broadcasts.
    """
    parents = nodes.select(F.col("id").alias("p"), F.col("parent").alias("pp"))
    level = nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"), F.col("parent").alias("next"))
    out = level
    for d in range(1, max_depth):
        level = cut(level.where("next is not null and next <> ancestor").join(parents, F.col("next") == F.col("p")).select("id", F.col("p").alias("ancestor"), F.lit(d).alias("depth"), F.col("pp").alias("next")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.select("id", "ancestor", "depth")


def infer_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, type, n): the class of most values of each text column; earlier in int, float, text, datetime, bool of equals."""
    v = F.col("value")
    is_int, is_float = v.rlike(r"^[+-]?[0-9]+$") & ~v.startswith("0"), v.rlike(r"^[+-]?[0-9.]{0,19}$") & ~v.startswith("0")
    kind = F.when(is_int, "int").when(is_float, "float").when(v.rlike(r"^(?i)(true|yes|false|no)$"), "bool").when(F.try_to_timestamp(v).isNotNull(), "datetime").otherwise("text")
    long = df.select(F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("string"))))).alias("column", "value")).where("value is not null")
    big = F.max(F.when(is_int & v.try_cast("long").isNull(), 1).otherwise(0))
    counts = long.withColumn("kind", kind).groupBy("column", "kind").agg(F.count("*").alias("n"), big.alias("big"))
    order = F.array_position(F.array(*map(F.lit, ("int", "float", "text", "datetime", "bool"))), F.col("kind"))
    top = counts.groupBy("column").agg(F.max(F.struct("n", (-order).alias("o"), "kind")).alias("t"), F.max("big").alias("big"))
    return top.select("column", F.when(F.col("big") == 1, "float").otherwise(F.col("t.kind")).alias("type"), F.col("t.n").alias("n"))


def rows_to_text(columns: list[str]) -> Column:
    """'name:value; ...' of a row, without nulls and empty values."""
    cells = F.array(*(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))) for c in columns))
    return F.array_join(F.array_compact(cells), "; ")


def order_by_array_mean(df: DataFrame, arr: str, *ties: str) -> DataFrame:
    mean = F.aggregate(arr, F.lit(0.0), lambda s, x: s + x) / F.size(arr)
    return df.orderBy(mean, *ties)


def get_row(df: DataFrame, key: str, value) -> DataFrame:
    """The row of an id; none if there is none."""
    return df.where(F.col(key) == F.lit(value))


def project(df: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """The key and those of the fields that the table has, each once, in the order asked for."""
    return df.select(*dict.fromkeys([key, *(f for f in fields if f in df.columns)]))


def row_dicts(df: DataFrame, key: str = "id") -> DataFrame:
    """(key, row): each row as a JSON object without its null fields."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("row"))


def delete_counted(df: DataFrame, where: Column):
    """(rows that stay, Observation whose get["deleted"] is the number of those gone, once the rows have been read)."""
    from pyspark.sql import Observation

    seen, gone = Observation(), F.coalesce(where, F.lit(False))
    return df.observe(seen, F.count_if(gone).alias("deleted")).where(~gone), seen


def remove_tags(df: DataFrame, col: str, tags: list[str]) -> DataFrame:
    """Without these tags; other rows and null lists as they were."""
    return df.withColumn(col, F.filter(col, lambda x: ~F.coalesce(x.isin(tags), F.lit(False))))


def rename_tag(df: DataFrame, col: str, old: str, new: str) -> DataFrame:
    """Where a list has the old tag, all of it goes and the new one is put last."""
    return update_where(df, F.array_contains(col, old), remove={col: old.strip()}, add={col: new})


def chunk_list(chunks: DataFrame, order: list, offset: int = 0, n: int = 128, key: str = "doc_id") -> DataFrame:
    """A page of each document's chunks in reading order: those at offset to offset + n, with their `place` from zero."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return chunks.withColumn("place", place).where((F.col("place") >= offset) & (F.col("place") < offset + n))


def list_chunks(chunks: DataFrame, where: Column, order: list, number: int = 1, size: int = 1024) -> DataFrame:
    """A search without a question: a page of the rows that pass, in a total order."""
    return page(chunks.where(F.coalesce(where, F.lit(False))), order, number, size)


#: Names of a cited chunk's fields, and the columns that may hold them, the first that is not null.
CITED = {
    "id": ("chunk_id", "id"), "content": ("content", "content_with_weight"), "document_id": ("doc_id", "document_id"), "document_name": ("docnm_kwd", "document_name"),
    "dataset_id": ("kb_id", "dataset_id"), "image_id": ("image_id", "img_id"), "positions": ("positions", "position_int"), "url": ("url",), "similarity": ("similarity",),
    "vector_similarity": ("vector_similarity",), "term_similarity": ("term_similarity",), "doc_type": ("doc_type_kwd",),
}


def format_hits(df: DataFrame) -> DataFrame:
    """Hits under the names of citations; a field that no column holds is null."""
    held = {name: [F.col(c) for c in columns if c in df.columns] for name, columns in CITED.items()}
    return df.select(*((F.coalesce(*c) if c else F.lit(None).cast("string")).alias(name) for name, c in held.items()))
