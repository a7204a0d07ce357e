"""Operators of a service's own tables: statistics by day and state, facets, sizes, sections, continuations, histories, chunk upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import n_tokens, units
from .catalog import top_k, update_where


def daily_stats(rows: DataFrame, ts: str, user: str, sums: dict[str, str], means: dict[str, str] | None = None, counts: dict[str, Column] | None = None, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """(day, pv, uv, …) by day of ts: rows, exact users, sums and means {name: column}, counts {name: condition}; since <= ts < until.

    Rows without a time are left out; days without rows have none; a sum of nulls is null.
    """
    own = rows.where(F.col(ts).isNotNull())
    own = own if since is None else own.where(F.col(ts) >= since)
    own = own if until is None else own.where(F.col(ts) < until)
    aggs = [F.count("*").alias("pv"), F.countDistinct(user).alias("uv")]
    aggs += [F.sum(c).alias(n) for n, c in sums.items()] + [F.avg(c).alias(n) for n, c in (means or {}).items()] + [F.count_if(c).alias(n) for n, c in (counts or {}).items()]
    return own.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(*aggs)


def speed(tokens: Column, seconds: Column) -> Column:
    """Tokens a second, a tenth of a second at least."""
    return tokens / (seconds + 0.1)


def status_counts(docs: DataFrame, key: str, status: str, states: dict[str, str], cancelled: Column | None = None) -> DataFrame:
    """(key, a count for each state {name: value}, cancelled): a cancelled row counts as that alone; a null state as none."""
    gone = F.lit(False) if cancelled is None else F.coalesce(cancelled, F.lit(False))
    aggs = [F.count_if(~gone & (F.col(status) == v)).alias(n) for n, v in states.items()]
    return docs.groupBy(key).agg(*aggs, F.count_if(gone).alias("cancelled"))


def facets(docs: DataFrame, columns: list[str], where: Column | None = None) -> DataFrame:
    """(facet, value, n) of several columns over the same rows, in one pass; null values count as such."""
    own = docs if where is None else docs.where(where)
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")
    return own.select(each).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def total_size(docs: DataFrame, size: str, key: str | None = None, where: Column | None = None) -> DataFrame:
    """Summed sizes of the rows that count, 0 where none do; of each key, or one row."""
    counted = F.col(size) if where is None else F.when(where, F.col(size))
    own = docs.groupBy(key) if key else docs.groupBy()
    return own.agg(F.coalesce(F.sum(counted), F.lit(0)).alias("size"))


def sections(lines: DataFrame, key: str, order: str, opens: Column) -> DataFrame:
    """lines with `section`: how many lines so far open one (such as a heading of the pivot level or above)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.sum(F.coalesce(opens, F.lit(False)).cast("long")).over(w))


def fold_continuations(lines: DataFrame, key: str, order: str, text: str, whole: Column, forward: bool = False, sep: str = "\n") -> DataFrame:
    """(key, pair, body): a line that is not whole goes on the last whole one before it, or (forward) before the next one.

    Lines before the first whole one, or (forward) after the last, are a pair of their own; null texts are left out of the body.
    """
    w = Window.partitionBy(key).orderBy(order)
    mark = F.coalesce(whole, F.lit(False)).cast("long")
    reach = w.rowsBetween(Window.unboundedPreceding, -1) if forward else w.rowsBetween(Window.unboundedPreceding, 0)
    own = lines.withColumn("pair", F.coalesce(F.sum(mark).over(reach), F.lit(0)))
    body = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"])
    return own.groupBy(key, "pair").agg(F.array_join(body, sep).alias("body"))


def fit_history(turns: DataFrame, most: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """turns (key, order, role, text) that fit `most` tokens: all if they are fewer, else system turns and the last one, else those cut.

    If the first of these is over 80 % of both ends, it keeps the tokens that the last leaves; else the last one keeps as many
    as it leaves itself, or `most` if it has more. A cut text is its tokens with blanks between. Null texts have no tokens.
    """
    ends = Window.partitionBy(key)
    own = turns.withColumn("_n", n_tokens(F.col("text")))
    own = own.withColumn("_all", F.sum("_n").over(ends)).withColumn("_last", F.col(order) == F.max(order).over(ends))
    own = own.where((F.col("_all") < most) | (F.col("role") == "system") | F.col("_last"))
    own = own.withColumn("_kept", F.sum("_n").over(ends)).withColumn("_first", F.col(order) == F.min(order).over(ends))
    a = F.max(F.when(F.col("_first"), F.col("_n"))).over(ends)
    b = F.max(F.when(F.col("_last"), F.col("_n"))).over(ends)
    own = own.withColumn("_a", a).withColumn("_b", b).withColumn("_over", F.col("_kept") >= most)
    heavy = F.col("_a") > 0.8 * (F.col("_a") + F.col("_b"))
    room = most - F.col("_b")
    left = F.when(F.col("_over") & heavy & F.col("_first"), F.when(room >= 0, room).otherwise(F.greatest(F.col("_a") + room, F.lit(0))))
    left = left.when(F.col("_over") & ~heavy & F.col("_last"), F.when(room >= 0, room).otherwise(F.lit(most)))
    text = F.when(left.isNotNull() & (F.col("_n") > left), F.array_join(F.slice(units(F.col("text")), F.lit(1), left.cast("int")), " ")).otherwise(F.col("text"))
    return own.withColumn("text", text).select(turns.columns)


def leaf_folders(files: DataFrame) -> DataFrame:
    """(id) of folders (files: id, parent_id, type) that have no folder in them."""
    folders = files.where("type = 'folder'")
    inner = folders.where("parent_id <> id").select(F.col("parent_id").alias("id")).distinct()
    return folders.select("id").join(inner, "id", "left_anti")


#: What a chunk has where it says nothing.
DEFAULTS = {"available_int": 1, "removed_kwd": "N", "_order_id": 0}


def upsert_chunks(target: DataFrame, batch: DataFrame, latest: str, defaults: dict | None = None) -> DataFrame:
    """target with the rows of batch (id, …) put in by id, the latest of each id in the batch.

    Nulls get the defaults; columns that target does not have go into its `extra` map as text; group_id is the metadata's
    _group_id, else doc_id; docnm_kwd the metadata's _title, if it has one (metadata: map<string,string>, may be absent).
    """
    new = top_k(batch.where("id is not null"), "id", F.col(latest), 1).drop("rank")
    known = [c for c in new.columns if c in target.columns]
    more = [c for c in new.columns if c not in target.columns and c != latest]
    cols = {c: F.col(c) for c in known}
    if "extra" in target.columns:
        own = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in more)), lambda x: x["v"].isNotNull())) if more else F.create_map().cast("map<string,string>")
        cols["extra"] = F.map_concat(F.coalesce("extra", F.create_map().cast("map<string,string>")), own) if "extra" in new.columns else own
    if "metadata" in new.columns:
        if "group_id" in target.columns:
            cols["group_id"] = F.coalesce(F.col("metadata")["_group_id"], F.col("doc_id").cast("string"))
        if "docnm_kwd" in target.columns:
            cols["docnm_kwd"] = F.coalesce(F.col("metadata")["_title"], cols.get("docnm_kwd", F.lit(None).cast("string")))
    for c, v in (DEFAULTS if defaults is None else defaults).items():
        if c in target.columns:
            cols[c] = F.coalesce(cols[c], F.lit(v)) if c in cols else F.lit(v)
    kinds = {f.name: f.dataType for f in target.schema}
    filled = new.select(*(cols.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in target.columns))
    return target.join(filled.select("id"), "id", "left_anti").select(target.columns).unionByName(filled)


def update_metadata(df: DataFrame, doc_id: object, metadata: dict[str, str]) -> DataFrame:
    """Rows of a document with new metadata, and group_id and docnm_kwd as it says."""
    set_: dict = {"metadata": F.create_map(*(F.lit(x) for kv in metadata.items() for x in kv)).cast("map<string,string>")}
    if "group_id" in df.columns:
        set_["group_id"] = metadata.get("_group_id", str(doc_id))
    if "docnm_kwd" in df.columns and "_title" in metadata:
        set_["docnm_kwd"] = metadata["_title"]
    return update_where(df, F.col("doc_id") == F.lit(doc_id), set_)


def merge_extractions(items: DataFrame, seq: str = "seq") -> DataFrame:
    """(doc_id, class, text, attributes): items (…, attributes map<string,array<string>>) of one class and text as one.

    A later item's single value takes the place of an earlier one; lists (of two or more) are put one after the other, each value once.
    """
    one = items.select("doc_id", "class", "text", seq, F.explode("attributes").alias("k", "v"))
    by = Window.partitionBy("doc_id", "class", "text", "k").orderBy(seq)
    one = one.withColumn("list", F.size("v") > 1).withColumn("any_list", F.max("list").over(Window.partitionBy("doc_id", "class", "text", "k")))
    values = one.withColumn("r", F.row_number().over(by)).groupBy("doc_id", "class", "text", "k").agg(
        F.max("any_list").alias("any_list"), F.max_by("v", "r").alias("last"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]))).alias("all"),
    )
    whole = values.groupBy("doc_id", "class", "text").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", F.when(F.col("any_list"), F.col("all")).otherwise(F.col("last")).alias("v"))))).alias("attributes"))
    return items.select("doc_id", "class", "text").distinct().join(whole, ["doc_id", "class", "text"], "left")


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns as the types that were voted for them (int, float, bool, datetime, text); what does not parse is null."""
    of = {"int": lambda c: c.try_cast("long"), "float": lambda c: c.try_cast("double"), "bool": lambda c: F.when(F.lower(c).isin("true", "yes"), True).when(F.lower(c).isin("false", "no"), False), "datetime": lambda c: c.try_cast("timestamp"), "text": lambda c: c}
    return reduce(lambda d, kv: d.withColumn(kv[0], of[kv[1]](F.trim(F.col(kv[0])))), types.items(), df)
