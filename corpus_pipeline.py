"""Clean, de-duplicate, decontaminate, redact and pack the documents table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeglean.llm import decontaminate, pack, pii, quality, simhash
from lakeglean.llm.common import table
from lakeglean.operators.components import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def own_md5() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def keyed(docs: DataFrame) -> DataFrame:
    """(row: all columns of docs, whatever their names; id; md5 of the text, null as empty)."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), own_md5().alias("md5"))


def chosen(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs with (left_semi) or without (left_anti) those whose id and text are in rows (doc_id, text_md5); ids may be null."""
    keys = rows.select(F.col("doc_id").alias("other"), F.col("text_md5").alias("other_md5")).distinct()
    return keyed(docs).join(keys, F.col("id").eqNullSafe(F.col("other")) & (F.col("md5") == F.col("other_md5")), how).select("row.*")


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, by id and text; rows alike in both share the decision, ids may be null.

    Null and empty texts are scored as texts without words; an empty table stays empty; columns keep their names and order.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return chosen(docs, quality.score(docs, model).where("predicted = 0"), "left_anti")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the text of the smallest doc_id stays, once (of texts with that id, the one of the smallest md5).

    Null and empty texts, and those without words, are copies of one another; a component whose ids are all null keeps one
    row; of rows repeated with id and text any one stays; an empty table stays empty; columns keep their names and order.
    """
    groups = cut(simhash.near_duplicate_texts(docs))
    kept = chosen(docs, groups.where("not first"), "left_anti")
    twice = cut(groups.where("first").groupBy("doc_id", "text_md5").agg(F.count("*").alias("n")).where("n > 1"))
    if twice.isEmpty():
        return kept
    one = keyed(chosen(docs, twice, "left_semi")).dropDuplicates(["id", "md5"]).select("row.*")
    return chosen(kept, twice, "left_anti").unionByName(one)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, by id and text.

    Null and empty texts have no words and stay; an empty table or benchmark drops nothing; columns keep their names and order.
    """
    hit = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return chosen(docs, hit.where("size(hits) > 0"), "left_anti")


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is named, not shown; n_chars follows the text. A document without any is as it was.

    Null texts stay null; rows alike in id and text get the same text; an empty table stays empty; columns keep their names and order.
    """
    found = pii.find(docs, pii.train(docs)).where("spans <> ''").select(F.col("doc_id").alias("other"), F.col("redacted").alias("shown"), F.col("text_md5").alias("other_md5")).dropDuplicates(["other", "other_md5"])
    both = keyed(docs).join(found, F.col("id").eqNullSafe(F.col("other")) & (F.col("md5") == F.col("other_md5")), "left")
    new = {"text": F.coalesce("shown", "row.text"), "n_chars": F.when(F.col("shown").isNull(), F.col("row.n_chars")).otherwise(F.length("shown").cast("long"))}
    return both.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences, as op5 returns them; null texts are empty, an empty table has no pieces."""
    return pack.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", of_quality),
    ("near_duplicates", without_copies),
    ("decontaminate", clean_of_benchmark),
    ("pii", redacted),
    ("pack", packed),
]

#: The learned stages have no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What each other stage keeps is stored before the next one uses it, which it does more than once."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
