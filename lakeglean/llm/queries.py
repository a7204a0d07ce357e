"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avi, decontaminate, langid, lm, merkle, pack, pii, preference, quality, simhash, suffix, urlrules, whiten
from .common import fold, table


def op1_gru_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lm.score(docs, lm.train(docs.where(fold(F.col("doc_id"), 5) != 1)))
    return found.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 5) == 1, F.lit(False)))  # a null id is in neither part


def op2_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_avi_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.read_avi(avi.to_avi(table(spark, sf_dir, "documents")))


def op4_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicate(table(spark, sf_dir, "documents")).drop("starts", "ends")


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"))


def op7_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(preference.stale_reply_pairs(table(spark, sf_dir, "conversations")), "conv_id")


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs), redact=False)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.report(found)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))  # a null id is in neither part
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_midstate_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(fold(F.col("doc_id"), 2) == 0, F.translate("text", "\n", ""))
    return merkle.prove(table(spark, sf_dir, "documents"), changed)


def op12_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs.where(fold(F.col("doc_id"), 4) != 2)))
    return found.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)))


def op13_refined_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return whiten.whiten(rows, whiten.train(rows))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_gru_likelihood": op1_gru_likelihood,
    "op2_simhash_balls": op2_simhash_balls,
    "op3_avi_clips": op3_avi_clips,
    "op4_suffix_levels": op4_suffix_levels,
    "op5_vector_packing": op5_vector_packing,
    "op6_url_rules": op6_url_rules,
    "op7_preference_pairs": op7_preference_pairs,
    "op8_pii_spans": op8_pii_spans,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_midstate_manifest": op11_midstate_manifest,
    "op12_kneser_ney_langid": op12_kneser_ney_langid,
    "op13_refined_whitening": op13_refined_whitening,
}
ORACLES: dict[str, str] = {"op7_preference_pairs": preference.ORACLE, "op9_benchmark_decontamination": decontaminate.ORACLE, "op11_midstate_manifest": merkle.ORACLE}
