"""Association-rule URL filtering: FP-growth mines token combinations from labelled URLs; pruned rules match by an inverted index.

URLs that a listed rule fits are labelled by it. Spark's FP-growth mines combinations of URL tokens with the label; rules
to a label with enough support and confidence stay, unless a rule on fewer tokens is as sure. A rule is filed under its
rarest token, so a URL is compared only with rules filed under one of its own tokens.

Edge cases: a null url, or one without `://`, has empty host and path and no tokens, and is allowed; equal urls and repeated
rows are judged alike; of tied rules the one with more tokens, then the later in order, is used; very long urls have many
tokens; without labelled urls there are no learned rules and the method allows; an empty table gives no rows; extra
columns are left out, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path) of the listed rules.
LISTED = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def listed_rule(host: Column, path: Column, rules: tuple = LISTED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct host labels, path parts (numbers as #) and query keys, marked by where they stand."""
    parts = lambda c, by, mark: F.transform(F.filter(F.split(c, by), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0])
    return F.array_distinct(
        F.concat(
            parts(host_of(url), r"\.", "h:"),
            parts(F.regexp_replace(path_of(url), "[0-9]+", "#"), "/", "p:"),
            F.transform(F.filter(keys, lambda x: x != ""), lambda x: F.concat(F.lit("q:"), x)),
        )
    )


@dataclass
class Rules:
    """Learned rules (antecedent array<string>, key, verdict, confidence, support), or None."""

    table: DataFrame | None


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> Rules:
    """From (items array<string>, verdict)."""
    labelled = labelled.where("verdict is not null and size(items) > 0")
    if labelled.isEmpty():
        return Rules(None)
    rows = labelled.select(F.concat("items", F.array(F.concat(F.lit("label:"), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows)
    rules = model.associationRules.where(F.col("consequent")[0].startswith("label:") & ~F.exists("antecedent", lambda x: x.startswith("label:")))
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 7, 100).alias("verdict"), "confidence", "support")
    counts = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    keyed = rules.withColumn("token", F.explode("antecedent")).join(counts, "token").groupBy("antecedent", "verdict", "confidence", "support").agg(F.min_by("token", F.struct("freq", "token")).alias("key"))
    # a rule goes if one on a part of its tokens is as sure of the same verdict
    part = keyed.select(F.col("antecedent").alias("part"), F.col("verdict"), F.col("confidence").alias("sure"), F.col("key").alias("token"))
    beaten = (
        keyed.withColumn("token", F.explode("antecedent"))
        .join(part, ["token", "verdict"])
        .where((F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0) & (F.col("sure") >= F.col("confidence")))
        .select("antecedent", "verdict")
        .distinct()
    )
    return Rules(keyed.join(beaten, ["antecedent", "verdict"], "left_anti"))


def judge(pages: DataFrame, listed: tuple = LISTED, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, learned): learned is the rule the method used, where no listed one fits."""
    url = F.col(url_col)
    rule, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    own = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), tokens(url).alias("items"))
    own = own.withColumns({"rule": rule, "listed": verdict})
    rules = mine(own.select("items", F.col("listed").alias("verdict")), min_support, min_confidence)
    if rules.table is None:
        return own.select("page_id", "host", "path", "rule", F.coalesce("listed", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("learned"))
    # distinct token lists without a listed verdict are matched once each
    open_ = own.where("listed is null").select("items").distinct()
    hits = open_.withColumn("key", F.explode("items")).join(rules.table, "key").where(F.size(F.array_except("antecedent", "items")) == 0)
    best = hits.groupBy("items").agg(F.max(F.struct("confidence", "support", F.size("antecedent").alias("n"), F.array_join("antecedent", " ").alias("learned"), "verdict")).alias("best"))
    settled = own.where("listed is not null").select("page_id", "host", "path", "rule", F.col("listed").alias("verdict"), F.lit(None).cast("string").alias("learned"))
    joined = own.where("listed is null").join(best, "items", "left")
    return settled.unionByName(joined.select("page_id", "host", "path", "rule", F.coalesce("best.verdict", F.lit("allow")).alias("verdict"), F.col("best.learned").alias("learned")))
