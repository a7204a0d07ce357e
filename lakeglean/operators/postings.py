"""Full-text operators: postings, presence and BM25 scores, phrases, term weights, query building, batch retrieval pieces.

A query table (query_id, text) is answered as a whole: terms of queries meet terms of documents in one equi-join, so the
work follows the matching postings. Frequent terms are skewed keys of that join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_cjk_query, space_latin_cjk, strip_question_words, to_half_width, tokens

K1, B = 1.2, 0.75


def build_postings(chunks: DataFrame, id_col: str, fields: dict[str, Column]) -> DataFrame:
    """(term, chunk_id, field, tf, dl): how often each field of a chunk has a term, and the field's length."""
    rows = chunks.select(F.col(id_col).alias("chunk_id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), tokens(c).alias("w")) for f, c in fields.items()))).alias("x"))
    rows = rows.select("chunk_id", "x.field", F.size("x.w").cast("long").alias("dl"), F.explode("x.w").alias("term"))
    return rows.groupBy("term", "chunk_id", "field").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def statistics(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(field, term, df) and (field, n, avgdl): chunks with the term; chunks with any term, their mean length."""
    df = postings.groupBy("field", "term").agg(F.count("*").alias("df"))
    totals = postings.groupBy("field").agg(F.countDistinct("chunk_id").alias("n"), F.sum("tf").alias("len")).select("field", "n", (F.col("len") / F.col("n")).alias("avgdl"))
    return df, totals


def query_terms(queries: DataFrame, id_col: str = "query_id", text: str = "text", most: int = 256) -> DataFrame:
    """(query_id, term): the distinct terms among the first `most` tokens."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(F.slice(tokens(F.col(text)), 1, most))).alias("term"))


def presence_score(df: Column, n: Column) -> Column:
    """The score of a term that is there, however often: its idf over that of a term of one document."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) / F.log(1 + (n - 0.5) / 1.5)


def bm25_score(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def match(terms: DataFrame, postings: DataFrame, how: str = "presence", boosts: dict[str, float] | None = None) -> DataFrame:
    """(query_id, chunk_id, field, hits, score) of queries (query_id, term) against postings, each field by its boost."""
    _, totals = statistics(postings)
    own = postings.join(terms.select("term").distinct(), "term", "left_semi")  # only what is asked for is counted and shuffled
    df, _ = statistics(own)
    joined = terms.join(own, "term").join(df, ["field", "term"]).join(F.broadcast(totals), "field")  # a row for each field
    score = presence_score(F.col("df"), F.col("n")) if how == "presence" else bm25_score(*map(F.col, ("tf", "dl", "df", "n", "avgdl")))
    if boosts:
        names = F.create_map(*(x for f, b in boosts.items() for x in (F.lit(f), F.lit(float(b)))))
        score = score * F.coalesce(names[F.col("field")], F.lit(1.0))
    return joined.groupBy("query_id", "chunk_id", "field").agg(F.count("*").alias("hits"), F.sum(score).alias("score"))


def combine_fields(scored: DataFrame, mode: str = "max") -> DataFrame:
    """(query_id, chunk_id, score): the best field, or the sum of all."""
    return scored.groupBy("query_id", "chunk_id").agg((F.max if mode == "max" else F.sum)("score").alias("score"), F.max("hits").alias("hits"))


def min_should_match(scored: DataFrame, terms: DataFrame, share: float) -> DataFrame:
    """Rows that have at least floor(share * terms) of their query's terms, one at least."""
    need = terms.groupBy("query_id").agg(F.greatest(F.floor(F.count("*") * share), F.lit(1)).alias("need"))
    return scored.join(need, "query_id").where("hits >= need").drop("need")


def term_pairs(chunks: DataFrame, id_col: str, text: str, slop: int = 0, asked: DataFrame | None = None) -> DataFrame:
    """(chunk_id, first, second, n): how many places of a first term have the second within 1 + slop after them.

    With asked (first, second, ...) only those pairs are counted and shuffled.
    """
    t = F.col("t")
    nexts = [F.slice(t, 2 + i, F.greatest(F.size(t), F.lit(1))).alias(f"n{i}") for i in range(1 + slop)]
    rows = chunks.select(F.col(id_col).alias("chunk_id"), tokens(F.col(text)).alias("t")).select("chunk_id", F.explode(F.arrays_zip(t.alias("first"), *nexts)).alias("x"))
    after = F.array_distinct(F.array_compact(F.array(*(F.col(f"x.n{i}") for i in range(1 + slop)))))
    pairs = rows.select("chunk_id", F.col("x.first").alias("first"), F.explode(after).alias("second"))
    if asked is not None:
        pairs = pairs.join(asked.select("first", "second").distinct(), ["first", "second"], "left_semi")
    return pairs.groupBy("chunk_id", "first", "second").agg(F.count("*").alias("n"))


def phrase_match(phrases: DataFrame, pairs: DataFrame) -> DataFrame:
    """(phrase_id, chunk_id, n) of two-term phrases (phrase_id, first, second) that chunks have as term_pairs.

    Phrases meet pairs by both terms at once, so a frequent term alone makes no rows.
    """
    return phrases.select("phrase_id", "first", "second").join(pairs, ["first", "second"]).groupBy("phrase_id", "chunk_id").agg(F.sum("n").alias("n"))


def bigrams(queries: DataFrame, id_col: str, text: str) -> DataFrame:
    """(query_id, i, first, second) of adjacent terms."""
    t = tokens(F.col(text))
    return queries.select(F.col(id_col).alias("query_id"), F.posexplode(F.arrays_zip(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))).alias("first"), F.slice(t, 2, F.size(t)).alias("second"))).alias("i", "x")).select("query_id", "i", "x.first", "x.second")


def idf10(s: Column, n: float) -> Column:
    return F.log10(10 + (n - s + 0.5) / (s + 0.5))


def term_weights(terms: DataFrame, freq: DataFrame, *within: str) -> DataFrame:
    """terms (query_id, term, ...) with `weight`, summing to 1 for each query (and `within`), from (term, freq, df) of the corpus.

    Numbers weigh double, one or two letters a hundredth; unknown words have count 10 and 3 documents.
    """
    kind = F.when(F.col("term").rlike("^[0-9,.]{2,}$"), 2.0).when(F.col("term").rlike("^[a-z]{1,2}$"), 0.01).otherwise(1.0)
    w = (0.3 * idf10(F.greatest(F.coalesce("freq", F.lit(10)), F.lit(10)), 1e7) + 0.7 * idf10(F.coalesce(F.col("df") + 3, F.lit(3)), 1e9)) * kind
    raw = terms.join(freq, "term", "left").select(*terms.columns, w.alias("raw"))
    return raw.withColumn("weight", F.col("raw") / F.sum("raw").over(Window.partitionBy("query_id", *within))).drop("raw")


def query_rows(queries: DataFrame, freq: DataFrame, synonyms: DataFrame, most: int = 256, short: int = 32) -> DataFrame:
    """(query_id, kind, text, weight) of queries (query_id, text): what a full-text search looks for, as rows.

    Questions in words: each of the first `most` tokens is a term by its weight, its synonyms (term, synonym) weigh a
    quarter of it, and two terms in turn are a phrase of twice the greater weight; single letters and digits go. Others
    (three words or fewer, or mostly not of Latin letters): the first `short` tokens are terms, weighed within their
    segment (a word, or Latin words in turn), synonyms weigh a fifth, and the terms of a segment of several are looked
    for near each other (kind near, within two places) by 1.5. A null or empty text has no rows.
    """
    plain = F.trim(F.regexp_replace(to_half_width(F.lower(space_latin_cjk(F.col("text")))), r"[ :|\r\n\t,，。？?/`!！&^%()\[\]{}<>]+", " "))
    d = queries.select("query_id", strip_question_words(plain).alias("t"))
    d = d.withColumn("cjk", is_cjk_query(F.trim("t"))).withColumn("t", strip_question_words(F.col("t")))
    words = d.select("query_id", "cjk", F.posexplode(F.filter(F.split("t", " "), lambda x: x != "")).alias("p", "word"))
    w = Window.partitionBy("query_id").orderBy("p")
    latin = F.col("word").rlike("[a-z]$")
    words = words.withColumn("joins", F.coalesce(latin & F.lag(latin).over(w), F.lit(False)))
    words = words.withColumn("seg", F.sum((~F.col("joins")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = words.select("query_id", "cjk", "p", F.when(F.col("cjk"), F.col("seg")).otherwise(0).alias("seg"), F.posexplode(tokens(F.col("word"))).alias("q", "term"))
    own = own.where(F.col("cjk") | ~F.col("term").rlike("^[a-z0-9]$"))
    by = Window.partitionBy("query_id").orderBy("p", "q")
    own = own.withColumn("i", F.row_number().over(by)).where(F.col("i") <= F.when(F.col("cjk"), short).otherwise(most)).drop("p", "q")
    own = term_weights(own, freq, "seg")
    ordered = Window.partitionBy("query_id").orderBy("i")
    paired = own.where("not cjk").select("query_id", "weight", "term", F.lead("term").over(ordered).alias("next"), F.lead("weight").over(ordered).alias("w2"))
    phrases = paired.where("next is not null").select("query_id", F.lit("phrase").alias("kind"), F.concat_ws(" ", "term", "next").alias("text"), (2 * F.greatest("weight", "w2")).alias("weight"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "term"))), lambda x: x["term"]), " ")
    near = own.where("cjk").groupBy("query_id", "seg").agg(F.count("*").alias("n"), texts.alias("text")).where("n > 1")
    syn = own.join(synonyms, "term").select("query_id", F.lit("syn").alias("kind"), F.col("synonym").alias("text"), (F.col("weight") / F.when(F.col("cjk"), 5).otherwise(4)).alias("weight"))
    terms = own.select("query_id", F.lit("term").alias("kind"), F.col("term").alias("text"), "weight")
    return terms.unionByName(syn).unionByName(phrases).unionByName(near.select("query_id", F.lit("near").alias("kind"), "text", F.lit(1.5).alias("weight")))


def token_similarity(weights: DataFrame, presence: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, tksim): the share of the query's weight that the chunk's terms (term, chunk_id) have.

    With candidates (query_id, chunk_id) only those are looked at, so that frequent terms make no rows for other chunks.
    """
    total = weights.groupBy("query_id").agg(F.sum("weight").alias("total"))
    if candidates is None:
        met = weights.join(presence, "term")
    else:
        met = candidates.select("query_id", "chunk_id").join(weights, "query_id").join(presence, ["term", "chunk_id"])
    hit = met.groupBy("query_id", "chunk_id").agg(F.sum("weight").alias("hit"))
    return hit.join(total, "query_id").select("query_id", "chunk_id", ((F.col("hit") + 1e-9) / (F.col("total") + 1e-9)).alias("tksim"))


def expand_synonyms(terms: DataFrame, synonyms: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, term, source, weight): each term with weight 1, and up to `most` of its synonyms (term, synonym) with 1/4."""
    ranked = synonyms.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy("synonym"))).where(F.col("r") <= most)
    more = terms.join(ranked, "term").select("query_id", F.col("synonym").alias("term"), F.col("term").alias("source"), F.lit(0.25).alias("weight"))
    return terms.select("query_id", "term", F.col("term").alias("source"), F.lit(1.0).alias("weight")).unionByName(more)


def paragraph_terms(weights: DataFrame, most: int = 30) -> DataFrame:
    """The heaviest terms of each text, for a search of texts like it."""
    w = Window.partitionBy("query_id").orderBy(F.col("weight").desc(), "term")
    return weights.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")
