"""Hybrid retrieval of a whole query table as one plan: text, vectors, fusion, boosts, re-ranking, pages, citations."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, norm, strip_question_words, tokens
from ..operators import postings as P
from ..operators import search as S
from ..operators import vectors as V
from ..operators.catalog import rank_within, top_k
from ..operators.components import cut


@dataclass
class Config:
    page: int = 1
    page_size: int = 10
    vector_weight: float = 0.95
    text_candidates: int = 1024
    vector_candidates: int = 1024
    min_share: float = 0.3
    min_sim: float = 0.1
    threshold: float = 0.0
    #: Share of terms and least similarity of the second pass.
    relaxed: tuple[float, float] = (0.1, 0.17)
    boosts: dict[str, float] = field(default_factory=lambda: {"title": 10.0, "content": 2.0})

    @property
    def window(self) -> int:
        """Rows that are re-ranked: 64, rounded up to whole pages."""
        return math.ceil(64 / self.page_size) * self.page_size


def fuse(text: DataFrame | None, vector: DataFrame | None, weight: float) -> DataFrame:
    """(query_id, chunk_id, score): text (…, score) and vector (…, sim) hits together; a side of no weight is left out of the plan."""
    if weight <= 0 or vector is None:
        return text.select("query_id", "chunk_id", F.col("score"))
    if weight >= 1 or text is None:
        return vector.select("query_id", "chunk_id", F.col("sim").alias("score"))
    both = text.select("query_id", "chunk_id", F.col("score").alias("ts")).join(vector.select("query_id", "chunk_id", "sim"), ["query_id", "chunk_id"], "full")
    return both.select("query_id", "chunk_id", (F.coalesce("ts", F.lit(0.0)) * (1 - weight) + F.coalesce("sim", F.lit(0.0)) * weight).alias("score"))


def fuse_text_first(text: DataFrame, vectors: DataFrame, queries: DataFrame, weight: float, candidates: int, min_sim: float) -> DataFrame:
    """The best text hits, those with enough similarity among them, scored by both; vector-only hits never appear."""
    capped = top_k(text, "query_id", F.round("score", 9), candidates, "chunk_id")
    both = capped.join(vectors.select("chunk_id", F.col("vector").alias("cv")), "chunk_id").join(queries.select("query_id", F.col("vector").alias("qv")), "query_id")
    both = both.withColumn("sim", cosine(F.col("qv"), F.col("cv"))).where(F.col("sim") >= min_sim)
    return both.select("query_id", "chunk_id", (F.col("score") * (1 - weight) + F.col("sim") * weight).alias("score"))


def boost_static(scored: DataFrame, chunks: DataFrame, column: str, scale: float) -> DataFrame:
    return scored.join(chunks.select("chunk_id", F.col(column).alias("_b")), "chunk_id", "left").withColumn("score", F.col("score") + F.coalesce("_b", F.lit(0)) / scale).drop("_b")


def rank_feature(query_tags: DataFrame, chunk_tags: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, chunk_id, fea): ten times the cosine of tag weights (id, tag, w) of candidates (query_id, chunk_id) that share a tag.

    Only candidates are looked at: a tag that all chunks have makes no pairs of its own.
    """
    qn = query_tags.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qn"))
    cn = chunk_tags.groupBy("chunk_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("cn"))
    asked = candidates.select("query_id", "chunk_id").distinct().join(query_tags.withColumnRenamed("w", "qw"), "query_id")
    dot = asked.join(chunk_tags, ["chunk_id", "tag"]).groupBy("query_id", "chunk_id").agg(F.sum(F.col("qw") * F.col("w")).alias("dot"))
    return dot.join(qn, "query_id").join(cn, "chunk_id").select("query_id", "chunk_id", (10 * F.col("dot") / (F.col("qn") * F.col("cn"))).alias("fea"))


def rerank(candidates: DataFrame, tksim: DataFrame, sim: DataFrame, fea: DataFrame | None, tw: float = 0.3, vw: float = 0.7) -> DataFrame:
    """(…, tksim, vsim, score): vw * similarity + tw * token similarity (+ feature); a query without any similarity goes by tokens."""
    c = candidates.select("query_id", "chunk_id").join(tksim, ["query_id", "chunk_id"], "left").join(sim.select("query_id", "chunk_id", F.col("sim").alias("vsim")), ["query_id", "chunk_id"], "left")
    c = c.na.fill(0.0, ["tksim", "vsim"])
    none = c.groupBy("query_id").agg((F.max(F.abs("vsim")) == 0).alias("none"))
    c = c.join(none, "query_id").withColumn("score", F.when(F.col("none"), F.col("tksim")).otherwise(vw * F.col("vsim") + tw * F.col("tksim"))).drop("none")
    if fea is not None:
        c = c.join(fea, ["query_id", "chunk_id"], "left").withColumn("score", F.col("score") + F.coalesce("fea", F.lit(0.0))).drop("fea")
    return c


def rerank_external(scored: DataFrame, external: DataFrame, tw: float = 0.3, vw: float = 0.7) -> DataFrame:
    """tw * token similarity + vw * a score (query_id, chunk_id, ext) from elsewhere."""
    return scored.join(external, ["query_id", "chunk_id"], "left").withColumn("score", tw * F.col("tksim") + vw * F.coalesce("ext", F.lit(0.0))).drop("ext")


def paged(scored: DataFrame, cfg: Config) -> DataFrame:
    """One page of each query, in one order over all its hits at or over the threshold."""
    ranked = rank_within(scored.where(F.col("score") >= cfg.threshold), "query_id", F.round("score", 9), "chunk_id")
    return ranked.where((F.col("rank") > (cfg.page - 1) * cfg.page_size) & (F.col("rank") <= cfg.page * cfg.page_size))


NO_SYNONYMS = "term string, synonym string"


def retrieve(
    queries: DataFrame, chunks: DataFrame, cfg: Config | None = None, fields: dict[str, Column] | None = None, where: Column | None = None, payload: tuple[str, ...] = (), synonyms: DataFrame | None = None,
) -> DataFrame:
    """(query_id, rank, chunk_id, score, tksim, vsim, total, payload columns) of queries (query_id, text, vector) on chunks (chunk_id, text, vector).

    Queries become weighted terms, synonyms and phrases, which run against the chunks that `where` admits (document
    frequencies are of all chunks), beside the nearest vectors. A query that finds nothing is asked again with a smaller
    share of terms and the similarity of cfg.relaxed. What both find is fused, the best are scored again by the weight of
    the query's terms they have and by cosine. total: the re-ranked hits at or over the threshold, of which a page is returned.
    """
    cfg = cfg or Config()
    pool = chunks if where is None else chunks.where(where)
    fields = fields or {"content": F.col("text")}
    terms = cut(P.query_terms(queries))
    freq = cut(S.frequencies(terms, chunks, F.col("text")))
    rows = cut(P.query_rows(queries.select("query_id", "text"), freq, synonyms if synonyms is not None else queries.sparkSession.createDataFrame([], NO_SYNONYMS)))

    def once(queries: DataFrame, rows: DataFrame, share: float, least_sim: float) -> tuple[DataFrame, DataFrame]:
        sim = cut(V.knn(queries, pool, cfg.vector_candidates, least_sim))
        text = S.search(rows, pool, fields, cfg.text_candidates, boosts=cfg.boosts, share=share, digits=9, corpus=chunks if where is not None else None, keep=sim)
        return cut(top_k(fuse(text, sim, cfg.vector_weight), "query_id", F.round("score", 9), cfg.window * cfg.page, "chunk_id").drop("rank")), sim

    first, sim = once(queries, rows, cfg.min_share, cfg.min_sim)
    missed = cut(queries.join(first.select("query_id").distinct(), "query_id", "left_anti"))
    if not missed.isEmpty():
        more, near = once(missed, rows.join(missed.select("query_id"), "query_id", "left_semi"), *cfg.relaxed)
        first, sim = first.unionByName(more), sim.unionByName(near)
    own = P.build_postings(chunks.join(first.select("chunk_id").distinct(), "chunk_id", "left_semi"), "chunk_id", {"content": F.col("text")})  # of candidates only
    tk = P.token_similarity(P.term_weights(terms, freq), own.select("term", "chunk_id"), first)
    scored = rerank(first, tk, sim, None).where(F.col("score") >= cfg.threshold)
    page = paged(scored.join(scored.groupBy("query_id").agg(F.count("*").alias("total")), "query_id"), cfg)
    page = page.join(chunks.select("chunk_id", *payload), "chunk_id") if payload else page
    return page.select("query_id", "rank", "chunk_id", "score", "tksim", "vsim", "total", *payload)


def doc_aggs(hits: DataFrame, chunks: DataFrame, doc_col: str) -> DataFrame:
    """(query_id, doc_col, n): hits (query_id, chunk_id) by document, or whatever column says where a chunk comes from."""
    return hits.join(chunks.select("chunk_id", doc_col), "chunk_id").groupBy("query_id", doc_col).agg(F.count("*").alias("n"))


def with_fallback(queries: DataFrame, first: DataFrame, relaxed: DataFrame) -> DataFrame:
    """Hits of the first pass, and of the relaxed one for queries that have none."""
    missed = queries.select("query_id").distinct().join(first.select("query_id").distinct(), "query_id", "left_anti")
    return first.unionByName(relaxed.join(missed, "query_id", "left_semi"))


def toc_boost(hits: DataFrame, toc: DataFrame, top: int) -> DataFrame:
    """Hits (query_id, chunk_id, doc_id, score) with the scores of the table of contents (doc_id, chunk_id, toc; query_id too where they differ by query) of each query's best document added."""
    best = top_k(hits.groupBy("query_id", "doc_id").agg(F.sum("score").alias("total")), "query_id", F.round("total", 9), 1, "doc_id").select("query_id", "doc_id")
    extra = toc.join(best, [c for c in ("query_id", "doc_id") if c in toc.columns]).groupBy("query_id", "doc_id", "chunk_id").agg(F.avg("toc").alias("toc"))
    both = hits.join(extra, ["query_id", "doc_id", "chunk_id"], "full").withColumn("score", F.coalesce("score", F.lit(0.0)) + F.coalesce("toc", F.lit(0.0))).drop("toc")
    return top_k(both, "query_id", F.round("score", 9), top, "chunk_id")


def sentences(answers: DataFrame, id_col: str, text: str, least: int = 5) -> DataFrame:
    """(id, i, sentence): code fences whole, else parts that end at a stop before a blank or a line end; short ones out."""
    parts = F.regexp_extract_all(F.col(text), F.lit(r"(?s)```.*?```|[^.?!;。；？！\n]+(?:[.?!;。；？！]+(?=[ \n]|$)|[\n]|[.?!;。；？！]|$)"), F.lit(0))
    return answers.select(id_col, F.posexplode(parts).alias("i", "sentence")).where(F.length("sentence") >= least)


THRESHOLDS = (0.63, 0.504, 0.4032, 0.32256)


def attribute_citations(pairs: DataFrame) -> DataFrame:
    """(answer_id, i, chunk_id) of scored sentence-chunk pairs (answer_id, i, chunk_id, sim).

    An answer takes the highest of THRESHOLDS that a sentence of it reaches with 0.99 of its best; each such sentence cites
    up to 4 chunks over that, and of an answer's repeated citations the first stays.
    """
    best = pairs.groupBy("answer_id", "i").agg((F.max("sim") * 0.99).alias("mx"))
    level = F.greatest(*(F.when(F.col("mx") >= t, F.lit(t)) for t in THRESHOLDS)) if len(THRESHOLDS) > 1 else None
    answer = best.groupBy("answer_id").agg(F.max(level).alias("level")).where("level is not null")
    cites = pairs.join(best, ["answer_id", "i"]).join(answer, "answer_id").where("mx >= level and sim > mx")
    four = top_k(cites, ["answer_id", "i"], F.col("sim"), 4, "chunk_id").drop("rank")
    return top_k(four, ["answer_id", "chunk_id"], -F.col("i"), 1).select("answer_id", "i", "chunk_id")


def sentence_similarity(sents: DataFrame, chunks: DataFrame, candidates: DataFrame, freq: DataFrame, tw: float = 0.1, vw: float = 0.9) -> DataFrame:
    """(answer_id, i, chunk_id, sim): tw * weighted token similarity + vw * cosine, for attribute_citations.

    sents: (answer_id, i, sentence, vector); chunks: (chunk_id, text, vector); candidates: (answer_id, chunk_id), the chunks
    that an answer was made from; freq: (term, freq, df) of the corpus. Only candidates are compared; null texts share no token.
    """
    own = sents.withColumn("query_id", F.concat_ws(":", F.col("answer_id").cast("string"), F.col("i").cast("string")))
    pairs = own.join(candidates, "answer_id")
    words = chunks.select("chunk_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    tk = P.token_similarity(P.term_weights(P.query_terms(own, "query_id", "sentence"), freq), words, pairs)
    scored = pairs.select("query_id", "answer_id", "i", "chunk_id", F.col("vector").alias("qv")).join(chunks.select("chunk_id", F.col("vector").alias("cv")), "chunk_id").join(tk, ["query_id", "chunk_id"], "left")
    return scored.select("answer_id", "i", "chunk_id", (tw * F.coalesce("tksim", F.lit(0.0)) + vw * F.coalesce(cosine(F.col("qv"), F.col("cv")), F.lit(0.0))).alias("sim"))


def assemble_context(hits: DataFrame, budget: int) -> DataFrame:
    """(query_id, context): ID, title and content of ranked hits (query_id, rank, chunk_id, title, text, tokens) within the budget."""
    run = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    body = F.format_string("ID: %s\nTitle: %s\nContent: %s", F.col("chunk_id").cast("string"), "title", "text")
    kept = hits.withColumn("used", run).where(F.col("used") <= budget)
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", body.alias("body")))), lambda x: x["body"]), "\n\n").alias("context"))


def tag_prior(tags: DataFrame, smooth: int = 1000) -> DataFrame:
    """(tag, prior) of tagged examples (chunk_id, tag)."""
    counts = tags.groupBy("tag").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select("tag", ((F.col("c") + 1) / (F.col("total") + smooth)).alias("prior"))


def tag_targets(matched: DataFrame, tags: DataFrame, prior: DataFrame, top: int = 3, smooth: int = 1000, floor: int = 0) -> DataFrame:
    """(query_id, tag, score): tags of the examples that a text matches (query_id, chunk_id), against their prior, rounded half to even."""
    counts = matched.join(tags, "chunk_id").groupBy("query_id", "tag").agg(F.count("*").alias("c"))
    total = counts.groupBy("query_id").agg(F.sum("c").alias("n"))
    score = F.bround(0.1 * (F.col("c") + 1) / (F.col("n") + smooth) / F.greatest(F.coalesce("prior", F.lit(0.0001)), F.lit(1e-6)))
    scored = counts.join(total, "query_id").join(prior, "tag", "left").select("query_id", "tag", score.alias("score"))
    best = top_k(scored, "query_id", F.col("score"), top, "tag").drop("rank")
    best = best.withColumn("score", F.greatest("score", F.lit(float(floor)))) if floor else best.where("score > 0")
    return best.withColumn("tag", F.replace("tag", F.lit("."), F.lit("_")))


__all__ = ["Config", "norm", "retrieve", "strip_question_words", "tokens"]
