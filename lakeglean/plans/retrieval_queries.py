"""Retrieval over documents (chunks), benchmark items (queries) and embeddings."""

from pyspark.sql import functions as F

from ..functions.text import QUESTION_STOPS, QUESTION_WORDS, cosine, tokens
from ..operators import catalog as C
from ..operators import postings as P
from ..operators import search as S
from ..operators import vectors as V
from ..operators.components import cut
from . import retrieval as R
from .book import Book, r6

book = Book()
TOK = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\pL\\pM\\pN]+'), lambda x: x <> '')"
BASE = f"""WITH w AS (SELECT doc_id AS chunk_id, unnest({TOK.format("text")}) AS term FROM documents), p AS (SELECT chunk_id, term, count(*) AS tf FROM w GROUP BY ALL),
dl AS (SELECT chunk_id, sum(tf) AS dl FROM p GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT DISTINCT item_id AS query_id, unnest({TOK.format("text")}[1:256]) AS term FROM benchmark),
m AS (SELECT query_id, chunk_id, count(*) AS hits, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) / ln(1 + (n - 0.5) / 1.5)) AS presence,
      sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM q JOIN p USING (term) JOIN df USING (term) JOIN dl USING (chunk_id), st GROUP BY ALL),
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
sims AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity(a.e, b.e), 9) AS sim FROM v a, v b WHERE a.vec_id % 20 = 0)
"""


def terms(t):
    return P.query_terms(t.benchmark.withColumnRenamed("item_id", "query_id"))


def chunks(t):
    return t.documents.withColumnRenamed("doc_id", "chunk_id")


def content():
    return {"content": F.col("text")}


def found(t, q, k=10, how="presence", **kw):
    """Hits of the terms of q in whole documents."""
    return S.search(S.term_rows(q), chunks(t), content(), k, how, **kw)


def vectors(t):
    v = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return v.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), v


@book.query(BASE + "SELECT query_id, chunk_id, round(presence, 6) AS score FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(presence, 6) DESC, chunk_id) <= 10")
def text_topk_presence(t):
    return found(t, terms(t)).select("query_id", "chunk_id", r6("score").alias("score"))


@book.query(BASE + "SELECT query_id, chunk_id, round(bm25, 6) AS score FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, chunk_id) <= 10")
def text_topk_bm25(t):
    return found(t, terms(t), how="bm25").select("query_id", "chunk_id", r6("score").alias("score"))


TWO = f"""WITH f AS (SELECT doc_id AS chunk_id, 'content' AS field, text AS x FROM documents UNION ALL SELECT doc_id, 'title', left(text, 60) FROM documents),
w AS (SELECT chunk_id, field, unnest({TOK.format("x")}) AS term FROM f), p AS (SELECT chunk_id, field, term FROM w GROUP BY ALL),
st AS (SELECT field, count(DISTINCT chunk_id) AS n FROM p GROUP BY 1), df AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL),
q AS (SELECT DISTINCT item_id AS query_id, unnest({TOK.format("text")}[1:256]) AS term FROM benchmark),
m AS (SELECT query_id, chunk_id, field, sum(CASE field WHEN 'title' THEN 10 ELSE 2 END * ln(1 + (n - df + 0.5) / (df + 0.5)) / ln(1 + (n - 0.5) / 1.5)) AS s FROM q JOIN p USING (term) JOIN df USING (field, term) JOIN st USING (field) GROUP BY ALL),
c AS (SELECT query_id, chunk_id, round({{agg}}(s), 6) AS score FROM m GROUP BY ALL)
SELECT query_id, chunk_id, score FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10"""


def two_fields(t, mode):
    fields = content() | {"title": F.substring("text", 1, 60)}
    return S.search(S.term_rows(terms(t)), chunks(t), fields, 10, boosts={"title": 10, "content": 2}, mode=mode).select("query_id", "chunk_id", r6("score").alias("score"))


@book.query(TWO.format(agg="max"))
def multi_field_best(t):
    return two_fields(t, "max")


@book.query(TWO.format(agg="sum"))
def multi_field_sum(t):
    return two_fields(t, "sum")


@book.query(BASE + ", need AS (SELECT query_id, greatest(floor(count(*) * 0.5), 1) AS need FROM q GROUP BY 1) SELECT query_id, count(*) AS n, min(chunk_id) AS first FROM m JOIN need USING (query_id) WHERE hits >= need GROUP BY 1")
def min_should_match(t):
    return found(t, terms(t), None, share=0.5).groupBy("query_id").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first"))


POS = f"""WITH d AS (SELECT doc_id, {TOK.format("text")} AS w FROM documents), pos AS (SELECT doc_id AS chunk_id, i, w[i] AS term FROM d, unnest(range(1, len(w) + 1)) t(i)),
b AS (SELECT item_id, {TOK.format("text")} AS w FROM benchmark), ph AS (SELECT item_id || ':' || (i - 1) AS phrase_id, w[i] AS f, w[i + 1] AS s FROM b, unnest(range(1, len(w))) t(i)),
pp AS (SELECT DISTINCT a.chunk_id, a.i, a.term AS f, z.term AS s FROM pos a JOIN pos z ON z.chunk_id = a.chunk_id AND z.i IN ({{reach}}) WHERE (a.term, z.term) IN (SELECT (f, s) FROM ph))
SELECT phrase_id, chunk_id, count(*) AS n FROM ph JOIN pp USING (f, s) GROUP BY ALL"""


def phrases(t, slop):
    pairs = P.bigrams(t.benchmark, "item_id", "text").select(F.concat_ws(":", "query_id", "i").alias("phrase_id"), "first", "second")
    return P.phrase_match(pairs, P.term_pairs(t.documents, "doc_id", "text", slop, pairs))


@book.query(POS.format(reach="a.i + 1"))
def phrase_match(t):
    return phrases(t, 0)


@book.query(POS.format(reach="a.i + 1, a.i + 2, a.i + 3"))
def proximity_match(t):
    return phrases(t, 2)


WEIGHTS = """, fr AS (SELECT term, sum(tf) AS freq, count(*) AS df FROM p GROUP BY 1),
x AS (SELECT query_id, term, (0.3 * log10(10 + (1e7 - greatest(coalesce(freq, 10), 10) + 0.5) / (greatest(coalesce(freq, 10), 10) + 0.5)) + 0.7 * log10(10 + (1e9 - coalesce(df + 3, 3) + 0.5) / (coalesce(df + 3, 3) + 0.5)))
 * CASE WHEN regexp_full_match(term, '[0-9,.]{2,}') THEN 2 WHEN regexp_full_match(term, '[a-z]{1,2}') THEN 0.01 ELSE 1 END AS raw FROM q LEFT JOIN fr USING (term)),
tw AS (SELECT query_id, term, raw / sum(raw) OVER (PARTITION BY query_id) AS weight FROM x)
"""


def weights(t):
    return P.term_weights(terms(t), S.frequencies(terms(t), chunks(t), F.col("text")))


@book.query(BASE + WEIGHTS + "SELECT query_id, term, round(weight, 6) AS weight FROM tw")
def term_weights(t):
    return weights(t).withColumn("weight", r6("weight"))


@book.query(BASE + WEIGHTS + "SELECT query_id, chunk_id, round((sum(weight) + 1e-9) / (1 + 1e-9), 6) AS tksim FROM tw JOIN p USING (term) GROUP BY query_id, chunk_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tksim DESC, chunk_id) <= 10")
def token_similarity(t):
    rows = weights(t).select("query_id", F.lit("term").alias("kind"), F.col("term").alias("text"), "weight")  # weights of a query add up to 1
    return S.search(rows, chunks(t), content(), 10, "weight").select("query_id", "chunk_id", r6((F.col("score") + 1e-9) / (1 + 1e-9)).alias("tksim"))


@book.query(BASE + WEIGHTS + "SELECT query_id, term, round(weight, 6) AS weight FROM tw QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(weight, 9) DESC, term) <= 5")
def paragraph_terms(t):
    return P.paragraph_terms(weights(t).withColumn("weight", F.round("weight", 9)), 5).withColumn("weight", r6("weight"))


@book.query(BASE + """, syn AS (SELECT DISTINCT term, left(term, 3) AS synonym FROM q WHERE length(term) > 3)
SELECT query_id, term, term AS source, 1.0::DOUBLE AS weight FROM q UNION ALL SELECT query_id, synonym, term, 0.25::DOUBLE FROM q JOIN syn USING (term)""")
def synonyms(t):
    q = terms(t)
    return P.expand_synonyms(q, q.where(F.length("term") > 3).select("term", F.substring("term", 1, 3).alias("synonym")).distinct())


def _stripped(c):
    once = f"regexp_replace(regexp_replace({c}, '(?i)(^| )({QUESTION_WORDS})(''re|''s)? ', ' ', 'g'), '(?i)(^| )({STOPS}) ', ' ', 'g')"
    return f"CASE WHEN {once} = '' THEN {c} ELSE {once} END"


STOPS = QUESTION_STOPS.replace("'", "''")
PLAIN = r"trim(regexp_replace(lower(text), '[ :|\r\n\t,，。？?/`!！&^%()\[\]{}<>]+', ' ', 'g'))"
# items of over three words, mostly of letters: only the path of questions in words
BUILT = f""", fr AS (SELECT term, sum(tf) AS freq, count(*) AS df FROM p GROUP BY 1), b1 AS (SELECT item_id AS query_id, {PLAIN} AS t FROM benchmark), b2 AS (SELECT query_id, {_stripped("t")} AS t FROM b1), b3 AS (SELECT query_id, {_stripped("t")} AS t FROM b2),
bt AS (SELECT query_id, list_filter({TOK.format("t")}, lambda x: NOT regexp_full_match(x, '[a-z0-9]'))[1:256] AS w FROM b3), bi AS (SELECT query_id, i, w[i] AS term FROM bt, unnest(range(1, len(w) + 1)) u(i)),
bx AS (SELECT query_id, i, term, (0.3 * log10(10 + (1e7 - greatest(coalesce(freq, 10), 10) + 0.5) / (greatest(coalesce(freq, 10), 10) + 0.5)) + 0.7 * log10(10 + (1e9 - coalesce(df + 3, 3) + 0.5) / (coalesce(df + 3, 3) + 0.5)))
 * CASE WHEN regexp_full_match(term, '[0-9,.]{{2,}}') THEN 2 WHEN regexp_full_match(term, '[a-z]{{1,2}}') THEN 0.01 ELSE 1 END AS raw FROM bi LEFT JOIN fr USING (term)),
bw AS (SELECT query_id, i, term, raw / sum(raw) OVER (PARTITION BY query_id) AS weight FROM bx), b4 AS (SELECT *, lead(term) OVER o AS nxt, lead(weight) OVER o AS w2 FROM bw WINDOW o AS (PARTITION BY query_id ORDER BY i))
SELECT query_id, kind, text, round(weight, 6) AS weight FROM (SELECT query_id, 'term' AS kind, term AS text, weight FROM bw UNION ALL SELECT query_id, 'syn', left(term, 3), weight / 4 FROM bw WHERE length(term) > 3
UNION ALL SELECT query_id, 'phrase', term || ' ' || nxt, 2 * greatest(weight, w2) FROM b4 WHERE nxt IS NOT NULL)"""


@book.query(BASE + BUILT)
def query_rows(t):
    freq = S.frequencies(terms(t), chunks(t), F.col("text"))
    syn = terms(t).where(F.length("term") > 3).select("term", F.substring("term", 1, 3).alias("synonym")).distinct()
    return P.query_rows(t.benchmark.select(F.col("item_id").alias("query_id"), "text"), freq, syn).withColumn("weight", r6("weight"))


RUN = BASE + BUILT.replace("SELECT query_id, kind, text, round(weight, 6) AS weight FROM (", ", rows AS (").replace("WHERE nxt IS NOT NULL)", "WHERE nxt IS NOT NULL)") + f""",
idf AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) / ln(1 + (n - 0.5) / 1.5) AS idf FROM df, st),
dw AS (SELECT doc_id AS chunk_id, {TOK.format("text")} AS w FROM documents), pos AS (SELECT chunk_id, i, w[i] AS f, w[i + 1] AS s FROM dw, unnest(range(1, len(w))) t(i)),
ph AS (SELECT query_id, split_part(text, ' ', 1) AS f, split_part(text, ' ', 2) AS s, weight FROM rows WHERE kind = 'phrase'),
pp AS (SELECT DISTINCT chunk_id, f, s FROM pos WHERE (f, s) IN (SELECT (f, s) FROM ph)),
one AS (SELECT query_id, chunk_id, weight * idf AS x FROM rows JOIN p ON term = text JOIN idf USING (term) WHERE kind IN ('term', 'syn')
UNION ALL SELECT query_id, chunk_id, weight * (a.idf + b.idf) FROM ph JOIN pp USING (f, s) JOIN idf a ON a.term = f JOIN idf b ON b.term = s)
SELECT query_id, chunk_id, round(sum(x), 6) AS score FROM one GROUP BY query_id, chunk_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10"""


@book.query(RUN)
def search_query_rows(t):
    """Built rows (terms, synonyms, phrases) run against the positions of all documents."""
    asked = terms(t)
    syn = asked.where(F.length("term") > 3).select("term", F.substring("term", 1, 3).alias("synonym")).distinct()
    rows = cut(P.query_rows(t.benchmark.select(F.col("item_id").alias("query_id"), "text"), S.frequencies(asked, chunks(t), F.col("text")), syn))
    return S.search(rows, chunks(t), content(), 10, least=0).select("query_id", "chunk_id", r6("score").alias("score"))


@book.query(BASE + "SELECT query_id, chunk_id, round(sim, 6) AS sim FROM sims QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) <= 10")
def knn_exact(t):
    q, v = vectors(t)
    return V.knn(q, v, 10).withColumn("sim", r6("sim"))


@book.query(BASE + "SELECT query_id, chunk_id, round(sim, 6) AS sim FROM sims JOIN embeddings ON vec_id = chunk_id WHERE label < 5 AND sim >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) <= 8")
def knn_filtered(t):
    q, _ = vectors(t)
    v = t.embeddings.where("label < 5").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return V.knn(q, v, 8, 0.2).withColumn("sim", r6("sim"))


@book.query()
def knn_lsh(t):
    q, v = vectors(t)
    return V.knn_lsh(q, v, 10)


@book.query()
def knn_index(t):
    """Ten nearest by a list index: 128 lists of which 64 are probed by code, the 100 best by code compared exactly."""
    q, v = vectors(t)
    return V.ListIndex(v, 128).knn(q, 10, 64, 100)


def text_of_vectors(t, k, keep=None, digits=6):
    """Text hits whose chunks and queries have vectors: documents and items of like ids."""
    q = P.query_terms(t.documents.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")).join(t.embeddings.select(F.col("vec_id").alias("query_id")), "query_id", "left_semi")
    own = chunks(t).join(t.embeddings.select(F.col("vec_id").alias("chunk_id")), "chunk_id", "left_semi")
    return S.search(S.term_rows(q), own, content(), k, corpus=chunks(t), keep=keep, digits=digits)


HYB = BASE + f""", dq AS (SELECT DISTINCT doc_id AS query_id, unnest({TOK.format("text")}[1:256]) AS term FROM documents WHERE doc_id % 20 = 0),
tx AS (SELECT query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) / ln(1 + (n - 0.5) / 1.5)) AS ts FROM dq JOIN p USING (term) JOIN df USING (term), st WHERE chunk_id IN (SELECT vec_id FROM v) AND query_id IN (SELECT vec_id FROM v) GROUP BY ALL),
top AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) <= 64)
"""


@book.query(HYB + "SELECT query_id, chunk_id, round(coalesce(ts, 0) * 0.05 + coalesce(sim, 0) * 0.95, 6) AS score FROM tx FULL JOIN top USING (query_id, chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10")
def hybrid_fusion(t):
    q, v = vectors(t)
    sim = V.knn(q, v, 64)
    f = R.fuse(text_of_vectors(t, 64 + 10, sim), sim, 0.95).withColumn("score", r6("score"))
    return C.top_k(f, "query_id", F.col("score"), 10, "chunk_id").drop("rank")


@book.query(HYB + """, cap AS (SELECT * FROM tx QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(ts, 9) DESC, chunk_id) <= 100)
SELECT query_id, chunk_id, round(ts * 0.5 + list_cosine_similarity(a.e, b.e) * 0.5, 6) AS score FROM cap JOIN v a ON a.vec_id = query_id JOIN v b ON b.vec_id = chunk_id WHERE list_cosine_similarity(a.e, b.e) >= 0.1""")
def text_first_fusion(t):
    q, v = vectors(t)
    return R.fuse_text_first(text_of_vectors(t, 100, digits=9), v, q, 0.5, 100, 0.1).withColumn("score", r6("score"))


@book.query(HYB + """, s AS (SELECT query_id, chunk_id, sim + coalesce(label, 0) / 100 AS score, label FROM top LEFT JOIN embeddings ON vec_id = chunk_id)
SELECT query_id, chunk_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY round(score, 6) DESC, chunk_id) = 1""")
def boosted_group_best(t):
    """Best chunk of each label, with the label as a static boost."""
    q, v = vectors(t)
    groups = t.embeddings.select(F.col("vec_id").alias("chunk_id"), "label")
    s = R.boost_static(V.knn(q, v, 64).withColumnRenamed("sim", "score"), groups, "label", 100).withColumn("score", r6("score"))
    return C.top_k(s.join(groups, "chunk_id"), ["query_id", "label"], F.col("score"), 1, "chunk_id").select("query_id", "chunk_id", "score")


@book.query(HYB + """, mx AS (SELECT query_id, max(ts) AS mx FROM tx GROUP BY 1), r AS (SELECT query_id, chunk_id, 0.7 * sim + 0.3 * coalesce(ts / mx, 0) AS score FROM top LEFT JOIN tx USING (query_id, chunk_id) LEFT JOIN mx USING (query_id))
SELECT query_id, chunk_id, round(score, 6) AS score FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) BETWEEN 11 AND 20""")
def rerank_page2(t):
    q, v = vectors(t)
    sim = V.knn(q, v, 64)
    text = text_of_vectors(t, 1, sim)
    tk = text.join(text.groupBy("query_id").agg(F.max("score").alias("mx")), "query_id").select("query_id", "chunk_id", (F.col("score") / F.col("mx")).alias("tksim"))
    s = R.rerank(sim, tk, sim, None).withColumn("score", r6("score"))
    return R.paged(s, R.Config(page=2, page_size=10, threshold=-9.0)).select("query_id", "chunk_id", "score")


@book.query(HYB + """SELECT query_id, chunk_id, round(0.3 * sim + 0.7 * (chunk_id % 7) / 7, 6) AS score FROM top""")
def rerank_external(t):
    q, v = vectors(t)
    sim = V.knn(q, v, 64)
    ext = sim.select("query_id", "chunk_id", ((F.col("chunk_id") % 7) / 7).alias("ext"))
    return R.rerank_external(sim.withColumnRenamed("sim", "tksim"), ext).select("query_id", "chunk_id", r6("score").alias("score"))


@book.query()
def retrieve_hybrid(t):
    """The whole path: documents with vectors as chunks, every 20th as a query."""
    e = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    c = t.documents.join(e, "doc_id").select(F.col("doc_id").alias("chunk_id"), "text", "vector")
    q = c.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "text", "vector")
    return R.retrieve(q, c)


@book.query(BASE + """, need AS (SELECT query_id, count(*) AS k FROM q GROUP BY 1), a AS (SELECT query_id, chunk_id FROM m JOIN need USING (query_id) WHERE hits >= greatest(floor(k * 0.9), 1)),
b AS (SELECT query_id, chunk_id FROM m JOIN need USING (query_id) WHERE hits >= greatest(floor(k * 0.5), 1) AND query_id NOT IN (SELECT query_id FROM a)) SELECT query_id, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""")
def retrieve_fallback(t):
    q = terms(t)
    scored = found(t, q, None, share=0.5)
    both = R.with_fallback(q, P.min_should_match(scored, q, 0.9), P.min_should_match(scored, q, 0.5))
    return both.groupBy("query_id").agg(F.count("*").alias("n"))


@book.query(BASE + """, h AS (SELECT query_id, chunk_id, source, presence FROM m JOIN documents ON doc_id = chunk_id WHERE hits >= 8) SELECT query_id, source, count(*) AS n FROM h GROUP BY ALL""")
def doc_aggs(t):
    return R.doc_aggs(found(t, terms(t), None, least=8), chunks(t), "source")


TAGS = """, tags AS (SELECT doc_id AS chunk_id, unnest(['q.' || quality, 't.' || toxic, lang]) AS tag FROM labels JOIN documents USING (doc_id)), tc AS (SELECT tag, count(*) AS c FROM tags GROUP BY 1), pr AS (SELECT tag, (c + 1) / (sum(c) OVER () + 1000) AS prior FROM tc)
"""


def tags(t):
    d = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    return d.select(F.col("doc_id").alias("chunk_id"), F.explode(F.array(F.concat(F.lit("q."), F.col("quality").cast("string")), F.concat(F.lit("t."), F.col("toxic").cast("string")), F.col("lang"))).alias("tag"))


@book.query(BASE + TAGS + "SELECT tag, round(prior, 6) AS prior FROM pr")
def tag_prior(t):
    return R.tag_prior(tags(t)).withColumn("prior", r6("prior"))


@book.query(BASE + TAGS + """, hit AS (SELECT query_id, chunk_id FROM m WHERE hits >= 6), c AS (SELECT query_id, tag, count(*) AS c FROM hit JOIN tags USING (chunk_id) GROUP BY ALL),
s AS (SELECT query_id, tag, round_even(0.1 * (c + 1) / (sum(c) OVER (PARTITION BY query_id) + 10) / greatest(prior, 1e-6), 0) AS score FROM c JOIN pr USING (tag))
SELECT query_id, replace(tag, '.', '_') AS tag, greatest(score, 1) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tag) <= 3""")
def tag_queries(t):
    hit = found(t, terms(t), None, least=6).select("query_id", "chunk_id")
    return R.tag_targets(hit, tags(t), R.tag_prior(tags(t)), smooth=10, floor=1)


@book.query(HYB + TAGS + """, ct AS (SELECT chunk_id, tag, 1.0 AS w FROM tags), qt AS (SELECT chunk_id AS query_id, tag, CASE WHEN tag LIKE 'q%' THEN 2.0 ELSE 1.0 END AS w FROM tags WHERE chunk_id % 20 = 0),
f AS (SELECT query_id, chunk_id, 10 * sum(qt.w * ct.w) / (sqrt(6.0) * sqrt(3.0)) AS fea FROM top JOIN qt USING (query_id) JOIN ct USING (chunk_id, tag) GROUP BY ALL) SELECT query_id, round(sum(fea), 4) AS total, count(*) AS n FROM f GROUP BY 1""")
def tag_rank_feature(t):
    ct = tags(t).withColumn("w", F.lit(1.0))
    qt = ct.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "tag", F.when(F.col("tag").startswith("q"), 2.0).otherwise(1.0).alias("w"))
    q, v = vectors(t)
    return R.rank_feature(qt, ct, V.knn(q, v, 64)).groupBy("query_id").agg(F.round(F.sum("fea"), 4).alias("total"), F.count("*").alias("n"))


@book.query(HYB + """, h AS (SELECT query_id, chunk_id, label AS doc_id, sim AS score FROM top JOIN embeddings ON vec_id = chunk_id), best AS (SELECT query_id, doc_id FROM h GROUP BY query_id, doc_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(sum(score), 9) DESC, doc_id) = 1),
toc AS (SELECT query_id, doc_id, vec_id AS chunk_id, (vec_id % 5) / 5 AS toc FROM best JOIN embeddings ON label = doc_id WHERE vec_id % 3 = 0)
SELECT query_id, chunk_id, round(coalesce(score, 0) + coalesce(toc, 0), 6) AS score FROM h FULL JOIN toc USING (query_id, doc_id, chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(score, 0) + coalesce(toc, 0), 9) DESC, chunk_id) <= 8""")
def toc_boost(t):
    q, v = vectors(t)
    labels = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"))
    hits = V.knn(q, v, 64).withColumnRenamed("sim", "score").join(labels, "chunk_id")
    toc = labels.where("chunk_id % 3 = 0").withColumn("toc", (F.col("chunk_id") % 5) / 5)
    return R.toc_boost(hits, toc, 8).select("query_id", "chunk_id", r6("score").alias("score"))


@book.query()
def citation_attribution(t):
    """Assistant turns as answers, the user turns of the same conversation as chunks; shared words as similarity."""
    turns = t.conversations.where("text is not null")
    s = R.sentences(turns.where("role = 'assistant'").withColumn("answer_id", F.col("conv_id") * 1000 + F.col("turn")), "answer_id", "text")
    s = s.withColumn("conv_id", F.floor(F.col("answer_id") / 1000)).withColumn("a", F.array_distinct(tokens(F.col("sentence"))))
    c = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("chunk_id"), F.array_distinct(tokens(F.col("text"))).alias("b"))
    sim = F.size(F.array_intersect("a", "b")) / F.greatest(F.size("a"), F.lit(1))
    return R.attribute_citations(s.join(c, "conv_id").select("answer_id", "i", "chunk_id", sim.alias("sim")))


@book.query()
def citation_hybrid(t):
    """Sentences of assistant turns against the user turns of their conversation, by weighted tokens and vectors of hashed words."""
    from ..operators.embed import embed

    turns = t.conversations.where("text is not null").withColumn("at", F.col("conv_id") * 1000 + F.col("turn"))
    sents = embed(R.sentences(turns.where("role = 'assistant'").withColumnRenamed("at", "answer_id"), "answer_id", "text"), "sentence")
    asked = turns.where("role = 'user'").withColumnRenamed("at", "chunk_id")
    own = cut(embed(asked.select("chunk_id", "text", "conv_id"), "text"))
    candidates = turns.where("role = 'assistant'").select(F.col("at").alias("answer_id"), "conv_id").join(own.select("conv_id", "chunk_id"), "conv_id").drop("conv_id")
    terms_ = sents.select(F.explode(F.array_distinct(tokens(F.col("sentence")))).alias("term"))
    freq = S.frequencies(terms_, own, F.col("text"))
    return R.attribute_citations(R.sentence_similarity(cut(sents), own, candidates, freq))


@book.query(BASE + """, h AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(presence, 6) DESC, chunk_id) AS rank FROM m QUALIFY rank <= 5),
u AS (SELECT h.*, lang, text AS body, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM h JOIN documents ON doc_id = chunk_id)
SELECT query_id, string_agg('ID: ' || chunk_id || E'\nTitle: ' || lang || E'\nContent: ' || body, E'\n\n' ORDER BY rank) AS context FROM u WHERE used <= 8000 GROUP BY 1""")
def assemble_context(t):
    top = C.rank_within(found(t, terms(t), 5), "query_id", r6("score"), "chunk_id")
    d = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("title"), "text")
    return R.assemble_context(top.join(d, "chunk_id").withColumn("tokens", F.length("text")), 8000)


QRELS = """, run AS (SELECT query_id, chunk_id, presence AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(presence, 6) DESC, chunk_id) AS rank FROM m QUALIFY rank <= 30),
qrels AS (SELECT query_id, chunk_id, CASE WHEN hits >= 0.9 * (SELECT count(*) FROM q qq WHERE qq.query_id = m.query_id) THEN 2 ELSE 1 END AS rel FROM m WHERE hits >= 0.6 * (SELECT count(*) FROM q qq WHERE qq.query_id = m.query_id)),
j AS (SELECT run.query_id, rank, coalesce(rel, 0) AS rel FROM run LEFT JOIN qrels USING (query_id, chunk_id)),
ideal AS (SELECT query_id, sum(rel / log2(r + 1)) AS idcg FROM (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS r FROM qrels) WHERE r <= 10 GROUP BY 1), nrel AS (SELECT query_id, count(*) AS nrel FROM qrels GROUP BY 1)
"""


def run_and_qrels(t):
    q = terms(t)
    run = C.rank_within(found(t, q, 30), "query_id", r6("score"), "chunk_id").select("query_id", "chunk_id", "rank")
    m = found(t, q, None, share=0.6).join(q.groupBy("query_id").agg(F.count("*").alias("k")), "query_id")
    qrels = m.where("hits >= 0.6 * k").select("query_id", "chunk_id", F.when(F.col("hits") >= 0.9 * F.col("k"), 2).otherwise(1).alias("rel"))
    return run, qrels


@book.query(BASE + QRELS + "SELECT query_id, round(sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) / max(idcg), 6) AS ndcg FROM j JOIN ideal USING (query_id) GROUP BY 1")
def ndcg_at_10(t):
    from ..operators import evalrank as E

    return E.ndcg(*run_and_qrels(t), 10).withColumn("ndcg", r6("ndcg"))


@book.query(BASE + QRELS + ", h AS (SELECT query_id, rank, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS seen, rel FROM j WHERE rank <= 5) SELECT query_id, round(sum(CASE WHEN rel > 0 THEN seen / rank ELSE 0 END) / max(nrel), 6) AS ap FROM h JOIN nrel USING (query_id) GROUP BY 1")
def map_at_5(t):
    from ..operators import evalrank as E

    return E.average_precision(*run_and_qrels(t), 5).withColumn("ap", r6("ap"))


@book.query(BASE + QRELS + "SELECT query_id, round(coalesce(1 / min(rank) FILTER (rel > 0 AND rank <= 10), 0), 6) AS rr FROM j WHERE query_id IN (SELECT query_id FROM nrel) GROUP BY 1")
def mrr_at_10(t):
    from ..operators import evalrank as E

    return E.reciprocal_rank(*run_and_qrels(t), 10).withColumn("rr", r6("rr"))


@book.query(BASE + QRELS + ", x AS (SELECT query_id, round(sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) / max(idcg), 6) AS ndcg FROM j JOIN ideal USING (query_id) GROUP BY 1) SELECT query_id, ndcg FROM x ORDER BY ndcg, query_id LIMIT 5")
def worst_first_report(t):
    from ..operators import evalrank as E

    return E.worst_queries(E.ndcg(*run_and_qrels(t), 10).withColumn("ndcg", r6("ndcg")), "ndcg", 5)


@book.query(BASE + "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS sim FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def cosine_neighbours(t):
    v = t.embeddings.select("vec_id", "embedding")
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("eb"))
    return v.join(b, "vec_id").select(F.col("vec_id").alias("a"), "b", r6(cosine(F.col("embedding"), F.col("eb"))).alias("sim"))
