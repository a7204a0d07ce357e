"""Citations by hybrid similarity, and vectors of titles and contents."""

import math

import numpy as np
from pyspark.sql import functions as F

from lakeglean.operators import embed as M
from lakeglean.operators import search as S
from lakeglean.plans import retrieval as R


def test_sentences_cite_what_they_say(spark):
    chunks = spark.createDataFrame([(1, "red apples grow on old trees"), (2, "the blue whale swims in the sea"), (3, None), (9, "red apples grow on old trees")], "chunk_id long, text string")
    answers = spark.createDataFrame([(5, "Red apples grow on old trees. And the blue whale swims in the sea. Nothing alike here at all")], "answer_id long, text string")
    candidates = spark.createDataFrame([(5, 1), (5, 2), (5, 3)], "answer_id long, chunk_id long")
    sents, own = M.embed(R.sentences(answers, "answer_id", "text"), "sentence"), M.embed(chunks, "text")
    freq = S.frequencies(sents.select(F.explode(F.split(F.lower("sentence"), " ")).alias("term")), chunks, F.col("text"))
    sim = R.sentence_similarity(sents, own, candidates, freq)
    by = {(r.i, r.chunk_id): r.sim for r in sim.collect()}
    assert len(by) == 9 and math.isclose(by[0, 1], 1.0, abs_tol=1e-6) and by[0, 3] == 0 and by[1, 2] > 0.9
    assert {(r.i, r.chunk_id) for r in R.attribute_citations(sim).collect()} == {(0, 1), (1, 2)}  # 9 was no source of the answer


def test_chunk_vectors_blend_title_and_content(spark):
    calls = []

    def encode(texts):
        calls.append(len(texts))
        return np.array([[len(t), t.count("a"), 1.0] for t in texts])

    d = spark.createDataFrame([(1, "aa", "bbbb", None), (2, "", "cc", []), (3, "a", "ignored", ["q1", "q2a"]), (4, "t", "w " * 9, None)], "id int, title string, text string, questions array<string>")
    got = {r.id: [round(x, 5) for x in r.vector] for r in M.embed_chunks(d, "title", "text", "questions", encode, most=5).collect()}
    assert got == {1: [3.8, 0.2, 1.0], 2: [2, 0, 1], 3: [round(0.1 + 0.9 * 6, 5), round(0.1 + 0.9, 5), 1.0], 4: [round(0.1 + 0.9 * 9, 5), 0, 1]}
