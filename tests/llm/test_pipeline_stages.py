"""Stages of the pipeline on their own: columns of any name, edge rows, planted near copies, blocks of clouds."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c
from lakeglean.llm import simhash

NAMES = ("_own", "_id", "_md5", "id", "md5", "row", "other", "other_md5", "shown", "a.b")


@pytest.fixture(scope="module")
def clashing(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    edge = spark.createDataFrame([(None, None, None, None, None), (None, "", None, None, 0), (5, None, None, None, None)], d.schema)
    d = d.unionByName(edge).unionByName(d.limit(2))
    for n in NAMES:
        d = d.withColumn(n, F.lit(n))
    return d


@pytest.mark.parametrize("name", [n for n, _ in c.STAGES[:-1]])
def test_columns_of_any_name_stay(spark, sf, clashing, name):
    out = dict(c.STAGES)[name](spark, clashing, sf)
    assert out.columns == clashing.columns
    got = out.collect()
    assert got and all(r[n] == n for r in got for n in NAMES)
    assert dict(c.STAGES)[name](spark, clashing.where("false"), sf).count() == 0


def test_planted_near_copies_meet(spark):
    r = random.Random(11)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(3000)]
    docs, pairs = [], []
    for i in range(120):
        text = r.choices(words, k=r.randint(80, 400))
        near = list(text)
        for _ in range(max(1, len(text) // 100)):
            near[r.randrange(len(near))] = r.choice(words)
        docs += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(near))]
        a, b = (simhash.shingle_set(" ".join(x).encode(), 5) for x in (text, near))
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append((2 * i, 2 * i + 1))
    found = {x.doc_id: x.component_id for x in simhash.near_duplicate_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(pairs) > 100 and sum(found[a] == found[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert all(found[2 * i] == 2 * i for i in range(120))  # nothing else meets


def test_blocks_by_bytes_find_the_same(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 60, 40, dtype=np.uint64)
    rows = [("cloud", i, i, np.unique(np.concatenate([base[: 40 - i % 5], r.integers(0, 1 << 60, i % 7 * 3, dtype=np.uint64)])).tobytes()) for i in range(60)]
    members = spark.createDataFrame(rows, "cloud string, doc_id long, c long, set binary")

    def groups(df):
        root = {i: i for i in range(60)}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for e in df.collect():
            root[max(top(e.src), top(e.dst))] = min(top(e.src), top(e.dst))
        return [top(i) for i in range(60)]

    one = groups(simhash.within_clouds(members, 0.8))
    monkeypatch.setattr(simhash, "TOGETHER_BYTES", 2000)
    assert groups(simhash.within_clouds(members, 0.8)) == one and 1 < len(set(one)) < 60
