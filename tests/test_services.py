"""Operators of a service's tables: states, facets, histories by brute force, chunk upserts, extractions, types."""

import random

import pytest
from pyspark.sql import functions as F

from lakeglean.operators import services as S


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_states_and_sizes(spark):
    d = spark.createDataFrame([("k", "run", 5, False), ("k", "done", 3, True), ("k", None, None, None), ("k", "run", 2, None), ("m", "done", 1, True)], "kb string, state string, size long, stop boolean")
    got = S.status_counts(d, "kb", "state", {"running": "run", "finished": "done"}, F.col("stop"))
    assert rows(got) == [("k", 2, 0, 1), ("m", 0, 0, 1)]
    assert rows(S.total_size(d, "size", "kb", F.col("state") == "run")) == [("k", 7), ("m", 0)]
    assert rows(S.total_size(d.where("false"), "size")) == [(0,)]
    assert rows(S.facets(d, ["kb", "state"])) == sorted([("kb", "k", 4), ("kb", "m", 1), ("state", "run", 2), ("state", "done", 2), ("state", None, 1)], key=str)


def test_continuations_both_ways(spark):
    d = spark.createDataFrame([(1, 0, "x"), (1, 1, "A:"), (1, 2, "y"), (1, 3, "B:"), (1, 4, None), (1, 5, "z")], "k int, i int, t string")
    whole = F.col("t").endswith(":")
    assert rows(S.fold_continuations(d, "k", "i", "t", whole)) == [(1, 0, "x"), (1, 1, "A:\ny"), (1, 2, "B:\nz")]
    assert rows(S.fold_continuations(d, "k", "i", "t", whole, forward=True, sep="|")) == [(1, 0, "x|A:"), (1, 1, "y|B:"), (1, 2, "z")]


def brute_history(turns, most):
    def cut(words, n):
        return words[:n] if n >= 0 else words[: max(len(words) + n, 0)]

    turns = [(i, role, (t or "").split()) for i, role, t in turns]
    if sum(len(w) for *_, w in turns) < most:
        return [(i, w) for i, _, w in turns]
    kept = [t for t in turns if t[1] == "system" or t[0] == turns[-1][0]]
    if sum(len(w) for *_, w in kept) < most:
        return [(i, w) for i, _, w in kept]
    a, b = len(kept[0][2]), len(kept[-1][2])
    words = {i: w for i, _, w in kept}
    at = kept[0][0] if a > 0.8 * (a + b) else kept[-1][0]
    words[at] = cut(words[at], most - b)
    return sorted(words.items())


def test_histories_against_brute_force(spark):
    r = random.Random(5)
    all_, want = [], {}
    for c in range(60):
        turns = [(i, "system" if i == 0 and c % 2 else r.choice(["user", "assistant"]), " ".join(f"w{j}" for j in range(r.choice([1, 3, 20, 60])))) for i in range(r.randint(1, 5))]
        all_ += [(c, *t) for t in turns]
        want[c] = brute_history(turns, 40)
    got = {}
    for x in S.fit_history(spark.createDataFrame(all_, "conv_id int, turn int, role string, text string"), 40).orderBy("conv_id", "turn").collect():
        got.setdefault(x.conv_id, []).append((x.turn, x.text.split()))
    assert got == want


def test_leaf_folders(spark):
    d = spark.createDataFrame([(1, 1, "folder"), (2, 1, "folder"), (3, 2, "folder"), (4, 3, "doc"), (5, 1, "folder")], "id int, parent_id int, type string")
    assert rows(S.leaf_folders(d)) == [(3,), (5,)]


TARGET = "id string, doc_id string, docnm_kwd string, group_id string, available_int int, removed_kwd string, metadata map<string,string>, extra map<string,string>"


def test_upserts_fill_defaults_and_keep_what_has_no_column(spark):
    target = spark.createDataFrame([("a", "d1", "old", "d1", 0, "N", None, None), ("b", "d2", "two", "d2", 1, "N", None, None)], TARGET)
    batch = spark.createDataFrame(
        [("a", "d1", "new", None, {"_title": "Title", "_group_id": "g"}, 7, 2), ("a", "d1", "older", 0, None, 1, 1), ("c", "d3", "three", None, {"x": "y"}, None, 1), (None, "d4", "none", None, None, None, 1)],
        "id string, doc_id string, docnm_kwd string, available_int int, metadata map<string,string>, pages int, at int",
    )
    got = {r.id: r for r in S.upsert_chunks(target, batch, "at").collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].docnm_kwd, got["a"].group_id, got["a"].available_int, got["a"].removed_kwd, got["a"].extra) == ("Title", "g", 1, "N", {"pages": "7"})
    assert (got["c"].docnm_kwd, got["c"].group_id, got["c"].extra) == ("three", "d3", {}) and got["b"].docnm_kwd == "two"
    new = {r.id: r for r in S.update_metadata(S.upsert_chunks(target, batch, "at"), "d2", {"_title": "T2"}).collect()}
    assert (new["b"].docnm_kwd, new["b"].group_id, new["b"].metadata) == ("T2", "d2", {"_title": "T2"}) and new["c"].docnm_kwd == "three"


def test_extractions_merge_by_kind_of_value(spark):
    items = spark.createDataFrame(
        [(1, "drug", "x", 1, {"dose": ["1"], "side": ["a", "b"]}), (1, "drug", "x", 2, {"dose": ["2"], "side": ["b", "c"]}), (1, "drug", "y", 1, {}), (2, "drug", "x", 1, None)],
        "doc_id int, class string, text string, seq int, attributes map<string,array<string>>",
    )
    got = {(r.doc_id, r.text): r.attributes for r in S.merge_extractions(items).collect()}
    assert got == {(1, "x"): {"dose": ["2"], "side": ["a", "b", "c"]}, (1, "y"): None, (2, "x"): None}


def test_voted_types_are_applied(spark):
    d = spark.createDataFrame([(" 7", "1.5", "Yes", "2024-01-02", "t"), ("x", None, "maybe", "never", None)], "a string, b string, c string, d string, e string")
    got = S.typed(d, {"a": "int", "b": "float", "c": "bool", "d": "datetime", "e": "text"}).collect()
    assert got[0][:3] == (7, 1.5, True) and got[0].d.day == 2 and got[0].e == "t"
    assert tuple(got[1]) == (None, None, None, None, None)


@pytest.mark.parametrize("since", [None, "2024-01-02"])
def test_days(spark, since):
    d = spark.createDataFrame([("2024-01-01 05:00:00", 1, 2.0), ("2024-01-02 05:00:00", 1, None), ("2024-01-02 06:00:00", 1, 4.0), (None, 2, 1.0)], "t string, u int, v double").withColumn("t", F.to_timestamp("t"))
    got = rows(S.daily_stats(d, "t", "u", {"s": "v"}, {"m": "v"}, {"big": F.col("v") > 3}, F.to_timestamp(F.lit(since)) if since else None))
    assert got == ([] if since else [("2024-01-01", 1, 1, 2.0, 2.0, 0)]) + [("2024-01-02", 2, 1, 4.0, 4.0, 1)]
