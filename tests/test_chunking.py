"""Structure-aware chunkers: nothing lost, nothing protected cut, sizes kept; brute force of parts and of nested JSON."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lakeglean.operators import chunking as K


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def chunks(df, *order):
    return [(r.doc_id, r.text) for r in df.orderBy("doc_id", *order).collect()]


def count(t):
    return len([w for w in re.split(r"[^\w]+", t.lower()) if w])


def test_parts_outside_protected_regions(spark):
    r = random.Random(2)
    bits = ["word ", "one. ", "two! ", "$a. b$ ", "$$x. y$$ ", "```c. d``` ", "<table>e. f</table> ", "<p>g. h</p> ", "\\(i. j\\) ", "lone $ sign. ", "\n"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(60)] + ["```open. fence", "", None]
    guarded = re.compile(r"```.*?(?:```|\Z)|\$\$.*?(?:\$\$|\Z)|\$[^$\n]+\$|\\\(.*?(?:\\\)|\Z)|\\\[.*?(?:\\\]|\Z)|<(table|div|p|pre|code|blockquote)\b.*?(?:</\1>|\Z)", re.S)

    def brute(t):
        spans = [m.span() for m in guarded.finditer(t or "")]
        cuts, at = [], 0
        for a, b in [*spans, (len(t or ""), None)]:  # a match lies in one plain stretch
            cuts += [at + m.end() for m in re.finditer(r"[.!?]+\s*", (t or "")[at:a])]
            at = b or 0
        edges = [0, *cuts, len(t or "")]
        return [x for x in ((t or "")[a:b] for a, b in zip(edges, edges[1:])) if x]

    got = docs(spark, *texts).select("doc_id", K.parts_outside(F.col("text"), r"[.!?]+\s*").alias("p")).collect()
    for row in got:
        assert (row.p or []) == brute(texts[row.doc_id])


def test_pattern_chunks_lose_nothing_and_keep_tables(spark):
    text = "A first one. A second one. " * 10 + "<table><tr><td>x. y. z. " * 1 + "q " * 40 + "</td></tr></table> After it. End"
    got = chunks(K.chunk_regex(docs(spark, text, "a; b; c; d " * 20), r"[.!?]+\s*", 12, 4, protect=True, delims=";"), "seq")
    assert "".join(t for i, t in got if i == 0) == text and "".join(t for i, t in got if i == 1) == "a; b; c; d " * 20
    assert sum("<table>" in t and "</table>" in t for _, t in got) == 1
    assert all(count(t) <= 12 + 4 or "<table>" in t for _, t in got)


MARKDOWN = """intro line
# One
para one is here

| a | b |
|---|---|
| 1 | 2 |
| 3 | 4 |

## Two
```
# no heading
code one

code two
```
tiny
# Three
{long}

- item one
- item two
"""


def test_smart_chunks(spark):
    text = MARKDOWN.format(long=" ".join(f"Sentence number {i} ends here." for i in range(30)))
    got = [t for _, t in chunks(K.chunk_smart(docs(spark, text, "", None), 20, 6), "part")]
    whole = "\n".join(got)
    for line in text.split("\n"):
        if line.strip() and not line.startswith("Sentence"):
            assert line.strip().removeprefix("# ").removeprefix("## ") in whole or line.startswith("#")
    for i in range(30):
        assert whole.count(f"Sentence number {i} ends here.") == 1
    assert any("| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |" in t for t in got)  # one table
    assert any("```\n# no heading\ncode one\n\ncode two\n```" in t for t in got)  # one fence
    assert any(t.startswith("One > Two\n") or "\nOne > Two\n" in t for t in got)
    assert got[0].startswith("intro line")
    small = [t for t in got if count(t) < 6]
    assert len(small) <= 1  # a small chunk joined the one before, but for the first


def test_small_titles_join(spark):
    text = "# A\n" + "word " * 10 + "\n# B\nfew words\n# C\n" + "more " * 10
    apart = K.chunk_title(docs(spark, text), 3, 16).orderBy("section").collect()
    assert [r.title for r in apart] == ["A", "B", "C"]
    joined = K.chunk_title(docs(spark, text), 3, 16, least=4).orderBy("section").collect()
    assert [r.title for r in joined] == ["A", "C"] and "B\nfew words" in joined[0].text


def merged(parts):
    out = {}

    def put(a, b):
        for k, v in b.items():
            if isinstance(v, dict) and isinstance(a.get(k), dict):
                put(a[k], v)
            else:
                assert k not in a  # nothing twice
                a[k] = v

    for p in parts:
        put(out, p)
    return out


def as_objects(v):
    if isinstance(v, list):
        return {str(i): as_objects(x) for i, x in enumerate(v)}
    return {k: as_objects(x) for k, x in v.items()} if isinstance(v, dict) else v


@pytest.mark.parametrize("seed", range(12))
def test_nested_json_is_whole_again(seed):
    r = random.Random(seed)

    def value(depth):
        kind = r.random()
        if depth < 5 and kind < 0.35:
            return {f"k{i}é": value(depth + 1) for i in range(r.randint(1, 6))}
        if depth < 5 and kind < 0.6:
            return [value(depth + 1) for _ in range(r.randint(1, 6))]
        return r.choice([None, True, 3.5, "text " * r.randint(0, 8), "\"q\" \\ ü"])

    doc = {f"top{i}": value(0) for i in range(8)}
    parts = K.json_pieces(json.dumps(doc), 200, 60)
    assert merged(map(json.loads, parts)) == as_objects(doc)
    leaf = max((len(json.dumps({k: v}, ensure_ascii=False)) for k, v in doc.items() if not isinstance(v, (dict, list))), default=0)
    assert all(len(p) <= max(200, leaf) + 200 for p in parts)


def test_nested_json_rows(spark):
    deep = json.dumps({"a": {"b": [{"c": "x" * 50}, {"c": "y" * 50}], "d": 1}, "e": None})
    d = docs(spark, deep, "not json", None, "[1, [2, 3]]", "7", "{}")
    got = chunks(K.chunk_json_nested(d, "text", 100, 20), "seq")
    assert [json.loads(t) for i, t in got if i == 0] == [{"a": {"b": {"0": {"c": "x" * 50}}}}, {"a": {"b": {"1": {"c": "y" * 50}}, "d": 1}, "e": None}]
    assert [t for i, t in got if i == 3] == ['{"0": 1, "1": {"0": 2, "1": 3}}'] and [t for i, t in got if i == 4] == ["7"]
    assert {i for i, _ in got} == {0, 3, 4}


def test_readers_by_suffix(spark):
    rows = [("a.csv", 1, 'name,say\n"Doe, J","hi\nyou"\nK,"a ""b"""\n'), ("b.TSV", 2, "x\ty\n1\t2\n"), ("c.md", 3, "# T\nbody text\n"), ("d.json", 4, '{"p": {"q": 1}}'), ("e.jsonl", 5, '{"a": 1}\n{"a": 2}\nbroken'), ("f.py", 6, "x = 1, 2\n"), ("g", 7, "plain, text"), ("h.csv", 8, None)]
    got = {}
    for r in K.chunk_by_suffix(spark.createDataFrame(rows, "path string, doc_id long, text string")).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {1: ["name: Doe, J; say: hi\nyou; name: K; say: a \"b\""], 2: ["x: 1; y: 2"], 3: ["T\nbody text"], 4: ['{"p": {"q": 1}}'], 5: ['{"a": 1}', '{"a": 2}'], 6: ["x = 1, 2"], 7: ["plain, text"]}


def test_chunks_are_made_once(spark):
    plan = K.chunk_merge(docs(spark, "a. b. c"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
