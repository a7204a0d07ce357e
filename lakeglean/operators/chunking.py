"""Chunking of whole corpora: documents in, (doc_id, seq, text, n_tokens, ...) out, in parallel over documents.

Splitting, classifying, heading paths and joining are expressions and windows over lines; only the greedy fold, whose
resets depend on its running state, is a small vectorised helper over an array of sizes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import partial
from itertools import zip_longest

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import GRAMMARS, clean_page, content_id, domain, heading_grammar, heading_level, n_tokens, page_description, page_language, page_title, without_blanks, without_contents

DELIMITERS = "\n。；！？"


def groups(sizes: list[int], limit: float, over: bool, least: int = 0) -> list[int]:
    """Group number of each size. over: a group goes on until it is over the limit; else until the next would take it over.

    A last group under `least` joins the one before.
    """
    out, g, now = [], 0, 0
    for n in sizes:
        if now and (now > limit if over else now + n > limit):
            g, now = g + 1, 0
        out.append(g)
        now += n
    if least and g and now < least:
        out = [min(x, g - 1) for x in out]
    return out


def group_ends(sizes: Column, rule: Callable[[list[int]], list[int]]) -> Column:
    """array<int> of the ends of the groups that a rule numbers array<int> sizes by."""

    def ends(x: list[int] | None) -> list[int] | None:
        if x is None:
            return None
        ids = rule(list(x))
        return [i + 1 for i, g in enumerate(ids) if i + 1 == len(ids) or ids[i + 1] != g]

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(ends)

    return run(sizes)


def packed(
    d: DataFrame, parts: Column, sep: str, limit: float = 0, over: bool = False, least: int = 0, sizes: Column | None = None, rule: Callable[[list[int]], list[int]] | None = None
) -> DataFrame:
    """d with `chunks`, array<struct<text, n>>: its parts (array<string>) in turn by their tokens (or `sizes`), each looked at once, in groups() or those of a rule."""
    d = d.withColumn("_p", parts).withColumn("_n", sizes if sizes is not None else F.transform("_p", lambda x: n_tokens(x).cast("int")))
    d = d.withColumn("_e", group_ends(F.col("_n"), rule or partial(groups, limit=limit, over=over, least=least)))
    start = lambda i: F.when(i == 0, 0).otherwise(F.get("_e", i - 1))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y)
    one = lambda e, i: F.struct(F.array_join(F.slice("_p", start(i) + 1, e - start(i)), sep).alias("text"), total(F.slice("_n", start(i) + 1, e - start(i))).alias("n"))
    return d.withColumn("chunks", F.transform("_e", one)).drop("_p", "_n", "_e")


def unpacked(d: DataFrame, *keys: str, counted: bool = True) -> DataFrame:
    """(keys, seq, text, n_tokens) of `chunks`, blank ones out; counted: the sizes of the parts were their tokens."""
    # outer: else Spark would make the chunks twice, once to see that there are any
    out = d.select(*keys, F.posexplode_outer("chunks").alias("seq", "c")).where(without_blanks(F.col("c.text")) != "")
    return out.select(*keys, "seq", "c.text", (F.col("c.n") if counted else n_tokens(F.col("c.text"))).alias("n_tokens"))


def exploded(df: DataFrame, chunks: Column, id_col: str = "doc_id") -> DataFrame:
    out = df.select(id_col, F.posexplode_outer(chunks).alias("seq", "text")).where(F.trim("text") != "")
    return out.withColumn("n_tokens", n_tokens(F.col("text")))


def _sections(text: Column, delims: str, n: int) -> Column:
    """Lines; a line of n tokens or more in parts at the delimiters, which go."""
    cut = f"[{re.escape(delims)}]"
    lines = F.filter(F.split(text, "\n"), lambda x: without_blanks(x) != "")
    return F.flatten(F.transform(lines, lambda x: F.when(n_tokens(x) >= n, F.filter(F.split(x, cut), lambda y: without_blanks(y) != "")).otherwise(F.array(x))))


def chunk_merge(docs: DataFrame, n: int = 128, delims: str = DELIMITERS, overlap: int = 0) -> DataFrame:
    """Sections in turn until a chunk is over n * (100 - overlap) / 100 tokens; the next begins with the last `overlap` percent of its characters."""
    d = packed(docs.select("doc_id", "text"), _sections(F.col("text"), delims, n), "\n", n * (100 - overlap) / 100, over=True).drop("text")
    if not overlap:
        return unpacked(d, "doc_id")
    size = lambda c: F.floor(F.length(c) * overlap / 100).cast("int")
    tail = lambda c: F.when(size(c) > 0, F.substring(c, -size(c), size(c))).otherwise("")
    return exploded(d, F.transform("chunks", lambda x, i: F.when(i == 0, x["text"]).otherwise(F.concat(tail(F.get("chunks", i - 1)["text"]), x["text"]))))


def chunk_text(docs: DataFrame, n: int = 128, delims: str = "\n!?;。；！？") -> DataFrame:
    """As chunk_merge without overlap, for plain text: all sections are parted at the delimiters."""
    parts = F.filter(F.split("text", f"[{re.escape(delims)}]"), lambda x: F.trim(x) != "")
    return unpacked(packed(docs.select("doc_id", "text"), parts, "\n", n, over=True), "doc_id")


def chunk_fixed(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Windows of `size` characters that end at the last '.' of their second half, if there is one, and overlap."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict]:
            out, start = [], 0
            while t and start < len(t):
                end = start + size
                if end < len(t) and (stop := t.rfind(".", start, end)) > start + size // 2:
                    end = stop + 1
                out.append({"start": start, "end": min(end, len(t))})
                start = end - overlap if end < len(t) else len(t)
            return out

        return texts.map(one)

    d = docs.select("doc_id", "text", spans("text").alias("s"))
    return exploded(d, F.transform("s", lambda x: F.trim(F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"]))))


#: What a pattern never cuts: formulas, fenced code, and HTML blocks, to their end or to the end of the text.
PROTECTED = (
    r"(?s)```.*?(?:```|\z)|\$\$.*?(?:\$\$|\z)|\$[^$\n]+\$|\\\(.*?(?:\\\)|\z)|\\\[.*?(?:\\\]|\z)|<table\b.*?(?:</table>|\z)"
    r"|<div\b.*?(?:</div>|\z)|<p\b.*?(?:</p>|\z)|<pre\b.*?(?:</pre>|\z)|<code\b.*?(?:</code>|\z)|<blockquote\b.*?(?:</blockquote>|\z)"
)
#: Marks a cut while parts are made (characters for private use).
CUT = "\ue000\ue001\ue000"


def parts_outside(text: Column, pattern: str) -> Column:
    """array<string>: the text cut after each match of the pattern that lies outside PROTECTED."""
    plain = F.transform(F.split(text, PROTECTED), lambda x: F.regexp_replace(x, f"({pattern})", f"$0{CUT}"))
    kept = F.regexp_extract_all(text, F.lit(PROTECTED), F.lit(0))
    whole = F.array_join(F.transform(plain, lambda x, i: F.concat(x, F.coalesce(F.get(kept, i), F.lit("")))), "")
    return F.filter(F.split(whole, CUT), lambda x: x != "")


def chunk_regex(docs: DataFrame, pattern: str, n: int = 256, least: int = 128, protect: bool = False, delims: str = "") -> DataFrame:
    """Parts that end with a match of the pattern, packed to at most n tokens; a last chunk under `least` joins the one before.

    With protect, matches in formulas, code and HTML blocks do not cut. Parts over n tokens are cut after each of `delims`
    (outside of those, with protect). The pattern has no groups of its own.
    """
    if protect:
        parts = parts_outside(F.col("text"), pattern)
    else:
        parts = F.filter(F.regexp_extract_all("text", F.lit(rf"(?s).*?(?:{pattern})|(?s).+\z"), F.lit(0)), lambda x: x != "")
    d = docs.select("doc_id", parts.alias("parts"))
    own = F.col("parts")
    if delims:
        any_of = f"[{re.escape(delims)}]"
        smaller = (lambda x: parts_outside(x, any_of)) if protect else (lambda x: F.filter(F.split(F.regexp_replace(x, any_of, f"$0{CUT}"), CUT), lambda y: y != ""))
        own = F.flatten(F.transform("parts", lambda x: F.when(n_tokens(x) > n, smaller(x)).otherwise(F.array(x))))
    return unpacked(packed(d, own, "", n, False, least), "doc_id")


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line, text, fence, level): level of a markdown heading outside code fences, else 0."""
    own = docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line", "text"))
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.col("text").rlike(r"^\s*(```|~~~)")
    own = own.withColumn("mark", mark).withColumn("fence", F.sum(F.col("mark").cast("int")).over(w) % 2 == 1)
    level = F.when(~F.col("fence") & ~F.col("mark"), F.length(F.regexp_extract("text", r"^(#{1,6})\s", 1))).otherwise(0)
    return own.withColumn("level", level)


def open_headings(own: DataFrame, max_level: int = 6) -> DataFrame:
    """Lines with `open`: the headings (line, text) over and with each line, outermost first. A heading ends those as deep or deeper."""
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    for k in range(1, max_level + 1):
        own = own.withColumn(f"h{k}", F.last(F.when(F.col("level") == k, F.struct("line", "text")), ignorenulls=True).over(w))
    alive = []
    for k in range(1, max_level + 1):
        shallower = [F.coalesce(F.col(f"h{j}.line"), F.lit(-1)) for j in range(1, k)]
        ok = F.col(f"h{k}").isNotNull() & (F.col(f"h{k}.line") > F.greatest(F.lit(-1), *shallower) if shallower else F.lit(True))
        alive.append(F.when(ok, F.col(f"h{k}")))
    return own.withColumn("open", F.array_compact(F.array(*alive))).drop(*(f"h{k}" for k in range(1, max_level + 1)))


def heading_path(own: DataFrame, max_level: int = 6) -> DataFrame:
    """Lines with `path`: the texts of their open headings, without marks."""
    title = lambda h: F.trim(F.regexp_replace(h["text"], r"^#+\s*", ""))
    return open_headings(own, max_level).withColumn("path", F.transform("open", title)).drop("open")


def _body(own: DataFrame, *keys: str) -> DataFrame:
    """Lines of each key in order, joined; the first line and path of each."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
    return own.groupBy("doc_id", *keys).agg(F.array_join(texts, "\n").alias("text"), F.min("line").alias("line"), F.min_by("path", "line").alias("path"))


def joined_ids(sizes: Column, least: int, most: float) -> Column:
    """array<int>: chunks of under `least` tokens join the one before, while both have no more than `most`."""

    def ids(x: list[int] | None) -> list[int] | None:
        out: list[int] = []
        now = 0
        for n in x if x is not None else ():
            joins = bool(out) and n < least and now + n <= most
            out.append(out[-1] + (not joins) if out else 0)
            now = now + n if joins else n
        return out

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(ids)

    return run(sizes)


def told(rows: DataFrame, sep: str) -> DataFrame:
    """(doc_id, m, title: the first, text) of rows (doc_id, m, section, part, title, text) joined by m; a title that changes within a chunk is said again."""
    w = Window.partitionBy("doc_id", "m").orderBy("section", "part")
    before = F.lag("title").over(w)
    own = rows.withColumn("said", F.when(before.isNotNull() & (before != F.col("title")) & (F.col("title") != ""), F.concat("title", F.lit("\n"), "text")).otherwise(F.col("text")))
    line = F.transform(F.array_sort(F.collect_list(F.struct("section", "part", "said"))), lambda x: x["said"])
    return own.groupBy("doc_id", "m").agg(F.min_by("title", F.struct("section", "part")).alias("title"), F.array_join(line, sep).alias("text"))


def chunk_title(docs: DataFrame, level: int = 3, n: int = 256, least: int = 0) -> DataFrame:
    """A chunk from each heading of `level` or above to the next; long ones packed by lines with the title repeated; bare titles go.

    Chunks of under `least` tokens join the one before, while both fit n, under their own title if it differs.
    """
    own = heading_path(lines(docs))
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("section", F.sum(F.when(F.col("level").between(1, level), 1).otherwise(0)).over(w))
    body = _body(own.where("level = 0 or level > %d" % level), "section").where(F.trim("text") != "")
    d = packed(body.select("doc_id", "section", F.array_join("path", " > ").alias("title"), "text"), F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), "\n", n)
    out = d.select("doc_id", "section", "title", F.posexplode_outer("chunks").alias("part", "c")).where("c is not null")
    out = out.select("doc_id", "section", "part", "title", "c.text", F.col("c.n").alias("n_tokens"))
    if not least:
        return out
    per = out.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section", "part", "title", "text", "n_tokens"))).alias("c"))
    ids = joined_ids(F.transform("c", lambda x: x["n_tokens"].cast("int")), least, n)
    rows = per.withColumn("m", ids).select("doc_id", F.explode(F.arrays_zip("c", "m")).alias("z")).select("doc_id", "z.m", "z.c.*")
    return told(rows, "\n").select("doc_id", F.col("m").alias("section"), F.lit(0).alias("part"), "title", "text", n_tokens(F.col("text")).alias("n_tokens"))


def block_kind() -> Column:
    """Of lines()."""
    t = F.col("text")
    return (
        F.when(F.col("fence") | F.col("mark"), "fence").when(F.col("level") > 0, "header").when(t.rlike(r"^\s*\|.*\|\s*$"), "table")
        .when(t.rlike(r"^\s*([-*+]|[0-9]+[.)])\s"), "list").when(t.rlike(r"^\s*>"), "quote").when(F.trim("text") == "", "blank").otherwise("paragraph")
    )


def fresh_block(by) -> Column:
    """Whether a block begins with a line."""
    before, opens = F.lag("kind").over(by), F.col("mark") & F.col("fence")
    return before.isNull() | (before != F.col("kind")) | (F.col("kind") == "header") | opens


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block, kind, text): runs of header, fence, table, list, quote and paragraph lines."""
    own = lines(docs)
    by = Window.partitionBy("doc_id").orderBy("line")
    own = own.withColumn("kind", block_kind())
    own = own.withColumn("block", F.sum(fresh_block(by).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
    return own.where("kind <> 'blank'").groupBy("doc_id", "block", "kind").agg(F.array_join(texts, "\n").alias("text"))


def chunk_smart(docs: DataFrame, n: int = 256, least: int = 64, delims: str = DELIMITERS) -> DataFrame:
    """(doc_id, part, text, n_tokens): typed blocks packed to n tokens within a heading, the heading path first.

    Tables and fences are never cut. Other blocks over 1.5 n tokens go by lines, and lines over n by sentences. A chunk of
    under `least` tokens joins the one before, of whatever heading, while both have 1.2 n at most; its own path is said then.
    """
    own = heading_path(lines(docs)).withColumn("kind", block_kind())
    by = Window.partitionBy("doc_id").orderBy("line")
    running = by.rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(running)).withColumn("block", F.sum(fresh_block(by).cast("int")).over(running))
    blocks = own.where("kind not in ('blank', 'header')").groupBy("doc_id", "section", "block", "kind").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("rows"), F.min_by("path", "line").alias("path")
    )
    text = F.array_join("rows", "\n")
    sentence = lambda x: F.filter(F.split(F.regexp_replace(x, f"[{re.escape(delims)}]|(?<=[.!?]) ", f"$0{CUT}"), CUT), lambda y: F.trim(y) != "")
    finer = F.flatten(F.transform("rows", lambda x: F.when(n_tokens(x) > n, sentence(x)).otherwise(F.array(x))))
    pieces = F.when(~F.col("kind").isin("table", "fence") & (n_tokens(text) > 1.5 * n), finer).otherwise(F.array(text))
    title = F.array_join("path", " > ")
    pieces = blocks.select("doc_id", "section", title.alias("title"), "block", F.posexplode(pieces).alias("i", "piece"))
    per = pieces.groupBy("doc_id", "section").agg(F.array_sort(F.collect_list(F.struct("block", "i", "piece"))).alias("p"), F.first("title").alias("title"))  # of one section
    per = packed(per, F.transform("p", lambda x: x["piece"]), "\n\n", n)
    chunks = per.select("doc_id", "section", "title", F.posexplode_outer("chunks").alias("part", "c")).where("c is not null").select("doc_id", "section", "part", "title", "c.text", F.col("c.n").alias("n_tokens"))
    whole = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section", "part", "title", "text", "n_tokens"))).alias("c"))
    ids = joined_ids(F.transform("c", lambda x: x["n_tokens"].cast("int")), least, 1.2 * n)
    rows = whole.withColumn("m", ids).select("doc_id", F.explode(F.arrays_zip("c", "m")).alias("z")).select("doc_id", "z.m", "z.c.*")
    out = told(rows, "\n\n")
    return out.select("doc_id", F.col("m").alias("part"), F.when(F.col("title") == "", F.col("text")).otherwise(F.concat("title", F.lit("\n"), "text")).alias("text")).withColumn("n_tokens", n_tokens(F.col("text")))


def chunk_outline(docs: DataFrame, levels: list[str], hierarchy: int) -> DataFrame:
    """Lines by the first matching pattern's level; each leaf emits its path down to `hierarchy`, with the text under it."""
    level = F.lit(0)
    for i, pattern in reversed(list(enumerate(levels, 1))):
        level = F.when(F.col("text").rlike(pattern), i).otherwise(level)
    own = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("level", level)
    own = heading_path(own, len(levels))
    own = own.withColumn("key", F.array_join(F.slice("path", 1, hierarchy), "\n"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
    body = own.where("level = 0").where(F.trim("text") != "").groupBy("doc_id", "key").agg(F.array_join(texts, "\n").alias("body"), F.min("line").alias("line"))
    return body.select("doc_id", "line", F.concat_ws("\n", F.when(F.col("key") != "", F.col("key")), "body").alias("text"))


def pivot_level(own: DataFrame) -> DataFrame:
    """(doc_id, pivot): the most frequent heading level of each document, the shallowest of equals."""
    counts = own.where("level > 0").groupBy("doc_id", "level").agg(F.count("*").alias("n"))
    return counts.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("level")).alias("l"))).alias("m")).select("doc_id", (-F.col("m.l")).alias("pivot"))


def chunk_sections(own: DataFrame, small: int = 32, large: int = 1024) -> DataFrame:
    """Lines cut where a heading of the pivot level or above begins; sections under `small` tokens go on into the next while under `large`."""
    p = own.join(pivot_level(own), "doc_id", "left").withColumn("pivot", F.coalesce("pivot", F.lit(0)))
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("section", F.sum(((F.col("level") > 0) & (F.col("level") <= F.col("pivot"))).cast("int")).over(w)).withColumn("path", F.array().cast("array<string>"))
    per = _body(p, "section").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("section", "text"))), lambda x: x["text"]).alias("p"))

    def rule(row: list[int]) -> list[int]:
        out, g, now = [], 0, 0
        for n in row:
            if out and not (now < small and now + n < large):
                g, now = g + 1, 0
            out.append(g)
            now += n
        return out

    return unpacked(packed(per, F.col("p"), "\n", rule=rule), "doc_id")


#: Level of a line that is no heading of its document's grammar, below all of those.
BODY = max(map(len, GRAMMARS)) + 1


def graded_lines(docs: DataFrame, contents: bool = True) -> DataFrame:
    """(doc_id, grammar, line, text, level) of the lines with over one character that are no bare number, by the document's heading grammar.

    contents: tables of contents stay.
    """
    ls = F.split("text", "\n")
    d = docs.select("doc_id", ls.alias("ls"))
    if not contents:
        d = d.withColumn("ls", without_contents(F.col("ls")))
    own = d.select("doc_id", heading_grammar(F.col("ls")).alias("grammar"), F.posexplode("ls").alias("line", "text"))
    own = own.withColumn("text", F.trim(F.translate("text", "\u3000\r", "  "))).where((F.length("text") > 1) & ~F.col("text").rlike("^[0-9]+$"))
    return own.withColumn("level", F.coalesce(heading_level(F.col("text"), F.col("grammar")), F.lit(BODY)))


def chunk_tree(docs: DataFrame, depth: int = 2) -> DataFrame:
    """(doc_id, seq, text, n_tokens) as for laws: headings down to the depth-th level in use are nodes, what is below them is their text.

    Each leaf is a chunk, after the texts of the nodes over it; text before any node is one too. Tables of contents go.
    Without headings each line is a chunk. A document without lines (null or empty text) has none.
    """
    own = graded_lines(docs, contents=False)
    used = own.groupBy("doc_id").agg(F.array_sort(F.collect_set("level")).alias("used"))
    target = F.get("used", F.least(F.lit(depth), F.size("used")) - 1)
    target = F.when((target == BODY) & (F.size("used") > 1), F.get("used", F.size("used") - 2)).otherwise(target)
    own = own.join(used.select("doc_id", target.alias("target")), "doc_id")
    w = Window.partitionBy("doc_id").orderBy("line")
    own = own.withColumn("node", F.sum((F.col("level") <= F.col("target")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
    nodes = own.groupBy("doc_id", "node").agg(F.array_join(texts, "\n").alias("text"), F.min("line").alias("line"), F.min_by("level", "line").alias("level"))
    nodes = nodes.withColumn("level", F.when(F.col("node") > 0, F.col("level")).otherwise(0))
    after = F.lead("level").over(w)
    leaves = open_headings(nodes, BODY).withColumn("after", after).where("level = 0 or after is null or after <= level")
    whole = F.when(F.col("level") == 0, F.col("text")).otherwise(F.array_join(F.transform("open", lambda h: h["text"]), "\n"))
    out = leaves.select("doc_id", (F.row_number().over(w) - 1).alias("seq"), whole.alias("text"))
    return out.withColumn("n_tokens", n_tokens(F.col("text")))


def chunk_book(docs: DataFrame, depth: int = 5, n: int = 218) -> DataFrame:
    """(doc_id, seq, text, n_tokens) as for books: each line under its open headings, and the deeper headings that have no line of their own.

    Lines without headings are packed while under n tokens. `depth` counts levels from the lines up, with one for titles
    by layout, of which plain text has none. Documents without a grammar are cut as chunk_merge does, to 256 tokens.
    """
    graded = graded_lines(docs)
    own = open_headings(graded, BODY - 1)
    body = own.where(F.col("level") == BODY)
    size = F.create_map(*(x for g, p in enumerate(GRAMMARS) for x in (F.lit(g), F.lit(len(p)))))[F.col("grammar")]
    # a heading is told with the lines under it; a bare one, with no line below, on its own
    used = body.select("doc_id", F.explode(F.transform("open", lambda h: h["line"])).alias("line")).distinct()
    bare = own.where((F.col("grammar") >= 0) & (F.col("level") < BODY) & (F.col("level") > size + 2 - depth))
    bare = bare.join(used, ["doc_id", "line"], "left_anti")
    # or with the bare ones deeper under it
    inner = bare.select("doc_id", F.col("line").alias("own"), F.explode(F.transform("open", lambda h: h["line"])).alias("line")).where("own <> line").select("doc_id", "line").distinct()
    bare = bare.join(inner, ["doc_id", "line"], "left_anti")
    # fixed rule: a bare heading of the second level stands without the first
    over = F.when(F.col("level") == 2, F.array("text")).otherwise(F.transform("open", lambda h: h["text"]))
    cols = ["doc_id", "level", "line", "parts"]
    said = body.where("grammar >= 0").withColumn("parts", F.concat(F.transform("open", lambda h: h["text"]), F.array("text"))).select(cols)
    said = said.unionByName(bare.withColumn("parts", over).select(cols))
    per = said.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("level")).alias("o"), "line", "parts"))).alias("c"))
    text = F.transform("c", lambda x: F.array_join(x["parts"], "\n"))
    sizes = F.transform("c", lambda x: F.when(F.size(x["parts"]) == 1, n_tokens(x["parts"][0]).cast("int")).otherwise(n))
    per = packed(per, text, "\n", n - 1, sizes=sizes)
    plain = docs.select("doc_id", "text").where(heading_grammar(F.split("text", "\n")) < 0)
    return unpacked(per, "doc_id", counted=False).unionByName(chunk_merge(plain, 256, "\n。；！？"))


def chunk_one(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.lit(0).alias("seq"), "text", n_tokens(F.col("text")).alias("n_tokens"))


def chunk_qa(own: DataFrame, sep: str = "\t") -> DataFrame:
    """(doc_id, q, question, answer) of lines: a line with one separator begins a pair, others go on its answer; lines before any pair go."""
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    pair = F.size(F.split("text", re.escape(sep))) == 2
    own = own.withColumn("pair", pair).withColumn("q", F.sum(F.col("pair").cast("int")).over(w)).where("q > 0")
    rest = F.when(F.col("pair"), F.split("text", re.escape(sep))[1]).otherwise(F.col("text"))
    strip = lambda c: F.trim(F.regexp_replace(c, r"(?i)^\s*(question|answer|user|assistant|q|a)\s*[:：\t]\s*", ""))
    answer = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", rest.alias("t")))), lambda x: x["t"]), "\n")
    out = own.groupBy("doc_id", "q").agg(F.min_by(F.split("text", re.escape(sep))[0], "line").alias("question"), answer.alias("answer"))
    return out.select("doc_id", "q", strip(F.col("question")).alias("question"), strip(F.col("answer")).alias("answer"))


def chunk_tags(own: DataFrame, sep: str = "\t") -> DataFrame:
    """(doc_id, r, content, tags): lines up to and with one that ends in a separator and comma-separated tags are one content."""
    pair = F.size(F.split("text", re.escape(sep))) == 2
    back = Window.partitionBy("doc_id").orderBy("line").rowsBetween(0, Window.unboundedFollowing)
    own = own.withColumn("pair", pair).withColumn("r", F.sum(F.col("pair").cast("int")).over(back)).where("r > 0")
    part = F.split("text", re.escape(sep))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", part[0].alias("t")))), lambda x: x["t"]), "\n")
    tags = F.max(F.when(F.col("pair"), part[1]))
    split = F.filter(F.transform(F.split("tags", ","), lambda y: F.trim(y)), lambda x: x != "")
    return own.groupBy("doc_id", "r").agg(text.alias("content"), tags.alias("tags")).select("doc_id", "r", "content", split.alias("tags"))


def html_markdown(html: Column) -> Column:
    """Block text of a page: scripts, styles and comments out, headings as #, block tags as line ends, other tags out."""
    c = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|nav|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"\s+", " ")
    for k in range(1, 7):
        c = F.regexp_replace(c, f"(?i)<h{k}[^>]*>", "\n\n" + "#" * k + " ")
    c = F.regexp_replace(c, r"(?i)</?(p|div|li|ul|ol|br|tr|table|section|article|header|footer|body|html|main|h[1-6])\b[^>]*>", "\n")
    c = F.regexp_replace(c, "<[^>]+>", "")
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), lambda y: F.trim(y)), lambda x: x != ""), "\n")


def chunk_html(pages: DataFrame, n: int = 512) -> DataFrame:
    d = pages.select(F.col("page_id").alias("doc_id"), F.split(html_markdown(F.col("html")), "\n").alias("p"))
    return unpacked(packed(d, F.col("p"), "\n", n), "doc_id")


def chunk_json(docs: DataFrame, json: str, most: int = 2000) -> DataFrame:
    """(doc_id, seq, paths): the parts (path: value) of a JSON column, packed to `most` characters."""
    flat = docs.select("doc_id", F.expr(f"try_parse_json({json})").alias("v")).where("v is not null")
    leaves = flat.lateralJoin(flat.sparkSession.tvf.variant_explode_outer(F.col("v").outer()))
    one = leaves.select("doc_id", F.coalesce("key", F.col("pos").cast("string"), F.lit("")).alias("path"), F.expr("to_json(value)").alias("value"))
    per = one.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "path", "value"))).alias("p"))
    per = packed(per, F.col("p"), ", ", most, sizes=F.transform("p", lambda x: F.length(x)))
    return per.select("doc_id", F.posexplode_outer(F.transform("chunks", lambda x: x["text"])).alias("seq", "paths")).where("paths is not null")


def json_pieces(text: str | None, most: int, least: int) -> list[str] | None:
    """A JSON document in JSON objects of under `most` characters that keep the paths of what they hold; lists become objects by place.

    A value that does not fit the room left goes into its members; a chunk of `least` characters at least is closed first.
    A single value larger than `most` stays whole. None for what is no JSON.
    """
    try:
        todo: list = [((), json.loads(text or ""))]
    except ValueError:
        return None
    chunks: list[dict] = [{}]
    length = lambda x: len(json.dumps(x, ensure_ascii=False))

    def members(v: object) -> dict | None:
        return v if isinstance(v, dict) else {str(i): x for i, x in enumerate(v)} if isinstance(v, list) else None

    def plain(v: object) -> object:
        own = members(v)
        return v if own is None else {k: plain(x) for k, x in own.items()}

    while todo:
        path, value = todo.pop()
        inner = members(value)
        if path:
            filled = length(chunks[-1])
            if length({path[-1]: plain(value)}) >= most - filled:
                if filled >= least:
                    chunks.append({})
                if inner:
                    todo.extend(((*path, k), x) for k, x in reversed(inner.items()))
                    continue
            at = chunks[-1]
            for k in path[:-1]:
                at = at.setdefault(k, {})
            at[path[-1]] = plain(value)
        elif inner is None:
            return [json.dumps(value, ensure_ascii=False)]
        else:
            todo.extend(((k,), x) for k, x in reversed(inner.items()))
    return [json.dumps(c, ensure_ascii=False) for c in chunks if c]


def chunk_json_nested(docs: DataFrame, column: str, most: int = 4000, least: int = 1800) -> DataFrame:
    """(doc_id, seq, text): json_pieces of a JSON column, of any depth; rows without JSON have none."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: json_pieces(t, most, least))

    return docs.select("doc_id", F.posexplode_outer(run(F.col(column))).alias("seq", "text")).where("text is not null")


def pack_contexts(chunks: DataFrame, budget: int = 1024) -> DataFrame:
    """(doc_id, seq, text): a document's chunks (doc_id, seq, text, n_tokens) in order in contexts under the budget."""
    own = F.array_sort(F.collect_list(F.struct("seq", "text", "n_tokens")))
    d = chunks.groupBy("doc_id").agg(own.alias("c")).select("doc_id", F.transform("c", lambda x: x["text"]).alias("p"), F.transform("c", lambda x: x["n_tokens"].cast("int")).alias("n"))
    return unpacked(packed(d, F.col("p"), "\n", budget - 1, sizes=F.col("n")), "doc_id", counted=False)


def pack_rows(rows: DataFrame, key: str, order: str, text: str, batch: int = 10) -> DataFrame:
    """Rows of each key in tens, joined by '; '."""
    n = F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / batch)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("_t")))), lambda x: x["_t"]), "; ")
    return rows.withColumn("batch", n).groupBy(key, "batch").agg(line.alias("text"))


def work_units(docs: DataFrame, size: int = 3000) -> DataFrame:
    """(doc_id, from_row, to_row, digest): slices of `size` characters, one at least."""
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(size)))
    u = docs.select("doc_id", "text", start.alias("from_row"))
    part = F.substring("text", F.col("from_row") + 1, F.lit(size))
    return u.select("doc_id", "from_row", F.least(F.col("from_row") + size, F.length("text")).alias("to_row"), F.md5(F.concat_ws("|", "from_row", part)).alias("digest"))


def enrich(chunks: DataFrame, docs: DataFrame, title: str, now: Column) -> DataFrame:
    """Chunks with ids, the document's title tokens, timestamps and positions."""
    from ..functions.text import tokens

    d = docs.select("doc_id", F.array_join(tokens(F.regexp_replace(title, r"\.[a-zA-Z]+$", "")), " ").alias("title_tks"))
    c = chunks.join(d, "doc_id", "left")
    pos = F.array_repeat(F.array_repeat(F.col("seq"), 5), 1)
    return c.withColumns({"id": content_id(F.col("text"), F.col("doc_id").cast("string")), "content_ltks": F.array_join(tokens(F.col("text")), " "), "create_time": F.date_format(now, "yyyy-MM-dd HH:mm:ss"), "create_timestamp_flt": F.unix_timestamp(now).cast("double"), "position_int": pos})


def page_documents(pages: DataFrame) -> DataFrame:
    """A document row for each scraped page."""
    md, none = html_markdown(F.col("html")), F.lit(None).cast("string")
    title = F.trim(F.regexp_extract("html", "(?is)<title>([^<]*)</title>", 1))
    return pages.select(
        content_id(F.col("url"), F.substring(md, 1, 100)).alias("id"), "page_id", page_title(title, none, md, F.col("url")).alias("title"), page_description(md).alias("description"),
        page_language(md).alias("language"), domain(F.col("url")).alias("domain"), clean_page(md).alias("content"), F.to_json(F.struct("url", F.length("html").alias("size"))).alias("metadata"),
    ).where("content <> ''")


CHUNKERS: dict[str, Callable[..., DataFrame]] = {
    "naive": chunk_merge, "text": chunk_text, "fixed": chunk_fixed, "regex": chunk_regex, "title": chunk_title, "smart": chunk_smart, "outline": chunk_outline,
    "one": chunk_one, "html": chunk_html, "json": chunk_json, "json_nested": chunk_json_nested, "tree": chunk_tree, "book": chunk_book,
}


#: Suffixes that a reader of their own takes.
PAGES, TABLES, MARKDOWN, JSONS = ("html", "htm"), ("csv", "tsv"), ("md", "markdown", "mdx"), ("json", "jsonl")


def csv_rows(text: str | None, sep: str) -> list[str]:
    """Rows of a table, each value with its column's name; quotes may hold separators and line ends."""
    import csv

    rows = [r for r in csv.reader((text or "").splitlines(keepends=True), delimiter=sep) if any(x.strip() for x in r)]
    return ["; ".join(f"{h}: {v}" if h else v for h, v in zip_longest(rows[0], r, fillvalue="") if v.strip()) for r in rows[1:]] if len(rows) > 1 else ["; ".join(r) for r in rows]


def chunk_by_suffix(files: DataFrame, n: int = 128) -> DataFrame:
    """(doc_id, seq, text, n_tokens) of files (path, doc_id, text), each format by its reader.

    Rows of csv and tsv with their column names, whole and ten at most together; markdown by its blocks and headings; JSON
    (one document, or one a line) in parts that keep their paths; pages as text; code and all else by lines.
    """
    f = files.select("doc_id", "text", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("kind"))

    @F.pandas_udf("array<string>")
    def rows(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([csv_rows(t, "," if k == "csv" else "\t") for t, k in zip(texts, kinds, strict=True)])

    tables = f.where(F.col("kind").isin(*TABLES)).select("doc_id", F.posexplode_outer(rows("text", "kind")).alias("row", "line")).where("line is not null")
    tables = pack_rows(tables, "doc_id", "row", "line").select("doc_id", F.col("batch").cast("int").alias("seq"), "text").withColumn("n_tokens", n_tokens(F.col("text")))
    marked = chunk_smart(f.where(F.col("kind").isin(*MARKDOWN)), n).select("doc_id", F.col("part").cast("int").alias("seq"), "text", "n_tokens")
    own = f.where(F.col("kind").isin(*JSONS)).select("doc_id", F.explode(F.when(F.col("kind") == "jsonl", F.split("text", "\n")).otherwise(F.array("text"))).alias("text"))
    parsed = own.select("doc_id", F.monotonically_increasing_id().alias("line"), "text")
    parts = chunk_json_nested(parsed.select(F.struct("doc_id", "line").alias("doc_id"), "text"), "text")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "i")) - 1
    parts = parts.select("doc_id.doc_id", "doc_id.line", F.col("seq").alias("i"), "text").withColumn("seq", order.cast("int")).select("doc_id", "seq", "text", n_tokens(F.col("text")).alias("n_tokens"))
    pages = f.where(F.col("kind").isin(*PAGES)).select("doc_id", html_markdown(F.col("text")).alias("text"))
    rest = f.where(~F.col("kind").isin(*PAGES, *TABLES, *MARKDOWN, *JSONS)).select("doc_id", "text")
    lined = chunk_merge(pages.unionByName(rest), n).select("doc_id", "seq", "text", "n_tokens")
    return lined.unionByName(tables).unionByName(marked).unionByName(parts)
