"""Knowledge-graph jobs over nodes(id, type, description, source_id) and edges(src, dst, weight, description, keywords, source_id), src < dst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_str, grams, is_english, similar_name
from .catalog import top_k
from .components import connected_components, cut

SEP = "<SEP>"


def canonical(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Ends in order."""
    return edges.withColumns({src: F.least(src, dst), dst: F.greatest(src, dst)})


def parse_records(responses: DataFrame, types: list[str], text: str = "response", mark: str = "<|>") -> tuple[DataFrame, DataFrame]:
    """Entities (name, type, description, source) and relations (src, dst, description, keywords, weight, source) of delimited records."""
    field = lambda x: F.upper(clean_str(x))
    rec = responses.select("source", F.explode(F.regexp_extract_all(text, F.lit(r"\(([^()]*)\)"), F.lit(1))).alias("r"))
    part = F.split("r", r"<\|>" if mark == "<|>" else mark)
    rec = rec.select("source", F.transform(part, lambda x: F.trim(F.replace(x, F.lit('"'), F.lit("")))).alias("p"))
    size, kind = F.size("p"), F.lower(F.get("p", 0))
    e = rec.where((size >= 4) & (kind == "entity")).select(field(F.get("p", 1)).alias("name"), F.lower(F.get("p", 2)).alias("type"), clean_str(F.get("p", 3)).alias("description"), "source")
    e = e.where((F.col("name") != "") & F.col("type").isin([t.lower() for t in types]))
    r = rec.where((size >= 5) & (kind == "relationship")).select(
        field(F.get("p", 1)).alias("src"), field(F.get("p", 2)).alias("dst"), clean_str(F.get("p", 3)).alias("description"), clean_str(F.get("p", 4)).alias("keywords"),
        F.coalesce(F.element_at("p", -1).try_cast("double"), F.lit(1.0)).alias("weight"), "source")
    return e, canonical(r.where("src <> '' and dst <> ''"))


def _texts(c: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(c)), SEP)


def merge_entities(mentions: DataFrame) -> DataFrame:
    """(name, type: the most frequent, the smallest of equals, description, source_id, n)."""
    votes = mentions.groupBy("name", "type").agg(F.count("*").alias("n"))
    kind = votes.groupBy("name").agg(F.min_by("type", F.struct((-F.col("n")).alias("n"), "type")).alias("type"))
    rest = mentions.groupBy("name").agg(_texts("description").alias("description"), F.array_sort(F.collect_set("source")).alias("source_id"), F.count("*").alias("n"))
    return rest.join(kind, "name")


def merge_relations(mentions: DataFrame) -> DataFrame:
    return canonical(mentions).groupBy("src", "dst").agg(F.sum("weight").alias("weight"), _texts("description").alias("description"), F.array_sort(F.collect_set("keywords")).alias("keywords"), F.array_sort(F.collect_set("source")).alias("source_id"))


def tidy(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with a description and a source; edges only between nodes that stay."""
    ok = F.col("description").isNotNull() & F.col("source_id").isNotNull()
    n = nodes.where(ok)
    e = edges.where(ok)
    if "keywords" in e.columns:
        e = e.withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    return n, valid_relations(e, n)[0]


def valid_relations(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with both ends among the nodes, and the number of the others (one row)."""
    ids = nodes.select("id").distinct()
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, edges.agg(F.count("*").alias("n")).join(kept.agg(F.count("*").alias("k"))).select((F.col("n") - F.col("k")).alias("ignored"))


def union_edges(*graphs: DataFrame) -> DataFrame:
    """Edges (src, dst, weight, source) of several graphs merged: weights add up."""
    all_ = graphs[0]
    for g in graphs[1:]:
        all_ = all_.unionByName(g)
    return canonical(all_).groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.array_sort(F.collect_set("source")).alias("source_id"))


def _in_order(c: str, sep: str | None = None) -> Column:
    """Values of the graphs in their order: joined texts, or one array of all arrays."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(c).alias("_v")))), lambda x: x["_v"])
    return F.array_join(own, sep) if sep is not None else F.flatten(own)


def union_graphs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graphs numbered by seq merged in that order, with their attributes.

    nodes: (seq, id, type, description, source_id array); edges: (seq, src, dst, weight, description, keywords and source_id
    arrays); one row a graph. A node keeps the type it had first, descriptions are joined, sources and keywords put one after
    the other, weights added up. rank is the number of a node's edges, a loop counting two. Null descriptions are left out.
    """
    n = nodes.groupBy("id").agg(F.min_by("type", "seq").alias("type"), _in_order("description", SEP).alias("description"), _in_order("source_id").alias("source_id"))
    e = canonical(edges).groupBy("src", "dst").agg(F.sum("weight").alias("weight"), _in_order("description", SEP).alias("description"), _in_order("keywords").alias("keywords"), _in_order("source_id").alias("source_id"))
    n = n.join(degrees(e).withColumnRenamed("degree", "rank"), "id", "left").withColumn("rank", F.coalesce("rank", F.lit(0).cast("long")))
    return n, e


def rebuild_graphs(nodes: DataFrame, edges: DataFrame, exclude: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graphs of union_graphs put over each other again, but for those with a source of exclude (source).

    The latest graph's attributes win, and its edge wins whole; sources of a node come from all graphs that have it.
    """
    gone = exclude.select("source").distinct()
    hit = lambda df: df.select("seq", F.explode("source_id").alias("source")).join(gone, "source", "left_semi").select("seq")
    out = hit(nodes).unionByName(hit(edges)).distinct()  # a graph goes as a whole
    n, e = (df.join(out, "seq", "left_anti") for df in (nodes, canonical(edges)))
    n = n.groupBy("id").agg(F.max_by("type", "seq").alias("type"), F.max_by("description", "seq").alias("description"), _in_order("source_id").alias("source_id"))
    last = F.max_by(F.struct("weight", "description", "keywords", "source_id"), "seq").alias("x")
    return n, e.groupBy("src", "dst").agg(last).select("src", "dst", "x.*")


def touched(before: DataFrame, batch: DataFrame, *keys: str) -> DataFrame:
    """(keys, change) of a batch: added, or updated where it was there before."""
    known = before.select(*keys).distinct().withColumn("_old", F.lit(True))
    return batch.select(*keys).distinct().join(known, list(keys), "left").select(*keys, F.when(F.col("_old"), "updated").otherwise("added").alias("change"))


def contract_graph(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, description, source_id) and edges (…, keywords) with each src of pairs (src, dst) made one with its dst.

    The kept node's type stays; descriptions are joined, its own first; sources are put together once each. Edges that meet
    add their weights and join the rest the same way; those within one node go. Pairs must not chain (see components).
    """
    to = pairs.select(F.col("src").alias("id"), F.col("dst").alias("_to")).where("id <> _to").dropDuplicates(["id"])
    own = nodes.join(to, "id", "left").select(F.coalesce("_to", "id").alias("_id"), F.col("_to").isNotNull().alias("_moved"), "*")
    own = own.withColumn("seq", F.struct("_moved", "id"))
    n = own.groupBy("_id").agg(F.min_by("type", "seq").alias("type"), _in_order("description", SEP).alias("description"), F.array_sort(F.array_distinct(_in_order("source_id"))).alias("source_id")).withColumnRenamed("_id", "id")
    ends = edges.withColumn("seq", F.struct("src", "dst"))
    for c in ("src", "dst"):
        ends = ends.join(to.select(F.col("id").alias(c), "_to"), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    e = canonical(ends.where("src <> dst")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"), _in_order("description", SEP).alias("description"), F.array_sort(F.array_distinct(_in_order("keywords"))).alias("keywords"), F.array_sort(F.array_distinct(_in_order("source_id"))).alias("source_id"))
    return n, e


def changes(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(key, change): added or kept."""
    added = after.select(key).join(before.select(key), key, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(after.select(key).join(before.select(key), key, "left_semi").withColumn("change", F.lit("kept")))


def doc_subgraph(nodes: DataFrame) -> DataFrame:
    """(source, id): nodes of each document."""
    return nodes.select(F.explode("source_id").alias("source"), "id").distinct()


def rebuild(mentions: DataFrame, exclude: DataFrame) -> DataFrame:
    """Entities merged again without the mentions of some sources."""
    return merge_entities(mentions.join(exclude.select("source"), "source", "left_anti"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree); a self-loop counts two."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 100, tol: float = 1e-6, every: int = 5, start: DataFrame | None = None) -> DataFrame:
    """(id, pagerank) of an undirected weighted graph; dangling mass and jumps are uniform.

    start (id, pagerank): ranks to begin with, such as those before some edges came; other nodes begin with the uniform rank.

    A round is one join on the source and one sum by target, which combines in each task first, so a node with very many
    edges is a skewed join at most. The frame is cut from its lineage every few rounds, and there compared with the last.
    """
    both = edges.select("src", "dst", "weight").unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    total = both.groupBy("src").agg(F.sum("weight").alias("total"))
    share = cut(both.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    ids = cut(share.select(F.col("src").alias("id")).distinct())
    n = ids.count()
    if not n:
        return ids.withColumn("pagerank", F.lit(0.0))
    rank = ids.withColumn("pr", F.lit(1.0 / n))
    if start is not None:
        known = ids.join(start, "id", "left").select("id", F.coalesce("pagerank", F.lit(1.0 / n)).alias("pr"))
        rank = known.join(known.agg(F.sum("pr").alias("all"))).select("id", (F.col("pr") / F.col("all")).alias("pr"))  # of one row
    for i in range(rounds):
        flow = share.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("pr") * F.col("share")).alias("in"))
        new = ids.join(flow, "id", "left").select("id", (F.coalesce("in", F.lit(0.0)) * alpha + (1 - alpha) / n).alias("new"))
        if (i + 1) % every and i + 1 < rounds:
            rank = new.withColumnRenamed("new", "pr")
            continue
        both_ = cut(new.join(rank, "id")) if tol > 0 else cut(new)
        rank = both_.select("id", F.col("new").alias("pr"))
        if tol > 0 and both_.agg(F.sum(F.abs(F.col("new") - F.col("pr")))).head()[0] < n * tol:
            break
    return rank.withColumnRenamed("pr", "pagerank")


#: Names of one block that a task compares with others at most, about.
HOT_BLOCK = 1000


def _prefix(marks: Column, need: Column) -> Column:
    """Of ordered marks, those of which a name with `need` of them in common must share one."""
    return F.slice(marks, 1, F.greatest(F.size(marks) - need + 1, F.lit(0)).cast("int"))


def entity_candidates(nodes: DataFrame, new_ids: DataFrame | None = None, block: bool = True) -> DataFrame:
    """(a, b) of nodes (id, name, type) of one type with similar names, one at least new.

    Names are compared once, however many nodes have them, and the pairs of names are then joined with their nodes.
    block: only names that can be similar are compared, without loss; else all of a type.
    """
    own = nodes.select("id", "name", "type").where("name is not null and type is not null")
    if new_ids is not None:
        own = own.join(new_ids.select("id", F.lit(True).alias("new")).distinct(), "id", "left").withColumn("new", F.coalesce("new", F.lit(False)))
    else:
        own = own.withColumn("new", F.lit(True))
    own = cut(own)
    names = cut(own.select("type", "name").distinct())
    alike = similar_names(names) if block else names.withColumnRenamed("name", "x").join(names.withColumnRenamed("name", "y"), "type").where((F.col("x") < F.col("y")) & similar_name(F.col("x"), F.col("y")))
    alike = cut(alike.unionByName(names.where(similar_name(F.col("name"), F.col("name"))).select("type", F.col("name").alias("x"), F.col("name").alias("y"))))
    a, b = (own.select("type", F.col("name").alias(n), F.col("id").alias(f"id_{n}"), F.col("new").alias(f"new_{n}")) for n in "xy")
    pairs = alike.join(a, ["type", "x"]).join(b, ["type", "y"]).where("new_x or new_y").where(F.when(F.col("x") == F.col("y"), F.col("id_x") < F.col("id_y")).otherwise(F.col("id_x") != F.col("id_y")))
    pairs = pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"))
    return pairs if own.groupBy("id").count().where("count > 1").isEmpty() else pairs.distinct()


def similar_names(names: DataFrame) -> DataFrame:
    """(type, x, y), x < y, of similar ones among the distinct names (type, name) of a type.

    Similar names have the same pieces with a digit. Latin ones within half the shorter's edits have max(lengths) - half
    the shorter of their characters (each counted as often as it is there) in common, so one of the first half of each
    name's characters in any one order; here the seldom ones of the type come first. Other names share distinct characters
    in the same way. Blocks of many names are dealt out over several keys.
    """
    own = names.withColumn("digits", F.array_join(F.array_sort(F.filter(grams(F.col("name")), lambda g: g.rlike("[0-9]"))), "\0")).withColumn("latin", is_english(F.col("name")))
    each = F.split("name", "")
    distinct = F.transform(F.array_distinct(each), lambda x: F.concat(F.lit("1"), x))
    counted = F.flatten(F.transform(F.array_distinct(each), lambda x: F.transform(F.sequence(F.lit(1), F.size(F.filter(each, lambda y: y == x))), lambda i: F.concat(i.cast("string"), x))))
    # the families: Latin names by edits; pairs with another name by distinct characters
    marked = own.select("*", F.explode(F.when(F.col("latin"), F.array(F.struct(F.lit(True).alias("edits"), counted.alias("marks")), F.struct(F.lit(False).alias("edits"), distinct.alias("marks")))).otherwise(F.array(F.struct(F.lit(False).alias("edits"), distinct.alias("marks"))))).alias("f")).select(own["*"], "f.*")
    if own.where(~F.col("latin")).isEmpty():
        marked = marked.where("edits")
    marked = cut(marked)
    rare = marked.select("type", "edits", F.explode("marks").alias("mark")).groupBy("type", "edits", "mark").agg(F.count("*").alias("n"))
    ranked = marked.select("name", "type", "edits", F.explode("marks").alias("mark")).join(rare, ["type", "edits", "mark"])
    ranked = ranked.groupBy("name", "type", "edits").agg(F.transform(F.array_sort(F.collect_set(F.struct("n", "mark"))), lambda x: x["mark"]).alias("marks"))
    n = F.size("marks")
    need = F.when(F.col("edits"), F.length("name") - F.floor(F.length("name") / 2)).otherwise(F.when(n < 4, 2).otherwise(F.ceil(n * 0.8 - 1e-9)))
    keyed = marked.drop("marks").join(ranked, ["name", "type", "edits"]).withColumn("k", F.explode(_prefix(F.col("marks"), need))).drop("marks")
    keys = ["type", "digits", "edits", "k"]
    keyed = cut(keyed)
    hot = keyed.groupBy(*keys).agg(F.ceil(F.count("*") / HOT_BLOCK).cast("int").alias("parts")).where("parts > 1")
    salted = keyed.join(hot, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    a = salted.select(*keys, F.pmod(F.xxhash64("name"), F.col("parts")).cast("int").alias("part"), F.col("latin").alias("latin_x"), F.col("name").alias("x"))
    b = salted.select(*keys, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("latin").alias("latin_y"), F.col("name").alias("y"))
    short, long = F.least(F.length("x"), F.length("y")), F.greatest(F.length("x"), F.length("y"))
    fits = F.when(F.col("edits"), long - short <= F.floor(short / 2)).otherwise(~(F.col("latin_x") & F.col("latin_y")))
    pairs = a.join(b, [*keys, "part"]).where((F.col("x") < F.col("y")) & fits)
    return pairs.where(similar_name(F.col("x"), F.col("y"))).select("type", "x", "y").distinct()


def parse_verdicts(responses: DataFrame, text: str = "response") -> DataFrame:
    """(batch, i) of questions that a response answers with yes."""
    hit = F.regexp_extract_all(text, F.lit(r"(?i)question\s*<?\|?#?([0-9]+)[^a-z0-9]*[^\n]*?\byes\b"), F.lit(1))
    return responses.select("batch", F.explode(F.transform(hit, lambda x: x.cast("int"))).alias("i"))


def contract(edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, labels): nodes that pairs (src, dst) join become their smallest; parallel edges add up, inner ones go."""
    labels = connected_components(pairs)
    at = lambda e, c: e.join(labels.select(F.col("node").alias(c), F.col("component").alias("_n")), c, "left").withColumn(c, F.coalesce("_n", c)).drop("_n")
    e = at(at(edges, "src"), "dst").where("src <> dst")
    return canonical(e).groupBy("src", "dst").agg(F.sum("weight").alias("weight")), labels


def largest_component(edges: DataFrame) -> DataFrame:
    """Nodes of the component with the most nodes, the smallest label of equals."""
    cc = connected_components(edges)
    top = cc.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "component").limit(1)
    return cc.join(F.broadcast(top.select("component")), "component", "left_semi").select(F.col("node").alias("id"))


#: Nodes whose labels go to all tasks at most; those of larger graphs are joined by shuffles.
SENT_NODES = 1 << 18


def communities(edges: DataFrame, max_size: int = 12, levels: int = 4, rounds: int = 8) -> DataFrame:
    """(level, id, community): local moving by modularity gain, then the same on the contracted graph.

    In a round each node looks at its neighbours' communities and moves to the best if that is a smaller label in even
    rounds, a larger one in odd rounds, so that two nodes do not swap for ever. A community at max_size takes no more.
    Edges stay where their first node is, and those to communities that it may not move to are left out before sums are made.
    """
    own, out = cut(edges.select("src", "dst", "weight").where("src <> dst")), None
    names = own.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.col("id").alias("node"), F.lit(1).alias("one"))
    for level in range(levels):
        both = cut(own.unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).repartition("src"))
        lab = cut(both.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k")).join(names.groupBy("node").agg(F.count("*").alias("size")), "node").select("node", F.col("node").alias("c"), "k", "size"))
        n, m2 = lab.agg(F.count("*"), F.sum("k")).head()
        if not m2:
            break
        sent = F.broadcast if n <= SENT_NODES else lambda x: x
        for i in range(rounds):
            per = lab.groupBy("c").agg(F.sum("k").alias("ck"), F.sum("size").alias("cs"))
            to = lab.select(F.col("node").alias("dst"), "c").join(per, "c").withColumnRenamed("c", "to")
            same = F.col("to") == F.col("c")
            turn = (F.col("to") < F.col("c")) if i % 2 == 0 else (F.col("to") > F.col("c"))
            near = both.join(sent(to), "dst").join(sent(lab.withColumnRenamed("node", "src")), "src").where(same | (turn & (F.col("cs") + F.col("size") <= max_size)))
            cand = near.groupBy(F.col("src").alias("node"), "to", "c", "k", "ck").agg(F.sum("weight").alias("w"))
            gain = F.col("w") - F.col("k") * (F.col("ck") - F.when(same, F.col("k")).otherwise(0)) / m2
            best = cand.withColumn("gain", F.round(gain, 9)).groupBy("node").agg(F.max(F.struct("gain", same.cast("int").alias("stay"), "to")).alias("b")).where("b.gain > 0")
            new = cut(lab.join(best, "node", "left").select("node", F.coalesce("b.to", "c").alias("c"), "k", "size", (F.coalesce("b.to", "c") != F.col("c")).alias("moved")))
            moved = new.where("moved").isEmpty()
            lab = new.drop("moved")
            if moved and i:
                break
        names = cut(names.join(lab.select("node", "c"), "node").select("id", F.col("c").alias("node"), "one"))
        here = names.select(F.lit(level).alias("level"), "id", F.col("node").alias("community"))
        out = here if out is None else out.unionByName(here)
        at = lambda e, c: e.join(sent(lab.select(F.col("node").alias(c), F.col("c").alias("_c"))), c).withColumn(c, F.col("_c")).drop("_c")
        nxt = cut(canonical(at(at(own, "src"), "dst")).where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
        if nxt.isEmpty():
            break
        own = nxt
    return out


def community_weights(comms: DataFrame, rank: DataFrame) -> DataFrame:
    """(level, community, n, weight): summed ranks of the members over the level's largest."""
    w = comms.join(rank, "id").groupBy("level", "community").agg(F.count("*").alias("n"), F.sum("rank").alias("w"))
    most = w.groupBy("level").agg(F.max("w").alias("most"))
    return w.join(F.broadcast(most), "level").select("level", "community", "n", (F.col("w") / F.col("most")).alias("weight"))


def community_edges(members: DataFrame, edges: DataFrame, most: int = 10_000) -> DataFrame:
    """(community, src, dst, weight): edges with both ends in a community, the heaviest `most` of each."""
    a, b = members.select(F.col("id").alias("src"), "community"), members.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    inner = edges.join(a, "src").join(b, "dst").where("community = cb").drop("cb")
    return top_k(inner, "community", F.col("weight"), most, "src", "dst").select("community", "src", "dst", "weight")


def community_inputs(members: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, entities, relations) as lines, of communities of two at least."""
    e = members.join(nodes, "id").groupBy("community").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(",", F.col("id").cast("string"), "description"))), "\n").alias("entities")).where("n >= 2")
    r = community_edges(members, edges).groupBy("community").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(",", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("weight").cast("string")))), "\n").alias("relations"))
    return e.join(r, "community", "left")


REPORT = "title string, summary string, rating double, findings array<struct<summary string, explanation string>>"


def parse_reports(responses: DataFrame, text: str = "response") -> DataFrame:
    """Reports that have every field."""
    r = responses.withColumn("r", F.from_json(text, REPORT)).where("r.title is not null and r.summary is not null and r.rating is not null and r.findings is not null")
    found = F.array_join(F.transform("r.findings", lambda f: F.concat_ws("\n", f["summary"], f["explanation"])), "\n\n")
    return r.select("community", "r.title", "r.summary", "r.rating", found.alias("evidences"))


def nhop_paths(edges: DataFrame, n: int = 2) -> DataFrame:
    """(start, path, weights) of up to n edges, no edge twice."""
    both = edges.select("src", "dst", "weight").unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    key = F.concat_ws("|", F.least("src", "dst").cast("string"), F.greatest("src", "dst").cast("string"))
    both = both.withColumn("e", key)
    step = both.select(F.col("src").alias("start"), F.array("src", "dst").alias("path"), F.array("weight").alias("weights"), F.array("e").alias("used"), F.col("dst").alias("end"))
    out = step
    for _ in range(n - 1):
        step = step.join(both, F.col("end") == F.col("src")).where(~F.array_contains("used", F.col("e"))).select(
            "start", F.array_append("path", F.col("dst")).alias("path"), F.array_append("weights", F.col("weight")).alias("weights"), F.array_append("used", F.col("e")).alias("used"), F.col("dst").alias("end"))
        out = out.unionByName(step)
    return out.select("start", "path", "weights")


def type_samples(nodes: DataFrame, k: int) -> DataFrame:
    """(type, names): the first k names of each type."""
    top = top_k(nodes.select("type", "name").distinct().withColumn("one", F.lit(0)), "type", F.col("one"), k, "name")
    return top.groupBy("type").agg(F.array_sort(F.collect_list("name")).alias("names"))


def graph_view(nodes: DataFrame, edges: DataFrame, n_nodes: int = 256, n_edges: int = 128) -> tuple[DataFrame, DataFrame]:
    """The top nodes by pagerank, and the heaviest edges between them."""
    top = nodes.orderBy(F.col("pagerank").desc(), "id").limit(n_nodes)
    ids = top.select("id")
    inner = edges.where("src <> dst").join(F.broadcast(ids.withColumnRenamed("id", "src")), "src", "left_semi").join(F.broadcast(ids.withColumnRenamed("id", "dst")), "dst", "left_semi")
    return top, inner.orderBy(F.col("weight").desc(), "src", "dst").limit(n_edges)


def kg_search(hits: DataFrame, nodes: DataFrame, paths: DataFrame, types: DataFrame, top: int = 6) -> DataFrame:
    """(query_id, id, score): entities by similarity x pagerank, with what paths from them lend, doubled for a type the query names.

    hits: (query_id, id, sim); paths: (start, path); types: (query_id, type). Hop i of a path from a hit lends sim / (2 + i).
    """
    hop = hits.join(paths.withColumnRenamed("start", "id"), "id").select("query_id", "sim", F.posexplode("path").alias("i", "at")).where("i > 0")
    lent = hop.groupBy("query_id", F.col("at").alias("id")).agg(F.sum(F.col("sim") / (1 + F.col("i"))).alias("lent"))
    both = hits.join(lent, ["query_id", "id"], "full").join(nodes.select("id", "type", "pagerank"), "id")
    named = both.join(types.withColumn("named", F.lit(2.0)), ["query_id", "type"], "left")
    score = (F.coalesce("sim", F.lit(0.0)) + F.coalesce("lent", F.lit(0.0))) * F.coalesce("named", F.lit(1.0)) * F.col("pagerank")
    return top_k(named.select("query_id", "id", score.alias("score")), "query_id", F.round("score", 9), top, "id").drop("rank")


def community_search(entities: DataFrame, reports: DataFrame, n: int = 1) -> DataFrame:
    """(query_id, community): reports (community, id, weight; a row for each member) that share an entity (query_id, id), the heaviest first."""
    hit = entities.join(reports, "id").select("query_id", "community", "weight").distinct()
    return top_k(hit, "query_id", F.col("weight"), n, "community").select("query_id", "community")


def random_walks(edges: DataFrame, walks: int = 10, length: int = 40, seed: int = 7) -> DataFrame:
    """(id, walk, path): from every node, each step to a neighbour with a chance by weight, drawn by a hash."""
    both = edges.select("src", "dst", "weight").unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    w = Window.partitionBy("src").orderBy("dst")
    hi = F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0))
    both = cut(both.withColumn("hi", hi).withColumn("total", F.sum("weight").over(Window.partitionBy("src"))).select("src", "dst", (F.col("hi") / F.col("total")).alias("hi"), ((F.col("hi") - F.col("weight")) / F.col("total")).alias("lo")))
    out = both.select(F.col("src").alias("id")).distinct().withColumn("walk", F.explode(F.sequence(F.lit(1), F.lit(walks)))).withColumn("path", F.array(F.col("id"))).withColumn("at", F.col("id"))
    for i in range(1, length):
        draw = F.pmod(F.xxhash64("id", "walk", F.lit(i), F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
        step = out.withColumn("u", draw).join(both, (F.col("at") == F.col("src")) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
        out = step.select("id", "walk", F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("at"))
        if i % 8 == 0:
            out = cut(out)
    return out.select("id", "walk", "path")


def node_embeddings(edges: DataFrame, dim: int = 16, walks: int = 10, length: int = 40, seed: int = 7) -> DataFrame:
    """(word, vector): Word2Vec over random walks."""
    from pyspark.ml.feature import Word2Vec

    paths = random_walks(edges, walks, length, seed).select(F.transform("path", lambda x: x.cast("string")).alias("path"))
    return Word2Vec(vectorSize=dim, windowSize=2, minCount=0, seed=seed, inputCol="path", outputCol="v").fit(paths).getVectors()


def merge_outlines(paths: DataFrame) -> DataFrame:
    """(key, parent, depth) of (seq, path): every key once, under the parent of its first and shallowest place."""
    flat = paths.select("seq", "path", F.posexplode("path").alias("depth", "key"))
    parent = F.when(F.col("depth") > 0, F.get("path", F.col("depth") - 1))
    return flat.groupBy("key").agg(F.min_by(F.struct(parent.alias("parent"), "depth"), F.struct("seq", "depth")).alias("x")).select("key", "x.parent", "x.depth")


