"""Graph jobs over trade between nations, parts and suppliers, and events."""

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import kgsearch as K
from ..operators.components import connected_components
from .book import Book, r6

book = Book()

TRADE = """WITH RECURSIVE raw AS (SELECT s_nationkey AS a, c_nationkey AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
edges AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, count(*)::DOUBLE AS weight FROM raw GROUP BY ALL)
"""
SUPPLY = """WITH RECURSIVE edges AS (SELECT -l_suppkey - 1 AS src, l_partkey AS dst, count(*)::DOUBLE AS weight FROM lineitem GROUP BY ALL), e2 AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)
"""
ORDERED = """WITH edges AS (SELECT -o_custkey - 1 AS src, o_orderkey AS dst FROM orders), e2 AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)
"""


def mentions(t):
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("a"))
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("b"))
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(c, "o_custkey")
    line = t.lineitem.join(s, "l_suppkey").join(o, "l_orderkey")
    return line.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("weight"), F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("description"), F.col("l_returnflag").alias("keywords"))


def trade(t):
    return G.canonical(mentions(t)).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def ordered(t):
    """Customers (below zero) and all their orders."""
    return t.orders.select((-F.col("o_custkey") - 1).alias("src"), F.col("o_orderkey").alias("dst"), F.lit(1.0).alias("weight"))


def supply(t):
    """Parts and suppliers (below zero) of all of lineitem."""
    e = t.lineitem.select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst"), F.lit(1.0).alias("weight"))
    return G.canonical(e).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


@book.query(SUPPLY + "SELECT src AS id, count(*) AS degree FROM e2 GROUP BY 1")
def graph_degree(t):
    return G.degrees(supply(t))


@book.query("""SELECT least(s_nationkey, c_nationkey) AS src, greatest(s_nationkey, c_nationkey) AS dst, count(*)::DOUBLE AS weight, string_agg(DISTINCT l_linestatus, '<SEP>' ORDER BY l_linestatus) AS description, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS sources
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def graph_merge(t):
    return G.merge_relations(mentions(t)).select("src", "dst", "weight", "description", F.array_join("source_id", ",").alias("sources"))


@book.query("""WITH v AS (SELECT source AS name, lang AS type, count(*) AS n FROM documents GROUP BY ALL)
SELECT name, arg_min(type, (-n, type)) AS type, sum(n)::BIGINT AS n, string_agg(DISTINCT type, '<SEP>' ORDER BY type) AS description FROM v GROUP BY name""".replace("arg_min(type, (-n, type))", "(list(type ORDER BY n DESC, type))[1]"))
def entity_merge(t):
    m = t.documents.select(F.col("source").alias("name"), F.col("lang").alias("type"), F.col("lang").alias("description"), F.col("doc_id").alias("source"))
    return G.merge_entities(m).select("name", "type", "n", "description")


@book.query("""SELECT name, type, upper(type) AS description FROM (SELECT 'S' || s_suppkey AS name, CASE WHEN s_nationkey < 10 THEN 'person' ELSE 'org' END AS type FROM supplier)""")
def parse_entities(t):
    rec = F.concat(F.lit('("entity"<|>"s'), F.col("s_suppkey").cast("string"), F.lit('"<|>'), F.when(F.col("s_nationkey") < 10, "PERSON").otherwise("org"), F.lit("<|>"), F.when(F.col("s_nationkey") < 10, "PERSON").otherwise("ORG"), F.lit(')##("entity"<|>x<|>planet<|>gone)'))
    e, _ = G.parse_records(t.supplier.select(F.col("s_suppkey").alias("source"), rec.alias("response")), ["person", "org"])
    return e.select("name", "type", "description")


@book.query("""SELECT least('N' || s_nationkey, 'S' || s_suppkey) AS src, greatest('N' || s_nationkey, 'S' || s_suppkey) AS dst, CASE WHEN s_suppkey % 2 = 0 THEN 1.0 ELSE s_suppkey::DOUBLE END AS weight FROM supplier""")
def parse_relations(t):
    w = F.when(F.col("s_suppkey") % 2 == 0, "none").otherwise(F.col("s_suppkey").cast("string"))
    rec = F.concat(F.lit('("relationship"<|>s'), F.col("s_suppkey").cast("string"), F.lit("<|>n"), F.col("s_nationkey").cast("string"), F.lit("<|>in<|>place<|>"), w, F.lit(")"))
    _, r = G.parse_records(t.supplier.select(F.col("s_suppkey").alias("source"), rec.alias("response")), [])
    return r.select("src", "dst", "weight")


@book.query(TRADE + "SELECT src, dst, weight FROM edges WHERE src IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) AND dst IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def valid_relations(t):
    return G.valid_relations(trade(t), t.nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("id")))[0]


@book.query(TRADE + "SELECT src, dst, weight * 2 AS weight FROM edges")
def graph_union(t):
    e = trade(t).withColumn("source", F.lit("a"))
    return G.union_edges(e, e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit("b").alias("source"))).select("src", "dst", "weight")


def line_graphs(t):
    """A graph of parts and suppliers for each line number: nodes, edges."""
    e = t.lineitem.groupBy(F.col("l_linenumber").alias("seq"), (-F.col("l_suppkey") - 1).alias("src"), F.col("l_partkey").alias("dst")).agg(
        F.count("*").cast("double").alias("weight"), F.min("l_returnflag").alias("description"), F.array(F.min("l_linestatus")).alias("keywords"))
    e = e.withColumn("source_id", F.array("seq"))
    ends = e.select("seq", F.explode(F.array("src", "dst")).alias("id"), "description").groupBy("seq", "id").agg(F.max("description").alias("description"))
    return ends.select("seq", "id", F.when(F.col("id") < 0, F.concat(F.lit("supplier"), "seq")).otherwise(F.concat(F.lit("part"), "seq")).alias("type"), "description", F.array("seq").alias("source_id")), e


LINES = """WITH e AS (SELECT l_linenumber AS seq, -l_suppkey - 1 AS src, l_partkey AS dst, count(*)::DOUBLE AS weight, min(l_returnflag) AS description, min(l_linestatus) AS keyword FROM lineitem GROUP BY ALL),
n AS (SELECT seq, id, (CASE WHEN id < 0 THEN 'supplier' ELSE 'part' END) || seq AS type, max(description) AS description FROM (SELECT seq, src AS id, description FROM e UNION ALL SELECT seq, dst, description FROM e) GROUP BY seq, id),
ue AS (SELECT src, dst, sum(weight) AS weight, string_agg(description, '<SEP>' ORDER BY seq) AS description, string_agg(keyword, ',' ORDER BY seq) AS keywords, string_agg(seq, ',' ORDER BY seq) AS sources FROM e GROUP BY ALL)
"""


@book.query(LINES + """, d AS (SELECT id, count(*) AS rank FROM (SELECT src AS id FROM ue UNION ALL SELECT dst FROM ue) GROUP BY 1)
SELECT id, arg_min(type, seq) AS type, string_agg(description, '<SEP>' ORDER BY seq) AS description, string_agg(seq, ',' ORDER BY seq) AS sources, any_value(rank) AS rank FROM n JOIN d USING (id) GROUP BY id""")
def graph_union_nodes(t):
    return G.union_graphs(*line_graphs(t))[0].select("id", "type", "description", F.array_join(F.transform("source_id", lambda x: x.cast("string")), ",").alias("sources"), "rank")


@book.query(LINES + "SELECT * FROM ue")
def graph_union_edges(t):
    e = G.union_graphs(*line_graphs(t))[1]
    return e.select("src", "dst", "weight", "description", F.array_join("keywords", ",").alias("keywords"), F.array_join(F.transform("source_id", lambda x: x.cast("string")), ",").alias("sources"))


@book.query(LINES + """SELECT 'node' AS kind, id AS a, NULL::BIGINT AS b, arg_max(type, seq) AS type, arg_max(description, seq) AS description, NULL::DOUBLE AS weight, string_agg(seq, ',' ORDER BY seq) AS sources FROM n WHERE seq NOT IN (2, 7) GROUP BY id
UNION ALL SELECT 'edge', src, dst, arg_max(keyword, seq), arg_max(description, seq), arg_max(weight, seq), max(seq)::VARCHAR FROM e WHERE seq NOT IN (2, 7) GROUP BY src, dst""")
def graph_rebuild_attributes(t):
    """All line graphs but two put together again; the latest wins."""
    nodes, edges = line_graphs(t)
    n, e = G.rebuild_graphs(nodes, edges, t.lineitem.where("l_linenumber in (2, 7)").select(F.col("l_linenumber").alias("source")))
    sources = F.array_join(F.transform("source_id", lambda x: x.cast("string")), ",").alias("sources")
    n = n.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "type", "description", F.lit(None).cast("double").alias("weight"), sources)
    return n.unionByName(e.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.get("keywords", 0).alias("type"), "description", "weight", sources))


@book.query("""SELECT c_custkey AS id, CASE WHEN c_nationkey = 0 THEN 'added' ELSE 'kept' END AS change FROM customer""")
def graph_changes(t):
    n = t.customer.select(F.col("c_custkey").alias("id"), "c_nationkey")
    return G.changes(n.where("c_nationkey > 0"), n)


@book.query("""SELECT DISTINCT lang AS source, source AS id FROM documents""")
def doc_subgraph(t):
    return G.doc_subgraph(t.documents.groupBy(F.col("source").alias("id")).agg(F.collect_set("lang").alias("source_id")))


@book.query("""SELECT source AS name, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY 1""")
def graph_rebuild(t):
    m = t.documents.select(F.col("source").alias("name"), F.col("lang").alias("type"), F.col("lang").alias("description"), F.col("lang").alias("source"))
    return G.rebuild(m, m.where("source = 'en'").select("source").distinct()).select("name", "n")


@book.query(SUPPLY + """, both_ AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges), tot AS (SELECT src, sum(weight) AS t FROM both_ GROUP BY 1),
sh AS (SELECT b.src, b.dst, weight / t AS share FROM both_ b JOIN tot USING (src)), n AS (SELECT count(*) AS n FROM tot),
pr AS (SELECT src AS id, 1.0::DOUBLE / n AS p, 0 AS i FROM tot, n UNION ALL SELECT sh.dst, 0.15 / max(n) + 0.85 * sum(p * share), max(i) + 1 FROM pr JOIN sh ON sh.src = pr.id, n WHERE i < 10 GROUP BY sh.dst)
SELECT id, round(p, 6) AS pagerank FROM pr WHERE i = 10""")
def pagerank_fixed(t):
    return G.pagerank(supply(t), rounds=10, tol=0).withColumn("pagerank", r6("pagerank"))


# labels of 30 rounds: enough where no two nodes are further apart
@book.query(SUPPLY + """, e3 AS (SELECT src, dst FROM e2 UNION SELECT src, src FROM e2), r AS (SELECT src AS node, min(dst) AS l, 1 AS i FROM e3 GROUP BY 1 UNION ALL SELECT e3.dst, min(r.l), max(r.i) + 1 FROM r JOIN e3 ON e3.src = r.node WHERE r.i < 30 GROUP BY 1)
SELECT node, l AS component FROM r WHERE i = 30""")
def connected_components_(t):
    return connected_components(supply(t))


book.queries["connected_components"] = book.queries.pop("connected_components_")
book.oracles["connected_components"] = book.oracles.pop("connected_components_")


@book.query(ORDERED + """, k AS (SELECT src FROM edges GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 1) SELECT src AS id FROM k UNION ALL SELECT dst FROM edges WHERE src IN (SELECT src FROM k)""")
def largest_component(t):
    return G.largest_component(ordered(t))


@book.query(TRADE + """, m AS (SELECT a.n_nationkey AS id, min(b.n_nationkey) AS rep FROM nation a JOIN nation b USING (n_regionkey) GROUP BY 1), x AS (SELECT p.rep AS a, q.rep AS b, weight FROM edges JOIN m p ON p.id = src JOIN m q ON q.id = dst WHERE p.rep <> q.rep)
SELECT least(a, b) AS src, greatest(a, b) AS dst, sum(weight) AS weight FROM x GROUP BY ALL""")
def contract_nodes(t):
    n = t.nation.select(F.col("n_nationkey"), "n_regionkey")
    first = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("dst"))
    pairs = n.join(first, "n_regionkey").select(F.col("n_nationkey").alias("src"), "dst")
    return G.contract(trade(t), pairs)[0]


@book.query("""WITH p AS (SELECT p_partkey AS id, p_name AS name, p_brand AS type FROM part), x AS (SELECT a.id AS a, b.id AS b, a.name AS x, b.name AS y FROM p a JOIN p b ON a.type = b.type AND a.id < b.id)
SELECT a, b FROM x WHERE levenshtein(x, y) <= least(length(x), length(y)) // 2""")
def entity_pairs(t):
    return G.entity_candidates(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type")))


@book.query()
def entity_pairs_blocked(t):
    nodes = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"))
    return G.entity_candidates(nodes, nodes.where("id % 2 = 0"))


@book.query("""SELECT c_nationkey AS batch, c_custkey::INT AS i FROM customer WHERE c_acctbal > 5000""")
def entity_verdicts(t):
    said = F.concat(F.lit("For question "), F.col("c_custkey").cast("string"), F.when(F.col("c_acctbal") > 5000, ": Yes, they are").otherwise(": no"))
    r = t.customer.groupBy(F.col("c_nationkey").alias("batch")).agg(F.array_join(F.collect_list(said), "\n").alias("response"))
    return G.parse_verdicts(r)


@book.query()
def communities(t):
    return G.communities(supply(t))


@book.query("""WITH w AS (SELECT c_nationkey AS community, count(*) AS n, sum(c_custkey) AS w FROM customer GROUP BY 1) SELECT 0 AS level, community, n, round(w / max(w) OVER (), 6) AS weight FROM w""")
def community_weight(t):
    m = t.customer.select(F.lit(0).alias("level"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("community"))
    return G.community_weights(m, t.customer.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("rank"))).withColumn("weight", r6("weight"))


@book.query(TRADE + """, i AS (SELECT a.n_regionkey AS community, src, dst, weight FROM edges JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey = b.n_regionkey)
SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY community ORDER BY weight DESC, src, dst) <= 5""")
def community_edges(t):
    m = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("community"))
    return G.community_edges(m, trade(t), 5)


@book.query("""SELECT n_regionkey AS community, string_agg(line, E'\n' ORDER BY line) AS entities FROM (SELECT n_regionkey, n_nationkey || ',' || n_name AS line FROM nation) GROUP BY 1""")
def community_inputs(t):
    m = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("community"))
    return G.community_inputs(m, t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("description")), trade(t)).select("community", "entities")


@book.query("""SELECT c_custkey AS community, c_name AS title, c_nationkey::DOUBLE AS rating, 'a' || chr(10) || 'b' AS evidences FROM customer WHERE c_nationkey > 0""")
def community_reports(t):
    whole = F.struct(F.col("c_name").alias("title"), F.lit("s").alias("summary"), F.col("c_nationkey").cast("double").alias("rating"), F.array(F.struct(F.lit("a").alias("summary"), F.lit("b").alias("explanation"))).alias("findings"))
    body = F.when(F.col("c_nationkey") > 0, F.to_json(whole)).otherwise('{"title": "x"}')
    return G.parse_reports(t.customer.select(F.col("c_custkey").alias("community"), body.alias("response"))).drop("summary")


@book.query(ORDERED + """SELECT src AS start, src || '>' || dst AS path FROM e2
UNION ALL SELECT a.src, a.src || '>' || a.dst || '>' || b.dst FROM e2 a JOIN e2 b ON a.dst = b.src WHERE b.dst <> a.src""")
def nhop_paths(t):
    return G.nhop_paths(ordered(t)).select("start", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@book.query("""SELECT lang AS type, string_agg(source, ',' ORDER BY source) AS names FROM (SELECT DISTINCT lang, source FROM documents QUALIFY dense_rank() OVER (PARTITION BY lang ORDER BY source) <= 3) GROUP BY 1""")
def type_samples(t):
    return G.type_samples(t.documents.select(F.col("lang").alias("type"), F.col("source").alias("name")), 3).select("type", F.array_join("names", ",").alias("names"))


@book.query(SUPPLY + """, top AS (SELECT src AS id FROM e2 GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 256) SELECT src, dst, weight FROM edges WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top) ORDER BY weight DESC, src, dst LIMIT 128""")
def graph_view(t):
    """The heaviest edges between the nodes of most neighbours."""
    e = supply(t)
    return G.graph_view(G.degrees(e).select("id", F.col("degree").alias("pagerank")), e)[1]


KG = TRADE + """, e2 AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges WHERE src <> dst), hits AS (SELECT r_regionkey AS query_id, n_nationkey AS id, 1.0 / (n_nationkey + 2) AS sim FROM region JOIN nation ON n_regionkey = r_regionkey),
paths AS (SELECT src AS start, dst AS one, NULL::INTEGER AS two FROM e2 UNION ALL SELECT a.src, a.dst, b.dst FROM e2 a JOIN e2 b ON a.dst = b.src WHERE (least(a.src, a.dst), greatest(a.src, a.dst)) <> (least(b.src, b.dst), greatest(b.src, b.dst))),
hops AS (SELECT start, one AS node, 2 AS d FROM paths UNION ALL SELECT start, two, 3 FROM paths WHERE two IS NOT NULL),
lent AS (SELECT query_id, node AS id, sum(sim / d) AS lent FROM hits JOIN hops ON start = id GROUP BY ALL), b AS (SELECT query_id, id, coalesce(sim, 0) + coalesce(lent, 0) AS s FROM hits FULL JOIN lent USING (query_id, id))
SELECT query_id, id, round(s * (CASE WHEN n_regionkey = query_id THEN 2 ELSE 1 END) * (n_nationkey + 1), 6) AS score FROM b JOIN nation ON n_nationkey = id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s * (CASE WHEN n_regionkey = query_id THEN 2 ELSE 1 END) * (n_nationkey + 1), 9) DESC, id) <= 6"""


@book.query(KG)
def kg_search(t):
    hits = t.nation.select(F.col("n_regionkey").alias("query_id"), F.col("n_nationkey").alias("id"), (1.0 / (F.col("n_nationkey") + 2)).alias("sim"))
    nodes = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("type"), (F.col("n_nationkey") + 1).alias("pagerank"))
    types = t.region.select(F.col("r_regionkey").alias("query_id"), F.col("r_regionkey").alias("type"))
    return G.kg_search(hits, nodes, G.nhop_paths(trade(t), 2), types).withColumn("score", r6("score"))


SEARCH = SUPPLY + """, v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e FROM v WHERE vec_id % 20 = 0),
deg AS (SELECT src AS id, count(*) AS pagerank FROM e2 GROUP BY 1),
nodes AS (SELECT p_partkey AS id, p_brand AS type, pagerank, p_name AS description, e FROM part JOIN deg ON id = p_partkey LEFT JOIN v ON vec_id = p_partkey
UNION ALL SELECT -s_suppkey - 1, 'supplier', pagerank, s_name, NULL FROM supplier JOIN deg ON id = -s_suppkey - 1),
rels AS (SELECT dst * 1000000 - src AS rel, src, dst, weight, 'supplies' AS description, e FROM edges LEFT JOIN v ON vec_id = (dst * 31 - src) % 1000),
types AS (SELECT query_id, p_brand AS type FROM q JOIN part ON p_partkey = query_id),
ents AS (SELECT query_id, id, round(list_cosine_similarity(q.e, nodes.e), 9) AS sim FROM q, nodes WHERE nodes.e IS NOT NULL AND round(list_cosine_similarity(q.e, nodes.e), 9) >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) <= 56),
txt AS (SELECT query_id, rel, src AS f, dst AS t, round(list_cosine_similarity(q.e, rels.e), 9) AS sim FROM q, rels WHERE rels.e IS NOT NULL AND round(list_cosine_similarity(q.e, rels.e), 9) >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, rel) <= 56),
one AS (SELECT query_id, sim, id AS s, dst AS m FROM ents JOIN e2 ON src = id), two AS (SELECT query_id, sim, s, m, dst AS z FROM one JOIN e2 ON src = m WHERE dst <> s),
lent AS (SELECT query_id, f, t, sum(x) AS lent FROM (SELECT query_id, s AS f, m AS t, sim / 2 AS x FROM one UNION ALL SELECT query_id, s, m, sim / 2 FROM two UNION ALL SELECT query_id, m, z, sim / 3 FROM two) GROUP BY ALL),
ent AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank, id AS a, s AS score, description FROM
 (SELECT query_id, id, sim * (CASE WHEN types.type IS NOT NULL THEN 2 ELSE 1 END) * pagerank AS s, description FROM ents JOIN nodes USING (id) LEFT JOIN types USING (query_id, type)) QUALIFY rank <= 6),
b AS (SELECT query_id, f, t, sim, lent FROM txt FULL JOIN lent USING (query_id, f, t)),
bb AS (SELECT b.query_id, f, t, sim, lent, (CASE WHEN x.type IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN y.type IS NOT NULL THEN 1 ELSE 0 END) AS ends FROM b JOIN nodes nf ON nf.id = f JOIN nodes nt ON nt.id = t
 LEFT JOIN types x ON x.query_id = b.query_id AND x.type = nf.type LEFT JOIN types y ON y.query_id = b.query_id AND y.type = nt.type),
rel AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, f, t) AS rank, f AS a, t AS b, s AS score, description FROM
 (SELECT bb.query_id, f, t, (CASE WHEN sim IS NULL THEN lent * (1 + ends) ELSE sim * (1 + coalesce(lent, 0) + ends) END) * weight AS s, description FROM bb JOIN rels ON src = least(f, t) AND dst = greatest(f, t)) QUALIFY rank <= 6),
al AS (SELECT query_id, 'entity' AS kind, 0 AS place, rank, a, NULL::BIGINT AS b, score, description FROM ent UNION ALL SELECT query_id, 'relation', 1, rank, a, b, score, description FROM rel),
tok AS (SELECT *, len(list_filter(regexp_split_to_array(lower(concat_ws(', ', a, b, printf('%.2f', score), description)), '[^\\pL\\pM\\pN]+'), lambda x: x <> '')) AS n FROM al),
kept AS (SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY place, rank) AS used FROM tok QUALIFY used < 90),
rep AS (SELECT type AS community, count(*) AS weight FROM nodes GROUP BY 1), best AS (SELECT DISTINCT query_id, type AS community, weight FROM ent JOIN nodes ON id = a JOIN rep ON community = type)
SELECT query_id, kind, rank, a, b, round(score, 6) AS score FROM kept UNION ALL SELECT query_id, 'report', 1, NULL, NULL, weight FROM best QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, community) = 1"""


@book.query(SEARCH)
def graph_search(t):
    """Parts and suppliers by the vectors of parts and of their relations; brands as types, and as communities with reports."""
    e = supply(t)
    rank = G.degrees(e).withColumnRenamed("degree", "pagerank")
    v = t.embeddings.select("vec_id", F.col("embedding").alias("vector"))
    parts = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("type"), F.col("p_name").alias("description")).join(v.withColumnRenamed("vec_id", "id"), "id", "left")
    makers = t.supplier.select((-F.col("s_suppkey") - 1).alias("id"), F.lit("supplier").alias("type"), F.col("s_name").alias("description"), F.lit(None).cast("array<float>").alias("vector"))
    nodes = parts.unionByName(makers).join(rank, "id")
    rels = e.select((F.col("dst") * 1_000_000 - F.col("src")).alias("rel"), "src", "dst", "weight", F.lit("supplies").alias("description"), ((F.col("dst") * 31 - F.col("src")) % 1000).alias("vec_id")).join(v, "vec_id", "left")
    queries = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    types = queries.join(t.part, F.col("p_partkey") == F.col("query_id")).select("query_id", F.col("p_brand").alias("type"))
    sizes = nodes.groupBy("type").agg(F.count("*").cast("double").alias("weight"))
    reports = nodes.join(sizes, "type").select(F.col("type").alias("community"), "id", "weight", F.concat(F.lit("Parts of "), "type").alias("text"))
    found = K.search_graph(queries, types, nodes, rels, reports, K.GraphSearch(budget=90))
    return found.select("query_id", "kind", "rank", "a", "b", r6("score").alias("score"))


@book.query("""SELECT source AS query_id, lang AS community FROM (SELECT source, lang, count(*) AS w FROM documents GROUP BY ALL) WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY w DESC, lang) = 1""")
def community_search(t):
    """Languages as communities of sources, each source asked for."""
    w = t.documents.groupBy(F.col("source").alias("id"), F.col("lang").alias("community")).agg(F.count("*").alias("weight"))
    return G.community_search(t.documents.select(F.col("source").alias("query_id"), F.col("source").alias("id")).distinct(), w)


@book.query()
def node_embeddings(t):
    return G.node_embeddings(supply(t))


@book.query("""WITH x AS (SELECT r_name, n_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT DISTINCT c_name AS key, n_name AS parent, 2 AS depth FROM x UNION ALL SELECT DISTINCT n_name, r_name, 1 FROM x UNION ALL SELECT DISTINCT r_name, NULL, 0 FROM x""")
def merge_outlines(t):
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    p = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("seq"), F.array("r_name", "n_name", "c_name").alias("path"))
    return G.merge_outlines(p)
