"""Catalog operators over the order tables, events and documents."""

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import catalog as C
from ..operators import services as S
from .book import Book, r6

book = Book()


@book.query("""SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0""")
def catalog_inner(t):
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.where("c_acctbal > 0").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", "r_name")


@book.query("""SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'O') ON c_custkey = o_custkey""")
def catalog_left(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'O'"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@book.query("""SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'""")
def join_tenant(t):
    return t.orders.join(t.customer, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_mktsegment") == "BUILDING")).select("o_orderkey", "c_name")


@book.query("""SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey = o_custkey AND r_name = 'ASIA')""")
def semi_access(t):
    asia = t.nation.join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    members = t.customer.join(asia, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"))
    return C.by_ids(t.orders.select("o_orderkey", "o_custkey"), members, "o_custkey")


@book.query("""SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn > 20""")
def anti_retention(t):
    keep = C.keep_latest(t.events, "user_id", "ts", 20, "event_id")
    return C.not_in(t.events.select("event_id", "user_id"), keep, "event_id")


@book.query("""SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 5""")
def keep_latest_n(t):
    return C.keep_latest(t.events, "user_id", "ts", 5, "event_id").select("event_id", "user_id", "event_type")


@book.query("""SELECT DISTINCT c_nationkey, c_mktsegment FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F'""")
def distinct_of_join(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_nationkey", "c_mktsegment").distinct()


@book.query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def endpoint_join(t):
    parts, supps = t.part.where("p_size < 25").select(F.col("p_partkey").alias("l_partkey")), t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return t.lineitem.join(parts, "l_partkey", "left_semi").join(supps, "l_suppkey", "left_semi").select("l_orderkey", "l_linenumber")


@book.query("""WITH b AS (SELECT c_custkey, c_name || '!' AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0)
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT * FROM b""")
def upsert(t):
    base = t.customer.select("c_custkey", "c_name", "c_acctbal")
    own = base.where("c_custkey % 3 = 0")
    old = own.withColumn("v", F.lit(1))
    new = own.select("c_custkey", F.concat("c_name", F.lit("!")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(2).alias("v"))
    return C.upsert(base, old.unionByName(new), "c_custkey", "v").drop("v")


@book.query("""SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'low' ELSE s_name END AS s_name, CASE WHEN s_acctbal < 0 THEN 'b,c' ELSE 'a,b' END AS tags FROM supplier""")
def conditional_update(t):
    s = t.supplier.withColumn("tags", F.array(F.lit("a"), F.lit("b")))
    new = C.update_where(s, F.col("s_acctbal") < 0, set_={"s_name": "low"}, remove={"tags": "a"}, add={"tags": "c"})
    return new.select("s_suppkey", "s_name", F.array_join("tags", ",").alias("tags"))


@book.query("""SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'P' AND o_totalprice > 1000)""")
def delete_where(t):
    return C.delete_where(t.orders, (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 1000)).select("o_orderkey")


@book.query("""SELECT lang AS value, count(*) AS n FROM documents WHERE source <> 'src1' GROUP BY lang""")
def value_counts_lang(t):
    return C.value_counts(t.documents.where("source <> 'src1'"), "lang")


@book.query("""SELECT w AS value, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE trim(w) <> '' GROUP BY w""")
def array_value_counts(t):
    return C.array_value_counts(t.part.select(F.split("p_name", " ").alias("w")), "w")


@book.query("""SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents WHERE n_chars > 500 GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents WHERE n_chars > 500 GROUP BY source""")
def facet_counts(t):
    """Both facets in one pass over the rows."""
    return S.facets(t.documents, ["lang", "source"], F.col("n_chars") > 500)


@book.query("""SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders WHERE o_orderpriority = '1-URGENT'""")
def with_total(t):
    return C.with_total(t.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey"), "o_custkey")


@book.query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS pv, count(DISTINCT user_id) AS uv, round(sum(value), 6) AS total, round(avg(value), 6) AS mean,
count(*) FILTER (event_type = 'purchase') AS up, round(sum(value) / (count(*) + 0.1), 6) AS speed FROM events WHERE ts >= TIMESTAMP '2024-01-03' GROUP BY 1""")
def daily_stats(t):
    own = S.daily_stats(t.events, "ts", "user_id", {"total": "value"}, {"mean": "value"}, {"up": F.col("event_type") == "purchase"}, F.lit("2024-01-03").cast("timestamp_ntz"))
    return own.withColumn("speed", r6(S.speed(F.col("total"), F.col("pv")))).withColumns({"total": r6("total"), "mean": r6("mean")})


@book.query("""SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS processing, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'P') AS failed,
coalesce(sum(o_totalprice) FILTER (o_orderpriority <> '5-LOW'), 0) AS size FROM orders GROUP BY o_custkey""")
def status_rollup(t):
    counts = S.status_counts(t.orders, "o_custkey", "o_orderstatus", {"processing": "O", "finished": "F", "failed": "P"}).drop("cancelled")
    return counts.join(S.total_size(t.orders, "o_totalprice", "o_custkey", F.col("o_orderpriority") != "5-LOW"), "o_custkey")


@book.query("""SELECT o_custkey, count(*) FILTER (s = 'O' AND NOT c) AS processing, count(*) FILTER (s = 'F' AND NOT c) AS finished, count(*) FILTER (s = 'P' AND NOT c) AS failed, count(*) FILTER (c) AS cancelled
FROM (SELECT o_custkey, o_orderstatus AS s, o_orderpriority = '1-URGENT' AS c FROM orders) GROUP BY 1""")
def cancelled_rollup(t):
    """Urgent orders as cancelled ones."""
    return S.status_counts(t.orders, "o_custkey", "o_orderstatus", {"processing": "O", "finished": "F", "failed": "P"}, F.col("o_orderpriority") == "1-URGENT")


@book.query("""WITH k AS (SELECT o_orderkey % 500 AS doc_id, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'P' THEN -1.0 ELSE 0.5 END AS p, o_orderkey % 3 AS priority, o_orderstatus AS m FROM orders WHERE o_orderstatus <> 'O' OR o_orderkey % 500 < 250),
a AS (SELECT doc_id, avg(greatest(p, 0.0)) AS mean, bool_and(p IN (1, -1)) AS ended, bool_or(p = -1) AS failed, max(priority) AS priority, string_agg(DISTINCT m, chr(10) ORDER BY m) AS messages FROM k GROUP BY doc_id)
SELECT doc_id, round(CASE WHEN ended AND failed THEN -1.0 WHEN ended THEN 1.0 ELSE mean END, 6)::DOUBLE AS progress, CASE WHEN ended AND failed THEN 'FAIL' WHEN ended THEN 'DONE' ELSE 'RUNNING' END AS status, priority, messages FROM a""")
def progress_rollup(t):
    s = F.col("o_orderstatus")
    tasks = t.orders.where((s != "O") | (F.col("o_orderkey") % 500 < 250)).select(
        (F.col("o_orderkey") % 500).alias("doc_id"), F.when(s == "F", 1.0).when(s == "P", -1.0).otherwise(0.5).alias("progress"), (F.col("o_orderkey") % 3).alias("priority"), s.alias("message"))
    return C.doc_progress(tasks).withColumn("progress", r6("progress"))


@book.query("""SELECT l_suppkey, sum(n) AS n, round(sum(q), 6) AS q FROM (SELECT s_suppkey AS l_suppkey, 10 AS n, 0.5 AS q FROM supplier UNION ALL SELECT l_suppkey, 1, l_quantity FROM lineitem) GROUP BY l_suppkey""")
def additive_counters(t):
    base = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.lit(10).cast("long").alias("n"), F.lit(0.5).alias("q"))
    deltas = t.lineitem.select("l_suppkey", F.lit(1).cast("long").alias("n"), F.col("l_quantity").alias("q"))
    return C.apply_deltas(base, deltas, ["l_suppkey"], ["n", "q"]).withColumn("q", r6("q"))


@book.query("""SELECT 'k' AS key, json_extract_string(props, '$.k') AS value, count(*) AS n, min(event_id) AS first FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 2
UNION ALL SELECT 'type', event_type, count(*), min(event_id) FROM events GROUP BY 2""")
def metadata_inverted(t):
    meta = C.invert_metadata(t.events, "event_id", F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("type"), F.col("event_type")))
    return meta.groupBy("key", "value").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@book.query("""SELECT event_id FROM events WHERE try_cast(json_extract_string(props, '$.k') AS DECIMAL(20,10)) >= 50 AND (starts_with(json_extract_string(props, '$.k'), '6') OR json_extract_string(props, '$.k') = '77')""")
def props_metadata_filter(t):
    spec = {"logic": "and", "conditions": [{"key": "k", "op": "≥", "value": 50}, {"logic": "or", "conditions": [{"key": "k", "op": "start with", "value": "6"}, {"key": "k", "op": "is", "value": "77"}, {"key": "k", "op": "no such"}]}]}
    return t.events.where(P.metadata_filter("props", spec)).select("event_id")


@book.query("""SELECT o_orderkey AS doc_id FROM orders WHERE o_totalprice::VARCHAR::DOUBLE > 100000 AND contains(lower(o_orderpriority), 'high')""")
def document_meta_filter(t):
    meta = C.invert_metadata(t.orders, "o_orderkey", F.create_map(F.lit("price"), F.col("o_totalprice").cast("string"), F.lit("priority"), F.col("o_orderpriority")))
    return P.meta_filter(meta, [("price", ">", "100000"), ("priority", "contains", "HIGH"), ("absent", "=", "x")])


@book.query("""SELECT l_orderkey AS doc_id FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R') AND bool_or(l_linestatus = 'O')""")
def extraction_filter(t):
    items = t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_set(F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))).alias("items"))
    return items.where(P.extraction_filter("items", [("flag", "=", "r"), ("status", "=", "O")])).select("doc_id")


@book.query("""SELECT doc_id FROM documents WHERE lang IN ('fr', 'de') AND n_chars > 300""")
def combined_doc_filters(t):
    a, b = t.documents.where("lang in ('fr', 'de')"), t.documents.where("n_chars > 300")
    return P.combine_doc_filters([(True, a), (False, t.documents.where("false")), (True, b)], t.documents)


@book.query("""SELECT event_id, CASE WHEN event_type = 'purchase' AND value > 50 THEN 'big' WHEN contains(event_type, 'c') OR value < 5 THEN 'small' ELSE 'rest' END AS route FROM events""")
def switch_route(t):
    e, v = F.col("event_type"), F.col("value")
    return t.events.select("event_id", P.route([((e == "purchase") & (v > 50), "big"), (e.contains("c") | (v < 5), "small")], "rest").alias("route"))


@book.query("""SELECT c_custkey FROM customer WHERE ((c_nationkey IN (1, 2) AND c_mktsegment = 'BUILDING') OR c_nationkey = 7) AND c_acctbal > 0""")
def visible_rows(t):
    rows = t.customer.select("c_custkey", "c_nationkey", F.when(F.col("c_mktsegment") == "BUILDING", "team").otherwise("me").alias("permission"), F.when(F.col("c_acctbal") > 0, "1").otherwise("0").alias("status"))
    return rows.where(P.visible("c_nationkey", "permission", "status", 7, [1, 2])).select("c_custkey")


@book.query("""SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 600 MINUTES AND contains(lower(event_type), 'vie')""")
def recent_by_name(t):
    now = t.events.agg(F.max("ts").alias("now"))
    return t.events.join(F.broadcast(now)).where(P.recent("ts", F.col("now"), 600) & P.name_contains("event_type", "VIE")).select("event_id")


@book.query("""SELECT p_partkey FROM part WHERE p_size IN (1, 2, 3) AND p_brand IS NOT NULL AND NOT coalesce(p_size, 1) < 1""")
def condition_filter(t):
    parts = t.part.withColumn("available_int", F.col("p_size")).withColumn("removed", F.lit(None))
    return parts.where(P.condition({"p_size": [1, 2, 3], "exists": "p_brand", "must_not": {"exists": "removed"}, "available_int": 1, "p_type": None})).select("p_partkey")


@book.query("""SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'small', p_name])""")
def array_condition(t):
    w = t.part.select("p_partkey", "p_name", F.split("p_name", " ").alias("w"))
    return w.where(P.array_any("w", ["red", "small"]) | F.array_contains("w", F.col("p_name"))).select("p_partkey")


@book.query("""WITH RECURSIVE f AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent, p_size AS size FROM part),
a AS (SELECT id, id AS ancestor, parent AS next, size FROM f UNION ALL SELECT a.id, f.id, f.parent, a.size FROM a JOIN f ON a.next = f.id)
SELECT ancestor AS id, sum(size)::BIGINT AS size, count(*) AS n FROM a GROUP BY 1""")
def folder_sizes(t):
    f = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("parent"), F.col("p_size").alias("size"))
    return C.roll_up(f).join(f.select("id", "size"), "id").groupBy(F.col("ancestor").alias("id")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))


@book.query("""WITH v AS (SELECT 'p_size' AS c, p_size::VARCHAR AS v FROM part UNION ALL SELECT 'p_retailprice', p_retailprice::VARCHAR FROM part UNION ALL SELECT 'p_name', p_name FROM part),
k AS (SELECT c, CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') AND NOT starts_with(v, '0') THEN 'int' WHEN regexp_full_match(v, '[+-]?[0-9.]{0,19}') AND NOT starts_with(v, '0') THEN 'float' ELSE 'text' END AS k FROM v),
n AS (SELECT c, k, count(*) AS n FROM k GROUP BY ALL) SELECT c AS "column", arg_max(k, n) AS type, max(n) AS n FROM n GROUP BY c""")
def column_type_vote(t):
    return C.infer_types(t.part, ["p_size", "p_retailprice", "p_name"])


@book.query("""SELECT s_suppkey, 'p_name:' || s_name || '; key:' || s_nationkey AS line FROM supplier""")
def row_to_text(t):
    return t.supplier.select("s_suppkey", F.col("s_name").alias("p_name"), F.lit(None).cast("string").alias("gone"), F.col("s_nationkey").alias("key")).select("s_suppkey", C.rows_to_text(["p_name", "gone", "key"]).alias("line"))


@book.query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40""")
def page_of_orders(t):
    return C.page(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"], 3, 20)


@book.query("""SELECT p_partkey, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1""")
def group_top1(t):
    return C.top1_per_group(t.part, "p_brand", "p_retailprice", "p_partkey").select("p_partkey", "p_brand")


@book.query("""WITH m AS (SELECT o_custkey, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1)
SELECT o_orderkey, round(CASE WHEN hi - lo < 0.001 THEN 0.0 ELSE (o_totalprice - lo) / (hi - lo) END, 6) AS score FROM orders JOIN m USING (o_custkey)""")
def minmax_norm(t):
    return C.minmax_norm(t.orders.select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("score")), "o_custkey", "score").select("o_orderkey", r6("score").alias("score"))


@book.query("""SELECT o_custkey, o_orderkey FROM (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) - o_totalprice AS used FROM orders) WHERE used < 300000""")
def context_budget(t):
    return C.within_budget(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", 300000, inclusive=True).select("o_custkey", "o_orderkey")


@book.query("""SELECT conv_id, turn, text FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3""")
def last_n_user_turns(t):
    return C.last_turns(t.conversations, 3, "user").select("conv_id", "turn", "text")


@book.query("""SELECT doc_id, min(step) AS step FROM (SELECT doc_id, 0 AS step FROM documents WHERE n_chars < 1000 UNION ALL SELECT doc_id, 1 FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 2 FROM documents WHERE source = 'src3') GROUP BY doc_id""")
def multi_query_merge(t):
    d = t.documents.select("doc_id", "lang", "source", "n_chars")
    return C.merge_hits([d.where("n_chars < 1000"), d.where("lang = 'en'"), d.where("source = 'src3'")], "doc_id").select("doc_id", "step")


@book.query("""SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 EXCEPT SELECT s_suppkey FROM supplier WHERE s_acctbal < 0""")
def intersect_except(t):
    a, b = t.lineitem.where("l_returnflag = 'R'").select("l_suppkey"), t.lineitem.where("l_quantity > 49").select("l_suppkey")
    return a.intersect(b).join(t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_anti")


@book.query("""SELECT doc_id, md5(text) AS h, length(text) AS value FROM documents""")
def cached_compute(t):
    d = t.documents.select("doc_id", "text")
    cache = d.where("doc_id % 2 = 0").select(F.md5("text").alias("cache_key"), F.length("text").alias("value")).dropDuplicates(["cache_key"])
    rows, _ = C.with_cache(d, cache, F.md5("text"), F.length("text"))
    return rows.select("doc_id", F.col("cache_key").alias("h"), F.col("value").cast("long").alias("value"))


@book.query("""SELECT doc_id, from_page, doc_id % 3 <> 0 AS reused FROM (SELECT doc_id, unnest(range(0, greatest(n_chars, 1), 3000)) AS from_page FROM documents)""")
def reuse_units(t):
    span = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_chars") - 1, F.lit(0)), F.lit(3000).cast("long")))
    new = t.documents.select("doc_id", span.alias("from_page"), "text").withColumn("digest", F.md5(F.substring("text", F.col("from_page").cast("int") + 1, F.lit(3000)))).drop("text")
    prev = new.select("doc_id", "from_page", "digest", F.when(F.col("doc_id") % 3 == 0, 0.5).otherwise(1.0).alias("progress"), F.array(F.col("digest")).alias("chunk_ids"))
    units, _ = C.reuse_units(new, prev, ["doc_id", "from_page", "digest"])
    return units.select("doc_id", "from_page", "reused")


@book.query("""SELECT min(doc_id) AS doc_id, md5(text || chr(1) || lang) AS id, count(*) AS copies FROM documents GROUP BY 2""")
def dedup_content_id(t):
    from ..functions.text import content_id

    return t.documents.groupBy(content_id(F.col("text"), F.col("lang")).alias("id")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@book.query("""SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM conversations""")
def section_ids(t):
    return S.sections(t.conversations, "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "section")


@book.query("""WITH a AS (SELECT *, sum(CASE WHEN text LIKE '%.%' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g FROM conversations)
SELECT conv_id, g::BIGINT AS pair, string_agg(text, E'\n' ORDER BY turn) AS body FROM a GROUP BY ALL""")
def fold_continuations(t):
    """A line without a stop goes on the line before it."""
    return S.fold_continuations(t.conversations, "conv_id", "turn", "text", F.col("text").contains("."))


_W = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\pL\\pM\\pN]+'), lambda x: x <> '')"


@book.query(f"""WITH a AS (SELECT *, len({_W}) AS n FROM conversations), b AS (SELECT *, sum(n) OVER c AS total, turn = max(turn) OVER c AS l FROM a WINDOW c AS (PARTITION BY conv_id)),
k AS (SELECT *, sum(n) OVER c AS kept, turn = min(turn) OVER c AS f FROM b WHERE total < 120 OR role = 'system' OR l WINDOW c AS (PARTITION BY conv_id)),
e AS (SELECT *, max(n) FILTER (f) OVER c AS x, max(n) FILTER (l) OVER c AS y FROM k WINDOW c AS (PARTITION BY conv_id)),
r AS (SELECT *, CASE WHEN kept >= 120 AND x > 0.8 * (x + y) AND f THEN CASE WHEN 120 >= y THEN 120 - y ELSE greatest(x + 120 - y, 0) END WHEN kept >= 120 AND x <= 0.8 * (x + y) AND l THEN CASE WHEN 120 >= y THEN 120 - y ELSE 120 END END AS room FROM e)
SELECT conv_id, turn, CASE WHEN room IS NOT NULL AND n > room THEN array_to_string({_W}[1:room], ' ') ELSE text END AS text FROM r""")
def history_budget(t):
    """Conversations in 120 tokens, by the rule of four fifths."""
    return S.fit_history(t.conversations, 120).select("conv_id", "turn", "text")


@book.query("""WITH a AS (SELECT *, length(text) AS n FROM conversations), s AS (SELECT conv_id, sum(n) AS total, max(turn) AS last, min(turn) AS first FROM a GROUP BY 1)
SELECT conv_id, turn, CASE WHEN total <= 2000 THEN text ELSE left(text, 1000) END AS kept FROM a JOIN s USING (conv_id) WHERE total <= 2000 OR turn = last OR (turn = first AND role = 'system')""")
def history_fit(t):
    """The whole history if it fits; else the system turn and the last, each cut to half the room."""
    n = t.conversations.withColumn("n", F.length("text"))
    s = n.groupBy("conv_id").agg(F.sum("n").alias("total"), F.max("turn").alias("last"), F.min("turn").alias("first"))
    kept = n.join(s, "conv_id").where("total <= 2000 or turn = last or (turn = first and role = 'system')")
    return kept.select("conv_id", "turn", F.when(F.col("total") <= 2000, F.col("text")).otherwise(F.substring("text", 1, 1000)).alias("kept"))


@book.query("""SELECT doc_id AS id, text, lang FROM documents WHERE doc_id = 7""")
def get_row(t):
    return C.project(C.get_row(t.documents.withColumnRenamed("doc_id", "id"), "id", 7), ["text", "lang", "gone"])


@book.query("""SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS place FROM lineitem QUALIFY place >= 128 AND place < 256""")
def chunk_list(t):
    """The second page of each supplier's lines by date."""
    return C.chunk_list(t.lineitem, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], 128, 128, "l_suppkey").select("l_suppkey", "l_orderkey", "l_linenumber", "place")


@book.query("""SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20""")
def list_chunks(t):
    return C.list_chunks(t.documents, F.col("lang") == "en", [F.col("n_chars").desc(), "doc_id"], 2, 20).select("doc_id", "lang", "n_chars")


TAGGED = """WITH l AS (SELECT doc_id, ['q' || quality, 't' || toxic, 'q1'] AS tags FROM labels)
"""


def tagged(t):
    return t.labels.select("doc_id", F.array(F.concat(F.lit("q"), "quality"), F.concat(F.lit("t"), "toxic"), F.lit("q1")).alias("tags"))


@book.query(TAGGED + """SELECT doc_id, array_to_string(CASE WHEN list_contains(tags, 't1') THEN list_append(list_filter(tags, lambda x: x <> 't1'), 'harm') ELSE tags END, ',') AS tags FROM l""")
def rename_tag(t):
    return C.rename_tag(tagged(t), "tags", "t1", "harm").withColumn("tags", F.array_join("tags", ","))


@book.query(TAGGED + """SELECT doc_id, array_to_string(list_filter(tags, lambda x: x NOT IN ('q1', 't0')), ',') AS tags FROM l""")
def remove_tags(t):
    return C.remove_tags(tagged(t), "tags", ["q1", "t0"]).withColumn("tags", F.array_join("tags", ","))


@book.query("""SELECT doc_id AS id, text AS content, source AS document_name, coalesce(lang, source) AS dataset_id, NULL::VARCHAR AS url FROM documents""")
def format_hits(t):
    d = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content_with_weight"), F.col("source").alias("docnm_kwd"), F.col("lang").alias("kb_id"), F.col("source").alias("dataset_id"))
    return C.format_hits(d).select("id", "content", "document_name", "dataset_id", "url")
