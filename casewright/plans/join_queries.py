"""Lookups, inventories, components and array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import arrays
from casewright.operators import audits, graph, joins
from casewright.plans.registry import query, table


@query("""
SELECT l_partkey, count(*) AS n, max(p_name) AS p_name, min(p_retailprice) AS p_retailprice FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY l_partkey""")
def checked_product_join(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_orderkey")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_retailprice")
    joined, _ = audits.checked_lookup(li, part, ["l_partkey"], "p_name")
    return joined.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"), F.max("p_name").alias("p_name"), F.min("p_retailprice").alias("p_retailprice")
    )


@query("""
SELECT 'key not unique' AS violation, sum(n)::BIGINT AS n FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'required value missing', count(*) FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 1) ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL
  AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def join_violations(spark, d):
    li = table(spark, d, "lineitem")
    keyed = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("m"), "l_suppkey")
    heads = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    _, repeated = audits.checked_lookup(keyed.select("k", "m").distinct(), keyed, ["k", "m"], "l_suppkey")
    seen = li.select(F.col("l_orderkey").alias("k"), F.lit(True).alias("has")).distinct()
    _, missing = audits.checked_lookup(heads, seen, ["k"], "has")
    return repeated.unionByName(missing)


@query("""
SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def dimension_lookup(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    n = joins.dimension(s, table(spark, d, "nation"), ["n_nationkey"])
    r = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return joins.dimension(n, r, ["n_regionkey"]).select("s_suppkey", "n_name", "r_name")


@query("""
SELECT o_custkey, string_agg('about ' || o_orderpriority, '|' ORDER BY k) AS contents, true AS hits_ok
FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY ALL) GROUP BY o_custkey""")
def titled_documents(spark, d):
    o = table(spark, d, "orders")
    # Titles in order-key order; a customer has few distinct ones.
    first = o.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("k"))
    refs = first.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("k", "o_orderpriority"))).alias("t"))
    refs = refs.select("o_custkey", F.transform("t", lambda x: x["o_orderpriority"]).alias("titles"))
    docs = o.select(F.col("o_orderpriority").alias("title")).distinct().withColumn("body", F.concat(F.lit("about "), "title"))
    out = joins.titled_documents(refs, docs, "o_custkey", "titles", "title", "body")
    return out.select("o_custkey", F.array_join("contents", "|").alias("contents"), "hits_ok")


@query("""
WITH q AS (SELECT DISTINCT l_returnflag AS source, l_orderkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F'),
r AS (SELECT DISTINCT l_returnflag AS source, l_orderkey, l_suppkey FROM lineitem)
SELECT r.source, count(*) AS n, count(q.source) AS matched_rows FROM r LEFT JOIN q USING (source, l_orderkey, l_suppkey) GROUP BY r.source""")
def composite_key_join(spark, d):
    pair = F.array("l_orderkey", "l_suppkey").alias("id")
    li = table(spark, d, "lineitem")
    asked = li.where("l_linestatus = 'F'").select(F.col("l_returnflag").alias("source"), pair).distinct()
    resolved = li.select(F.col("l_returnflag").alias("source"), pair).distinct()
    out = joins.by_composite_key(resolved, asked, "source", "id")
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("matched").alias("matched_rows"))


@query("""
WITH inv AS (SELECT DISTINCT p_brand AS category FROM part), s AS (SELECT unnest(['F', 'O']) AS sentiment),
iv AS (SELECT category, sentiment, (row_number() OVER (ORDER BY category, sentiment) - 1) // 8 + 1 AS block FROM inv, s),
g AS (SELECT DISTINCT l_suppkey, p_brand AS category, l_linestatus AS sentiment FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_suppkey, block, count(*) AS questions, count(*) FILTER (EXISTS (SELECT 1 FROM g WHERE g.l_suppkey = r.l_suppkey AND g.category = iv.category AND g.sentiment = iv.sentiment)) AS yes
FROM (SELECT DISTINCT l_suppkey FROM lineitem) r, iv GROUP BY l_suppkey, block""")
def inventory_questions(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_linestatus")
    pairs = F.concat_ws("|", "p_brand", "l_linestatus")
    # A review's gold pairs are a set of inventory entries.
    reviews = li.join(part, "l_partkey").groupBy("l_suppkey").agg(F.collect_set(pairs).alias("pairs")).withColumn("domain", F.lit("parts"))
    inventory = part.select(F.lit("parts").alias("domain"), F.col("p_brand").alias("category"))
    out = joins.inventory_questions(reviews, inventory, "l_suppkey", "domain", "pairs", "category", ["F", "O"], 8)
    yes = F.size(F.filter("questions", lambda q: q["gold"] == "yes")).cast("bigint")
    return out.select("l_suppkey", F.col("block").cast("bigint").alias("block"), F.size("questions").cast("bigint").alias("questions"), yes.alias("yes"))


@query("""
WITH e AS (SELECT l_orderkey AS form, l_partkey AS id, CASE WHEN max(l_linestatus) = 'F' THEN 'question' ELSE 'answer' END AS label, list(DISTINCT l_partkey + 1) || list(DISTINCT l_partkey + 2) AS links
  FROM lineitem GROUP BY ALL),
x AS (SELECT form, id, unnest(links) AS t FROM e WHERE label = 'question')
SELECT x.form, x.id, x.t AS answer_id FROM x JOIN e ON e.form = x.form AND e.id = x.t AND e.label = 'answer'""")
def linked_answers(spark, d):
    e = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("form"), F.col("l_partkey").alias("id")).agg(
        F.when(F.max("l_linestatus") == "F", "question").otherwise("answer").alias("label")
    )
    e = e.withColumn("links", F.array(F.col("id") + 1, F.col("id") + 2))
    return joins.linked(e, "form", "id", "links", "label")


@query("""
WITH u AS (SELECT o_orderkey AS id, 'open' AS split, o_orderpriority AS file FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT o_orderkey, 'done', o_orderpriority FROM orders WHERE o_orderstatus = 'F')
SELECT id, split FROM u WHERE file IN (SELECT o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW')""")
def union_of_existing(spark, d):
    o = table(spark, d, "orders")
    parts = [
        o.where(F.col("o_orderstatus") == s).select(F.col("o_orderkey").alias("id"), F.lit(n).alias("split"), F.col("o_orderpriority").alias("file"))
        for s, n in (("O", "open"), ("F", "done"))
    ]
    listing = o.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderpriority").alias("file"))
    return joins.existing_only(parts, listing, "file").select("id", "split")


EDGES = r"""
ed AS (SELECT 'doc:' || doc_id::VARCHAR AS a, 'text:' || sha256(text) AS b FROM documents
  UNION SELECT 'doc:' || doc_id::VARCHAR, 'clean:' || sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) FROM documents),
bi AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed),
r AS (SELECT a AS node, a AS label FROM bi UNION SELECT bi.b, r.label FROM r JOIN bi ON bi.a = r.node),
comp AS (SELECT node, min(label) AS component FROM r GROUP BY node)"""


def doc_components(spark, d):
    from casewright.functions import text

    docs = table(spark, d, "documents")
    node = F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("a")
    exact = docs.select(node, F.concat(F.lit("text:"), F.sha2("text", 256)).alias("b"))
    near = docs.select(node, F.concat(F.lit("clean:"), F.sha2(text.clean(F.lower("text")), 256)).alias("b"))
    return graph.components(exact.unionByName(near), "a", "b")


@query(f"WITH RECURSIVE {EDGES} SELECT * FROM comp")
def duplicate_components(spark, d):
    return doc_components(spark, d)


@query(f"""
WITH RECURSIVE {EDGES}
SELECT node, component, ('0x' || substr(sha256('calibration:' || component), 1, 8))::BIGINT % 5 = 0 AS calibration FROM comp WHERE starts_with(node, 'doc:')""")
def leak_free_split(spark, d):
    docs = doc_components(spark, d).where(F.col("node").startswith("doc:"))
    return graph.hash_split(docs, "component", "calibration")


@query("""
WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_key FROM orders GROUP BY ALL)
SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY first_key) AS priorities FROM f GROUP BY o_custkey""")
def ordered_distinct(spark, d):
    listed = joins.ordered_distinct(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey", "priorities")
    return listed.withColumn("priorities", F.array_join("priorities", ","))


@query("""
SELECT o_orderkey, (list_position(['F', 'O', 'P'], o_orderstatus) - 1)::BIGINT AS status_at FROM orders""")
def value_position(spark, d):
    at = F.array_position(F.array(*[F.lit(x) for x in "FOP"]), F.col("o_orderstatus")) - 1
    return table(spark, d, "orders").select("o_orderkey", at.alias("status_at"))


@query("""
WITH b AS (SELECT p_partkey, p_size AS t0, p_size + 10 AS t1, p_partkey % 40 AS a0, p_partkey % 40 + 9 AS a1, p_size + 5 AS b0, p_size + 15 AS b1,
  p_partkey % 70 AS c0, p_partkey % 70 + 8 AS c1, p_size + 18 AS d0, p_size + 30 AS d1 FROM part),
m AS (SELECT *, a0 < t1 AND t0 < a1 AS a_t, b0 < t1 AND t0 < b1 AS b_t, c0 < t1 AND t0 < c1 AS c_t, d0 < t1 AND t0 < d1 AS d_t, a0 < b1 AND b0 < a1 AS ab, a0 < c1 AND c0 < a1 AS ac,
  a0 < d1 AND d0 < a1 AS ad, b0 < c1 AND c0 < b1 AS bc, b0 < d1 AND d0 < b1 AS bd, c0 < d1 AND d0 < c1 AS cd FROM b),
k1 AS (SELECT *, NOT a_t AS ka FROM m), k2 AS (SELECT *, NOT b_t AND NOT (ka AND ab) AS kb FROM k1),
k3 AS (SELECT *, NOT c_t AND NOT (ka AND ac) AND NOT (kb AND bc) AS kc FROM k2), k4 AS (SELECT *, NOT d_t AND NOT (ka AND ad) AND NOT (kb AND bd) AND NOT (kc AND cd) AS kd FROM k3)
SELECT p_partkey, concat_ws(',', CASE WHEN ka THEN a0 END, CASE WHEN kb THEN b0 END, CASE WHEN kc THEN c0 END, CASE WHEN kd THEN d0 END) AS kept FROM k4""")
def kept_boxes(spark, d):
    s, k = F.col("p_size"), F.col("p_partkey")

    def box(x0, width):
        x0 = x0.cast("bigint")
        return F.struct(x0.alias("x0"), F.lit(0).alias("y0"), (x0 + width).alias("x1"), F.lit(10).alias("y1"))

    boxes = F.array(box(k % 40, 9), box(s + 5, 10), box(k % 70, 8), box(s + 18, 12))
    kept = arrays.kept_boxes(boxes, box(s, 10))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(kept, lambda b: b["x0"].cast("string")), ",").alias("kept"))


@query("""
SELECT user_id, event_type, max(event_id) AS latest FROM events GROUP BY ALL""")
def merged_maps(spark, d):
    """Each event is a map of its type to its id; in order of the ids, later ones win."""
    one = F.struct("event_id", "event_type")
    rows = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(one)).alias("e"))
    maps = F.transform("e", lambda e: F.create_map(e["event_type"], e["event_id"]))
    return rows.select("user_id", F.explode(arrays.merged(maps)).alias("event_type", "latest"))
