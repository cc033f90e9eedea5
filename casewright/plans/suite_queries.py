"""Building cases: filters, editions, audits, digests, questions and text functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.functions import arrays, hashing, scoring, text
from casewright.operators import audits, editions, facts, inference, joins, results
from casewright.plans.derived import ORDER_CASES, order_cases
from casewright.plans import spec
from casewright.plans.registry import query, table
from casewright.session import checkpoint_dir
from casewright.sources import digests, readers


@query("""
SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def exclusion_filter(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("run_id"), "lang", "source")
    toxic = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("run_id"))
    return editions.exclude(docs, toxic).withColumnRenamed("run_id", "doc_id")


@query("""
SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def subset_semi_join(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("run_id"))
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("run_id"))
    return editions.keep_listed(docs, good).withColumnRenamed("run_id", "doc_id")


@query("""
WITH r AS (SELECT source || ':' || doc_id::VARCHAR AS run_id, lang AS catalog_id, doc_id FROM documents),
keep AS (SELECT r.catalog_id, r.run_id FROM r JOIN labels USING (doc_id) WHERE quality = 1 AND r.catalog_id = 'en')
SELECT run_id, catalog_id FROM r WHERE catalog_id <> 'fr' AND (catalog_id <> 'de' OR starts_with(run_id, 'src1'))
  AND (catalog_id NOT IN (SELECT catalog_id FROM keep) OR run_id IN (SELECT run_id FROM keep))""")
def edition_filter(spark, d):
    rows = table(spark, d, "documents").select(
        F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("run_id"), F.col("lang").alias("catalog_id"), "doc_id"
    )
    langs = rows.select("catalog_id").distinct()
    retired = langs.where("catalog_id = 'fr'")
    replaced = langs.where("catalog_id = 'de'").withColumn("prefix", F.lit("src1"))
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    subset = rows.where("catalog_id = 'en'").join(good, "doc_id", "left_semi").select("catalog_id", "run_id")
    return editions.in_edition(rows, retired, replaced, subset).select("run_id", "catalog_id")


@query(f"""
WITH {ORDER_CASES}, sub AS (SELECT DISTINCT catalog_id, group_id FROM cases WHERE catalog_id IN (1, 3) AND gold = 'yes' AND pred = 'yes'),
exc AS (SELECT DISTINCT run_id FROM cases WHERE status = 'error'),
car AS (SELECT DISTINCT catalog_id, group_id FROM cases WHERE run_id IN (SELECT run_id FROM exc))
SELECT catalog_id, count(*) AS n, sum(group_id)::BIGINT AS group_sum FROM cases c WHERE catalog_id NOT IN (SELECT catalog_id FROM sub)
  OR EXISTS (SELECT 1 FROM sub s WHERE s.catalog_id = c.catalog_id AND s.group_id = c.group_id)
  OR EXISTS (SELECT 1 FROM car s WHERE s.catalog_id = c.catalog_id AND s.group_id = c.group_id) GROUP BY catalog_id""")
def group_preserving_cut(spark, d):
    rows = order_cases(spark, d)
    subset = rows.where("catalog_id in (1, 3) and gold = 'yes' and pred = 'yes'").select("catalog_id", "group_id").distinct()
    excluded = rows.where("status = 'error'").select("run_id").distinct()
    kept = editions.cut_groups(rows, subset, excluded)
    return kept.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("n"), F.sum("group_id").alias("group_sum"))


@query("""
SELECT lang, CASE WHEN quality IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'toxic' WHEN n_chars < 200 THEN 'too short'
  WHEN quality = 0 THEN 'low quality' ELSE 'kept' END AS reason, count(*) AS n
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def first_failing_reason(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    rules = [
        ("unlabelled", F.col("quality").isNull()), ("toxic", F.col("toxic") == 1),
        ("too short", F.col("n_chars") < 200), ("low quality", F.col("quality") == 0),
    ]
    return audits.reason_counts(rows, rules, ["lang"])


@query("""
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' AND o_orderdate <= l_shipdate GROUP BY ALL""")
def date_policy(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    inside = F.col("l_shipdate").between("1996-01-01", "1997-12-31")
    kept = li.where(inside).join(o, "l_orderkey").where("o_orderdate <= l_shipdate")
    return kept.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT doc_id::VARCHAR AS run_id, text AS state, '[]' AS questions FROM documents""")
def request_projection(spark, d):
    cases = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("run_id"), F.col("text").alias("state"), F.lit("[]").alias("questions"), F.lit("yes").alias("expected")
    )
    return facts.requests(cases)


@query("""
WITH o AS (SELECT l_orderkey, list(DISTINCT l_suppkey::VARCHAR ORDER BY l_suppkey::VARCHAR) AS opts FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) >= 2)
SELECT l_orderkey, chr((65 + l_orderkey % len(opts))::INT) AS gold, array_to_string(list_transform(opts, lambda x, i: chr(64 + i::INT) || '=' || x), ';') AS criteria FROM o""")
def choice_cases(spark, d):
    # An order has at most a few dozen distinct suppliers; more than 255 would be an error.
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("s")).distinct()
    opts = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("s")).alias("options")).where(F.size("options") >= 2)
    opts = opts.withColumns({"gold_index": F.col("l_orderkey") % F.size("options"), "instr": F.lit("Which supplier?")})
    made = facts.choice_case(opts, "options", "gold_index", "instr")
    shown = F.transform(F.col("questions")[0]["criteria"], lambda c: F.concat(c["option"], F.lit("="), c["descr"]))
    return made.select("l_orderkey", F.element_at("expected", "q1").alias("gold"), F.array_join(shown, ";").alias("criteria"))


@query("""
SELECT o_custkey, unnest(['F', 'O', 'P']) AS field, CASE WHEN list_contains(s, unnest(['F', 'O', 'P'])) THEN 'yes' ELSE 'no' END AS gold
FROM (SELECT o_custkey, list(DISTINCT o_orderstatus) AS s FROM orders GROUP BY o_custkey)""")
def label_questions(spark, d):
    seen = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    return facts.label_questions(seen, ["F", "O", "P"], "s").select("o_custkey", "field", "gold")


@query(f"""
WITH {ORDER_CASES}
SELECT catalog_id, field, count(*) AS n FROM cases WHERE NOT (status = 'unsupported') AND (catalog_id <> 3 OR field = 'A') GROUP BY ALL""")
def scored_fields(spark, d):
    rows = order_cases(spark, d)
    unscored = rows.where("status = 'unsupported'").select("run_id", "field").distinct()
    only = rows.where("catalog_id = 3 and field = 'A'").select("catalog_id", "field").distinct()
    kept = facts.scored_fields(rows, unscored, only)
    return audits.tally(kept, ["catalog_id", "field"])


@query("""
SELECT c_custkey, n_f, n_o, label FROM (
  SELECT o_custkey AS c_custkey, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o,
    sign(count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority < '3') - count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority < '3'))::INTEGER AS label
  FROM orders GROUP BY o_custkey) WHERE label <> 0 AND sign(n_f - n_o) = label""")
def tie_drop(spark, d):
    """Customers labelled by their urgent orders; those whose label all orders contradict are left out after ties."""
    sided = lambda s, more="true": F.count_if((F.col("o_orderstatus") == s) & F.expr(more))
    urgent = "o_orderpriority < '3'"
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        sided("F").alias("n_f"), sided("O").alias("n_o"), F.signum(sided("F", urgent) - sided("O", urgent)).cast("int").alias("label")
    )
    kept, wrong = joins.tied_out(n, F.col("label"), F.signum(F.col("n_f") - F.col("n_o")) == F.col("label"))
    return kept.join(wrong.select("c_custkey"), "c_custkey", "left_anti")


@query("""
SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE contains(props, '"k": 4') AND event_id % 5 <> 2
UNION ALL SELECT -count(*), NULL FROM events WHERE contains(props, '"k": 4') AND event_id % 5 = 2""")
def substring_prefilter(spark, d):
    """Lines that hold a text are parsed, others never; lines that do not fit are counted below zero."""
    path = f"{checkpoint_dir(spark)}/marked-{uuid.uuid4().hex}"
    whole = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "props": '), "props", F.lit("}"))
    torn = F.substr(whole, F.lit(1), F.length(whole) - 1)
    table(spark, d, "events").select(F.when(F.col("event_id") % 5 == 2, torn).otherwise(whole).alias("value")).write.text(path)
    schema = T.StructType.fromDDL("event_id bigint, props struct<k:bigint>")
    good, bad = readers.containing(spark, path, '"k": 4', schema, "rejects")
    lost = bad.agg((-F.count(F.lit(1))).alias("event_id")).select("event_id", F.lit(None).cast("bigint").alias("k"))
    return good.select("event_id", F.col("props.k").alias("k")).unionByName(lost)


@query(r"""
SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents""")
def whitespace_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("text"))


@query("""
WITH e AS (SELECT lang AS edition, sha256(min(text)) AS rows_sha256, CASE WHEN lang <> 'en' THEN count(*) % 2 END::VARCHAR AS added_sha256 FROM documents GROUP BY lang),
f AS (SELECT edition, rows_sha256, added_sha256 FROM e UNION ALL SELECT edition || '.1', rows_sha256, added_sha256 FROM e)
SELECT a.edition AS edition_a, b.edition AS edition_b FROM f a JOIN f b ON a.rows_sha256 = b.rows_sha256 AND a.added_sha256 IS NOT DISTINCT FROM b.added_sha256""")
def compatible_editions(spark, d):
    e = table(spark, d, "documents").groupBy(F.col("lang").alias("edition")).agg(
        F.sha2(F.min("text"), 256).alias("rows_sha256"), F.count(F.lit(1)).alias("n")
    )
    e = e.select("edition", "rows_sha256", F.when(F.col("edition") != "en", (F.col("n") % 2).cast("string")).alias("added_sha256"))
    both = e.unionByName(e.withColumn("edition", F.concat("edition", F.lit(".1"))))
    return editions.compatible(both, ["rows_sha256", "added_sha256"])


@query("""
WITH r AS (SELECT page_id, 'Look at <image 1> and <image 9>: ' || url AS q, ['one', 'two', 'three', 'four'] AS o, page_id % 3 = 0 AS inside FROM pages)
SELECT page_id, CASE WHEN inside THEN 'Answer the multiple-choice question shown in the image (options A-D).'
   ELSE replace(q, '<image 1>', '[image 1]') END AS instructions, CASE WHEN inside THEN 'A|B|C|D' ELSE array_to_string(o, '|') END AS option_texts FROM r""")
def image_requests(spark, d):
    rows = table(spark, d, "pages").select(
        "page_id", F.concat(F.lit("Look at <image 1> and <image 9>: "), "url").alias("q"),
        F.array(*[F.lit(x) for x in ("one", "two", "three", "four")]).alias("o"), (F.col("page_id") % 3 == 0).alias("inside"),
    )
    made = facts.image_choice_case(rows, "o", "q", "inside")
    return made.select("page_id", "instructions", F.array_join("option_texts", "|").alias("option_texts"))


@query("""
SELECT p_partkey, chr(65 + p_size % 6) AS gold FROM part WHERE p_size % 6 < 2 + p_partkey % 3""")
def gold_within_options(spark, d):
    rows = table(spark, d, "part").select(
        "p_partkey", F.char(65 + F.col("p_size") % 6).alias("gold"),
        F.array_repeat(F.lit("x"), (2 + F.col("p_partkey") % 3).cast("int")).alias("options"),
    )
    return facts.gold_within(rows, "gold", "options").select("p_partkey", "gold")


@query("""
SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tools FROM events GROUP BY user_id""")
def nested_gold_names(spark, d):
    one = table(spark, d, "events").select("user_id", "event_type").distinct()
    calls = one.groupBy("user_id").agg(F.collect_list(F.create_map("event_type", F.lit(1))).alias("calls"))
    return calls.select("user_id", F.array_join(F.array_sort(arrays.call_names(F.col("calls"))), ",").alias("tools"))


@query("""
SELECT p.o_custkey, len(list_filter(want, lambda x: NOT list_contains(have, x))) = 0 AS covered, list_sort(want) = list_sort(have) AS same
FROM (SELECT o_custkey, list(DISTINCT o_orderstatus) AS want, list(DISTINCT CASE WHEN o_totalprice > 100000 THEN o_orderstatus ELSE 'F' END) AS have FROM orders GROUP BY o_custkey) p""")
def subset_and_set_tests(spark, d):
    both = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.collect_set("o_orderstatus").alias("want"),
        F.collect_set(F.when(F.col("o_totalprice") > 100000, F.col("o_orderstatus")).otherwise("F")).alias("have"),
    )
    return both.select(
        "o_custkey", arrays.subset(F.col("want"), F.col("have")).alias("covered"), arrays.same_set(F.col("want"), F.col("have")).alias("same")
    )


@query("""
WITH l AS (SELECT source, sha256(doc_id::VARCHAR || ' ' || sha256(text)) AS h FROM documents),
s AS (SELECT source, count(*) AS rows, sum(('0x' || substr(h, 1, 15))::BIGINT::HUGEINT) w0, sum(('0x' || substr(h, 16, 15))::BIGINT::HUGEINT) w1,
  sum(('0x' || substr(h, 31, 15))::BIGINT::HUGEINT) w2, sum(('0x' || substr(h, 46, 15))::BIGINT::HUGEINT) w3 FROM l GROUP BY source)
SELECT source, rows, sha256(concat_ws(':', rows, w0, w1, w2, w3)) AS fingerprint FROM s""")
def row_set_fingerprints(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", F.sha2("text", 256).alias("p"))
    return digests.row_set_fingerprint(rows, ["source"], "doc_id", "p")


@query("""
WITH l AS (SELECT source, doc_id::VARCHAR AS i, sha256(text) AS p FROM documents)
SELECT source, count(*) AS rows, sha256(string_agg(i || chr(10), '' ORDER BY i)) AS run_ids_sha256,
  sha256(string_agg(i || ' ' || p || chr(10), '' ORDER BY i)) AS payloads_sha256 FROM l GROUP BY source""")
def pinned_row_digests(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", F.sha2("text", 256).alias("p"))
    return digests.pinned_digests(rows, ["source"], "doc_id", "p")


@query("""
WITH l AS (SELECT source, doc_id, sha256(text) AS p, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS segment FROM documents)
SELECT source, segment, count(*) AS rows, sha256(string_agg(doc_id::VARCHAR || ' ' || p || chr(10), '' ORDER BY doc_id)) AS digest FROM l GROUP BY ALL""")
def segment_digests(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", F.sha2("text", 256).alias("p"))
    return digests.segment_digests(rows, ["source"], "doc_id", "p", 20)


@query("""
WITH w AS (SELECT lang, count(*) AS rows, min(sha256(text)) AS low, max(sha256(text)) AS high FROM documents GROUP BY lang),
f AS (SELECT lang, count(*) AS rows, min(sha256(text)) AS low, max(sha256(text)) AS high FROM documents WHERE doc_id > 0 AND lang <> 'de' GROUP BY lang)
SELECT w.lang, coalesce(w.rows = f.rows, false) AS rows_match, coalesce(w.low = f.low, false) AS low_match, coalesce(w.high = f.high, false) AS high_match FROM w LEFT JOIN f USING (lang)""")
def digests_against_pins(spark, d):
    """Pins of all documents against a copy that lacks the first document and a language."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("p"))
    ends = [F.count(F.lit(1)).alias("rows"), F.min("p").alias("low"), F.max("p").alias("high")]
    found = docs.where("doc_id > 0 and lang <> 'de'").groupBy("lang").agg(*ends)
    return digests.against_pins(found, docs.groupBy("lang").agg(*ends), ["lang"], ["rows", "low", "high"])


@query("""
SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_linestatus = 'O' GROUP BY l_returnflag""")
def filtered_scan(spark, d):
    from casewright.sources import readers

    rows = readers.parquet(
        spark, f"{d}/lineitem.parquet", ["l_returnflag", "l_extendedprice"],
        "l_shipdate >= timestamp_ntz '1998-01-01' and l_linestatus = 'O'",
    )
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("""
SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_suppkey) <> max(l_suppkey) AS conflict,
  CASE WHEN min(l_suppkey) <> max(l_suppkey) THEN 0 ELSE count(*) - 1 END AS duplicates
FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def key_conflicts(spark, d):
    return audits.key_conflicts(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_suppkey"))


@query("""
SELECT sha256(lower(text)) AS payload_sha256, count(*) AS copies, min(doc_id) AS doc_id FROM documents GROUP BY sha256(lower(text))
HAVING min(lang) = max(lang)""")
def first_of_identical(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    kept, _ = audits.first_of_identical(docs, F.lower("text"), "doc_id", "lang")
    return kept.select("payload_sha256", "copies", "doc_id")


@query(r"""
WITH c AS (SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents),
b AS (SELECT sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM benchmark
  UNION SELECT h FROM c JOIN labels USING (doc_id) WHERE quality = 0)
SELECT h AS state_sha256, min(doc_id) AS doc_id, count(*) AS copies FROM c WHERE h NOT IN (SELECT h FROM b) GROUP BY h""")
def dedup_against_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("s"))
    held = table(spark, d, "benchmark").select(text.clean(F.col("text")).alias("s"))
    low = docs.join(table(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_semi").select("s")
    return audits.dedup_outside(docs, F.col("s"), "doc_id", held.unionByName(low), F.col("s"))


COMPARED = """
a AS (SELECT o_orderkey AS run_id, sha256(CASE WHEN o_totalprice > 200000 THEN '1-URGENT' ELSE o_orderpriority END) AS p FROM orders WHERE o_orderstatus <> 'P'),
b AS (SELECT o_orderkey AS run_id, sha256(o_orderpriority) AS p FROM orders WHERE o_orderstatus <> 'O'),
cmp AS (SELECT coalesce(a.run_id, b.run_id) AS run_id, CASE WHEN a.run_id IS NULL THEN 'missing' WHEN b.run_id IS NULL THEN 'extra'
  WHEN a.p IS DISTINCT FROM b.p THEN 'payload_changed' ELSE 'identical' END AS class FROM a FULL JOIN b ON a.run_id = b.run_id)"""


def compared(spark, d):
    """Two snapshots of the orders: without pending ones and with raised priorities, and without open ones."""
    o = table(spark, d, "orders").withColumn("run_id", F.col("o_orderkey"))
    raised = F.when(F.col("o_totalprice") > 200000, "1-URGENT").otherwise(F.col("o_orderpriority"))
    new = o.where("o_orderstatus <> 'P'").select("run_id", F.sha2(raised, 256).alias("p"))
    old = o.where("o_orderstatus <> 'O'").select("run_id", F.sha2("o_orderpriority", 256).alias("p"))
    return audits.compare_runs(new, old, "run_id", "p")


@query(f"WITH {COMPARED} SELECT class, count(*) AS n FROM cmp GROUP BY class")
def run_comparison(spark, d):
    return audits.comparison_counts(compared(spark, d))


@query(f"""WITH {COMPARED} SELECT class, run_id, n FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY run_id) AS n FROM cmp WHERE class <> 'identical') WHERE n <= 10""")
def run_comparison_examples(spark, d):
    return audits.comparison_examples(compared(spark, d), "run_id").select("class", "run_id", "n")


@query("""
WITH e AS (SELECT DISTINCT l_suppkey AS k, l_linenumber AS m FROM lineitem WHERE l_returnflag = 'A'),
a AS (SELECT l_suppkey AS k, l_linenumber AS m FROM lineitem WHERE l_returnflag = 'R'),
u AS (SELECT k, m, max(x) AS e, count(*) FILTER (x = 0) AS a FROM (SELECT k, m, 1 AS x FROM e UNION ALL SELECT k, m, 0 FROM a) GROUP BY ALL)
SELECT k, count(*) FILTER (a = 0) AS missing, count(*) FILTER (e = 0) AS extra, count(*) FILTER (a > 1 AND e = 1) AS repeated,
  count(*) FILTER (a = 0 OR e = 0 OR a > 1) = 0 AS same FROM u GROUP BY k""")
def set_equality(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("m"), "l_returnflag")
    expected = li.where("l_returnflag = 'A'").select("k", "m").distinct()
    actual = li.where("l_returnflag = 'R'").select("k", "m")
    return audits.same_members(expected, actual, ["k"], "m").select("k", "missing", "extra", "repeated", "same")


@query("""
SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus) > 1""")
def shared_groups(spark, d):
    return audits.shared_groups(table(spark, d, "lineitem"), "l_orderkey", "l_linestatus")


@query("""
SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def key_set_difference(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    ordered = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.without_leaks(c, ordered, ["c_custkey"])


@query(f"""
WITH {ORDER_CASES}, per AS (SELECT catalog_id, run_id, count(*) n, count(*) FILTER (gold_label NOT IN ('A', 'N')) bad FROM cases GROUP BY ALL)
SELECT catalog_id, sum(n)::BIGINT AS rows, count(*) FILTER (n > 1) AS repeated_ids, sum(bad)::BIGINT AS gold_outside_options,
  (sum(n) + CASE WHEN catalog_id = 2 THEN 1 ELSE 0 END)::BIGINT AS pinned_rows, catalog_id <> 2 AS as_pinned FROM per GROUP BY catalog_id""")
def write_expectations(spark, d):
    rows = order_cases(spark, d)
    pins = rows.groupBy("catalog_id").agg((F.count(F.lit(1)) + F.when(F.col("catalog_id") == 2, 1).otherwise(0)).alias("rows"))
    return audits.expectations(rows, "run_id", ["catalog_id"], F.col("gold_label").isin("A", "N"), pins)


@query(f"""
WITH {ORDER_CASES}, per AS (SELECT catalog_id, group_id, count(*) r, sum(n_options) f, sum(n_accepted) t FROM cases GROUP BY ALL)
SELECT catalog_id, count(*) AS cases, sum(r)::BIGINT AS requests, sum(f)::BIGINT AS fields, sum(t)::BIGINT AS proxy_tokens,
  round(sum(t) * 0.08 / 1e6, 9) AS estimated_usd FROM per GROUP BY ROLLUP (catalog_id)""")
def suite_manifest(spark, d):
    out = audits.manifest(order_cases(spark, d), "catalog_id", "group_id", "n_options", "n_accepted", 0.08)
    return out.withColumn("estimated_usd", F.round("estimated_usd", 9))


@query("""
SELECT DISTINCT event_id, last_value(event_id) OVER w AS latest_event, last_value(event_type) OVER w AS event_type FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) QUALIFY event_id = latest_event""")
def latest_result(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("seq"))
    out = results.latest(e, ["user_id"])
    return out.select("event_id", F.col("event_id").alias("latest_event"), "event_type")


@query("""
WITH e AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN value END AS pred, ts FROM events)
SELECT user_id, event_id, pred FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pred IS NOT NULL DESC, ts DESC, event_id DESC) rn FROM e) WHERE rn = 1""")
def latest_prediction(spark, d):
    e = table(spark, d, "events").select(
        "user_id", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("pred"), F.struct("ts", "event_id").alias("seq")
    )
    return results.latest_prediction(e, ["user_id"]).select("user_id", "event_id", "pred")


@query(f"""
WITH {ORDER_CASES}, one AS (SELECT run_id, max(status) AS status FROM cases GROUP BY run_id)
SELECT run_id FROM one WHERE status IN ('pending', 'error')""")
def resume_todo(spark, d):
    one = order_cases(spark, d).groupBy("run_id").agg(F.max("status").alias("status"))
    log = one.where("status <> 'pending'")
    return results.todo(one.select("run_id"), log)


@query("""
WITH l AS (SELECT doc_id, n_chars % 6 AS a, length(source || lang) % 5 AS b FROM documents)
SELECT doc_id, CASE WHEN a < 4 THEN chr((65 + a)::INT) END AS short, CASE WHEN b < 4 THEN chr((65 + b)::INT) END AS long FROM l""")
def reply_letters(spark, d):
    """Replies built from the documents: a short one that leads with a letter, a long one that states two."""
    a, b = F.char(65 + F.col("n_chars") % 6), F.char(65 + F.length(F.concat("source", "lang")) % 5)
    short = F.concat(F.lit("("), a, F.lit(") "), F.col("source"))
    long = F.concat(F.lit("Option "), a, F.lit(" is close for "), F.col("lang"), F.lit(". Final answer is: ("), F.lower(b), F.lit(")"))
    return table(spark, d, "documents").select("doc_id", text.short_letter(short, 4).alias("short"), text.long_letter(long, 4).alias("long"))


@query("""
SELECT event_id, CASE event_type WHEN 'click' THEN 'abstained' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'unsupported' ELSE 'error' END
  WHEN 'view' THEN CASE WHEN event_id % 5 = 0 THEN 'error' ELSE 'ok' END ELSE 'ok' END AS status FROM events""")
def outcome_status(spark, d):
    k, kind = F.col("event_id"), F.col("event_type")
    message = F.when(
        kind == "error", F.when(k % 2 == 0, F.concat(F.lit("http 400: maximum context length "), k.cast("string"))).otherwise("boom")
    )
    status = inference.outcome_status(kind == "click", message, (kind == "view") & (k % 5 == 0))
    return table(spark, d, "events").select("event_id", status.alias("status"))


@query("""
SELECT p_partkey, 'Pick for ' || p_name || chr(10) || 'A: ' || p_brand || chr(10) || 'B: ' || p_type || chr(10) || 'C: ' || p_size::VARCHAR AS prompt FROM part""")
def prompt_text(spark, d):
    keys = F.array(*[F.lit(x) for x in "ABC"])
    texts = F.array("p_brand", "p_type", F.col("p_size").cast("string"))
    return table(spark, d, "part").select(
        "p_partkey", facts.prompt(F.concat(F.lit("Pick for "), F.col("p_name")), keys, texts).alias("prompt")
    )


@query("""
WITH r AS (SELECT *, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'Z' ELSE l_returnflag END AS choice FROM lineitem)
SELECT l_linenumber, CASE WHEN choice = 'Z' THEN 'invalid chosen answer' WHEN l_quantity > 45 THEN 'incomplete or invalid probability distribution'
  WHEN l_quantity < 3 THEN 'incomplete or invalid probability distribution' END AS reason, count(*) AS n FROM r GROUP BY ALL""")
def answer_validation(spark, d):
    q = F.col("l_quantity")
    choice = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "Z").otherwise(F.col("l_returnflag"))
    keys = F.when(q < 3, F.array(F.lit("A"), F.lit("N"))).otherwise(F.array(F.lit("A"), F.lit("N"), F.lit("R")))
    each = F.when(q > 45, F.lit(0.5)).otherwise(1.0 / F.size(keys))
    rows = table(spark, d, "lineitem").select(
        "l_linenumber", choice.alias("choice"), F.map_from_arrays(keys, F.array_repeat(each, F.size(keys))).alias("p")
    )
    options = F.array(F.lit("R"), F.lit("A"), F.lit("N"))
    reason = scoring.invalid_reason(F.lit("choice"), options, F.col("choice"), F.col("p"), F.lit(None).cast("double"))
    return rows.withColumn("reason", reason).groupBy("l_linenumber", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'one choice question per request' WHEN o_orderkey % 4 = 1 THEN 'choice questions only'
  WHEN o_orderkey % 4 = 2 THEN 'option keys must be the letters A, B, C, ...' END AS reason FROM orders""")
def predictor_precondition(spark, d):
    def question(kind, keys):
        criteria = F.array(*[F.struct(F.lit(k).alias("option"), F.lit(k).alias("descr")) for k in keys])
        return F.struct(F.lit("q").alias("key"), F.lit(kind).alias("type"), F.lit("").alias("instructions"), criteria.alias("criteria"))

    good, odd, noul = question("choice", "ABC"), question("choice", "ACB"), question("noul", "ABC")
    k = F.col("o_orderkey") % 4
    asked = F.when(k == 0, F.array(good, good)).when(k == 1, F.array(noul)).when(k == 2, F.array(odd)).otherwise(F.array(good))
    return table(spark, d, "orders").select("o_orderkey", inference.unsupported_reason(asked).alias("reason"))


@query("""
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN floor(p_retailprice) * 1000 WHEN 1 THEN p_retailprice WHEN 3 THEN p_size + 0.5 END::DOUBLE AS amount,
  CASE WHEN p_size % 5 = 4 THEN 'text' ELSE 'number' END AS kind FROM part""")
def receipt_amounts(spark, d):
    """Part prices written the ways receipts write them, and read back."""
    price, whole = F.col("p_retailprice"), F.floor("p_retailprice")
    way = F.col("p_size") % 5
    written = (
        F.when(way == 0, F.concat(F.lit("Rp "), F.replace(F.format_number(whole * 1000, 0), F.lit(","), F.lit("."))))
        .when(way == 1, F.concat(text.amount_label(price, F.lit(True)), F.lit(" SR")))
        .when(way == 2, F.concat(F.lit("-"), whole.cast("string")))
        .when(way == 3, F.concat(F.col("p_size").cast("string"), F.lit(",50")))
        .otherwise(F.col("p_type"))
    )
    return table(spark, d, "part").select("p_partkey", text.amount(written).alias("amount"), text.text_kind(written).alias("kind"))


@query(r"""
SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))::BIGINT AS n_words, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')))::BIGINT AS n_distinct,
  regexp_replace(lower(source || ' ' || lang), '[^a-z0-9]+', '-', 'g') AS slug, ('0x' || substr(sha256(text), 1, 8))::BIGINT % 5 AS bucket FROM documents""")
def text_functions(spark, d):
    w = text.words(F.col("text"))
    return table(spark, d, "documents").select(
        "doc_id", F.size(w).cast("bigint").alias("n_words"), F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"),
        text.slug(F.concat_ws(" ", "source", "lang")).alias("slug"), hashing.hash_mod(hashing.sha(F.col("text")), 5).alias("bucket"),
    )


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 10 AS r, l_tax * 10 AS g, l_quantity / 50 AS b FROM lineitem)
SELECT '#' || lpad(lower(hex(round_even(r * 255, 0)::BIGINT)), 2, '0') || lpad(lower(hex(round_even(g * 255, 0)::BIGINT)), 2, '0')
  || lpad(lower(hex(round_even(b * 255, 0)::BIGINT)), 2, '0') AS color, count(*) AS n FROM c GROUP BY ALL""")
def palette_colors(spark, d):
    c = text.rgb_hex(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50)
    return table(spark, d, "lineitem").select(c.alias("color")).groupBy("color").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH r AS (SELECT doc_id, CASE lang WHEN 'en' THEN 30 WHEN 'fr' THEN 48 ELSE 5 END AS catalog_id, CASE WHEN doc_id % 3 = 0 THEN 'v0.3-gsm8k:' ELSE 'v0.2:' END || doc_id::VARCHAR AS run_id FROM documents),
e AS (SELECT unnest(['0.1', '0.2', '0.2.1', '0.3']) AS edition)
SELECT edition, catalog_id, count(*) AS n, sum(doc_id)::BIGINT AS docs FROM r, e
WHERE edition <> '0.3' OR (catalog_id <> 48 AND (catalog_id <> 30 OR starts_with(run_id, 'v0.3-gsm8k:'))) GROUP BY ALL""")
def rows_by_edition(spark, d):
    """Documents as rows of three benchmarks, through the published tables of retired and replaced ones."""
    number = F.when(F.col("lang") == "en", 30).when(F.col("lang") == "fr", 48).otherwise(5)
    prefix = F.when(F.col("doc_id") % 3 == 0, "v0.3-gsm8k:").otherwise("v0.2:")
    rows = table(spark, d, "documents").select("doc_id", number.alias("catalog_id"), F.concat(prefix, F.col("doc_id").cast("string")).alias("run_id"))
    none = rows.select("catalog_id", "run_id").limit(0)
    out = None
    for edition in spec.EDITION_ROWS:
        kept = editions.in_edition(rows, *spec.edition_tables(spark, edition), none)
        counted = kept.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("docs")).withColumn("edition", F.lit(edition))
        out = counted if out is None else out.unionByName(counted)
    return out.select("edition", "catalog_id", "n", "docs")
