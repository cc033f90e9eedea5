"""Samples, quotas, balance, pairs, histories and answer options."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import hashing
from casewright.operators import distractors, intervals, ordering, sampling
from casewright.plans.registry import query, table

SEED = 11

# One group per (source, documents of a customer-like bucket): derived from documents.
GROUPS = f"""
g AS (SELECT lang, source, doc_id // 3 AS group_id, count(*) AS size FROM documents GROUP BY ALL),
gh AS (SELECT *, sha256('{SEED}:' || lang || ':' || source || ':' || group_id::VARCHAR) AS h FROM g)"""


def doc_groups(spark, d):
    docs = table(spark, d, "documents").withColumn("group_id", F.floor(F.col("doc_id") / 3))
    return sampling.groups_of(docs, ["lang", "source"], "group_id", SEED)


ORDER_GROUPS = f"""
og AS (SELECT o_orderpriority AS catalog, l_orderkey AS group_id, count(*) AS size
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
oh AS (SELECT *, sha256('{SEED}:' || catalog || ':' || group_id::VARCHAR) AS h FROM og)"""


def order_groups(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group_id"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("group_id"), F.col("o_orderpriority").alias("catalog"))
    return sampling.groups_of(li.join(o, "group_id"), ["catalog"], "group_id", SEED)


@query(f"""
WITH {ORDER_GROUPS}
SELECT catalog, group_id, size FROM (SELECT *, row_number() OVER (PARTITION BY catalog ORDER BY h) rn FROM oh) WHERE rn <= 500""")
def hash_order_sample(spark, d):
    return sampling.cap_groups(order_groups(spark, d), ["catalog"], 500).select("catalog", "group_id", "size")


QUOTA = """
st AS (SELECT lang, source, count(*) AS n FROM gh GROUP BY ALL),
sh AS (SELECT *, 60.0::DOUBLE * n / sum(n) OVER (PARTITION BY lang) AS share FROM st),
ba AS (SELECT *, floor(share) AS base, 60 - sum(floor(share)) OVER (PARTITION BY lang) AS room FROM sh),
qu AS (SELECT lang, source, base + CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY base - share, source) <= room THEN 1 ELSE 0 END AS quota FROM ba)"""


@query(f"""
WITH {GROUPS}, {QUOTA}
SELECT lang, source, quota::BIGINT AS quota FROM qu""")
def stratum_quotas(spark, d):
    return sampling.quotas(doc_groups(spark, d), ["lang"], "source", 60)


@query(f"""
WITH {GROUPS}, {QUOTA}
SELECT lang, source, group_id FROM (SELECT gh.*, quota, row_number() OVER (PARTITION BY lang, source ORDER BY h) rn FROM gh JOIN qu USING (lang, source))
WHERE rn <= quota""")
def stratified_quota_sample(spark, d):
    return sampling.quota_sample(doc_groups(spark, d), ["lang"], "source", 60).select("lang", "source", "group_id")


@query(f"""
WITH {GROUPS}, {QUOTA.replace("60", "7")}
SELECT lang, source, group_id FROM (SELECT gh.*, quota, row_number() OVER (PARTITION BY lang, source ORDER BY h) rn FROM gh JOIN qu USING (lang, source))
WHERE rn <= greatest(1, quota)""")
def stratified_at_least_one(spark, d):
    out = sampling.quota_sample(doc_groups(spark, d), ["lang"], "source", 7, at_least_one=True)
    return out.select("lang", "source", "group_id")


@query(f"""
WITH RECURSIVE {GROUPS}, o AS (SELECT lang, source, group_id, size, row_number() OVER (PARTITION BY lang ORDER BY h) rn FROM gh),
w AS (SELECT lang, source, group_id, size, rn, size <= 150 AS took, CASE WHEN size <= 150 THEN size ELSE 0 END AS used FROM o WHERE rn = 1
  UNION ALL SELECT o.lang, o.source, o.group_id, o.size, o.rn, w.used + o.size <= 150, CASE WHEN w.used + o.size <= 150 THEN w.used + o.size ELSE w.used END
  FROM w JOIN o ON o.lang = w.lang AND o.rn = w.rn + 1)
SELECT lang, source, group_id, size FROM w WHERE took""")
def budgeted_groups(spark, d):
    return sampling.budget_sample(doc_groups(spark, d), ["lang"], 150).select("lang", "source", "group_id", "size")


@query(f"""
WITH {ORDER_GROUPS}, r AS (SELECT *, row_number() OVER (PARTITION BY catalog ORDER BY h) rn FROM oh),
c AS (SELECT *, coalesce(sum(size) OVER (ORDER BY rn, catalog ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT catalog, group_id, size, rn AS rank FROM c WHERE before < 2000""")
def round_robin_sample(spark, d):
    return sampling.round_robin(order_groups(spark, d), "catalog", 2000).select("catalog", "group_id", "size", "rank")


@query("""
WITH r AS (SELECT p_partkey, 2 + p_size % 4 AS n_options, row_number() OVER (PARTITION BY p_size % 4 ORDER BY sha256('letters:' || p_partkey::VARCHAR)) rn FROM part)
SELECT p_partkey, n_options, ((rn - 1) % n_options)::BIGINT AS position FROM r""")
def gold_positions(spark, d):
    parts = table(spark, d, "part").select("p_partkey", (2 + F.col("p_size") % 4).alias("n_options"))
    return ordering.gold_positions(parts, "p_partkey", "n_options", "letters")


@query("""
SELECT l_partkey, l_orderkey, l_suppkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY sha256(l_orderkey::VARCHAR || ':' || l_suppkey::VARCHAR || ':' || l_linenumber::VARCHAR)) rn FROM (
    SELECT DISTINCT l_partkey, l_orderkey, l_suppkey, l_linenumber FROM lineitem)) WHERE rn = 1""")
def first_per_parent(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_suppkey", "l_linenumber")
    hashed = rows.withColumn("h", hashing.sha(F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_linenumber")))
    return sampling.first_per_parent(hashed, ["l_partkey"], "h").drop("h")


@query("""
WITH j AS (SELECT doc_id, lang, toxic, quality FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, toxic, count(*) n FROM j WHERE quality = 1 GROUP BY ALL),
q AS (SELECT lang, min(n) AS m FROM c GROUP BY lang HAVING count(*) >= 2),
r AS (SELECT j.*, row_number() OVER (PARTITION BY lang, toxic ORDER BY sha256(doc_id::VARCHAR)) rn FROM j WHERE quality = 1)
SELECT doc_id, lang, toxic, quality FROM r JOIN q USING (lang) WHERE rn <= m
UNION ALL SELECT doc_id, lang, toxic, quality FROM j WHERE quality <> 1""")
def class_balance(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    rows = j.select("doc_id", "lang", "toxic", "quality")
    return sampling.balanced(rows, ["lang"], "toxic", "doc_id", F.col("quality") == 1)


PAIRS = """
pe AS (SELECT event_id, user_id, round(value)::BIGINT % 5 + 1 AS rating, event_type AS look,
  sha256(user_id::VARCHAR || ':' || event_id::VARCHAR) AS h, ts >= TIMESTAMP '2024-01-16' AS test FROM events),
pt AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h) - 1 AS k FROM pe WHERE test),
pp AS (SELECT user_id, k // 2 AS pair, max(event_id) FILTER (k % 2 = 0) AS ia, max(event_id) FILTER (k % 2 = 1) AS ib,
  max(rating) FILTER (k % 2 = 0) AS va, max(rating) FILTER (k % 2 = 1) AS vb, max(look) FILTER (k % 2 = 0) AS la, max(look) FILTER (k % 2 = 1) AS lb
  FROM pt GROUP BY ALL),
pk AS (SELECT *, ('0x' || right(sha256('pair:' || user_id::VARCHAR || ':' || ia::VARCHAR || ':' || ib::VARCHAR), 1))::INT % 2 = 1 AS flip
  FROM pp WHERE ib IS NOT NULL AND abs(va - vb) >= 2 AND la <> lb),
pairs AS (SELECT user_id, pair, CASE WHEN flip THEN ib ELSE ia END AS left_item, CASE WHEN flip THEN ia ELSE ib END AS right_item,
  la AS look_a, lb AS look_b, CASE WHEN CASE WHEN flip THEN vb > va ELSE va > vb END THEN 'A' ELSE 'B' END AS expected, abs(va - vb) AS gap FROM pk)"""


def rated(spark, d):
    return table(spark, d, "events").select(
        "event_id", "user_id", (F.round("value").cast("bigint") % 5 + 1).alias("rating"), F.col("event_type").alias("look"),
        hashing.sha(F.col("user_id"), F.col("event_id")).alias("h"),
        (F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")).alias("test"),
    )


def preference_targets(spark, d):
    targets = rated(spark, d).where("test")
    return sampling.pairs(targets, "user_id", "event_id", "rating", "look")


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def preference_pairs(spark, d):
    return preference_targets(spark, d)


@query(f"""
WITH {PAIRS}, hi AS (SELECT user_id, pair, e.event_id, e.h, row_number() OVER (PARTITION BY user_id, pair ORDER BY e.h) rn
  FROM pairs JOIN pe e USING (user_id) WHERE NOT e.test AND e.look <> look_a AND e.look <> look_b)
SELECT user_id, pair, string_agg(event_id::VARCHAR, ',' ORDER BY h) AS history FROM hi WHERE rn <= 8 GROUP BY user_id, pair HAVING count(*) >= 4""")
def leak_free_history(spark, d):
    history = rated(spark, d).where("not test")
    out = sampling.leak_free_history(preference_targets(spark, d), history, "user_id", "event_id", "look")
    return out.select("user_id", "pair", F.array_join("history", ",").alias("history"))


@query("""
SELECT user_id, event_type, max(c) AS max_run FROM (SELECT user_id, event_type, floor(value) AS v, count(*) AS c FROM events GROUP BY ALL) GROUP BY ALL""")
def longest_value_runs(spark, d):
    rows = table(spark, d, "events").withColumn("v", F.floor("value"))
    return ordering.longest_runs(rows, ["user_id", "event_type"], "v")


@query("""
WITH t AS (SELECT conv_id, turn, role, '[' || role || '] ' || text AS item FROM conversations)
SELECT a.conv_id, a.turn, string_agg(b.item, chr(10) ORDER BY b.turn) AS history
FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn <= a.turn WHERE a.role = 'user' GROUP BY a.conv_id, a.turn""")
def running_history(spark, d):
    turns = table(spark, d, "conversations")
    item = F.concat(F.lit("["), F.col("role"), F.lit("] "), F.col("text"))
    out = ordering.history(turns, "conv_id", "turn", item, at=F.col("role") == "user")
    return out.select("conv_id", "turn", F.array_join("history", "\n").alias("history"))


@query("""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations)
SELECT a.conv_id, a.turn, count(b.turn) AS n_before, coalesce(string_agg(b.text, chr(10) ORDER BY b.turn), '') AS history
FROM t a LEFT JOIN t b ON a.conv_id = b.conv_id AND b.turn < a.turn GROUP BY a.conv_id, a.turn""")
def prefix_history(spark, d):
    out = ordering.history(table(spark, d, "conversations"), "conv_id", "turn", F.col("text"), include_current=False)
    return out.select(
        "conv_id", "turn", F.size("history").cast("bigint").alias("n_before"), F.array_join("history", "\n").alias("history")
    )


@query("""
SELECT l_orderkey, line, CASE WHEN rn = 1 THEN l_orderkey::VARCHAR ELSE l_orderkey::VARCHAR || '#' || (rn - 1)::VARCHAR END AS unique_id
FROM (SELECT l_orderkey, sha256(l_partkey::VARCHAR || ':' || l_suppkey::VARCHAR || ':' || l_linenumber::VARCHAR) AS line,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY sha256(l_partkey::VARCHAR || ':' || l_suppkey::VARCHAR || ':' || l_linenumber::VARCHAR)) AS rn FROM lineitem)""")
def occurrence_ids(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("oid"), hashing.sha(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")).alias("line")
    )
    out = ordering.occurrence_ids(rows, "oid", "line")
    return out.select(F.col("oid").cast("bigint").alias("l_orderkey"), "line", "unique_id")


# Bands are walked by the recursive part; a band is too narrow (an) when a value fills more than m of its places.
ANSWER_GROUPS = """
at0 AS (SELECT l_suppkey * 10 + l_linenumber AS id, floor(sum(l_quantity))::BIGINT AS v FROM lineitem GROUP BY ALL),
ah AS (SELECT *, sha256('deal:order:' || id::VARCHAR) AS tie FROM at0),
ao AS (SELECT *, row_number() OVER (ORDER BY v, tie) - 1 AS p FROM ah),
az AS (SELECT count(*) AS n, ('0x' || substr(sha256('deal:leftover'), 1, 8))::BIGINT % count(*) AS st FROM ao),
ay AS (SELECT v, min(p) AS a, max(p) AS z FROM ao GROUP BY v),
aw AS (SELECT CASE WHEN a <= st AND z >= st THEN st WHEN a > st THEN a ELSE z END AS p,
  row_number() OVER (ORDER BY z < st, CASE WHEN z < st THEN -v ELSE v END) AS d FROM ay, az),
ax AS (SELECT ao.* FROM ao JOIN aw USING (p), az WHERE d <= n % 4),
ar AS (SELECT id, v, row_number() OVER (ORDER BY v, tie) - 1 AS p FROM ah WHERE id NOT IN (SELECT id FROM ax)),
au AS (SELECT v, min(p) AS a, count(*) AS c FROM ar GROUP BY v),
ac AS (SELECT count(*) // 4 AS total FROM ar),
ae AS (SELECT q, m FROM (SELECT unnest(range(total)) AS q FROM ac), (SELECT unnest(range(1, (SELECT max(c) FROM au) + 1)) AS m), ac WHERE q + m <= total),
an AS (SELECT DISTINCT q, m FROM ae JOIN au ON c > 1 AND a < 4 * (q + m) AND a + c > 4 * q AND least(a + c, 4 * (q + m)) - greatest(a, 4 * q) > m),
aq AS (SELECT q, min(m) AS m FROM ae ANTI JOIN an USING (q, m) GROUP BY q),
ak AS (SELECT 0::BIGINT AS q UNION ALL SELECT (ak.q + m)::BIGINT FROM ak JOIN aq ON aq.q = ak.q, ac WHERE ak.q + m < total),
al AS (SELECT max(ak.q) AS q FROM ak, ac WHERE EXISTS (SELECT 1 FROM ak b LEFT JOIN aq ON aq.q = b.q WHERE aq.m IS NULL)
  AND ak.q < (SELECT max(q) FROM ak)
  AND total - ak.q >= (SELECT max(a + c - greatest(a, 4 * ak.q)) FROM au WHERE a + c > 4 * ak.q)),
ab AS (SELECT ak.q, CASE WHEN ak.q = al.q THEN total - ak.q ELSE m END AS m FROM ak LEFT JOIN aq ON aq.q = ak.q, al, ac WHERE al.q IS NULL OR ak.q <= al.q),
ag AS (SELECT id, v, (q + (p - 4 * q) % m)::BIGINT AS answer_group FROM ar JOIN ab ON p >= 4 * q AND p < 4 * (q + m)
  UNION ALL SELECT id, v, -1 FROM ax)"""


def valued(spark, d):
    """One item per supplier and line number; the gold is the quantity sold."""
    li = table(spark, d, "lineitem")
    return li.groupBy((F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.floor(F.sum("l_quantity")).alias("v"))


@query(f"WITH RECURSIVE {ANSWER_GROUPS} SELECT * FROM ag")
def answer_groups(spark, d):
    return distractors.answer_groups(valued(spark, d), "id", "v", 4, "deal")


@query(f"""
WITH RECURSIVE {ANSWER_GROUPS}, ring AS (SELECT answer_group, list(v ORDER BY v) AS r FROM ag WHERE answer_group >= 0 GROUP BY answer_group
  UNION ALL SELECT -1, list(v ORDER BY v) FROM (
    SELECT v FROM ax UNION ALL (SELECT v FROM (SELECT DISTINCT v, (SELECT max(v) FROM ax) AS hi, (SELECT min(v) FROM ax) AS lo FROM ag)
      WHERE v > hi OR v < lo ORDER BY v < lo, CASE WHEN v > hi THEN v ELSE -v END LIMIT 4 - (SELECT count(*) FROM ax))) HAVING count(*) > 0),
rs AS (SELECT *, (('0x' || substr(sha256('deal:shift:' || answer_group::VARCHAR), 1, 8))::BIGINT % 3)::INT AS shift FROM ring)
SELECT id, v, answer_group, array_to_string(list_transform(range(3),
  lambda t: r[(((list_position(r, v) - 1 - shift + t) % len(r)) + len(r)) % len(r) + 1]), ',') AS options FROM ag JOIN rs USING (answer_group)""")
def ring_options(spark, d):
    from casewright.session import cut_lineage

    groups = cut_lineage(answer_groups(spark, d))
    out = distractors.ring_options(groups, "id", "v", 4, 3, "deal")
    return out.withColumn("options", F.array_join(F.transform("options", lambda x: x.cast("string")), ","))


@query("""
WITH s AS (SELECT p_partkey, unnest([p_name, p_brand, p_type, p_size::VARCHAR]) AS o FROM part),
u AS (SELECT DISTINCT p_partkey, o FROM s)
SELECT p_partkey, string_agg(o, '|' ORDER BY sha256('opts:' || p_partkey::VARCHAR || ':' || o)) AS options FROM u GROUP BY p_partkey""")
def hash_shuffled_options(spark, d):
    parts = table(spark, d, "part").select(
        "p_partkey", F.array_distinct(F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string"))).alias("o")
    )
    out = ordering.hash_shuffled(parts, "o", "opts", "p_partkey", "options")
    return out.select("p_partkey", F.array_join("options", "|").alias("options"))


@query("""
SELECT p_brand, p_partkey, ((row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1) // 64)::BIGINT AS chunk FROM part""")
def inventory_chunks(spark, d):
    parts = table(spark, d, "part").select("p_brand", "p_retailprice", "p_partkey")
    return ordering.chunks(parts, ["p_brand"], ["p_retailprice", "p_partkey"], 64).select("p_brand", "p_partkey", "chunk")


@query("""
WITH pe AS (SELECT event_id AS id, user_id, event_type IN ('click', 'view', 'error') AS starts, ts FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS rn FROM pe),
s AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY rn) AS s FROM o),
m AS (SELECT *, min(s) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, starts ORDER BY rn) AS pair FROM m WHERE starts OR s >= least(0, coalesce(low, 0)))
SELECT a.user_id, a.pair, a.id AS start_at, b.id AS stop_at FROM k a JOIN k b ON a.user_id = b.user_id AND a.pair = b.pair AND a.starts AND NOT b.starts""")
def fifo_pairs(spark, d):
    e = table(spark, d, "events").select(
        "event_id", "user_id", "ts", F.col("event_type").isin("click", "view", "error").alias("starts")
    )
    return intervals.paired_notes(e, ["user_id"], ["ts", "event_id"], "starts", "event_id")


@query("""
WITH e AS (SELECT event_id, user_id, value, epoch_us(ts) AS at FROM events)
SELECT a.event_id, count(*) AS near_rows, round(sum(b.value), 4) AS near_sum
FROM e a JOIN e b ON a.user_id = b.user_id AND b.at BETWEEN a.at - 7200000000 AND a.at + 7200000000 GROUP BY a.event_id""")
def context_overlap(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    out = intervals.overlap_stats(e, "user_id", "at", 7_200_000_000, "value", 86_400_000_000)
    return out.select("event_id", "near_rows", F.round("near_sum", 4).alias("near_sum"))


NOTES = """
notes AS (SELECT l_suppkey AS song, l_linenumber AS line, l_partkey % 128 AS pitch, l_orderkey % 400 AS s, l_orderkey % 400 + l_quantity::BIGINT AS e FROM lineitem)"""


def notes(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("song"), (F.col("l_partkey") % 128).alias("pitch"), (F.col("l_orderkey") % 400).alias("s"),
        (F.col("l_orderkey") % 400 + F.col("l_quantity").cast("bigint")).alias("e"),
    )


@query(f"""
WITH {NOTES}, top AS (SELECT song, (max(e) - 2) // 4 AS k FROM notes GROUP BY song),
grid AS (SELECT song, 2 + 4 * unnest(range(k + 1)) AS beat FROM top)
SELECT g.song, g.beat, coalesce(string_agg(DISTINCT (pitch % 12)::VARCHAR, ',' ORDER BY (pitch % 12)::VARCHAR), '') AS pitches
FROM grid g LEFT JOIN notes n ON n.song = g.song AND n.s <= g.beat AND g.beat < n.e GROUP BY g.song, g.beat""")
def sounding_pitches(spark, d):
    out = intervals.sounding(notes(spark, d), "song", "s", "e", 2, 4, (F.col("pitch") % 12).cast("string"), "pitches")
    return out.select("song", "beat", F.array_join("pitches", ",").alias("pitches"))


@query(f"""
WITH {NOTES}, points AS (SELECT song, 4 + 8 * unnest(range(max(e) // 8 + 1)) AS t FROM notes GROUP BY song)
SELECT p.song, p.t, count(*) AS context_notes, sum(pitch)::BIGINT AS pitch_sum FROM points p JOIN notes n ON n.song = p.song AND n.s < p.t + 4 AND n.e > p.t - 4
GROUP BY p.song, p.t""")
def context_notes(spark, d):
    """Notes around a point every eight beats of a song, so that each note is near one."""
    n = notes(spark, d)
    last = n.groupBy("song").agg(F.floor(F.max("e") / 8).alias("last"))
    points = last.select("song", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("last")), lambda k: 4 + 8 * k)).alias("t"))
    met = intervals.context(points, n, "song", "t", "s", "e", 4, 16)
    return met.groupBy("song", "t").agg(F.count(F.lit(1)).alias("context_notes"), F.sum("pitch").alias("pitch_sum"))


@query("""
WITH q AS (SELECT p_partkey % 50 AS form, p_partkey AS id, p_size * 10.0 AS x0, (p_partkey * 7) % 300 AS y0 FROM part WHERE p_type < 'M'),
qq AS (SELECT *, x0 + 40 AS x1, y0 + 10 AS y1 FROM q),
a AS (SELECT p_partkey % 50 AS form, p_partkey AS id, p_size * 10.0 + 60 AS x0, (p_partkey * 11) % 300 AS y0 FROM part WHERE p_type >= 'M'),
aa AS (SELECT form, x0, y0, y0 + 10 AS y1 FROM a)
SELECT form, id FROM qq WHERE NOT EXISTS (SELECT 1 FROM aa WHERE aa.form = qq.form AND (
  (abs((aa.y0 + aa.y1) / 2.0 - (qq.y0 + qq.y1) / 2.0) < 12 AND aa.x0 - qq.x1 >= 0 AND aa.x0 - qq.x1 < 250)
  OR (aa.y0 - qq.y1 >= 0 AND aa.y0 - qq.y1 < 25 AND abs(aa.x0 - qq.x0) < 60)))""")
def blank_fields(spark, d):
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    q = p.where("p_type < 'M'").select((key % 50).alias("form"), key.alias("id"), (F.col("p_size") * 10.0).alias("x0"), ((key * 7) % 300).alias("y0"))
    a = p.where("p_type >= 'M'").select(
        (key % 50).alias("form"), (F.col("p_size") * 10.0 + 60).alias("x0"), ((key * 11) % 300).alias("y0")
    )
    def boxed(df):
        return df.withColumns({"x1": F.col("x0") + 40, "y1": F.col("y0") + 10})

    return intervals.without_near_answer(boxed(q), boxed(a)).select("form", "id")


@query("""
WITH it AS (SELECT o_custkey AS parent, o_orderkey AS id, lower(trim(o_orderstatus || ' ' || (floor(o_totalprice)::BIGINT % 97)::VARCHAR)) AS gold FROM orders),
n AS (SELECT *, regexp_replace(gold, '[^a-z0-9%.]', '', 'g') AS nm FROM it),
pool AS (SELECT parent, nm, min(gold) AS peer, sha256('peer:' || parent::VARCHAR || ':' || nm) AS h FROM n WHERE nm <> '' GROUP BY ALL),
ok AS (SELECT n.parent, n.id, n.gold, peer, h, row_number() OVER (PARTITION BY n.id ORDER BY h) rn FROM n JOIN pool p ON p.parent = n.parent
  AND NOT contains(n.nm, p.nm) AND NOT contains(p.nm, n.nm))
SELECT parent, id, gold, string_agg(peer, '|' ORDER BY h) AS distractors FROM ok WHERE rn <= 3 GROUP BY parent, id, gold HAVING count(*) = 3""")
def peer_distractors(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("id"),
        F.concat(F.col("o_orderstatus"), F.lit(" "), (F.floor("o_totalprice") % 97).cast("string")).alias("answer"),
    )
    out = distractors.peer_pools(o, "parent", "id", "answer")
    return out.select("parent", "id", "gold", F.array_join("distractors", "|").alias("distractors"))


@query("""
WITH g AS (SELECT p_partkey, p_size::DECIMAL(38,9) AS v FROM part),
w AS (SELECT p_partkey, v, unnest([v - 10, v - 5, v - 2, v - 1, v + 1, v + 2, v + 5, v + 10, v * 2, v * 10, floor(v / 2)]) AS x FROM g),
t AS (SELECT DISTINCT p_partkey, v::BIGINT::VARCHAR AS gold, x::BIGINT::VARCHAR AS o FROM w WHERE x <> v),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY sha256('num:' || p_partkey::VARCHAR || ':' || o)) rn FROM t),
o AS (SELECT p_partkey, gold, o FROM r WHERE rn <= 3 UNION ALL SELECT p_partkey, v::BIGINT::VARCHAR, v::BIGINT::VARCHAR FROM g),
l AS (SELECT p_partkey, gold, list(o ORDER BY sha256('num:' || p_partkey::VARCHAR || ':4:' || o)) AS options FROM o GROUP BY ALL)
SELECT p_partkey, gold AS gold_text, array_to_string(options, ',') AS options, (list_position(options, gold) - 1)::BIGINT AS gold_index FROM l""")
def numeric_options(spark, d):
    out = distractors.numeric_options(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", "num", "p_partkey", 4)
    return out.select(
        "p_partkey", "gold_text", F.array_join("options", ",").alias("options"), F.col("gold_index").cast("bigint").alias("gold_index")
    )


RANKED = """
v AS (SELECT DISTINCT l_suppkey, l_quantity FROM lineitem),
rk AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM v),
items AS (SELECT l_suppkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL),
pl AS (SELECT i.*, l_suppkey::VARCHAR || '-' || l_linenumber::VARCHAR AS id, rn, rn - 1 AS below, n - rn AS above FROM items i JOIN rk USING (l_suppkey, l_quantity)),
fe AS (SELECT *, sha256('rank:' || id) AS h, least(3, below + above) AS take FROM pl),
fe2 AS (SELECT *, greatest(0, take - below) AS lo, least(take, above) AS hi, row_number() OVER (PARTITION BY l_linenumber ORDER BY h) AS turn FROM fe),
hf AS (SELECT l_linenumber, ceil(count(*) / 2) AS half FROM items GROUP BY l_linenumber)"""


def rank_rounds(k: int) -> str:
    """The rounds of the count assignment, unrolled."""
    parts, earlier = [], None
    for step in range(k + 1):
        used = f"(SELECT count(*) FROM p{step - 1} y WHERE y.l_linenumber = a.l_linenumber AND y.n_above = a.n_above)" if earlier else "0"
        rest = f"WHERE id NOT IN (SELECT id FROM {earlier})" if earlier else ""
        parts.append(f"""
a{step} AS (SELECT *, lo + (turn - 1 + {step}) % (hi - lo + 1) AS n_above FROM (SELECT * FROM fe2 {rest}) WHERE hi - lo + 1 > {step}),
g{step} AS (SELECT *, row_number() OVER (PARTITION BY l_linenumber, n_above ORDER BY h) AS rank_in FROM a{step}),
q{step} AS (SELECT a.id, a.l_linenumber, a.l_quantity, a.n_above FROM g{step} a JOIN hf USING (l_linenumber) WHERE rank_in <= half - {used}),
p{step} AS (SELECT * FROM q{step}{f" UNION ALL SELECT * FROM {earlier}" if earlier else ""})""")
        earlier = f"p{step}"
    return ",".join(parts)


@query(f"""
WITH {RANKED}, {rank_rounds(3)}
SELECT id, l_linenumber, l_quantity, n_above::BIGINT AS n_above FROM p3""")
def rank_balanced_distractors(spark, d):
    li = table(spark, d, "lineitem")
    items = li.groupBy("l_suppkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"))
    items = items.withColumn("id", F.concat_ws("-", F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")))
    pool = li.select("l_suppkey", "l_quantity")
    out = distractors.rank_spread(items, pool, "id", "l_suppkey", "l_linenumber", "l_quantity", 3, "rank")
    # The number of wrong values above the gold is what the SQL restates.
    above = F.size(F.filter("distractors", lambda x: x > F.col("l_quantity"))).cast("bigint")
    return out.select("id", "l_linenumber", "l_quantity", above.alias("n_above"))
