"""Metric and chance families over order and document cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import scoring
from casewright.operators import chance, facts, metrics, ordering, results
from casewright.plans.derived import DOC_CASES, ORDER_CASES, doc_cases, order_cases
from casewright.plans.registry import query, table


def r6(c):
    return F.round(c, 6)


def complete(spark, d, *dims):
    """Subtotals of the complete groups."""
    sub = metrics.group_subtotals(
        order_cases(spark, d), ["catalog_id"], "group_id", list(dims), F.sum("hit").alias("hits"), F.count("hit").alias("answered")
    )
    return sub.where("complete")


@query(f"""
WITH {ORDER_CASES}
SELECT catalog_id, count(*) AS requests, count(*) FILTER (status = 'ok') AS ok,
  count(*) FILTER (status = 'unsupported') AS unsupported, count(*) FILTER (status = 'error') AS error,
  count(*) FILTER (status = 'abstained') AS abstained, count(*) FILTER (status = 'pending') AS pending
FROM cases GROUP BY catalog_id""")
def status_counts(spark, d):
    rows = order_cases(spark, d)
    log = rows.where("status <> 'pending'").select("run_id", "status")
    # Several lines can share an id; the log keeps one record per run.
    latest = log.groupBy("run_id").agg(F.max("status").alias("status"))
    joined = results.with_status(rows.select("run_id", "catalog_id"), latest)
    return metrics.status_counts(joined, ["catalog_id"])


@query("""
SELECT event_type, count(*) AS n FROM events GROUP BY event_type""")
def event_tally(spark, d):
    from casewright.operators import audits

    return audits.tally(table(spark, d, "events"), ["event_type"])


@query("""
SELECT count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error,
  count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS "view", user_id
FROM events GROUP BY user_id""")
def event_pivot(spark, d):
    kinds = ["click", "error", "purchase", "view"]
    wide = table(spark, d, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1)))
    return wide.select("user_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


@query(f"""
WITH {ORDER_CASES}
SELECT catalog_id, track, count(*) AS planned_groups, round(avg(complete::INT), 6) AS coverage, round(avg(pending::INT), 6) AS pending
FROM (SELECT catalog_id, track, group_id, bool_and(status = 'ok') AS complete, bool_or(status IN ('pending', 'error')) AS pending
      FROM cases GROUP BY ALL)
GROUP BY catalog_id, track""")
def group_coverage(spark, d):
    out = metrics.group_coverage(order_cases(spark, d), ["catalog_id", "track"], "group_id")
    return out.select("catalog_id", "track", "planned_groups", r6("coverage").alias("coverage"), r6("pending").alias("pending"))


@query(f"""
WITH {ORDER_CASES}
SELECT catalog_id, round(avg(hit), 6) AS field_accuracy FROM cases GROUP BY catalog_id""")
def field_accuracy(spark, d):
    rows = order_cases(spark, d)
    scored = rows.withColumn("h", F.when(F.col("status") == "ok", metrics.hit(F.col("gold"), F.col("pred"))))
    out = metrics.mean_by(scored, ["catalog_id"], "h", "field_accuracy")
    return out.withColumn("field_accuracy", r6("field_accuracy"))


@query(f"""
WITH {ORDER_CASES}
SELECT catalog_id, count(*) AS cases, round(avg(x), 6) AS case_exact_accuracy
FROM (SELECT catalog_id, group_id, min(hit) AS x FROM done GROUP BY ALL) GROUP BY catalog_id""")
def case_exact_accuracy(spark, d):
    out = metrics.case_exact(order_cases(spark, d), ["catalog_id"], "group_id", "hit")
    return out.withColumn("case_exact_accuracy", r6("case_exact_accuracy"))


@query(f"""
WITH {ORDER_CASES}
SELECT catalog_id, count(*) AS cases, round(avg(x), 6) AS case_exact_accuracy
FROM (SELECT catalog_id, group_id,
        min(CASE WHEN pred_label = gold_label OR pred_label = 'N' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS x
      FROM done GROUP BY ALL)
GROUP BY catalog_id""")
def case_exact_with_ties(spark, d):
    rows = order_cases(spark, d).withColumn("accepted", F.array("gold_label", F.lit("N")))
    scored = rows.withColumn("h", metrics.hit(F.col("gold_label"), F.col("pred_label"), F.col("accepted")))
    out = metrics.case_exact(scored, ["catalog_id"], "group_id", "h")
    return out.withColumn("case_exact_accuracy", r6("case_exact_accuracy"))


LABEL_COUNTS = """
conf AS (SELECT catalog_id, gold_label g, pred_label p, count(*) n FROM {src} WHERE pred_label IS NOT NULL GROUP BY ALL),
labs AS (SELECT catalog_id, g AS label FROM conf UNION SELECT catalog_id, p FROM conf),
lc AS (SELECT l.catalog_id, l.label,
  coalesce(sum(n) FILTER (g = label AND p = label), 0) tp, coalesce(sum(n) FILTER (g = label), 0) gn,
  coalesce(sum(n) FILTER (p = label), 0) pn
  FROM labs l JOIN conf c ON c.catalog_id = l.catalog_id GROUP BY ALL)"""


@query(f"""
WITH {ORDER_CASES}, {LABEL_COUNTS.format(src="done")}
SELECT catalog_id, count(*) AS labels, round(avg(CASE WHEN gn + pn = 0 THEN 0 ELSE 2.0 * tp / (gn + pn) END), 6) AS macro_f1
FROM lc GROUP BY catalog_id""")
def macro_f1_observed_labels(spark, d):
    out = metrics.macro_f1(complete(spark, d, "gold_label", "pred_label"), ["catalog_id"], n="n")
    return out.withColumn("macro_f1", r6("macro_f1"))


@query(f"""
WITH {DOC_CASES}, conf AS (SELECT lang, gold g, pred p, count(*) n FROM dcases WHERE pred IS NOT NULL GROUP BY ALL),
labs AS (SELECT lang, g AS label FROM conf UNION SELECT lang, p FROM conf),
lc AS (SELECT l.lang, l.label, coalesce(sum(n) FILTER (g = label AND p = label), 0) tp,
  coalesce(sum(n) FILTER (g = label), 0) + coalesce(sum(n) FILTER (p = label), 0) gp
  FROM labs l JOIN conf c ON c.lang = l.lang GROUP BY ALL)
SELECT lang, count(*) AS labels, round(avg(CASE WHEN gp = 0 THEN 0 ELSE 2.0 * tp / gp END), 6) AS macro_f1 FROM lc GROUP BY lang""")
def macro_f1_documents(spark, d):
    out = metrics.macro_f1(doc_cases(spark, d), ["lang"], "gold", "pred")
    return out.withColumn("macro_f1", r6("macro_f1"))


@query(f"""
WITH {ORDER_CASES}
SELECT catalog_id, track, round(CASE WHEN count(*) FILTER (gold = 'yes') + count(*) FILTER (pred = 'yes') = 0 THEN 0
  ELSE 2.0 * count(*) FILTER (gold = 'yes' AND pred = 'yes') / (count(*) FILTER (gold = 'yes') + count(*) FILTER (pred = 'yes')) END, 6) AS f1
FROM done GROUP BY catalog_id, track""")
def binary_f1(spark, d):
    out = metrics.binary_f1(complete(spark, d, "track", "gold", "pred"), ["catalog_id", "track"], n="n")
    return out.withColumn("f1", r6("f1"))


@query(f"""
WITH {ORDER_CASES}, {LABEL_COUNTS.format(src="cases")},
m AS (SELECT catalog_id, count(*) FILTER (pred_label IS NULL) AS m FROM cases GROUP BY catalog_id),
classes AS (SELECT DISTINCT c.catalog_id, x.label FROM cases c, (SELECT unnest(['A', 'N', 'R', 'X']) AS label) x),
one AS (SELECT k.catalog_id, k.label, coalesce(tp, 0) tp, coalesce(gn, 0) + coalesce(pn, 0) + m.m AS d
  FROM classes k JOIN m USING (catalog_id) LEFT JOIN lc USING (catalog_id, label))
SELECT catalog_id, round(avg(CASE WHEN d = 0 THEN 0 ELSE 2.0 * tp / d END), 6) AS conservative_f1 FROM one GROUP BY catalog_id""")
def conservative_f1_fixed_classes(spark, d):
    rows = order_cases(spark, d)
    classes = rows.select("catalog_id").distinct().withColumn("label", F.explode(F.array(*[F.lit(x) for x in "ANRX"])))
    out = metrics.conservative_f1(rows, ["catalog_id"], classes)
    return out.withColumn("conservative_f1", r6("conservative_f1"))


@query(f"""
WITH {ORDER_CASES}
SELECT track, round(2.0 * count(*) FILTER (gold = 'yes' AND pred = 'yes')
  / (count(*) FILTER (gold = 'yes' AND pred IS NOT NULL) + count(*) FILTER (pred = 'yes') + count(*) FILTER (pred IS NULL)), 6) AS conservative_f1
FROM cases GROUP BY track""")
def conservative_f1_positive_class(spark, d):
    rows = order_cases(spark, d)
    classes = rows.select("track").distinct().withColumn("label", F.lit("yes"))
    out = metrics.conservative_f1(rows, ["track"], classes, "gold", "pred")
    return out.withColumn("conservative_f1", r6("conservative_f1"))


@query(f"""
WITH {ORDER_CASES}
SELECT catalog_id, count(*) AS clusters, round(avg(v), 6) AS cluster_macro_accuracy
FROM (SELECT catalog_id, cluster, avg(hit) AS v FROM done GROUP BY ALL) GROUP BY catalog_id""")
def cluster_macro_accuracy(spark, d):
    out = metrics.cluster_macro(
        complete(spark, d, "cluster"), ["catalog_id"], "cluster", "hits", "answered", "cluster_macro_accuracy"
    )
    return out.withColumn("cluster_macro_accuracy", r6("cluster_macro_accuracy"))


@query("""
SELECT event_type, count(*) AS clusters, round(avg(v), 6) AS user_macro_value
FROM (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY ALL) GROUP BY event_type""")
def user_macro_value(spark, d):
    out = metrics.cluster_macro(
        table(spark, d, "events").withColumn("one", F.lit(1)), ["event_type"], "user_id", "value", "one", "user_macro_value"
    )
    return out.withColumn("user_macro_value", r6("user_macro_value"))


@query(f"""
WITH {ORDER_CASES}
SELECT catalog_id, field, count(hit) AS n, round(avg(hit), 6) AS mean FROM done GROUP BY catalog_id, field""")
def subgroup_accuracy(spark, d):
    out = metrics.subgroup_table(complete(spark, d, "field"), ["catalog_id"], "field", "hits", "answered")
    return out.withColumn("mean", r6("mean"))


FIELD_F1 = """
ff AS (SELECT catalog_id, field, CASE WHEN count(*) FILTER (gold = 'yes') + count(*) FILTER (pred = 'yes') = 0 THEN 0
  ELSE 2.0 * count(*) FILTER (gold = 'yes' AND pred = 'yes') / (count(*) FILTER (gold = 'yes') + count(*) FILTER (pred = 'yes')) END AS f1
  FROM done GROUP BY catalog_id, field HAVING bool_and(gold IN ('yes', 'no')))"""


@query(f"WITH {ORDER_CASES}, {FIELD_F1} SELECT catalog_id, field, round(f1, 6) AS f1 FROM ff")
def positive_f1_by_field(spark, d):
    out = metrics.field_f1(complete(spark, d, "field", "gold", "pred"), ["catalog_id"], n="n")
    return out.withColumn("f1", r6("f1"))


@query(f"WITH {ORDER_CASES}, {FIELD_F1} SELECT catalog_id, round(avg(f1), 6) AS category_macro_f1 FROM ff GROUP BY catalog_id")
def category_macro_f1(spark, d):
    out = metrics.category_macro_f1(complete(spark, d, "field", "gold", "pred"), ["catalog_id"], n="n")
    return out.withColumn("category_macro_f1", r6("category_macro_f1"))


@query(f"""
WITH {ORDER_CASES}, pg AS (SELECT catalog_id, group_id, count(*) FILTER (gold = 'yes' AND pred = 'yes') b,
  count(*) FILTER (gold = 'yes') + count(*) FILTER (pred = 'yes') dd FROM done GROUP BY ALL)
SELECT catalog_id, count(*) AS groups, round(avg(CASE WHEN dd = 0 THEN 1.0 ELSE 2.0 * b / dd END), 6) AS review_f1
FROM pg GROUP BY catalog_id""")
def review_f1(spark, d):
    out = metrics.review_f1(
        order_cases(spark, d), ["catalog_id"], "group_id", F.col("gold") == "yes", F.col("pred") == "yes", complete_groups=True
    )
    return out.withColumn("review_f1", r6("review_f1"))


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) rn,
  count(*) OVER (PARTITION BY event_type) n FROM events)
SELECT event_type, max(n) AS n,
  round(max(value) FILTER (rn = least(n, ceil(n * 0.5::DOUBLE))), 6) AS p50_nearest_rank,
  round(max(value) FILTER (rn = least(n, ceil(n * 0.95::DOUBLE))), 6) AS p95_nearest_rank,
  round((max(value) FILTER (rn = (n + 1) // 2) + max(value) FILTER (rn = n // 2 + 1)) / 2, 6) AS median,
  round(max(value) FILTER (rn = floor(0.95::DOUBLE * (n - 1)) + 1), 6) AS p95_floor_index
FROM r GROUP BY event_type""")
def percentile_rules(spark, d):
    rules = {
        "p50_nearest_rank": metrics.nearest_rank(0.5),
        "p95_nearest_rank": metrics.nearest_rank(0.95),
        "median": metrics.middle(),
        "p95_floor_index": metrics.floor_index(0.95),
    }
    out = metrics.exact_percentiles(table(spark, d, "events"), ["event_type"], "value", rules)
    return out.select("event_type", "n", *[r6(c).alias(c) for c in rules])


@query(f"""
WITH {ORDER_CASES}
SELECT catalog_id, round(sum(tokens), 2) AS sum_tokens, round(sum(wall_ms), 2) AS sum_wall_ms,
  max(tokens) AS max_tokens, max(wall_ms) AS max_wall_ms FROM cases GROUP BY catalog_id""")
def usage_totals(spark, d):
    out = metrics.totals(order_cases(spark, d), ["catalog_id"], ["tokens", "wall_ms"], ["tokens", "wall_ms"])
    return out.withColumns({c: F.round(c, 2) for c in ("sum_tokens", "sum_wall_ms")})


@query(f"""
WITH {ORDER_CASES}, long AS (
  SELECT catalog_id, 'hit' AS metric, hit AS v FROM cases UNION ALL SELECT catalog_id, 'tokens', tokens FROM cases
  UNION ALL SELECT catalog_id, 'wall_ms', wall_ms FROM cases)
SELECT catalog_id, metric, count(v) AS n, round(avg(v), 4) AS mean FROM long WHERE v IS NOT NULL GROUP BY ALL""")
def metric_means(spark, d):
    out = metrics.metric_means(order_cases(spark, d), ["catalog_id"], ["hit", "tokens", "wall_ms"])
    return out.withColumn("mean", F.round("mean", 4))


@query("""
SELECT c_custkey, requests, answered, round(coalesce(answered::DOUBLE / nullif(requests, 0), 1.0), 6) AS coverage
FROM (SELECT c_custkey, count(o_orderkey) AS requests, count(*) FILTER (o_orderstatus = 'F') AS answered
      FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)""")
def coverage_share(spark, d):
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("o_orderstatus") == "F").alias("answered")
    )
    c = table(spark, d, "customer").select("c_custkey")
    joined = c.join(orders, c.c_custkey == orders.o_custkey, "left")
    n = {k: F.coalesce(k, F.lit(0)) for k in ("requests", "answered")}
    return joined.withColumns(n).select(
        "c_custkey", "requests", "answered", r6(scoring.share(F.col("answered"), F.col("requests"))).alias("coverage")
    )


@query(f"""
WITH {ORDER_CASES}, per AS (
  SELECT catalog_id, track, grouping(track) = 1 AS all_tracks, count(*) AS scored_requests,
    round(avg(hit), 6) AS score, round(2.0 * count(*) FILTER (gold = 'yes' AND pred = 'yes')
      / nullif(count(*) FILTER (gold = 'yes') + count(*) FILTER (pred = 'yes'), 0), 6) AS positive_f1
  FROM done GROUP BY GROUPING SETS ((catalog_id), (catalog_id, track))),
cnt AS (SELECT catalog_id, track, grouping(track) = 1 AS all_tracks, count(*) AS requests,
    count(*) FILTER (status = 'ok') AS answered, count(*) FILTER (status = 'pending') AS pending
  FROM cases GROUP BY GROUPING SETS ((catalog_id), (catalog_id, track))),
lat AS (SELECT catalog_id, round(median(wall_ms), 4) AS median_ms FROM cases WHERE status = 'ok' GROUP BY catalog_id)
SELECT cnt.catalog_id, CASE WHEN cnt.all_tracks THEN '*' ELSE cnt.track END AS track, requests, answered, pending,
  scored_requests, score, positive_f1, CASE WHEN cnt.all_tracks THEN median_ms END AS median_ms
FROM cnt JOIN per ON per.catalog_id = cnt.catalog_id AND per.track IS NOT DISTINCT FROM cnt.track
JOIN lat ON lat.catalog_id = cnt.catalog_id""")
def benchmark_summary(spark, d):
    from casewright.plans.score import summary

    out = summary(order_cases(spark, d), "wall_ms", small_groups=True)
    return out.select(
        "catalog_id", "track", "requests", "answered", "pending", "scored_requests",
        r6("score").alias("score"), r6("positive_f1").alias("positive_f1"), F.round("median_ms", 4).alias("median_ms"),
    )


@query("""
SELECT event_type AS task, user_id AS model, grouping(event_type)::INT AS all_tasks, round(avg(value), 9) AS mean_quality,
  round(avg(json_extract(props, '$.k')::DOUBLE), 9) AS mean_cost, count(*) AS cases
FROM events GROUP BY GROUPING SETS ((event_type, user_id), (user_id))""")
def calibration_profile(spark, d):
    e = table(spark, d, "events").select(
        F.col("event_type").alias("task"), F.col("user_id").alias("model"), "value",
        F.get_json_object("props", "$.k").cast("double").alias("cost"),
    )
    out = metrics.profile(e, "task", "model", "value", "cost")
    return out.withColumns({c: F.round(c, 9) for c in ("mean_quality", "mean_cost")})


RANK_SUMS = """
rs AS (SELECT l_partkey, l_suppkey, sum(l_linenumber)::BIGINT AS rank_sum FROM lineitem GROUP BY ALL),
rb AS (SELECT l_partkey, min(rank_sum) AS best FROM rs GROUP BY l_partkey)"""


@query(f"""
WITH {RANK_SUMS}
SELECT l_partkey, l_suppkey, rank_sum, best, rank_sum = best AS accepted FROM rs JOIN rb USING (l_partkey)""")
def rank_sums(spark, d):
    return metrics.rank_sums(table(spark, d, "lineitem"), ["l_partkey"], "l_suppkey", "l_linenumber")


@query("""
SELECT l_partkey, l_suppkey, l_extendedprice FROM lineitem l
WHERE l_extendedprice = (SELECT max(l_extendedprice) FROM lineitem x WHERE x.l_partkey = l.l_partkey)""")
def best_with_ties(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice")
    return ordering.best_with_ties(rows, ["l_partkey"], "l_extendedprice")


@query(f"""
WITH {ORDER_CASES}
SELECT catalog_id, round(avg(n_accepted::DOUBLE / n_options), 6) AS chance FROM cases GROUP BY catalog_id""")
def chance_expected_accuracy(spark, d):
    out = chance.expected_accuracy(order_cases(spark, d), ["catalog_id"], "n_accepted")
    return out.withColumn("chance", r6("chance"))


@query("""
SELECT l_returnflag, count(*) AS cases, round(avg(c), 6) AS chance
FROM (SELECT l_returnflag, l_orderkey, product(1.0::DOUBLE / (l_linenumber + 1)) AS c FROM lineitem GROUP BY ALL) GROUP BY l_returnflag""")
def chance_whole_case(spark, d):
    rows = table(spark, d, "lineitem").withColumn("n_options", F.col("l_linenumber") + 1)
    out = chance.whole_case(rows, ["l_returnflag"], "l_orderkey")
    return out.withColumn("chance", r6("chance"))


@query("""
SELECT lang, round(p, 6) AS prevalence, round(p / (p + 0.5), 6) AS chance
FROM (SELECT lang, avg(toxic)::DOUBLE AS p FROM documents JOIN labels USING (doc_id) GROUP BY lang)""")
def chance_coin_f1(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    out = chance.coin_f1(rows.withColumn("gold", (F.col("toxic") == 1).cast("string")), ["lang"])
    return out.select("lang", r6("prevalence").alias("prevalence"), r6("chance").alias("chance"))


@query(f"""
WITH {ORDER_CASES}
SELECT catalog_id, round(2.0 * count(*) FILTER (gold = 'yes') / (count(*) FILTER (gold = 'yes') + count(*)), 6) AS chance
FROM cases GROUP BY catalog_id""")
def chance_always_yes(spark, d):
    out = chance.always_yes_f1(order_cases(spark, d), ["catalog_id"])
    return out.withColumn("chance", r6("chance"))


@query(f"""
WITH {ORDER_CASES}, pg AS (SELECT catalog_id, group_id, count(*) FILTER (gold = 'yes') y, count(*) n FROM cases GROUP BY ALL)
SELECT catalog_id, count(*) AS groups, round(avg(2.0 * y / (y + n)), 6) AS chance FROM pg GROUP BY catalog_id""")
def chance_always_yes_review(spark, d):
    out = chance.always_yes_review_f1(order_cases(spark, d), ["catalog_id"], "group_id", F.col("gold") == "yes")
    return out.withColumn("chance", r6("chance"))


def offers(spark, d):
    """Options of an order: its suppliers, with a quality and a cost (the first line of a supplier counts)."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("option_id")).agg(
        F.max("l_quantity").alias("quality"), F.max("l_discount").alias("cost"), F.min("l_linenumber").cast("bigint").alias("rank_sum")
    )


def chosen(spark, d):
    """The option with the smallest id, or one that does not exist for every seventh case."""
    low = offers(spark, d).groupBy("case_id").agg(F.min("option_id").alias("option_id"))
    return low.withColumn("option_id", F.when(F.col("case_id") % 7 == 0, F.lit(-1)).otherwise(F.col("option_id")))


OFFERS = """
offers AS (SELECT l_orderkey AS case_id, l_suppkey AS option_id, max(l_quantity) AS quality, max(l_discount) AS cost,
  min(l_linenumber)::BIGINT AS rank_sum, 5 AS panel FROM lineitem GROUP BY ALL),
chosen AS (SELECT case_id, CASE WHEN case_id % 7 = 0 THEN -1 ELSE min(option_id) END AS option_id FROM offers GROUP BY case_id)"""


@query(f"""
WITH {OFFERS}, u AS (SELECT *, quality - 10.0::DOUBLE * cost AS utility FROM offers),
b AS (SELECT case_id, max(utility) AS best FROM u GROUP BY case_id)
SELECT c.case_id, c.option_id, quality, cost, round(utility, 6) AS utility, utility IS NOT NULL AS valid,
  coalesce(abs(best - utility) <= 1e-12, false) AS oracle_optimal, CASE WHEN utility IS NOT NULL THEN round(greatest(0, best - utility), 6) END AS utility_regret
FROM chosen c LEFT JOIN u USING (case_id, option_id) JOIN b USING (case_id)""")
def routing_outcomes(spark, d):
    out = metrics.outcome_scores(offers(spark, d), chosen(spark, d), "case_id", "option_id", "quality", "cost", 10.0)
    return out.withColumns({c: r6(c) for c in ("utility", "utility_regret")})


@query(f"""
WITH {OFFERS}, b AS (SELECT case_id, max(quality) AS best FROM offers GROUP BY case_id)
SELECT c.case_id, c.option_id, coalesce(quality = best, false) AS best_choice, round(coalesce(best - quality, 1.0), 6) AS value_regret
FROM chosen c LEFT JOIN offers USING (case_id, option_id) JOIN b USING (case_id)""")
def reference_value_regret(spark, d):
    out = metrics.reference_value_scores(offers(spark, d), chosen(spark, d), "case_id", "option_id", "quality")
    return out.withColumn("value_regret", r6("value_regret"))


@query(f"""
WITH {OFFERS}, b AS (SELECT case_id, min(rank_sum) AS best, count(*) AS k FROM offers GROUP BY case_id HAVING count(*) > 1)
SELECT c.case_id, c.option_id, coalesce(rank_sum = best, false) AS group_preferred,
  round(coalesce((rank_sum - best)::DOUBLE / (5 * (k - 1)), 1.0), 6) AS normalized_rank_regret
FROM chosen c JOIN b USING (case_id) LEFT JOIN offers USING (case_id, option_id)""")
def consensus_regret(spark, d):
    o = offers(spark, d).withColumn("panel", F.lit(5))
    several = o.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("case_id")
    o = o.join(several, "case_id", "left_semi")
    picked = chosen(spark, d).join(several, "case_id", "left_semi")
    out = metrics.consensus_scores(o, picked, "case_id", "option_id", "rank_sum", "panel")
    return out.withColumn("normalized_rank_regret", r6("normalized_rank_regret"))


@query("""
WITH f AS (SELECT source, CASE WHEN n_chars % 2 = 0 THEN 'scalar' ELSE 'joint' END AS kind,
  least(0.99::DOUBLE, n_chars / 2000.0::DOUBLE) AS p, quality AS y FROM documents JOIN labels USING (doc_id))
SELECT source, kind, count(*) AS n, round(avg(pow(p - y, 2)), 6) AS brier,
  round(avg(-y * ln(greatest(1e-15, least(1 - 1e-15, p))) - (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p)))), 6) AS log_loss,
  round(avg(((p >= 0.5) = (y = 1))::INT), 6) AS accuracy
FROM f GROUP BY source, kind""")
def forecast_scores(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    p = F.least(F.lit(0.99), F.col("n_chars") / 2000.0)
    y = F.col("quality")
    scored = docs.select(
        "source", F.when(F.col("n_chars") % 2 == 0, "scalar").otherwise("joint").alias("kind"),
        scoring.brier(p, y).alias("brier"), scoring.log_loss(p, y).alias("log_loss"),
        ((p >= 0.5) == (y == 1)).cast("double").alias("right"),
    )
    return scored.groupBy("source", "kind").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("brier")).alias("brier"),
        r6(F.avg("log_loss")).alias("log_loss"), r6(F.avg("right")).alias("accuracy"),
    )


@query("""
WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, list_value(l_quantity / 10, l_tax * 50, l_discount * 40) AS x FROM lineitem),
e AS (SELECT *, list_transform(x, lambda v: exp(v - list_max(x))) AS w, list_position(x, list_max(x)) - 1 AS choice FROM s)
SELECT choice::BIGINT AS choice, count(*) AS n, round(avg(w[1] / list_sum(w)), 6) AS p0, round(avg(w[2] / list_sum(w)), 6) AS p1,
  round(avg(w[3] / list_sum(w)), 6) AS p2 FROM e GROUP BY choice""")
def softmax_choice(spark, d):
    x = F.array(F.col("l_quantity") / 10, F.col("l_tax") * 50, F.col("l_discount") * 40)
    rows = table(spark, d, "lineitem").select(x.alias("x")).select(
        scoring.softmax(F.col("x")).alias("p"), scoring.first_max(F.col("x")).cast("bigint").alias("choice")
    )
    return rows.groupBy("choice").agg(
        F.count(F.lit(1)).alias("n"), *[r6(F.avg(F.col("p")[i])).alias(f"p{i}") for i in range(3)]
    )


@query("""
WITH s AS (SELECT l_orderkey, l_suppkey, list_value(l_tax, l_discount, l_tax * l_discount) AS p,
  CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'B' ELSE 'C' END AS choice FROM lineitem),
n AS (SELECT choice, CASE WHEN list_sum(p) > 0 THEN list_transform(p, lambda v: v / list_sum(p))
  ELSE list_transform(['A', 'B', 'C'], lambda k: CASE WHEN k = choice THEN 1.0 ELSE 0.0 END::DOUBLE) END AS q FROM s)
SELECT choice, count(*) AS n, round(sum(q[1]), 4) AS p0, round(sum(q[2]), 4) AS p1, round(sum(q[3]), 4) AS p2 FROM n GROUP BY choice""")
def normalized_probabilities(spark, d):
    li = table(spark, d, "lineitem")
    p = F.array("l_tax", "l_discount", F.col("l_tax") * F.col("l_discount"))
    choice = F.when(F.col("l_quantity") < 17, "A").when(F.col("l_quantity") < 34, "B").otherwise("C")
    rows = li.select(p.alias("p"), choice.alias("choice"))
    q = scoring.normalized(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.col("p"), F.col("choice"))
    return rows.select("choice", q.alias("q")).groupBy("choice").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.sum(F.col("q")[i]), 4).alias(f"p{i}") for i in range(3)]
    )


@query("""
WITH w AS (SELECT l_returnflag, l_quantity AS w, l_discount * 10 AS x FROM lineitem)
SELECT l_returnflag, round(sum(w * x) / sum(w), 6) AS weighted_mean,
  round((exp(sum(w * ln(0.1 + 0.9 * x)) / sum(w)) - 0.1) / 0.9, 6) AS weighted_geometric
FROM w GROUP BY l_returnflag""")
def weighted_means(spark, d):
    from casewright.operators import rollup

    rows = table(spark, d, "lineitem").withColumn("x", F.col("l_discount") * 10)
    out = rollup.weighted_means(rows, ["l_returnflag"], "l_quantity", "x")
    return out.withColumns({c: r6(c) for c in ("weighted_mean", "weighted_geometric")})


@query("""
SELECT doc_id, sha256(text) AS payload_sha256, greatest(1, length(text) // 4)::BIGINT AS proxy_tokens FROM documents""")
def payload_fingerprints(spark, d):
    from casewright.functions import hashing

    return table(spark, d, "documents").select(
        "doc_id", hashing.payload_sha(F.col("text")).alias("payload_sha256"), hashing.size_proxy(F.col("text")).alias("proxy_tokens")
    )
