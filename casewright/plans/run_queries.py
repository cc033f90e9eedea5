"""Typed cases, batch scoring and the result log as a stream."""

from __future__ import annotations

import uuid

from pyspark.errors import PythonException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.operators import facts, inference, metrics, results
from casewright.plans.derived import status_of
from casewright.plans.predictors import ByLength, Unbuildable, Unreachable, WholeCalls
from casewright.plans.registry import query, table
from casewright.functions import hashing
from casewright.functions import receipts as fields
from casewright.session import checkpoint_dir
from casewright.sources import readers
from casewright.streaming import result_log


def typed_cases(spark, d):
    """Labelled documents as typed cases: a two-option quality choice whose options
    are described in words, and a yes-no toxicity question."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "text", "n_chars")
    j = docs.join(table(spark, d, "labels"), "doc_id")
    option = lambda k, v: F.struct(F.lit(k).alias("option"), F.lit(v).alias("descr"))
    quality = F.struct(
        F.lit("quality").alias("key"), F.lit("choice").alias("type"), F.lit("Is it good text?").alias("instructions"),
        F.array(option("0", "poor"), option("1", "good")).alias("criteria"),
    )
    toxic = F.struct(
        F.lit("toxic").alias("key"), F.lit("noul").alias("type"), F.lit("Is it toxic?").alias("instructions"),
        F.array().cast("array<struct<option:string,descr:string>>").alias("criteria"),
    )
    return j.select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("run_id"),
        F.col("lang").alias("catalog_id"), F.col("source").alias("track"), F.floor(F.col("doc_id") / 3).alias("group_id"),
        F.array(quality, toxic).alias("questions"),
        F.create_map(
            F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), (F.col("toxic") == 1).cast("string")
        ).alias("expected"),
        "n_chars",
    )


def typed_results(cases):
    """Results of a length rule, with the status taken from the hash of the run id.

    The probabilities of very long texts do not add up to one.
    """
    answer = T.StructType(
        [T.StructField("type", T.StringType()), T.StructField("choice", T.StringType()), T.StructField("noul", T.DoubleType()),
         T.StructField("probabilities", T.MapType(T.StringType(), T.DoubleType()))]
    ).simpleString()
    long = F.col("n_chars") > 800
    choice = F.struct(
        F.lit("choice"), F.when(long, "1").otherwise("0"), F.lit(None).cast("double"),
        F.create_map(
            F.lit("0"), F.when(long, F.when(F.col("n_chars") > 3000, 0.6).otherwise(0.3)).otherwise(0.7),
            F.lit("1"), F.when(long, 0.7).otherwise(0.3),
        ),
    ).cast(answer)
    noul = F.struct(F.lit("noul"), F.lit(None).cast("string"), F.least(F.lit(1.0), F.col("n_chars") / 5000.0), F.lit(None).cast("map<string,double>")).cast(answer)
    status = status_of(hashing.hash_mod(hashing.sha(F.col("run_id")), 20))
    return cases.select(
        F.lit("rule").alias("engine"), "run_id", status.alias("status"),
        F.create_map(F.lit("quality"), choice, F.lit("toxic"), noul).alias("answers"), F.col("n_chars").cast("double").alias("total_wall_ms"),
    ).where("status <> 'pending'")


TYPED = """
tc AS (SELECT 'doc:' || d.doc_id::VARCHAR AS run_id, lang, n_chars, quality, toxic FROM documents d JOIN labels USING (doc_id)),
ts AS (SELECT *, ('0x' || substr(sha256(run_id), 1, 8))::BIGINT % 20 > 3 AS ok FROM tc),
tf AS (SELECT run_id, lang, 'quality' AS field, ok, quality::VARCHAR AS gold, CASE WHEN n_chars > 800 THEN '1' ELSE '0' END AS pred, 0.7::DOUBLE AS conf FROM ts
  UNION ALL SELECT run_id, lang, 'toxic', ok, (toxic = 1)::VARCHAR, (least(1.0, n_chars / 5000.0) >= 0.5)::VARCHAR,
    greatest(least(1.0, n_chars / 5000.0::DOUBLE), 1 - least(1.0, n_chars / 5000.0::DOUBLE)) FROM ts)"""


@query(f"""
WITH {TYPED}
SELECT lang, field, count(*) AS fields, count(*) FILTER (ok) AS answered, round(avg((gold = pred)::INT) FILTER (ok), 6) AS accuracy,
  round(avg(conf) FILTER (ok), 6) AS confidence, max(CASE field WHEN 'quality' THEN CASE gold WHEN '1' THEN 'good' ELSE 'poor' END ELSE gold END) AS top_label,
  max(CASE WHEN ok THEN CASE field WHEN 'quality' THEN CASE pred WHEN '1' THEN 'good' ELSE 'poor' END ELSE pred END END) AS top_predicted
FROM tf GROUP BY lang, field""")
def typed_fact(spark, d):
    cases = typed_cases(spark, d)
    fact = facts.fact(facts.fields(cases), typed_results(cases))
    right = F.when(F.col("status") == "ok", metrics.hit(F.col("gold"), F.col("pred")))
    return fact.groupBy(F.col("catalog_id").alias("lang"), "field").agg(
        F.count(F.lit(1)).alias("fields"), F.count_if(F.col("status") == "ok").alias("answered"),
        F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg("conf"), 6).alias("confidence"),
        F.max("gold_label").alias("top_label"), F.max("pred_label").alias("top_predicted"),
    )


@query(f"""
WITH {TYPED} SELECT run_id, CASE WHEN n_chars > 3000 THEN 'incomplete or invalid probability distribution' END AS reason, n_chars <= 3000 AS valid FROM ts WHERE ok""")
def response_validation(spark, d):
    cases = typed_cases(spark, d)
    given = facts.answers(typed_results(cases))
    asked = facts.fields(cases).join(given.select("run_id").distinct(), "run_id", "left_semi")
    return facts.validated(asked, given).select("run_id", "reason", "valid")


@query(f"""
WITH {TYPED}, h AS (SELECT *, ('0x' || substr(sha256('uniform:' || run_id || ':' || field), 1, 12))::BIGINT AS h FROM tf)
SELECT run_id, field, CASE WHEN field = 'quality' THEN (h % 2)::VARCHAR END AS choice, CASE WHEN field = 'toxic' THEN 0.5::DOUBLE END AS noul,
  CASE WHEN field = 'quality' THEN 0.5::DOUBLE END AS p0 FROM h""")
def uniform_baseline(spark, d):
    out = inference.uniform_answers(facts.fields(typed_cases(spark, d)), "uniform")
    return out.select("run_id", "field", "choice", "noul", F.try_element_at("probabilities", F.lit("0")).alias("p0"))


def quality_requests(spark, d, *more):
    """One request per document: its text, and whether it is good."""
    asked = '{"quality": {"type": "choice", "instructions": "Is it good text?", "criteria": {"0": "poor", "1": "good"}}}'
    return table(spark, d, "documents").select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("run_id"),
        F.to_json(F.struct("text")).alias("state"), F.lit(asked).alias("questions"), *more,
    )


def new_folder(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""
SELECT 'doc:' || doc_id::VARCHAR AS run_id, CASE WHEN length(text) > 20000 THEN 'unsupported' WHEN length(text) < 20 THEN 'abstained' ELSE 'ok' END AS status,
  CASE WHEN length(text) BETWEEN 20 AND 20000 THEN CASE WHEN length(text) > 800 THEN '1' ELSE '0' END END AS choice FROM documents""")
def batch_scoring(spark, d):
    requests = quality_requests(spark, d)
    log = inference.run(requests, "by-length", ByLength)
    return log.select("run_id", "status", F.get_json_object("response", "$.answers.quality.choice").alias("choice"))


@query("""
SELECT event_type, max((props->>'$.k')::BIGINT) AS max_image_pixels, max(value) AS max_image_tokens, count(*) AS rows_with_image_tokens
FROM events GROUP BY event_type""")
def usage_by_type(spark, d):
    e = table(spark, d, "events").select(
        "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("image_pixels"), F.col("value").alias("image_tokens")
    )
    return inference.usage_budget(e, keys=("event_type",))


@query("""
SELECT max(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN k END)::BIGINT AS first_pixels, max(k)::BIGINT AS max_image_pixels, max(value) AS max_image_tokens, count(*) AS rows_with_image_tokens
FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)""")
def merged_usage_budget(spark, d):
    e = table(spark, d, "events").select(
        "ts", F.get_json_object("props", "$.k").cast("bigint").alias("image_pixels"), F.col("value").alias("image_tokens")
    )
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    before = inference.usage_budget(e.where(early))
    now = inference.usage_budget(e.where(~early), before)
    one = F.lit(1).alias("_one")
    both = now.select(one, "*").join(before.select(one, F.col("max_image_pixels").alias("first_pixels")), "_one")
    return both.drop("_one")


EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]
)


@query("""
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def streamed_latest(spark, d):
    """The events table as a stream; last record per user through the idempotent sink."""
    root = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = result_log.read_log(spark, d, EVENT, "parquet", glob="events.parquet").select("user_id", "event_id", "event_type", "value")
    result_log.keep_latest(stream, ["user_id"], "event_id", f"{root}/latest", f"{root}/progress").awaitTermination()
    return result_log.read_latest(spark, f"{root}/latest", ["user_id"], "event_id")


@query("""
SELECT event_type, count(*) AS n FROM events GROUP BY event_type""")
def streamed_counts(spark, d):
    """Running counts of the event stream after all files are read."""
    root = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = result_log.read_log(spark, d, EVENT, "parquet", glob="events.parquet")
    result_log.live_counts(stream, ["event_type"], f"{root}/counts", f"{root}/progress").awaitTermination()
    return result_log.read_counts(spark, f"{root}/counts", ["event_type"])


def receipts(spark, d):
    """Orders as receipt JSON: one menu entry or a list of them, a total with thousands marks, a tax for some."""
    menu = F.transform(
        F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_quantity"))),
        lambda x: F.struct(F.concat(F.lit("part "), x["l_partkey"].cast("string")).alias("nm"), x["l_quantity"].cast("bigint").cast("string").alias("price")),
    )
    total = F.format_number(F.sum("l_quantity") * 1000, 0)
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        menu.alias("menu"), F.struct(total.alias("total_price")).alias("total"),
        F.struct(F.when(F.max("l_linestatus") == "F", "Rp 10.000").alias("tax_price")).alias("sub_total"),
    )
    many = F.to_json(F.struct("menu", "total", "sub_total"))
    one = F.to_json(F.struct(F.col("menu")[0].alias("menu"), F.array("total").alias("total"), "sub_total"))
    text = F.when(F.size("menu") == 1, one).otherwise(many)
    return per.select("l_orderkey", F.parse_json(text).alias("r"))


@query("""
SELECT l_orderkey, kind, count(*) AS n, sum(amount)::DOUBLE AS amount FROM (
  SELECT l_orderkey, 'menu_price' AS kind, l_quantity::BIGINT AS amount FROM lineitem
  UNION ALL SELECT l_orderkey, 'total_price', sum(l_quantity)::BIGINT * 1000 FROM lineitem GROUP BY l_orderkey
  UNION ALL SELECT l_orderkey, 'tax_price', 10000 FROM lineitem GROUP BY l_orderkey HAVING max(l_linestatus) = 'F') GROUP BY ALL""")
def receipt_pairs(spark, d):
    rows = fields.receipt_amounts(receipts(spark, d), "l_orderkey", "r")
    return rows.groupBy("l_orderkey", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query("""
SELECT l_orderkey, count(*) AS n_items, sum(l_quantity) AS item_total FROM lineitem GROUP BY l_orderkey""")
def receipt_items(spark, d):
    rows = fields.receipt_items(receipts(spark, d), "l_orderkey", "r")
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_items"), F.sum("price").alias("item_total"))


@query("""
SELECT l_orderkey, 'tax_price' AS field, CASE WHEN max(l_linestatus) = 'F' THEN 'A' ELSE 'B' END AS gold FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT DISTINCT l_orderkey, 'total_price', 'A' FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, 'cashprice', 'B' FROM lineitem""")
def receipt_field_presence(spark, d):
    return fields.field_presence(receipts(spark, d), "l_orderkey", "r", ["tax_price", "total_price", "cashprice"])


FROZEN = """
kc AS (SELECT l_orderkey, list(DISTINCT l_suppkey::VARCHAR ORDER BY l_suppkey::VARCHAR) AS opts, max(l_linestatus) AS st FROM lineitem GROUP BY l_orderkey),
kd AS (SELECT *, CASE WHEN len(opts) < 2 THEN 'fewer than two options' WHEN st = 'O' AND len(opts) = 2 THEN 'open pair' END AS reason FROM kc),
kg AS (SELECT l_orderkey, l_orderkey // 2 AS g, reason FROM kd WHERE reason IS NULL),
ks AS (SELECT g, row_number() OVER (ORDER BY sha256('7:30:' || g::VARCHAR)) AS rn FROM (SELECT DISTINCT g FROM kg))"""


def frozen_cases(spark, d):
    from casewright.plans import build

    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("opts"), F.max("l_linestatus").alias("st")
    )
    spec = build.CaseSpec(
        catalog_id=30, dataset="suppliers", track="orders", row_id=F.col("l_orderkey"), instructions=F.lit("Which supplier?"),
        options=F.col("opts"), gold_index=F.col("l_orderkey") % F.size("opts"), state=F.to_json(F.struct("l_orderkey")),
        group=F.floor(F.col("l_orderkey") / 2),
        rejects=[("fewer than two options", F.size("opts") < 2), ("open pair", (F.col("st") == "O") & (F.size("opts") == 2))],
    )
    return build.build_cases(li, spec)


@query(f"""
WITH {FROZEN}
SELECT '30:orders:' || l_orderkey::VARCHAR AS run_id, g::VARCHAR AS group_id FROM kg JOIN ks USING (g) WHERE rn <= 1500""")
def frozen_suite(spark, d):
    from casewright.plans import build

    cases, _ = frozen_cases(spark, d)
    return build.select_groups(cases, 7, case_cap=1500).select("run_id", "group_id")


@query(f"""
WITH {FROZEN}
SELECT reason, count(*) AS n FROM kd WHERE reason IS NOT NULL GROUP BY reason""")
def build_rejects(spark, d):
    _, rejected = frozen_cases(spark, d)
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT 'doc:' || doc_id::VARCHAR AS run_id, lang, CASE WHEN length(text) BETWEEN 20 AND 20000 THEN CASE WHEN length(text) > 800 THEN '1' ELSE '0' END END AS pred,
  quality::VARCHAR AS gold, CASE WHEN length(text) > 20000 THEN 'unsupported' WHEN length(text) < 20 THEN 'abstained' ELSE 'ok' END AS status
FROM documents JOIN labels USING (doc_id)""")
def scored_run(spark, d):
    """Typed cases through a predictor, its log parsed and joined back."""
    from casewright.plans import evaluate

    docs = table(spark, d, "documents").select("doc_id", "text").withColumn(
        "run_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    )
    cases = typed_cases(spark, d).withColumn("questions", F.slice("questions", 1, 1)).join(
        docs.select("run_id", F.to_json(F.struct("text")).alias("state")), "run_id"
    )
    log = inference.run(inference.request_json(cases), "by-length", ByLength, batch_key=None).withColumn("seq", F.lit(1))
    fact = evaluate.scored_fact(cases, log)
    return fact.select("run_id", F.col("catalog_id").alias("lang"), "pred", "gold", "status")


BY_LENGTH = "CASE WHEN length(text) > 20000 THEN 'unsupported' WHEN length(text) < 20 THEN 'abstained' ELSE 'ok' END"


@query(f"""
SELECT 'doc:' || doc_id::VARCHAR AS run_id, {BY_LENGTH} AS status, 1 AS records FROM documents""")
def resume_after_failure(spark, d):
    """A first run whose predictor cannot be set up leaves no record; the second takes everything up, the third nothing."""
    requests, log = quality_requests(spark, d), new_folder(spark, "log")
    try:
        inference.run_in_waves(requests, "by-length", Unbuildable, log, waves=2)
        raise AssertionError("the first run cannot end well")
    except PythonException:
        pass
    for _ in range(2):
        inference.run_in_waves(requests, "by-length", ByLength, log, waves=2)
    return inference.read_log(spark, log).groupBy("run_id").agg(F.max("status").alias("status"), F.count(F.lit(1)).cast("int").alias("records"))


@query(f"""
SELECT 'doc:' || doc_id::VARCHAR AS run_id, {BY_LENGTH} AS status FROM documents ORDER BY sha256('doc:' || doc_id::VARCHAR) LIMIT 100""")
def limited_waves(spark, d):
    """The hundred lowest hashes, in two waves; one event for each wave."""
    log, events = new_folder(spark, "log"), []
    inference.run_in_waves(quality_requests(spark, d), "by-length", ByLength, log, waves=2, limit=100, on_event=events.append)
    if [e["wave"] for e in events] != [0, 1]:
        raise AssertionError("an event for each wave")
    return inference.read_log(spark, log).select("run_id", "status")


@query("""
WITH k AS (SELECT doc_id, length(text) AS n, CASE WHEN doc_id % 7 = 0 AND length(text) <= 20000 THEN NULL ELSE doc_id // 10 END AS call FROM documents)
SELECT 'doc:' || doc_id::VARCHAR AS run_id, CASE WHEN call IS NOT NULL AND max(n) OVER (PARTITION BY call) > 20000 THEN 'error' WHEN n < 20 THEN 'abstained' ELSE 'ok' END AS status FROM k""")
def chunked_scoring(spark, d):
    """Calls of up to ten documents, and calls of documents without a key: a call that fails marks its own requests only."""
    asked = quality_requests(spark, d, F.length("text").alias("n"), F.col("doc_id"))
    key = F.when((F.col("doc_id") % 7 != 0) | (F.col("n") > 20_000), F.floor(F.col("doc_id") / 10))
    together = asked.withColumn("call", key).repartition("call")
    return inference.run(together, "whole", WholeCalls, batch_key="call").select("run_id", "status")


@query(f"""
SELECT 'doc:' || doc_id::VARCHAR AS run_id, {BY_LENGTH} AS status, true AS stopped_early FROM documents""")
def spread_failures(spark, d):
    """Errors in all tasks, in none of them as many as the limit, stop a wave; what is recorded stays and the rest is taken up."""
    requests, log, limit = quality_requests(spark, d).repartition(16), new_folder(spark, "log"), 40
    try:
        inference.run_in_waves(requests, "down", Unreachable, log, waves=1, stop_errors=limit, chunk=1)
        raise AssertionError("the run cannot end well")
    except inference.TooManyFailures:
        pass
    first = inference.read_log(spark, log).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "error").alias("e")).first()
    if first["n"] != first["e"] or first["e"] < limit:
        raise AssertionError("the errors that stopped the run are recorded")
    inference.run_in_waves(requests, "by-length", ByLength, log, waves=2)
    early = F.lit(first["n"] < requests.count())
    return results.latest(inference.read_log(spark, log), ["run_id"], "seq").select("run_id", "status", early.alias("stopped_early"))


@query("""
SELECT CASE WHEN doc_id % 10 IN (3, 7) THEN 'rejected' ELSE 'kept' END AS outcome, count(*) AS lines,
  sum(CASE WHEN doc_id % 10 NOT IN (3, 7) THEN n_chars END)::BIGINT AS chars FROM documents GROUP BY 1""")
def json_lines_roundtrip(spark, d):
    """Documents as JSON lines, some torn and some with text for a number, read back with their rejects."""
    docs, path = table(spark, d, "documents"), new_folder(spark, "lines")
    line = F.to_json(F.struct("doc_id", "lang", "n_chars"))
    mistyped = F.to_json(F.struct("doc_id", "lang", F.lit("many").alias("n_chars")))
    written = F.when(F.col("doc_id") % 10 == 3, mistyped).when(F.col("doc_id") % 10 == 7, F.expr("left(to_json(struct(doc_id, lang)), 9)")).otherwise(line)
    docs.select(written.alias("value")).write.text(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType())])
    good, bad = readers.json_lines(spark, path, schema, "rejects")
    kept = good.select(F.lit("kept").alias("outcome"), "n_chars")
    both = kept.unionByName(bad.select(F.lit("rejected").alias("outcome"), F.lit(None).cast("long").alias("n_chars")))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("lines"), F.sum("n_chars").alias("chars"))
