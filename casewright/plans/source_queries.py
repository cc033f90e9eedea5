"""Given tables written through the sinks and read back through the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.functions import scoring
from casewright.operators import inference, results
from casewright.plans import evaluate, score, spec
from casewright.plans.predictors import ByLength, Uniform
from casewright.plans.registry import query, table
from casewright.plans.run_queries import quality_requests, typed_cases
from casewright.session import checkpoint_dir
from casewright.sources import readers, sinks


def folder(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""
SELECT c_custkey::VARCHAR AS c_custkey, c_mktsegment || ' "' || c_name || '",' || chr(10) || 'end' AS note FROM customer""")
def csv_roundtrip(spark, d):
    """Quotes, commas and line breaks inside fields."""
    path = folder(spark, "csv")
    note = F.concat("c_mktsegment", F.lit(' "'), "c_name", F.lit('",\nend'))
    table(spark, d, "customer").select("c_custkey", note.alias("note")).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return readers.csv(spark, path)


@query("""
SELECT o_orderkey::VARCHAR AS text, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority[1:1] || '|' || o_orderstatus END AS pair FROM orders""")
def tab_tuples_roundtrip(spark, d):
    """Four-part tuples after a text; lines with a three-part one come back as rejects."""
    path = folder(spark, "tsv")
    four = F.concat_ws(" ", F.lit("a"), F.left("o_orderpriority", F.lit(1)), "o_orderstatus", F.lit("z"))
    line = F.concat_ws("\t", F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "P", "a b c").otherwise(four))
    table(spark, d, "orders").select(line.alias("value")).write.text(path)
    good, bad = readers.tab_tuples(spark, path)
    kept = good.select("text", F.element_at("pairs", 1).alias("pair"))
    return kept.unionByName(bad.select(F.split("value", "\t")[0].alias("text"), F.lit(None).cast("string").alias("pair")))


@query("""
SELECT 'kept' AS outcome, count(*) AS n, sum(c_acctbal)::DOUBLE AS balance FROM customer WHERE c_custkey % 10 NOT IN (3, 7)
UNION ALL SELECT 'rejected', count(*), NULL FROM customer WHERE c_custkey % 10 IN (3, 7)""")
def typed_csv_rejects(spark, d):
    """CSV rows by a stated schema: rows with a text for a number and rows with a field too few come back as rejects."""
    path = folder(spark, "csv")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), "c_name", F.lit('"')), F.when(F.col("c_custkey") % 10 == 3, "much").otherwise(F.col("c_acctbal").cast("string")))
    short = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name")
    rows = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 10 == 7, short).otherwise(line).alias("key,name,balance"))
    # The header is the name of the only column; lines are written as they are.
    rows.write.option("header", True).option("quote", "").option("sep", "\t").csv(path)
    good, bad = readers.csv(spark, path, T.StructType.fromDDL("key bigint, name string, balance decimal(15,2)"), "rejects")
    kept = good.select(F.lit("kept").alias("outcome"), F.col("balance").cast("double").alias("balance")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("balance").alias("balance"))
    lost = bad.select(F.lit("rejected").alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("balance"))
    return kept.unionByName(lost)


@query("""
SELECT o_custkey, count(*) AS orders, max(o_orderstatus) AS status FROM orders WHERE o_custkey % 16 <> 5 GROUP BY o_custkey
UNION ALL SELECT -1, count(DISTINCT o_custkey % 16), 'rejected' FROM orders WHERE o_custkey % 16 = 5 HAVING count(*) > 0""")
def json_documents_roundtrip(spark, d):
    """Customers with their orders as nested JSON, an array of documents over many lines in each file; a file cut short is rejected."""
    path = folder(spark, "json")
    one = F.struct("o_orderkey", F.struct(F.col("o_orderstatus").alias("status")).alias("state"))
    documents = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(one).alias("orders"))
    # A line each, with brackets around the lines of a file and commas between them.
    in_file = Window.partitionBy("part").orderBy("o_custkey")
    text = F.to_json(F.struct("o_custkey", "orders"))
    placed = documents.withColumn("part", (F.col("o_custkey") % 16).cast("int")).select(
        "part", "o_custkey", F.concat(F.when(F.row_number().over(in_file) == 1, "[").otherwise(","), F.lit("\n"), text,
        F.when(F.lead("o_custkey").over(in_file).isNull() & (F.col("part") != 5), "\n]").otherwise("")).alias("value"))
    placed.repartition(16, "part").sortWithinPartitions("part", "o_custkey").select("part", "value").write.partitionBy("part").text(path)
    schema = T.StructType.fromDDL("o_custkey bigint, orders array<struct<o_orderkey:bigint,state:struct<status:string>>>")
    good, bad = readers.json_documents(spark, f"{path}/part=*", schema, "rejects")
    kept = good.select("o_custkey", F.size("orders").cast("bigint").alias("orders"), F.array_max(F.transform("orders", lambda o: o["state"]["status"])).alias("status"))
    files = bad.agg(F.count(F.lit(1)).alias("orders")).where("orders > 0")
    return kept.unionByName(files.select(F.lit(-1).cast("bigint").alias("o_custkey"), "orders", F.lit("rejected").alias("status")))


@query("""
SELECT event_id, arg_max(event_type, pass) AS pred FROM (SELECT event_id, event_type, 1 AS pass FROM events WHERE event_type <> 'error'
  UNION ALL SELECT event_id, 'late', 2 FROM events WHERE event_id % 3 = 0) GROUP BY event_id""")
def prediction_files(spark, d):
    """A folder of prediction files, each ending in a torn line; the last record that has a prediction wins."""
    path = folder(spark, "predictions")
    e = table(spark, d, "events")
    first = e.select("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("pred"))
    late = e.where("event_id % 3 = 0").select("event_id", F.lit("late").alias("pred"))
    for name, part in (("a", first), ("b", late)):
        # Each file is a few whole lines, then the beginning of one without a line feed.
        lined = part.withColumn("file", F.pmod(F.xxhash64("event_id"), F.lit(8))).groupBy("file").agg(
            F.concat(F.array_join(F.collect_list(F.to_json(F.struct("event_id", "pred"))), "\n"), F.lit('\n{"event_id": 12')).alias("value"))
        lined.write.partitionBy("file").option("lineSep", "~").text(f"{path}/run={name}")
    schema = T.StructType.fromDDL("event_id bigint, pred string")
    back = readers.predictions(spark, path, schema, complete_lines=True, glob="*.txt")
    return results.latest_prediction(back, ["event_id"]).where("pred IS NOT NULL").select("event_id", "pred")


@query("""
SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey % 3 <> 1 OR c_custkey % 2 = 0 GROUP BY c_mktsegment
UNION ALL SELECT 'rejected', count(*) FROM customer WHERE c_custkey % 3 = 1 AND c_custkey % 2 <> 0""")
def suite_row_files(spark, d):
    """Base, added and replacement files as one relation; mistyped lines of the added ones come back."""
    path, c = folder(spark, "suite"), table(spark, d, "customer")
    row = F.to_json(F.struct("c_custkey", "c_mktsegment"))
    bad = F.to_json(F.struct(F.lit("none").alias("c_custkey"), "c_mktsegment"))
    for k, name in enumerate(("base", "added", "replaced")):
        value = F.when((F.lit(k) == 1) & (F.col("c_custkey") % 2 != 0), bad).otherwise(row)
        c.where(F.col("c_custkey") % 3 == k).select(value.alias("value")).write.text(f"{path}/{name}")
    good, bad_lines = readers.suite_rows(spark, [f"{path}/{n}" for n in ("base", "added", "replaced")], T.StructType.fromDDL("c_custkey bigint, c_mktsegment string"), "rejects")
    kept = good.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return kept.unionByName(bad_lines.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rejected").alias("c_mktsegment"), "n"))


@query("""
SELECT l_returnflag AS catalog_id, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY ALL""")
def partitioned_rows(spark, d):
    """Case rows by benchmark folder, and by the one-off conversion."""
    path = folder(spark, "rows")
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("catalog_id"), F.col("l_orderkey").alias("group_id"), "l_quantity")
    sinks.rows(li.where("l_quantity <= 25"), f"{path}/a")
    sinks.to_parquet(li.where("l_quantity > 25"), f"{path}/b")
    both = readers.parquet(spark, f"{path}/a").unionByName(readers.parquet(spark, f"{path}/b"))
    return both.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("double").alias("quantity"))


@query("""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'again' ELSE event_type END AS status FROM events""")
def appended_log(spark, d):
    """A log appended twice; compacted, and the last record of each run."""
    path = folder(spark, "log")
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("status"), F.lit(1).alias("seq"), F.col("props").alias("raw_output"))
    sinks.append_results(e, path)
    sinks.append_results(e.where("event_id % 2 = 0").withColumns({"status": F.lit("again"), "seq": F.lit(2)}), path)
    log = results.compact(spark.read.parquet(path).withColumn("run_id", F.col("event_id").cast("string")))
    if "raw_output" in log.columns:
        raise AssertionError("raw output stays out of a compact log")
    return results.latest(log, ["run_id"]).select(F.col("run_id").cast("bigint").alias("event_id"), "status")


@query("""
SELECT p_brand AS brand, count(*) AS n, round(avg(p_retailprice), 4) + 0.0 AS price FROM part GROUP BY p_brand""")
def exported_run(spark, d):
    """Three reports side by side, read back."""
    summary = table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("price"))
    shown = summary.withColumn("price", scoring.rounded(F.col("price")))
    paths = sinks.export_run(shown.select("brand", "n"), shown.select("brand", "price"), shown.select("brand"), folder(spark, "export"), "one")
    n = readers.json_lines(spark, paths["benchmark-summary"], T.StructType.fromDDL("brand string, n bigint"))
    price = readers.json_lines(spark, paths["index"], T.StructType.fromDDL("brand string, price double"))
    return n.join(price, "brand").join(readers.json_lines(spark, paths["scores"], T.StructType.fromDDL("brand string")), "brand")


@query("""
SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders""")
def sorted_export(spark, d):
    """A total order over all files: place follows from file name and line."""
    path = folder(spark, "sorted")
    sinks.export_sorted(table(spark, d, "orders").select("o_totalprice", "o_orderkey"), path, ["o_totalprice", "o_orderkey"])
    lines = spark.read.schema("o_totalprice double, o_orderkey bigint").json(path).withColumn("file", F.col("_metadata.file_name"))
    held = lines.groupBy("file").agg(F.min(F.struct("o_totalprice", "o_orderkey")).alias("low"), F.max(F.struct("o_totalprice", "o_orderkey")).alias("high"), F.count(F.lit(1)).alias("n"))
    files = held.orderBy("file").collect()  # one row per file of the export
    if any(a["high"] > b["low"] for a, b in zip(files, files[1:], strict=False)):
        raise AssertionError("files overlap")
    before, at = {}, 0
    for f in files:
        before[f["file"]], at = at, at + f["n"]
    starts = spark.createDataFrame(list(before.items()), "file string, before bigint")
    from pyspark.sql import Window

    ranked = lines.join(F.broadcast(starts), "file").withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("o_totalprice", "o_orderkey")))
    return ranked.select("o_orderkey", (F.col("before") + F.col("r")).alias("place"))


@query("""
SELECT 'doc:' || doc_id::VARCHAR AS run_id, 'ok' AS status FROM documents""")
def keyed_calls(spark, d):
    """Calls that never mix two languages, by a predictor loaded by its name, with a record of the run."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("run_id"), "lang")
    predictor = inference.load_predictor("casewright.plans.predictors:Uniform")
    done = inference.run(quality_requests(spark, d).join(docs, "run_id"), "uniform", predictor, batch_key="lang")
    record = inference.run_record(spark, "uniform", {"seed": 1}, None).select(F.col("engine").alias("_e"))
    return done.join(F.broadcast(record), done["engine"] == F.col("_e")).select("run_id", "status")


@query("""
SELECT lang, count(*) AS requests, round(avg((quality = 0)::INT), 6) AS quality_right FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def evaluated_log(spark, d):
    """Labelled documents through a predictor, from cases to scored fields by the log."""
    cases, path = typed_cases(spark, d).withColumn("state", F.lit("{}")), folder(spark, "log")
    inference.run_in_waves(inference.request_json(cases), "uniform", Uniform, path, waves=2)
    fact = evaluate.scored_fact(cases, inference.read_log(spark, path)).where("field = 'quality'")
    return fact.groupBy(F.col("catalog_id").alias("lang")).agg(F.count(F.lit(1)).alias("requests"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("quality_right"))


EDITION = """
fa AS (SELECT CASE lang WHEN 'en' THEN 57 WHEN 'fr' THEN 5 WHEN 'de' THEN 9 ELSE 36 END AS catalog_id, doc_id // 3 AS g, n_chars % 7 <> 0 AS ok,
  quality::VARCHAR AS gold, CASE WHEN n_chars % 7 <> 0 THEN (n_chars > 800)::INT::VARCHAR END AS pred, (n_chars % 100) / 100.0::DOUBLE AS value FROM documents JOIN labels USING (doc_id)),
st AS (SELECT *, bool_and(ok) OVER (PARTITION BY catalog_id, g) AS done FROM fa),
lb AS (SELECT catalog_id, label, sum(tp) AS tp, sum(gn) AS gn, sum(pn) AS pn FROM (SELECT catalog_id, gold AS label, (gold = pred)::INT AS tp, 1 AS gn, 0 AS pn FROM st WHERE done
  UNION ALL SELECT catalog_id, pred, 0, 0, 1 FROM st WHERE done) GROUP BY ALL),
mf AS (SELECT catalog_id, avg(2.0::DOUBLE * tp / (gn + pn)) AS macro FROM lb GROUP BY catalog_id),
ce AS (SELECT catalog_id, avg(right_all) AS exact FROM (SELECT catalog_id, g, min((gold = pred)::INT)::DOUBLE AS right_all FROM st WHERE done GROUP BY ALL) GROUP BY catalog_id),
bs AS (SELECT catalog_id, count(*) AS requests, count(*) FILTER (ok) AS answered, avg((gold = pred)::INT) FILTER (done) AS accuracy, avg(value) FILTER (done) AS mean_value FROM st GROUP BY catalog_id),
nt AS (SELECT catalog_id, answered / requests::DOUBLE AS cov, CASE catalog_id WHEN 57 THEN accuracy WHEN 5 THEN macro WHEN 9 THEN exact ELSE mean_value END AS score
  FROM bs LEFT JOIN mf USING (catalog_id) LEFT JOIN ce USING (catalog_id)),
ch AS (SELECT unnest([57, 5, 9]) AS catalog_id, unnest([0.1109::DOUBLE, 0.006, 0.0]) AS chance, unnest(['added', 'display', 'display']) AS rule),
rw AS (SELECT catalog_id, rule, chance, cov, score, CASE rule WHEN 'added' THEN round(score * cov, 4) ELSE round(score, 4) * cov END AS raw FROM nt JOIN ch USING (catalog_id))"""


def edition_fact(spark, d):
    """Labelled documents as four benchmarks, one for each native metric."""
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    ok = F.col("n_chars") % 7 != 0
    number = F.when(F.col("lang") == "en", 57).when(F.col("lang") == "fr", 5).when(F.col("lang") == "de", 9).otherwise(36)
    gold, pred = F.col("quality").cast("string"), F.when(ok, (F.col("n_chars") > 800).cast("int").cast("string"))
    return j.select(
        number.alias("catalog_id"), F.floor(F.col("doc_id") / 3).alias("group_id"), F.when(ok, "ok").otherwise("error").alias("status"), gold.alias("gold_label"),
        pred.alias("pred_label"), F.when(ok, (gold == pred).cast("double")).alias("hit"), (F.col("n_chars") % 100 / 100).alias("value"),
    )


@query(f"""
WITH {EDITION}
SELECT catalog_id, round(raw, 6) AS raw, round(CASE rule WHEN 'added' THEN round(greatest(0, (raw - chance) / (1 - chance)), 4) ELSE greatest(0, (raw - chance) / (1 - chance)) END, 6) AS skill, round(cov, 6) AS coverage FROM rw
UNION ALL SELECT 36, 0.0, 0.0, 0.0""")
def edition_values(spark, d):
    """Labelled documents as four benchmarks of an edition, each by its own metric; the one scored by track has no tracks."""
    fact = edition_fact(spark, d)
    values, _ = score.edition_report(fact, spec.dim_benchmark(spark, spec.EDITIONS["0.3"]))
    return values.where("catalog_id IN (57, 5, 9, 36)").select("catalog_id", *[F.round(c, 6).alias(c) for c in ("raw", "skill", "coverage")])


@query(f"""
WITH {EDITION}
SELECT metric, count(*) AS benchmarks, count(*) FILTER (catalog_id IN (SELECT catalog_id FROM fa)) AS run, round(max(score), 6) AS best FROM (
  SELECT unnest([5, 9, 36, 57]) AS catalog_id, unnest(['macro_f1', 'case_exact', 'mean_value', 'accuracy']) AS metric) LEFT JOIN nt USING (catalog_id) GROUP BY metric""")
def native_metrics(spark, d):
    """The four native scores, before rules and chance."""
    fact = edition_fact(spark, d)
    dim = spec.dim_benchmark(spark, spec.EDITIONS["0.3"]).where("catalog_id IN (57, 5, 9, 36)")
    scores = score.native_scores(fact, dim)
    return scores.groupBy("metric").agg(F.count(F.lit(1)).alias("benchmarks"), F.count_if(F.col("requests") > 0).alias("run"), F.round(F.max("score"), 6).alias("best"))


@query("""
WITH fa AS (SELECT CASE lang WHEN 'en' THEN 57 WHEN 'fr' THEN 31 WHEN 'de' THEN 6 ELSE 45 END AS catalog_id, doc_id, doc_id // 3 AS g, length(text) BETWEEN 20 AND 20000 AS ok,
  quality::VARCHAR AS gold, CASE WHEN length(text) > 800 THEN '1' ELSE '0' END AS pred FROM documents JOIN labels USING (doc_id)),
st AS (SELECT *, bool_and(ok) OVER (PARTITION BY catalog_id, g) AS done FROM fa),
nt AS (SELECT catalog_id, count(*) FILTER (ok) / count(*)::DOUBLE AS cov, avg((gold = pred)::INT) FILTER (done) AS score FROM st GROUP BY catalog_id),
tr AS (SELECT catalog_id,
    avg(CASE WHEN NOT done THEN 0 WHEN catalog_id = 31 THEN (gold = pred OR doc_id % 3 = 0)::INT WHEN pred = '1' THEN (doc_id % 10) / 10.0::DOUBLE ELSE 0.25 END) AS raw,
    avg(CASE WHEN catalog_id = 31 THEN CASE WHEN doc_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.5 END ELSE ((doc_id % 10) / 10.0::DOUBLE + 0.25) / 2 END) AS chance FROM st WHERE catalog_id IN (31, 6) GROUP BY catalog_id),
tc AS (SELECT catalog_id, avg(done::INT) AS cov FROM (SELECT DISTINCT catalog_id, g, done FROM st) GROUP BY catalog_id)
SELECT catalog_id, round(round(raw, 4), 6) AS raw, round(round(greatest(0, least(1, (raw - chance) / (1 - chance))), 4), 6) AS skill, round(round(tc.cov, 4), 6) AS coverage FROM tr JOIN tc USING (catalog_id)
UNION ALL SELECT 57, round(score * cov, 4), round(greatest(0, (round(score * cov, 4) - 0.1109) / (1 - 0.1109::DOUBLE)), 4), round(cov, 6) FROM nt WHERE catalog_id = 57
UNION ALL SELECT 45, round(round(score, 4) * cov, 6), round(greatest(0, (round(score, 4) * cov - 0.1641) / (1 - 0.1641::DOUBLE)), 6), round(cov, 6) FROM nt WHERE catalog_id = 45""")
def edition_from_log(spark, d):
    """Four benchmarks of an edition from their result log: added, shown, by track with ties, and routes by quality."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang").join(table(spark, d, "labels"), "doc_id")
    option = lambda k, v: F.struct(F.lit(k).alias("option"), F.lit(v).alias("descr"))
    asked = F.struct(F.lit("quality").alias("key"), F.lit("choice").alias("type"), F.lit("Is it good text?").alias("instructions"), F.array(option("0", "poor"), option("1", "good")).alias("criteria"))
    gold, both = F.col("quality").cast("string"), F.array(F.lit("0"), F.lit("1"))
    number = F.when(F.col("lang") == "en", 57).when(F.col("lang") == "fr", 31).when(F.col("lang") == "de", 6).otherwise(45)
    cases = docs.select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("run_id"), number.alias("catalog_id"), F.floor(F.col("doc_id") / 3).cast("string").alias("group_id"),
        F.lit("t").alias("track"), F.to_json(F.struct("text")).alias("state"), F.array(asked).alias("questions"), F.create_map(F.lit("quality"), gold).alias("expected"),
        F.when(F.col("lang") == "fr", F.create_map(F.lit("quality"), F.when(F.col("doc_id") % 3 == 0, both).otherwise(F.array(gold)))).alias("accepted"),
        F.when(F.col("lang") == "de", F.create_map(F.lit("0"), F.lit(0.25), F.lit("1"), F.col("doc_id") % 10 / 10)).alias("outcomes"),
    )
    dim = spec.dim_benchmark(spark, spec.EDITIONS["0.2"])
    values, _ = evaluate.evaluate_edition(cases, dim, "by-length", ByLength, folder(spark, "log"), 2)
    return values.where("catalog_id IN (57, 31, 6, 45)").select("catalog_id", *[F.round(c, 6).alias(c) for c in ("raw", "skill", "coverage")])
