"""Evaluation-shaped tables derived from the given ones.

``order_cases``: one request per order line. The line number is the benchmark,
the order is the linked group, the line status is the track, the supplier is
the cluster. Gold and prediction come from price columns, the status of a
request from the hash of its id (1/20 each pending, error, unsupported and
abstained). ``doc_cases`` is the same idea over labelled documents.

The SQL next to each function is the same table as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import hashing
from casewright.plans.registry import table

def status_of(hash_mod):
    """Status by hash remainder; the hash is evaluated once."""
    listed = F.array(*[F.lit(x) for x in ("pending", "error", "unsupported", "abstained")])
    return F.coalesce(F.get(listed, hash_mod), F.lit("ok"))


def order_cases(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    run_id = F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    ok = F.col("status") == "ok"
    return (
        li.withColumn("run_id", run_id)
        .withColumn("status", status_of(hashing.hash_mod(hashing.sha(F.col("run_id")), 20)))
        .select(
            "run_id",
            F.col("l_linenumber").cast("bigint").alias("catalog_id"),
            F.col("l_orderkey").alias("group_id"),
            F.col("l_linestatus").alias("track"),
            F.col("l_suppkey").alias("cluster"),
            F.col("l_returnflag").alias("field"),
            "status",
            F.when(F.col("l_discount") >= 0.05, "yes").otherwise("no").alias("gold"),
            F.when(ok, F.when(F.col("l_tax") >= 0.04, "yes").otherwise("no")).alias("pred"),
            F.col("l_returnflag").alias("gold_label"),
            F.when(
                ok, F.when(F.col("l_quantity") < 17, "A").when(F.col("l_quantity") < 34, "N").otherwise("R")
            ).alias("pred_label"),
            (F.col("l_partkey") % 4 + 2).alias("n_options"),
            (F.col("l_suppkey") % 2 + 1).alias("n_accepted"),
            F.when(ok, F.col("l_extendedprice")).alias("wall_ms"),
            F.when(ok, F.col("l_quantity")).alias("tokens"),
        )
        .withColumn("hit", F.when(ok, (F.col("gold") == F.col("pred")).cast("double")))
    )


ORDER_CASES = """
o0 AS (
  SELECT *, l_orderkey::VARCHAR || ':' || l_linenumber::VARCHAR || ':' || l_partkey::VARCHAR || ':' || l_suppkey::VARCHAR AS run_id
  FROM lineitem
), o1 AS (
  SELECT *, CASE ('0x' || substr(sha256(run_id), 1, 8))::BIGINT % 20
    WHEN 0 THEN 'pending' WHEN 1 THEN 'error' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'abstained' ELSE 'ok' END AS status
  FROM o0
), o2 AS (
  SELECT run_id, l_linenumber::BIGINT AS catalog_id, l_orderkey AS group_id, l_linestatus AS track,
    l_suppkey AS cluster, l_returnflag AS field, status,
    CASE WHEN l_discount >= 0.05::DOUBLE THEN 'yes' ELSE 'no' END AS gold,
    CASE WHEN status = 'ok' THEN CASE WHEN l_tax >= 0.04::DOUBLE THEN 'yes' ELSE 'no' END END AS pred,
    l_returnflag AS gold_label,
    CASE WHEN status = 'ok' THEN CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END END AS pred_label,
    l_partkey % 4 + 2 AS n_options, l_suppkey % 2 + 1 AS n_accepted,
    CASE WHEN status = 'ok' THEN l_extendedprice END AS wall_ms,
    CASE WHEN status = 'ok' THEN l_quantity END AS tokens
  FROM o1
), cases AS (
  SELECT *, CASE WHEN status = 'ok' THEN CASE WHEN gold = pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS hit FROM o2
), gs AS (
  SELECT catalog_id, group_id, bool_and(status = 'ok') AS complete, bool_or(status IN ('pending', 'error')) AS pending
  FROM cases GROUP BY catalog_id, group_id
), done AS (
  SELECT c.* FROM cases c JOIN gs USING (catalog_id, group_id) WHERE complete
)"""


def doc_cases(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, d, "labels")
    run_id = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    return (
        docs.join(labels, "doc_id")
        .withColumn("run_id", run_id)
        .withColumn("status", status_of(hashing.hash_mod(hashing.sha(F.col("run_id")), 20)))
        .withColumn("group_id", F.floor(F.col("doc_id") / 3))
        .withColumn("gold", F.col("quality").cast("string"))
        .withColumn("pred", F.when(F.col("status") == "ok", F.when(F.col("n_chars") > 800, "1").otherwise("0")))
    )


DOC_CASES = """
d0 AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, 'doc:' || d.doc_id::VARCHAR AS run_id
  FROM documents d JOIN labels l USING (doc_id)
), d1 AS (
  SELECT *, CASE ('0x' || substr(sha256(run_id), 1, 8))::BIGINT % 20
    WHEN 0 THEN 'pending' WHEN 1 THEN 'error' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'abstained' ELSE 'ok' END AS status,
    doc_id // 3 AS group_id, quality::VARCHAR AS gold
  FROM d0
), dcases AS (
  SELECT *, CASE WHEN status = 'ok' THEN CASE WHEN n_chars > 800 THEN '1' ELSE '0' END END AS pred FROM d1
)"""
