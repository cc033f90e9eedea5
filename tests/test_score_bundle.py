"""Summary, tracks and completion from one table of subtotals."""

from pyspark.sql import functions as F

from casewright.functions import skew
from casewright.operators import metrics, rollup
from casewright.plans import load_queries, score
from casewright.plans.registry import QUERIES
from tests.conftest import SF

load_queries()

FACT = "catalog_id int, group_id int, track string, status string, gold string, pred string, hit double"


def test_bundle_reads_no_row_after_its_subtotals(spark):
    plan = QUERIES["score_bundle"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and "sha2" not in plan


def rows_with_a_large_group(spark):
    """Three benchmarks of single rows, one group of a thousand rows in two labels, a null group and null statuses."""
    i = F.col("id")
    status = F.element_at(F.array(*[F.lit(s) for s in ("ok", "ok", "ok", "ok", "pending", "error", None)]), (i % 7 + 1).cast("int"))
    few = spark.range(3000).select((i % 3).cast("int").alias("catalog_id"), F.when(i > 9, i).cast("int").alias("group_id"), status.alias("status"), i.alias("x"))
    big = spark.range(1000).select(F.lit(1).alias("catalog_id"), F.lit(-1).alias("group_id"), F.lit("ok").alias("status"), (i + 1).alias("x"))
    ok = F.col("status") == "ok"
    return few.unionByName(big).select(
        "catalog_id", "group_id", "status", F.when(F.col("x") % 2 == 0, "F").alias("track"), F.lit("yes").alias("gold"),
        F.when(ok, F.when(F.col("x") % 3 == 0, "yes").otherwise("no")).alias("pred"), F.when(ok, (F.col("x") % 3 == 0).cast("double")).alias("hit"),
    ).withColumns({"gold_label": F.col("gold"), "pred_label": F.col("pred"), "cluster": F.lit("c"), "n_accepted": F.lit(1), "n_options": F.lit(2)})


def by_group(sub, dims):
    sums = [F.sum(c).alias(c) for c in ("n", "_hits", "_answered", "_share")]
    out = sub.groupBy("catalog_id", "group_id", *dims, "complete", "pending").agg(*sums, F.min("_all").alias("_all"), F.product("_guess").alias("_guess"))
    return sorted(map(tuple, out.collect()), key=repr)


def test_rows_as_their_own_subtotals(spark):
    rows, dims = rows_with_a_large_group(spark), ["track", "status", "gold", "pred"]
    measures = {
        "_hits": (F.sum, F.col("hit")), "_answered": (F.sum, F.col("hit").isNotNull().cast("bigint")), "_all": (F.min, F.col("hit")),
        "_share": (F.sum, F.col("n_accepted") / F.col("n_options")), "_guess": (F.product, 1.0 / F.col("n_options")),
    }
    aggs = [agg(value).alias(c) for c, (agg, value) in measures.items()]
    want = by_group(metrics.group_subtotals(rows, ["catalog_id"], "group_id", dims, *aggs), dims)
    assert len(skew.hot_values(rows, F.xxhash64("catalog_id", "group_id"), plain_rows=0)) == 1
    for plain in (0, 1_000_000):
        got = metrics.row_subtotals(rows, ["catalog_id"], "group_id", dims, measures, plain_rows=plain)
        assert by_group(got, dims) == want
    # The large group was counted, not carried row by row.
    cut = metrics.row_subtotals(rows, ["catalog_id"], "group_id", dims, measures, plain_rows=0)
    assert cut.where("group_id = -1").count() == 4


def test_summary_and_completion_from_subtotals(spark):
    rows = rows_with_a_large_group(spark)
    few = rollup.without_groups(rollup.track_subtotals(rows, ("status", "gold", "pred"), small_groups=True))
    want = score.summary(rows.withColumn("wall", F.lit(1.0)), "wall").drop("median_ms")
    got = score.summary_of(few).select(*want.columns)
    assert want.exceptAll(got).count() == got.exceptAll(want).count() == 0
    small = score.summary(rows.withColumn("wall", F.lit(1.0)), "wall", small_groups=True).drop("median_ms")
    assert want.exceptAll(small).count() == small.exceptAll(want).count() == 0
    numbered = rows.withColumn("run_id", F.concat_ws(":", F.monotonically_increasing_id(), F.col("group_id"))).localCheckpoint()
    plain = score.completion(numbered, numbered.where("status <> 'pending'"), ["catalog_id"])
    assert sorted(map(tuple, score.completion_of(few, ["catalog_id"]).collect())) == sorted(map(tuple, plain.collect()))


def test_completion_counts_each_request_once(spark):
    cases = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (2, "c"), (2, None)], "catalog_id int, run_id string")
    results = spark.createDataFrame([("a", "ok"), ("a", "error"), ("b", "ok"), (None, "ok"), ("z", "ok")], "run_id string, status string")
    got = {r["catalog_id"]: (r["expected"], r["recorded"], r["complete"]) for r in score.completion(cases, results, ["catalog_id"]).collect()}
    assert got == {1: (2, 2, True), None: (1, 1, True), 2: (2, 0, False)}
