"""Accepted answers, chunked calls, native metrics, linear interval sums and broadcast bounds."""

import json

import pytest
from pyspark.sql import functions as F

from casewright.functions import skew
from casewright.operators import audits, distractors, inference, intervals, joins
from casewright.plans import score
from casewright.plans.predictors import WholeCalls
from tests.test_running import ASKED


def test_no_accepted_answer_becomes_a_wrong_option(spark):
    rows = [(1, "p", ["red", "crimson"]), (2, "p", ["crimson"]), (3, "p", ["blue"]), (4, "p", ["green"]), (5, "p", ["dark red"])]
    got = distractors.peer_pools(spark.createDataFrame(rows, "id int, parent string, golds array<string>"), "parent", "id", "golds", k=2)
    found = {r["id"]: set(r["distractors"]) for r in got.collect()}
    assert found[1] == {"blue", "green"} and found[3] <= {"red", "crimson", "green", "dark red"} and len(found[3]) == 2
    plain = distractors.peer_pools(spark.createDataFrame([(i, "p", a[0]) for i, _, a in rows], "id int, parent string, gold string"), "parent", "id", "gold", k=2)
    assert plain.count() == 5


def test_a_failing_call_marks_only_its_chunk(spark):
    texts = ["a" * 30] * 3 + ["b" * 30_000] + ["c" * 40] * 4
    rows = [(f"r{i}", json.dumps({"text": t}), ASKED) for i, t in enumerate(texts)]
    asked = spark.createDataFrame(rows, "run_id string, state string, questions string").coalesce(1)
    for chunk, errors in ((2, 2), (4, 4), (100, 8)):
        got = inference.run(asked, "whole", WholeCalls, chunk=chunk)
        assert got.where("status = 'error'").count() == errors and got.count() == 8


def test_a_task_stops_after_errors_without_a_success(spark):
    class Broken(WholeCalls):
        def batch(self, payloads):
            raise RuntimeError("down")

    rows = [(f"r{i}", json.dumps({"text": "a" * 30}), ASKED) for i in range(20)]
    asked = spark.createDataFrame(rows, "run_id string, state string, questions string").coalesce(1)
    assert inference.run(asked, "down", Broken, chunk=3, stop_errors=5).count() == 6


@pytest.mark.parametrize("answer", [
    {"type": "noul", "noul": 0.5}, {"type": "choice", "choice": "9", "probabilities": {"0": 0.5, "1": 0.5}},
    {"type": "choice", "choice": "0", "probabilities": {"0": 0.5}}, {"type": "choice", "choice": "0", "probabilities": {"0": 0.9, "1": 0.9}},
    {"type": "choice", "choice": "0", "probabilities": {"0": float("nan"), "1": 1.0}}, {"type": "choice", "choice": "0"}, None, "text",
])
def test_answers_that_do_not_fit_are_errors(spark, answer):
    row = (json.dumps({"answers": {"q": answer}}), ASKED, "ok")
    log = spark.createDataFrame([row], "response string, questions string, status string")
    full = log.select(*[F.col(c) if c in log.columns else F.lit(None).cast("string").alias(c) for c in inference.LOG.names], "questions")
    got = inference.checked(full).first()
    assert got["status"] == "error" and got["error"] and got["response"] is None and got["exception"] == "InvalidAnswer"


def test_native_metric_of_each_benchmark(spark):
    rows = [
        (1, 1, "ok", "a", "a", 1.0, 0.5), (1, 1, "ok", "b", "a", 0.0, 0.7), (1, 2, "ok", "a", "a", 1.0, 0.1), (1, 3, "error", "a", None, None, None),
    ]
    fact = None
    for n in (1, 2, 3, 4):
        part = spark.createDataFrame(rows, "c int, group_id int, status string, gold_label string, pred_label string, hit double, value double").withColumn("catalog_id", F.lit(n))
        fact = part if fact is None else fact.unionByName(part)
    dim = spark.createDataFrame([(1, "accuracy"), (2, "macro_f1"), (3, "case_exact"), (4, "mean_value"), (5, "accuracy")], "catalog_id int, metric string")
    got = {r["catalog_id"]: r for r in score.native_scores(fact, dim).collect()}
    assert got[1]["score"] == pytest.approx(2 / 3) and got[2]["score"] == pytest.approx((0.8 + 0) / 2) and got[3]["score"] == 0.5
    assert got[4]["score"] == pytest.approx(1.3 / 3) and got[5]["score"] is None and (got[1]["answered"], got[1]["requests"]) == (3, 4)


def test_sums_within_reach(spark):
    import random

    rng = random.Random(1)
    rows = [(i, i % 3, rng.randint(0, 500), rng.choice([None, 0.1, 0.25, 7.5])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k int, at long, v double")
    got = {r["id"]: (r["near_rows"], r["near_sum"]) for r in intervals.overlap_stats(df, "k", "at", 40, "v", 100).collect()}
    for i, k, at, _ in rows:
        near = [v for _, k2, at2, v in rows if k2 == k and abs(at2 - at) <= 40]
        assert got[i] == (len(near), pytest.approx(sum(v or 0 for v in near)))


def test_wide_rows_are_not_broadcast(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    assert skew.small_enough(df, 100) and not skew.small_enough(df, 99) and not skew.small_enough(df, 100, 50_000)


def test_values_in_order_of_first_appearance(spark):
    rows = [(1, "b", 1), (1, "a", 2), (1, "b", 3), (1, "c", 0), (2, "a", 5)]
    got = joins.ordered_distinct(spark.createDataFrame(rows, "k int, v string, o int"), ["k"], "v", "o", "l")
    assert {r["k"]: r["l"] for r in got.collect()} == {1: ["c", "b", "a"], 2: ["a"]}


def test_corpus_checks(spark):
    rows = [("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), (None, "z"), ("c", None), ("d", " ")]
    got = {r["check"]: r["n"] for r in audits.corpus_checks(spark.createDataFrame(rows, "id string, body string"), "id", "body").collect()}
    assert got == {"documents": 7, "without_id": 1, "without_content": 2, "repeated_ids": 2, "conflicting_ids": 1}
