import math

import pytest
from pyspark.sql import functions as F

from casewright.functions import scoring
from casewright.operators import chance, metrics, retrieval
from casewright.plans import score


def pairs(spark, rows):
    return spark.createDataFrame([("k", g, p) for g, p in rows], "k string, gold string, pred string")


def test_conservative_f1_counts_missing_predictions(spark):
    df = pairs(spark, [("a", "a"), ("b", "b"), ("a", None), ("b", "a")])
    classes = spark.createDataFrame([("k", "a"), ("k", "b")], "k string, label string")
    got = metrics.conservative_f1(df, ["k"], classes, "gold", "pred").first()["conservative_f1"]
    a, b = 2 / (2 + 1 + 0 + 1), 2 / (2 + 0 + 1 + 1)
    assert got == pytest.approx((a + b) / 2)


def test_conservative_f1_of_one_class(spark):
    df = pairs(spark, [("yes", "yes"), ("no", "yes"), ("yes", None)])
    classes = spark.createDataFrame([("k", "yes")], "k string, label string")
    got = metrics.conservative_f1(df, ["k"], classes, "gold", "pred").first()["conservative_f1"]
    assert got == pytest.approx(2 / (2 + 1 + 0 + 1))


def test_macro_f1_takes_observed_labels(spark):
    got = metrics.macro_f1(pairs(spark, [("a", "a"), ("b", "c")]), ["k"], "gold", "pred").first()
    assert got["labels"] == 3 and got["macro_f1"] == pytest.approx(1 / 3)


def test_binary_f1(spark):
    got = metrics.binary_f1(pairs(spark, [("yes", "yes"), ("no", "yes"), ("yes", "no")]), ["k"]).first()
    assert got["f1"] == pytest.approx(0.5)
    assert metrics.binary_f1(pairs(spark, [("no", "no")]), ["k"]).first()["f1"] == 0.0


def test_review_f1(spark):
    rows = [("r1", "yes", "yes"), ("r1", "no", "yes"), ("r1", "no", "no"), ("r2", "no", "no"), ("r2", "no", "no")]
    df = spark.createDataFrame([(38, *r) for r in rows], "k int, g string, gold string, pred string")
    got = metrics.review_f1(df, ["k"], "g", F.col("gold") == "yes", F.col("pred") == "yes").first()
    assert got["review_f1"] == pytest.approx((2 / 3 + 1.0) / 2)


def test_ranking_scores(spark):
    cands = spark.createDataFrame([("q", "d1", 0.9), ("q", "d2", 0.5), ("q", "d3", 0.1), ("x", "d1", None)], "q string, d string, p double")
    qrels = spark.createDataFrame([("q", "d2", 1), ("x", "d1", 1)], "q string, d string, rel int")
    got = {r["q"]: r for r in retrieval.ranking_scores(cands, qrels, "q", "d", "p", "rel").collect()}
    assert got["q"]["valid"] and got["q"]["ndcg_at_10"] == pytest.approx(1 / math.log2(3)) and got["q"]["mrr"] == pytest.approx(0.5)
    assert not got["x"]["valid"] and got["x"]["ndcg_at_10"] is None
    base = retrieval.random_ndcg(cands.where("q = 'q'"), qrels, "q", "d", "rel").first()["random_ndcg"]
    assert base == pytest.approx((1 / 3) * sum(1 / math.log2(i + 2) for i in range(3)))


def test_outcome_value_consensus(spark):
    o = spark.createDataFrame([("c", "a", 1.0, 0.5), ("c", "b", 0.6, 0.01)], "c string, o string, q double, cost double")
    pick = spark.createDataFrame([("c", "a")], "c string, o string")
    free = metrics.outcome_scores(o, pick, "c", "o", "q", "cost", 0.0).first()
    paid = metrics.outcome_scores(o, pick, "c", "o", "q", "cost", 10.0).first()
    assert free["oracle_optimal"] and paid["utility_regret"] == pytest.approx((0.6 - 0.1) - (1.0 - 5.0))
    v = spark.createDataFrame([("c", "e", 0.6), ("c", "d", 0.6), ("c", "a", 0.1)], "c string, o string, v double")
    got = [metrics.reference_value_scores(v, spark.createDataFrame([("c", x)], "c string, o string"), "c", "o", "v").first() for x in "daz"]
    assert got[0]["best_choice"] and got[1]["value_regret"] == pytest.approx(0.5) and got[2]["value_regret"] == 1.0
    s = spark.createDataFrame([("c", "o0", 3, 3), ("c", "o1", 1, 3), ("c", "o2", 5, 3)], "c string, o string, s int, panel int")
    cons = metrics.consensus_scores(s, spark.createDataFrame([("c", "o2")], "c string, o string"), "c", "o", "s", "panel").first()
    assert cons["normalized_rank_regret"] == pytest.approx(4 / 6) and not cons["group_preferred"]


def test_forecast_and_skill(spark):
    row = spark.range(1).select(
        scoring.brier(F.lit(0.8), F.lit(1)).alias("b"), scoring.log_loss(F.lit(1.0), F.lit(0)).alias("l"),
        *[scoring.skill(F.lit(x), F.lit(b)).alias(f"s{i}") for i, (x, b) in enumerate(((0.5, 0.25), (0.1, 0.25), (1.5, 0.25)))],
    ).first()
    assert row["b"] == pytest.approx(0.04) and row["l"] == pytest.approx(-math.log(1e-15), rel=1e-3)
    assert (row["s0"], row["s1"], row["s2"]) == (pytest.approx(1 / 3), 0.0, 1.0)


def test_percentile_rules_match_sorted_lists(spark):
    import random
    import statistics

    rng = random.Random(3)
    data = {k: [rng.choice([1.0, 2.5, 2.5, 7.0, rng.random()]) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 37), ("d", 100))}
    df = spark.createDataFrame([(k, x) for k, xs in data.items() for x in xs], "k string, x double")
    rules = {"p50": metrics.nearest_rank(0.5), "p95": metrics.nearest_rank(0.95), "med": metrics.middle(), "fl": metrics.floor_index(0.95)}
    for r in metrics.exact_percentiles(df, ["k"], "x", rules).collect():
        xs = sorted(data[r["k"]])
        n = len(xs)
        assert r["n"] == n
        assert r["p50"] == xs[math.ceil(n * 0.5) - 1] and r["p95"] == xs[min(n - 1, math.ceil(n * 0.95) - 1)]
        assert r["med"] == pytest.approx(statistics.median(xs)) and r["fl"] == xs[int(0.95 * (n - 1))]


def test_softmax_and_ties(spark):
    inf = float("-inf")
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([inf, inf],)], "s array<double>")
    got = df.select(scoring.softmax(F.col("s")).alias("p"), scoring.first_max(F.col("s")).alias("i")).collect()
    assert sum(got[0]["p"]) == pytest.approx(1.0) and got[0]["i"] == 1 and got[1]["p"] == [0.5, 0.5]


def test_answer_checks(spark):
    rows = [
        ("choice", "a", {"a": 0.5, "b": 0.5}, None, None),
        ("choice", "c", {"a": 0.5, "b": 0.5}, None, "invalid chosen answer"),
        ("choice", "a", {"a": 1.0}, None, "incomplete or invalid probability distribution"),
        ("choice", "a", {"a": 0.5, "b": 0.4}, None, "incomplete or invalid probability distribution"),
        ("choice", "a", {"a": float("nan"), "b": 0.5}, None, "incomplete or invalid probability distribution"),
        ("noul", None, None, 0.3, None),
        ("noul", None, None, 1.3, "invalid yes-no probability"),
        ("score", None, None, 0.3, "unsupported question type"),
    ]
    df = spark.createDataFrame(rows, "t string, c string, p map<string,double>, n double, want string").withColumn("o", F.array(F.lit("a"), F.lit("b")))
    got = df.withColumn("r", scoring.invalid_reason(F.col("t"), F.col("o"), F.col("c"), F.col("p"), F.col("n"))).collect()
    assert [r["r"] for r in got] == [r["want"] for r in got]


def test_chances(spark):
    df = spark.createDataFrame([(1, "g", 4, "true"), (1, "g", 2, "false"), (1, "h", 2, "true"), (1, "h", 2, "false")], "k int, g string, n_options int, gold string")
    assert chance.expected_accuracy(df, ["k"]).first()["chance"] == pytest.approx((0.25 + 0.5 * 3) / 4)
    assert chance.whole_case(df, ["k"], "g").first()["chance"] == pytest.approx((0.125 + 0.25) / 2)
    assert chance.coin_f1(df, ["k"]).first()["chance"] == pytest.approx(0.5)
    assert chance.random_quality(df, ["k"], "g", "n_options").first()["chance"] == pytest.approx((3 + 2) / 2)


def test_added_report(spark):
    rows = [("r0", "ok", "A", "A", 1.0, 3.0), ("r1", "ok", "B", "A", 0.0, 5.0), ("r2", "unsupported", "A", None, None, None), ("r3", "pending", "B", None, None, None)]
    df = spark.createDataFrame([(57, *r, 4) for r in rows], "catalog_id int, run_id string, status string, gold string, pred string, hit double, ms double, n_options int")
    got = score.added_report(df, "ms").first()
    assert (got["score"], got["answered"], got["requests"], got["pending"], got["chance"], got["median_ms"]) == (0.5, 2, 4, 1, 0.25, 4.0)


def test_positive_class_report(spark):
    rows = [("true", "true"), ("false", "true"), ("true", "false"), ("false", "false")]
    df = spark.createDataFrame([(59, "ok", g, p) for g, p in rows], "catalog_id int, status string, gold string, pred string")
    got = score.positive_class_report(df, "true").first()
    assert got["score"] == pytest.approx(0.5) and got["chance"] == pytest.approx(0.5)


@pytest.mark.parametrize("limit", [100_000, 3])
def test_radix_selection_equals_sorting(spark, monkeypatch, limit):
    import random

    monkeypatch.setattr(metrics, "SORTED_VALUES", limit)
    monkeypatch.setattr(metrics, "PARTS", 4)
    rng = random.Random(4)
    groups = {
        "spread": [rng.lognormvariate(3, 2) for _ in range(300)],
        "close": [1e9 + rng.randint(0, 400) / 8 for _ in range(301)],
        "signs": [rng.gauss(0, 1) for _ in range(200)] + [0.0, -0.0],
        "hot": [5.0] * 400 + [rng.random() * 10 for _ in range(99)],
        "one": [2.5],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("spread", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    rules = {"p50": metrics.nearest_rank(0.5), "p95": metrics.nearest_rank(0.95), "mid": metrics.middle(), "low": metrics.floor_index(0.1)}
    got = {r["g"]: r for r in metrics.exact_percentiles(df, ["g"], "v", rules).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        x, n = sorted(vs), len(vs)
        want = (x[min(n, math.ceil(n * 0.5)) - 1], x[min(n, math.ceil(n * 0.95)) - 1], (x[(n + 1) // 2 - 1] + x[n // 2]) / 2, x[int(0.1 * (n - 1))])
        assert (got[g]["p50"], got[g]["p95"], got[g]["mid"], got[g]["low"]) == pytest.approx(want, rel=1e-12) and got[g]["n"] == n
