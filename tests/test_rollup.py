import pytest
from pyspark.sql import functions as F

from casewright.operators import ordering, rollup
from casewright.plans import score, spec
from tests import golden


def entrant_values(spark, edition):
    dim = spec.dim_benchmark(spark, spec.EDITIONS[edition]).where("in_index")
    rows = [(n, *v) for n, v in golden.ENTRANT_02.items()]
    board = spark.createDataFrame(
        [(r[0], float(r[1]), float(r[2]), float(r[3]), r[4], r[5], r[6]) for r in rows],
        "catalog_id int, raw double, skill double, coverage double, score double, answered long, requests long",
    )
    native = board.select("catalog_id", "score", "answered", "requests")
    return rollup.benchmark_values(dim, native, board.select("catalog_id", "raw", "skill", "coverage")), board


def test_published_index_is_reproduced(spark):
    values, board = entrant_values(spark, "0.2")
    got = score.index_of(values).first().asDict()
    for name, want in golden.SCORES_02.items():
        assert got[name] == pytest.approx(want, abs=0.01)
    both = values.alias("v").join(board.alias("b"), "catalog_id")
    off = both.where("abs(v.raw - b.raw) > 1.5e-4 or abs(v.skill - b.skill) > 1.5e-4")
    assert off.count() == 0


def test_definitions_are_consistent(spark):
    for edition, n in (("0.2", 40), ("0.2.1", 38), ("0.3", 37)):
        dim = spec.dim_benchmark(spark, spec.EDITIONS[edition])
        counted = dim.where("in_index")
        assert counted.count() == counted.select("catalog_id").distinct().count() == n
        assert counted.where("chance is null").count() == 0


def test_area_weights_by_square_root(spark):
    dim = spec.dim_benchmark(spark, spec.EDITIONS["0.2.1"]).where("in_index")
    areas = dim.groupBy("area_id").agg(F.count(F.lit(1)).alias("n_benchmarks"), F.max("fixed").alias("fixed"))
    w = {r["area_id"]: r["area_weight"] for r in rollup.area_weights(areas).collect()}
    assert sum(w.values()) == pytest.approx(1.0)
    assert {k: round(v, 6) for k, v in w.items()} == {
        "knowledge": 0.258494, "language": 0.258494, "retrieval": 0.200229, "tools": 0.182783, "arts": 0.1,
    }
    plain = areas.withColumn("fixed", F.lit(None).cast("double"))
    assert {round(r["area_weight"], 9) for r in rollup.area_weights(plain).collect()} == {0.2}


def test_published_form_gives_the_same_table(spark):
    s = spec.EDITIONS["0.3"]
    published = {
        "areas": [{"id": a, "benchmarks": ids} for a, ids in s["areas"].items()],
        "area_sizing": {"fixed": s["fixed"]}, "gold": {str(n): 1.2 for n in s["gold"]},
        "track_scored": s["track_scored"], "added": {str(n): {} for n in s["added"]}, "loss_rules": {},
        "chance": {str(n): {"chance": c} for n, c in s["chance"].items()},
        "not_in_index": [{"id": n} for n in s["shown"]], "tie": s["tie"],
    }
    a = spec.dim_benchmark(spark, s)
    b = spec.dim_benchmark(spark, spec.from_published(published))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_gold_weighs_inside_its_area_only(spark):
    dim = spec.dim_benchmark(spark, spec.EDITIONS["0.2.1"]).where("in_index")
    one = F.when(F.col("catalog_id") == 4, 1.0).otherwise(0.0)
    values = dim.withColumns({"raw": one, "skill": one, "coverage": F.lit(1.0)})
    areas = rollup.area_scores(values)
    retrieval = areas.where("area_id = 'retrieval'").first()
    assert retrieval["skill"] == pytest.approx(1.2 / (1.2 * 3 + 3))
    assert score.index_of(values).first()["balanced_skill"] == pytest.approx(100 * 0.200229 * retrieval["skill"], abs=1e-4)


def value_of(spark, rule, score_value, answered, requests, chance, baseline=None, best=None):
    dim = spark.createDataFrame(
        [(1, rule, chance, baseline, best)], "catalog_id int, rule string, chance double, baseline double, best double"
    )
    native = spark.createDataFrame([(1, score_value, answered, requests)], "catalog_id int, score double, answered long, requests long")
    tracks = spark.createDataFrame([], "catalog_id int, raw double, skill double, coverage double")
    return rollup.benchmark_values(dim, native, tracks).first()


def test_rules(spark):
    v = value_of(spark, "display", 0.8, 50, 100, 0.5)
    assert (v["raw"], v["skill"]) == (pytest.approx(0.4), 0.0)
    assert value_of(spark, "display", 0.9, 100, 100, 0.25)["skill"] == pytest.approx((0.9 - 0.25) / 0.75)
    assert value_of(spark, "display", None, 0, 100, 0.25)["skill"] == 0.0
    for s, n, want in ((0.25, 10, 0.0), (0.0, 10, 1.0), (0.2, 5, (0.25 - 0.2) / 0.25 * 0.5), (0.4, 10, 0.0)):
        assert value_of(spark, "loss", s, n, 10, 0.0, 0.25, 0.0)["skill"] == pytest.approx(want)
    v = value_of(spark, "added", 0.5, 2, 4, 0.25)
    assert (v["raw"], v["skill"]) == (pytest.approx(0.25), 0.0)
    assert value_of(spark, "added", None, 0, 2, 0.5)["skill"] == 0.0


def test_chain_ranks(spark):
    board = spark.createDataFrame([("a", 30.0), ("b", 29.8), ("c", 29.6), ("d", 29.0), ("e", None)], "entrant string, score double")
    got = {r["entrant"]: (r["rank"], r["tied"]) for r in ordering.chain_ranks(board, "entrant", "score", 0.25).collect()}
    assert got == {"a": (1, True), "b": (1, True), "c": (1, True), "d": (4, False)}


def test_unanswered_rows_count_as_wrong(spark):
    rows = spark.createDataFrame(
        [(44, f"g{i}", "t", s, g, p) for i, (s, g, p) in enumerate(
            [("ok", "A", "A"), ("ok", "A", "A"), ("ok", "A", "B"), ("unsupported", "A", None)])],
        "catalog_id int, group_id string, track string, status string, gold string, pred string",
    ).withColumns({"hit": (F.col("gold") == F.col("pred")).cast("double"), "n_options": F.lit(2), "n_accepted": F.lit(1), "cluster": F.lit("all")})
    named = rollup.scored_tracks(rows, rows.where("false"))
    tracks = rollup.track_scores([rollup.accuracy_tracks(named)], named).first()
    assert tracks["raw"] == pytest.approx(0.5) and tracks["coverage"] == pytest.approx(0.75)
    assert tracks["random"] == pytest.approx(0.5) and tracks["skill"] == 0.0


def test_conservative_track(spark):
    rows = spark.createDataFrame(
        [(40, "g0", "A", "ok", "yes", "yes"), (40, "g1", "A", "ok", "no", "yes"), (40, "g2", "A", "pending", "yes", None)],
        "catalog_id int, group_id string, track string, status string, gold_label string, pred_label string",
    )
    classes = spark.createDataFrame([(40, "A", "yes")], "catalog_id int, track string, label string")
    chances = spark.createDataFrame([(40, "A", 0.2226862339379383)], "catalog_id int, track string, chance double")
    got = rollup.track_scores([rollup.conservative_tracks(rows, classes, chances)], rows).first()
    assert got["raw"] == pytest.approx(2 / (2 + 1 + 0 + 1)) and got["coverage"] == pytest.approx(2 / 3)


def test_vision_numbers_are_reproduced(spark):
    weights = spec.vision_weights(spark)
    for entrant in (0, 1):
        rows = [(b, c, n, r[entrant] / n) for b, (c, n, r, _) in golden.VISION.items()]
        scores = spark.createDataFrame(rows, "benchmark string, chance double, rows long, accuracy double").withColumns(
            {"skill": (F.col("accuracy") - F.col("chance")) / (1 - F.col("chance")), "missing": F.lit(0)}
        )
        scores = scores.withColumn("skill_clipped", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "skill"))).join(weights, "benchmark")
        for r in scores.collect():
            assert round(100 * r["skill"], 2) == golden.VISION[r["benchmark"]][3][entrant]
        out = rollup.vision_index(scores, weights).first()
        assert round(out["public_index"], 2) == golden.VISION_INDEX[entrant] and out["complete"]


def test_vision_scores_count_unanswered_as_wrong(spark):
    rows = spark.createDataFrame([("m", f"r{i}", "A", 4) for i in range(4)], "benchmark string, run_id string, gold string, n_options int")
    preds = spark.createDataFrame([("r0", "A"), ("r1", "B"), ("r2", None)], "run_id string, pred string")
    weights = spark.createDataFrame([("m", 1.0)], "benchmark string, weight double")
    got = rollup.vision_scores(rows, preds, weights).first()
    assert (got["rows"], got["answered"], got["missing"], got["accuracy"]) == (4, 2, 1, 0.25)
    assert got["skill"] == pytest.approx(0.0)


def test_published_editions(spark):
    from casewright.operators import editions
    from casewright.plans import spec

    dim = spec.dim_edition(spark)
    assert editions.resolve_edition(None, dim).first()["edition"] == "0.3"
    assert editions.resolve_edition("release-v2.1", dim).first()["edition"] == "0.2.1"
    pairs = {(r["edition_a"], r["edition_b"]) for r in editions.compatible(dim, ["rows_sha256", "added_sha256", "gsm8k_sha256"]).collect()}
    assert pairs == {(e, e) for e in spec.EDITION_ROWS} | {("0.2", "0.2.1"), ("0.2.1", "0.2")}
