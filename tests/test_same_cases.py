"""The reference's mean over a run's complete cases."""

from casewright.plans import score


def test_groups_are_counted_without_a_join(spark):
    fact = spark.createDataFrame(
        [(1, 1, "ok"), (1, 1, "ok"), (1, 2, "ok"), (1, 2, "error"), (2, 3, "ok"), (2, 4, None), (2, None, "ok"), (3, 5, "ok")],
        "catalog_id int, group_id int, status string",
    )
    reference = spark.createDataFrame(
        [(1, 1, 1.0, "x"), (1, 1, 0.0, "y"), (1, 2, 1.0, "x"), (2, 3, None, "x"), (2, 9, 1.0, "x"), (2, None, 1.0, "x")],
        "catalog_id int, group_id int, hit double, part string",
    )
    out = score.reference_on_same_cases(fact, reference, ["catalog_id"])
    assert sorted(map(tuple, out.collect())) == [(1, 0.5), (2, None)]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    parts = score.reference_on_same_cases(fact, reference, ["part"])
    assert sorted(map(tuple, parts.collect())) == [("x", 1.0), ("y", 0.0)]
