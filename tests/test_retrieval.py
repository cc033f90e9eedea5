"""Lexical scores: where pairs are added up, and the two forms of the join."""

from casewright.operators import retrieval

DOCS = [(1, "red fox runs far"), (2, "red red stone"), (3, "blue stone lies"), (4, None), (5, "fox fox and stone"), (6, "green")]
ASKED = [(10, "the red stone"), (11, "a blue fox"), (12, "nothing known")]


def _tables(spark):
    return spark.createDataFrame(ASKED, "q long, t string"), spark.createDataFrame(DOCS, "d long, t string"), "q", "t", "d", "t"


def test_pairs_are_not_shuffled(spark):
    plan = retrieval.bm25_scores(*_tables(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(doc_id" in plan and "hashpartitioning(query_id" not in plan


def test_both_forms_agree(spark, monkeypatch):
    barred = spark.createDataFrame([(10, 2), (11, 1)], "query_id long, doc_id long")

    def found(**more):
        return sorted(map(tuple, retrieval.lexical_candidates(*_tables(spark), 3, **more).collect()))

    near, near_barred = found(), found(excluded=barred)
    assert len(near) == 9 and (10, 2) in {r[:2] for r in near} and not {(10, 2), (11, 1)} & {r[:2] for r in near_barred}
    monkeypatch.setattr(retrieval, "small_enough", lambda df: False)
    assert found() == near and found(excluded=barred) == near_barred
