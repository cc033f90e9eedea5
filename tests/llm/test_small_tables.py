"""Small tables cost few tasks, and Python gets few texts at a time: what took the pipeline over its limits on check_h."""

import uuid

import corpus_pipeline
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casewright.llm import pii
from casewright.llm.rows import numbered
from casewright.operators import graph
from casewright.session import ARROW_ROWS, cut_lineage, rows_at_once

PARTITIONS = 48


@pytest.fixture
def many_partitions(spark):
    """A session whose shuffles have many partitions that are not put together, as on a large cluster."""
    settings = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def tasks(spark, work):
    """What ``work`` returns, and how many tasks its jobs took."""
    name = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(name, name)
    out = work()
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)


def chains(spark):
    """Edges of 40 chains of 12 nodes, some of them twice and some with one end."""
    edges = [(f"{c:02}-{i:02}", f"{c:02}-{i + 1:02}") for c in range(40) for i in range(11)]
    return cut_lineage(spark.createDataFrame(edges + edges[:20] + [("99", "99")], "a string, b string").repartition(PARTITIONS))


def test_components_of_a_small_table_take_few_tasks(many_partitions):
    edges = chains(many_partitions)
    found, n = tasks(many_partitions, lambda: graph.components(edges, "a", "b").collect())
    assert {r.node: r.component for r in found} == {f"{c:02}-{i:02}": f"{c:02}-00" for c in range(40) for i in range(12)} | {"99": "99"}
    assert n < 20 * PARTITIONS


def test_components_are_the_same_without_broadcasts(many_partitions, monkeypatch):
    edges = chains(many_partitions)
    few = graph.components(edges, "a", "b").collect()
    monkeypatch.setattr(graph, "FEW_EDGES", 0)
    assert sorted(graph.components(edges, "a", "b").collect()) == sorted(few)


def test_components_of_no_edges(many_partitions):
    assert graph.components(chains(many_partitions).limit(0), "a", "b").collect() == []


def identifiers(spark):
    """Seeds and other tokens in contexts that they share in part."""
    rows = [(f"seed{i}@x.org", True, f"mail{i % 5} ", f" on{i % 3}") for i in range(60)]
    rows += [(f"token-{i}", False, f"mail{i % 5} " if i % 2 else "see ", f" on{i % 3}" if i % 3 else " then") for i in range(90)]
    rows += [(f"far-{i}", False, f"far{i} ", f" off{i}") for i in range(30)]
    return cut_lineage(spark.createDataFrame(rows, "hit string, base boolean, tail string, head string").repartition(PARTITIONS))


def test_bootstrap_of_a_small_table_takes_few_tasks(many_partitions, monkeypatch):
    found = identifiers(many_partitions)
    few, n = tasks(many_partitions, lambda: pii.bootstrap(found).collect())
    monkeypatch.setattr(pii, "FEW_EDGES", 0)
    many, most = tasks(many_partitions, lambda: pii.bootstrap(found).collect())
    assert sorted(few) == sorted(many) and 0 < len(few) < 120
    assert 3 * n < most


def test_file_numbers_need_no_python_workers(spark, odd):
    plan = numbered(odd, "r")._jdf.queryExecution().toString()
    assert "LocalRelation" in plan and "LogicalRDD" not in plan


def test_rows_at_once(spark):
    sizes = spark.range(5000, numPartitions=1).mapInPandas(lambda frames: (pd.DataFrame({"n": [len(f)]}) for f in frames), "n long")
    before = spark.conf.get(ARROW_ROWS)
    with rows_at_once(spark, 700):
        assert sizes.agg(F.max("n")).first()[0] == 700
        with rows_at_once(spark, 900):  # what is lower stays
            assert spark.conf.get(ARROW_ROWS) == "700"
    assert spark.conf.get(ARROW_ROWS) == before and sizes.agg(F.max("n")).first()[0] == 5000


def test_pipeline_gives_python_few_texts(spark, odd, tmp_path):
    before = spark.conf.get(ARROW_ROWS)
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    try:
        docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
        corpus_pipeline.reject_toxic(spark, docs, str(tmp_path))
        assert int(spark.conf.get(ARROW_ROWS)) <= corpus_pipeline.BATCH
    finally:
        spark.conf.set(ARROW_ROWS, before)
