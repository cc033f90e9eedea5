"""Row numbers, and what depends on them, when the splits of a table change between two passes."""

import duckdb
import pytest

from casewright.llm import exact_dedup, line_dedup, ngram_join, pii
from casewright.llm.rows import numbered

SPLITS = "spark.sql.files.minPartitionNum"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Many small row groups, so that a file can be split in many ways."""
    place = tmp_path_factory.mktemp("splits")
    for k in range(2):
        duckdb.sql(
            f"""COPY (SELECT {k} * 6000 + i AS doc_id, 'en' AS lang, 's' AS source, CAST(0 AS BIGINT) AS n_chars,
            'text of number ' || (i % 2000) || ' with words ' || (i % 2000) * 7 || chr(10) || 'mail me' || (i % 2000) || '@example.com' ||
            chr(10) || 'a last line ' || (i % 2000) AS text FROM range(6000) t(i)) TO '{place}/{k}.parquet' (ROW_GROUP_SIZE 2048)"""
        )
    return str(place)


@pytest.fixture(autouse=True)
def restore(spark):
    size = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.openCostInBytes", size)
    spark.conf.unset(SPLITS)


def test_numbers_do_not_depend_on_splits(spark, docs):
    seen = []
    for parts in (1, 5, 9):
        spark.conf.set(SPLITS, parts)
        df = spark.read.parquet(docs)
        seen.append((df.rdd.getNumPartitions(), dict(numbered(df, "n").select("doc_id", "n").collect())))
    assert len({n for n, _ in seen}) == 3
    assert seen[0][1] == seen[1][1] == seen[2][1] and len(set(seen[0][1].values())) == 12_000


@pytest.mark.parametrize("module", [exact_dedup, line_dedup, ngram_join, pii])
def test_operators_number_alike_in_all_passes(spark, docs, module, monkeypatch):
    run = {
        exact_dedup: lambda d: exact_dedup.dedup(d).select("text"),
        line_dedup: lambda d: line_dedup.clean(d).select("text"),
        ngram_join: lambda d: ngram_join.keep_one(d).select("text"),
        pii: lambda d: pii.mask(d).select("text"),
    }[module]
    spark.conf.set(SPLITS, 1)
    expected = sorted(r.text for r in run(spark.read.parquet(docs)).collect())
    passes = []

    def other_splits(df, name):
        passes.append(name)
        spark.conf.set(SPLITS, 2 + 3 * len(passes))
        return numbered(df, name)

    monkeypatch.setattr(module, "numbered", other_splits)
    assert sorted(r.text for r in run(spark.read.parquet(docs)).collect()) == expected
    assert len(passes) >= 2
