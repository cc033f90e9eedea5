"""Bands of answer groups against a plain walk from the left."""

import random

import pytest
from pyspark.sql import functions as F

from casewright.operators import bands, distractors


def plain_bands(values, k):
    """Widths from the left; the last band takes in earlier ones until it holds the rest."""

    def enough(start, end, m):
        return all(values[start:end].count(v) <= m for v in set(values[start:end]))

    total, q, out = len(values) // k, 0, []
    while q < total:
        m = next((m for m in range(1, total - q + 1) if enough(k * q, k * (q + m), m)), None)
        if m is None:
            while True:
                q, _ = out.pop()
                if enough(k * q, len(values), total - q):
                    return [*out, (q, total - q)]
        out.append((q, m))
        q += m
    return out


def runs_of(spark, values):
    rows, at = [], 0
    for v in sorted(set(values)):
        rows.append((at, values.count(v)))
        at += values.count(v)
    return spark.createDataFrame(rows, "a long, c long")


CASES = {
    "all different": lambda r: list(range(24)),
    "repeats": lambda r: [r.randint(1, 30) for _ in range(80)],
    "few values": lambda r: [r.randint(1, 6) for _ in range(60)],
    "one outlier": lambda r: [*range(40), *[40] * 9, *range(41, 72)],
    "outlier first": lambda r: [*[0] * 12, *range(1, 61)],
    "outlier last": lambda r: [*range(60), *[60] * 12],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("span", [4, 1 << 16])
def test_bands_follow_the_walk(spark, case, span):
    values = sorted(CASES[case](random.Random(3)))
    k = 4
    values = values[: len(values) // k * k]
    got = sorted((r.q, r.m) for r in bands.bands(runs_of(spark, values), k, len(values) // k, span).collect())
    assert got == plain_bands(values, k)


def test_an_outlier_leaves_other_bands_alone(spark):
    values = [*range(40), *[40] * 9, *range(41, 72)]
    got = sorted((r.q, r.m) for r in bands.bands(runs_of(spark, sorted(values)), 4, 20).collect())
    assert [m for q, m in got if q + m <= 8] and all(m == 1 for q, m in got if q + m <= 8)
    assert max(m for _, m in got) == 9


def test_long_stretches_are_cut(spark, monkeypatch):
    monkeypatch.setattr(bands, "STEP", 3)
    values = sorted([*[5] * 20, *range(100, 160)])
    assert sorted((r.q, r.m) for r in bands.bands(runs_of(spark, values), 4, 20).collect()) == plain_bands(values, 4)


@pytest.mark.parametrize("n", [41, 42, 43])
def test_items_left_over_have_different_values(spark, n):
    df = spark.createDataFrame([(i, i * 7 % 19) for i in range(n)], "id int, v int")
    groups = distractors.answer_groups(df, "id", "v", 4, "s").cache()
    left = sorted(r.v for r in groups.where("answer_group = -1").collect())
    assert len(left) == n % 4 == len(set(left)) and groups.count() == n
    sizes = groups.where("answer_group >= 0").groupBy("answer_group").agg(F.count_distinct("v").alias("d"), F.count("*").alias("n")).collect()
    assert {(r.d, r.n) for r in sizes} == {(4, 4)} and len(sizes) == n // 4
    ring = {r.answer_group: r.ring for r in distractors.group_values(groups, "v", 4).collect()}
    assert all(len(set(r)) == 4 for r in ring.values()) and set(left) <= set(ring[-1])
    above = [v for v in sorted({i * 7 % 19 for i in range(n)}) if v > max(left)]
    assert set(above[: 4 - len(left)]) <= set(ring[-1])
