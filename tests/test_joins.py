"""Question inventories against a plain restatement."""

import random

import pytest
from pyspark.sql import functions as F

from casewright.operators import joins


@pytest.mark.parametrize("block", [1, 7, 64])
def test_inventory_questions_by_bitmaps(spark, block):
    rng = random.Random(2)
    names = {"food": [f"c{i:03d}" for i in range(90)], "room": ["bed", "door"], "none": []}
    inventory = [(d, c) for d, cs in names.items() for c in cs] * 2
    reviews = []
    for i in range(30):
        d = rng.choice(["food", "food", "room", "none"])
        own = [f"{c}|{s}" for c in names[d] for s in ("neg", "pos") if rng.random() < 0.2]
        reviews.append((i, d, [*own, *own[:1], "unknown|pos"]))
    df = spark.createDataFrame(reviews, "id int, domain string, pairs array<string>")
    inv = spark.createDataFrame(inventory, "domain string, category string")
    out = joins.inventory_questions(df, inv, "id", "domain", "pairs", "category", ["pos", "neg"], block)
    got = {(r["id"], r["block"]): [(q["field"], q["gold"]) for q in r["questions"]] for r in out.collect()}
    want = {}
    for i, d, pairs in reviews:
        entries = [(c, s) for c in sorted(names[d]) for s in ("neg", "pos")]
        for at in range(0, len(entries), block):
            want[i, at // block + 1] = [(f"{c}__sentiment_{s}", "yes" if f"{c}|{s}" in pairs else "no") for c, s in entries[at : at + block]]
    assert got == want
    assert set(out.columns) == {"id", "domain", "pairs", "block", "questions"}


def test_blocks_have_a_bit_for_each_entry(spark):
    empty = spark.createDataFrame([], "id int, domain string, pairs array<string>")
    with pytest.raises(ValueError, match="1 to 64"):
        joins.inventory_questions(empty, empty.select("domain", F.lit("c").alias("category")), "id", "domain", "pairs", "category", ["pos"], 65)
