"""Wrong options: from peers, from neighbouring values, from ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import arrays, hashing, scans, text
from casewright.operators import bands
from casewright.operators.sampling import lowest_hashes
from casewright.session import cut_lineage

PEER_WINDOW = 16
PEER_LIST = 4096
# Ranks up to here are cut in each task before rows are shuffled.
SORTED_PEERS = 1000


def peer_pools(
    items: DataFrame, parent: str, row_id: str, answer: str, k: int = 3, window: int = PEER_WINDOW
) -> DataFrame:
    """``k`` wrong options per item from the answers to other items of the same parent.

    ``answer`` is a text or an array of accepted texts, the first of which is the
    gold. A peer answer must be of the same kind as the gold (with or without a
    digit) and neither equal to, part of, nor around any accepted text in
    comparison form. Items without ``k`` such peers are dropped. Peers are looked
    at in hash order, the first ``window`` distinct ones per parent and kind; items
    not settled by those look at sixteen times as many, until the pool is exhausted.
    """
    listed = F.col(answer) if items.schema[answer].dataType.typeName() == "array" else F.array(answer)
    base = items.select(row_id, parent, F.transform(listed, lambda a: F.lower(F.trim(a))).alias("_golds")).select(
        row_id, parent, F.try_element_at("_golds", F.lit(1)).alias("gold"), "_golds",
        F.transform("_golds", text.norm).alias("_norms"),
    ).withColumn("_num", text.has_digit(F.col("gold")))
    each = F.explode(F.arrays_zip(F.col("_golds").alias("peer"), F.col("_norms").alias("norm"), F.transform("_golds", text.has_digit).alias("num")))
    pool = (
        base.select(parent, each.alias("_a")).select(parent, F.col("_a.num").alias("_num"), F.col("_a.norm").alias("_norm"), F.col("_a.peer").alias("_text"))
        .where("_norm <> ''")
        .groupBy(parent, "_num", "_norm")
        .agg(F.min("_text").alias("peer"))
        .withColumn("_h", hashing.sha("peer", F.col(parent), F.col("_norm")))
        .withColumnRenamed("_norm", "_peer_norm")
    )
    sizes = pool.groupBy(parent, "_num").agg(F.count(F.lit(1)).alias("_pool"))
    waiting = base.join(sizes, [parent, "_num"])
    found: list[DataFrame] = []
    while True:
        look = _from_lists if window <= PEER_LIST else _from_rows
        seen = cut_lineage(look(waiting, pool, parent, row_id, k, window))
        found.append(seen.where(F.size("distractors") == k))
        waiting = seen.where((F.size("distractors") < k) & (F.col("_pool") > window)).drop("distractors")
        if waiting.isEmpty():
            break
        window *= 16
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.select(row_id, parent, "gold", "distractors")


def _apart(norms: Column, peer: Column) -> Column:
    """No accepted text contains the peer or is part of it; an empty one bars nothing."""
    return F.forall(norms, lambda norm: (norm == "") | ~(F.contains(norm, peer) | F.contains(peer, norm)))


def _first_peers(pool: DataFrame, parent: str, window: int) -> DataFrame:
    if window > SORTED_PEERS:  # beyond what a window cuts before its shuffle: ranks from segments of the hash
        ranked = scans.row_numbers(scans.hash_segments(pool, "_h"), [parent, "_num"], ["_h"], "_r").drop(scans.SEG)
    else:
        ranked = pool.withColumn("_r", F.row_number().over(Window.partitionBy(parent, "_num").orderBy("_h")))
    return ranked.where(F.col("_r") <= window)


def _from_lists(waiting: DataFrame, pool: DataFrame, parent: str, row_id: str, k: int, window: int) -> DataFrame:
    """Peers as one short array per parent and kind; the choice is made inside the item's row."""
    lists = _first_peers(pool, parent, window).groupBy(parent, "_num").agg(
        F.array_sort(F.collect_list(F.struct("_h", "_peer_norm", "peer"))).alias("_peers")
    )
    fit = F.filter("_peers", lambda p: _apart(F.col("_norms"), p["_peer_norm"]))
    met = waiting.join(lists, [parent, "_num"])
    return met.withColumn("distractors", F.transform(F.slice(fit, 1, k), lambda p: p["peer"])).drop("_peers")


def _from_rows(waiting: DataFrame, pool: DataFrame, parent: str, row_id: str, k: int, window: int) -> DataFrame:
    """The same for the few items that need a long look: peers as rows."""
    met = waiting.join(_first_peers(pool, parent, window), [parent, "_num"]).where(
        _apart(F.col("_norms"), F.col("_peer_norm"))
    )
    mine = Window.partitionBy(row_id).orderBy("_h")
    best = (
        met.withColumn("_i", F.row_number().over(mine))
        .where(F.col("_i") <= k)
        .groupBy(row_id)
        .agg(F.array_sort(F.collect_list(F.struct("_h", "peer"))).alias("_p"))
    )
    joined = waiting.join(best, row_id, "left")
    chosen = F.transform(F.coalesce("_p", F.array().cast("array<struct<_h:string,peer:string>>")), lambda p: p["peer"])
    return joined.withColumn("distractors", chosen).drop("_p")


def answer_groups(golds: DataFrame, row_id: str, value: str, k: int, seed: str) -> DataFrame:
    """Groups of ``k`` items with ``k`` different gold values of similar size.

    Items are sorted by (value, hash). The n mod k left over have different
    values and form group -1: from a place taken from the seed the first items of
    the values upwards, then the last ones of the values downwards. The others are
    cut into bands of k * m places (``operators/bands``), m being the least number
    so that no value fills more than m places of the band; a band is dealt in
    strides of m, so that the members of a group differ. A value with many items
    widens its own band only. Fails if a value fills more than n / k places, as no
    such grouping exists then.
    """
    hashed = golds.withColumn("_tie", hashing.sha(seed, "order", F.col(row_id)))
    cut = scans.range_segments(hashed, [], [value, "_tie"])
    placed = cut_lineage(scans.row_numbers(cut, [], [value, "_tie"]).select(row_id, value, (F.col("rn") - 1).alias("_p")))
    runs = cut_lineage(placed.groupBy(value).agg(F.min("_p").alias("a"), F.count(F.lit(1)).alias("c")))
    sizes = runs.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.max("c"), F.lit(0)).alias("most")).first()
    n, total = sizes["n"], sizes["n"] // k
    left = _left_over(runs, n, n % k, seed)
    # What is left when one item of each of these values is gone.
    here = F.filter(F.array(*[F.lit(p).cast("bigint") for p in left]), lambda p: (p >= F.col("a")) & (p < F.col("a") + F.col("c")))
    before = F.filter(F.array(*[F.lit(p).cast("bigint") for p in left]), lambda p: p < F.col("a"))
    rest = runs.select("a", "c")
    if left:  # counted under other names first: a name made beside a lambda would be taken inside it
        rest = runs.select("a", "c", F.size(before).alias("_b"), F.size(here).alias("_h")).selectExpr("a - _b AS a", "c - _h AS c").where("c > 0")
    longest = rest.agg(F.coalesce(F.max("c"), F.lit(0)).alias("c")).first()["c"] if left else sizes["most"]
    if longest > total:
        raise ValueError(f"a value occurs {longest} times, more than n/k = {total}")
    passed = F.size(F.filter(F.array(*[F.lit(p).cast("bigint") for p in left]), lambda p: p < F.col("_p"))) if left else F.lit(0)
    others = placed.where(~F.col("_p").isin(left)) if left else placed
    if not total:
        return placed.select(row_id, value, F.lit(-1).cast("bigint").alias("answer_group"))
    dealt = bands.dealt(others.withColumn("_p", F.col("_p") - passed), bands.bands(cut_lineage(rest), k, total), k, "_p", "answer_group")
    extra = placed.where(F.col("_p").isin(left) if left else F.lit(False))
    return dealt.select(row_id, value, "answer_group").unionByName(extra.select(row_id, value, F.lit(-1).cast("bigint").alias("answer_group")))


def _left_over(runs: DataFrame, n: int, many: int, seed: str) -> list[int]:
    """Places of ``many`` items (fewer than k) with different values, around a place taken from the seed."""
    if not many:
        return []
    start = runs.sparkSession.range(1).select(hashing.hash_mod(hashing.sha(seed, "leftover"), n).alias("p")).first()["p"]
    own = runs.where((F.col("a") <= start) & (F.col("a") + F.col("c") > start)).first()
    places = [start, *(r["a"] for r in runs.where(F.col("a") > own["a"]).orderBy("a").limit(many - 1).collect())]
    if len(places) < many:
        below = runs.where(F.col("a") < own["a"]).orderBy(F.desc("a")).limit(many - len(places)).collect()
        places += [r["a"] + r["c"] - 1 for r in below]
    if len(places) < many:
        raise ValueError(f"{many} items are left over, but there are only {len(places)} values")
    return places


def group_values(groups: DataFrame, value: str, k: int) -> DataFrame:
    """(answer_group, ring): the ``k`` values of each group; group -1 is filled with the next values above its own, then below."""
    own = groups.groupBy("answer_group").agg(F.array_sort(F.collect_list(value)).alias("ring"))
    few = own.where("answer_group = -1").first()
    if few is None or len(few["ring"]) >= k:
        return own
    distinct = groups.select(value).distinct()
    above = distinct.where(F.col(value) > few["ring"][-1]).orderBy(value).limit(k).select(value, F.lit(0).alias("_side"))
    below = distinct.where(F.col(value) < few["ring"][0]).orderBy(F.desc(value)).limit(k).select(value, F.lit(1).alias("_side"))
    # At most 2 k rows.
    ranked = F.array_sort(F.collect_list(F.struct("_side", F.when(F.col("_side") == 0, F.col(value)).otherwise(-F.col(value)).alias("_o"), F.col(value).alias("v"))))
    more = above.unionByName(below).agg(F.transform(F.slice(ranked, 1, k - len(few["ring"])), lambda x: x["v"]).alias("_more"))
    filled = own.where("answer_group = -1").join(more).select("answer_group", F.array_sort(F.concat("ring", "_more")).alias("ring"))
    return own.where("answer_group >= 0").unionByName(filled)


def ring_options(groups: DataFrame, row_id: str, value: str, k: int, width: int, seed: str) -> DataFrame:
    """``width`` neighbouring values of the group's sorted ring around each gold.

    The gold's place in the window is the group's shift, taken from its hash.
    """
    shift = hashing.hash_mod(hashing.sha(seed, "shift", F.col("answer_group")), width).cast("int")
    return groups.join(group_values(groups, value, k), "answer_group").select(
        row_id, value, "answer_group",
        arrays.ring_window(F.col("ring"), F.col(value), shift, width).alias("options"),
    )


def numeric_options(df: DataFrame, gold: str, seed: str, row_id: str, count: int) -> DataFrame:
    """``count`` numeric options: the gold and offsets or ratios of it, in hash order.

    ``gold`` is a whole-number or decimal column.
    """
    g = F.col(gold).cast("decimal(38,9)")
    # Offsets and ratios of the gold that make plausible wrong answers.
    offsets = [-10, -5, -2, -1, 1, 2, 5, 10]
    # Integer division that truncates toward zero, as decimal arithmetic does.
    half = F.when(g >= 0, F.floor(g / 2)).otherwise(F.ceil(g / 2))
    wrong = F.array(*[(g + F.lit(d)).cast("decimal(38,9)") for d in offsets], (g * 2).cast("decimal(38,9)"),
                    (g * 10).cast("decimal(38,9)"), half.cast("decimal(38,9)"))
    texts = F.transform(F.filter(F.array_distinct(wrong), lambda x: x != g), text.plain_number)
    chosen = F.slice(hashing.hash_order(texts, seed, F.col(row_id)), 1, count - 1)
    gold_text = text.plain_number(g)
    return df.withColumn("gold_text", gold_text).withColumn(
        "options", hashing.hash_order(F.concat(F.array(gold_text), chosen), seed, F.col(row_id), str(count))
    ).withColumn("gold_index", F.array_position("options", F.col("gold_text")) - 1)


def close_numbers(gold: Column, pool: Column, seed: str, row_id: Column) -> Column:
    """Three wrong numbers in the notation of the gold: pool numbers first, then made ones."""
    number = r"^-?\d+(\.\d+)?%?$"
    g = F.regexp_replace(gold, "%", "").cast("double")
    pct = gold.endswith("%")
    dec = F.length(F.regexp_extract(gold, r"\.(\d+)", 1))
    near = F.filter(
        F.transform(pool, lambda p: F.trim(p)),
        lambda p: p.rlike(number) & (p != gold) & (F.abs(F.regexp_replace(p, "%", "").try_cast("double") - g) > 1e-9),
    )
    near = hashing.hash_order(F.array_distinct(near), seed, row_id)
    # Offsets for small whole golds, ratios and last-digit steps for the others.
    small = F.array(*[g + float(d) for d in (1, -1, 2, -2, 3, -3, 4, 5, -4, 6)])
    small = F.when(
        g >= 0, F.concat(F.filter(small, lambda v: v >= 0), F.array(*[g + float(d) for d in (7, 8, 9)]))
    ).otherwise(small)
    unit = F.pow(F.lit(10.0), -dec)
    other = F.array(
        *[g * m for m in (0.5, 2.0, 1.5, 0.75, 1.25, 3.0, 0.25, 4.0, 0.9, 1.1)],
        *[g + unit * float(d) for d in (1, -1, 2, -2, 5)],
    )
    made = F.when((dec == 0) & (F.abs(g) < 30), small).otherwise(other)
    shown = F.transform(
        made, lambda v: F.concat(F.replace(F.call_function("format_number", v, dec.cast("int")), F.lit(","), F.lit("")), F.when(pct, "%").otherwise(""))
    )
    made_texts = hashing.hash_order(F.filter(F.array_distinct(shown), lambda s: s != gold), seed, row_id)
    return F.slice(F.array_distinct(F.concat(near, made_texts)), 1, 3)


def rank_spread(
    items: DataFrame, pool: DataFrame, row_id: str, parent: str, field: str, value: str, k: int, seed: str
) -> DataFrame:
    """Wrong values so that the gold's rank among its options is spread evenly over a field.

    ``pool(parent, value)`` holds the distinct values of a parent, the golds
    among them. How many lie above and below a gold follows from its rank, the
    number to take from above runs round-robin over what is feasible, and the
    values are taken by rank, so no item meets the whole pool. A number may serve
    half of a field's items; the others move on to their next feasible number,
    and an item goes only if all of its feasible numbers are full.
    """
    distinct = pool.select(parent, value).distinct()
    cut = scans.range_segments(distinct, [parent], [value])
    ranked = scans.scan(
        cut.withColumn("_one", F.lit(1).cast("bigint")), [parent], [value], {"_place": ("number", None), "_all": ("total", "_one")}
    ).select(parent, value, "_place", "_all")
    placed = items.join(ranked, [parent, value]).withColumn("_h", hashing.sha(seed, F.col(row_id)))
    below, above = F.col("_place") - 1, F.col("_all") - F.col("_place")
    take = F.least(F.lit(k).cast("bigint"), below + above)
    low = F.greatest(F.lit(0).cast("bigint"), take - below)
    high = F.least(take, above)
    turn = scans.row_numbers(scans.hash_segments(placed, "_h"), [field], ["_h"], "_turn").drop(scans.SEG)
    turn = turn.withColumns(
        {"_take": take, "_above": above, "_below": below, "_low": low, "_wide": high - low + 1}
    )
    sizes = items.groupBy(field).agg(F.ceil(F.count(F.lit(1)) / 2).alias("_half"))
    left = cut_lineage(turn)
    got: list[DataFrame] = []
    used = None
    for step in range(k + 1):
        asked = left.where(F.col("_wide") > step).withColumn(
            "n_above", F.col("_low") + (F.col("_turn") - 1 + step) % F.col("_wide")
        )
        room = asked.select(field, "n_above").distinct().join(sizes, field)
        if used is None:
            room = room.select(field, "n_above", F.col("_half").alias("quota"))
        else:
            room = room.join(used, [field, "n_above"], "left").select(
                field, "n_above", (F.col("_half") - F.coalesce("_used", F.lit(0))).alias("quota")
            )
        fitted = cut_lineage(lowest_hashes(asked, [field, "n_above"], room, "_h"))
        got.append(fitted)
        left = cut_lineage(left.join(fitted.select(row_id), row_id, "left_anti"))
        if left.isEmpty():
            break
        placed_so_far = got[0].select(field, "n_above")
        for part in got[1:]:
            placed_so_far = placed_so_far.unionByName(part.select(field, "n_above"))
        used = placed_so_far.groupBy(field, "n_above").agg(F.count(F.lit(1)).alias("_used"))
    inside = got[0]
    for part in got[1:]:
        inside = inside.unionByName(part)
    offset = hashing.hash_int(F.col("_h"), 12)

    def steps(count: Column, width: Column, base: Column) -> Column:
        many = F.sequence(F.lit(0).cast("bigint"), F.greatest(count - 1, F.lit(0).cast("bigint")))
        ranks = F.transform(many, lambda j: base + F.pmod(offset + j, F.greatest(width, F.lit(1).cast("bigint"))))
        return F.when(count > 0, ranks).otherwise(F.array().cast("array<bigint>"))

    wanted = F.concat(
        steps(F.col("n_above"), F.col("_above"), F.col("_place") + 1),
        steps(F.col("_take") - F.col("n_above"), F.col("_below"), F.lit(1).cast("bigint")),
    )
    asked = inside.select(row_id, parent, field, value, "n_above", F.explode(wanted).alias("_place"))
    values = ranked.select(parent, "_place", F.col(value).alias("wrong"))
    return asked.join(values, [parent, "_place"]).groupBy(row_id, parent, field, value, "n_above").agg(
        F.array_sort(F.collect_list("wrong")).alias("distractors")
    )
