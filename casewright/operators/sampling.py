"""Deterministic sampling in hash order.

The hash of a group is uniform, so its leading digits cut any benchmark into
even segments: ranks and cut-offs come from segment counts, and only rows of
segments that can still hold a survivor are ever sorted.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import hashing, scans
from casewright.functions.skew import broadcast_if_small
from casewright.session import cut_lineage

FINISH_ROWS = 50_000


def groups_of(rows: DataFrame, keys: list[str], group: str, seed: str | int | None = None, *carry: Column) -> DataFrame:
    """One row per group with its size and priority hash ``seed:key..:group``."""
    parts = [F.col(k) for k in keys] + [F.col(group)]
    h = hashing.sha(*parts) if seed is None else hashing.priority(seed, *parts)
    counted = rows.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("size"), *carry)
    return counted.withColumn("h", h)


def lowest_hashes(
    df: DataFrame, keys: list[str], limit: int | DataFrame, hash_col: str = "h", digits: int = 3,
    rank: str | None = None,
) -> DataFrame:
    """Rows with the lowest hashes per key; ``limit`` is a number or a table (keys.., quota).

    ``rank`` names a column for the position in hash order.
    """
    cut = scans.hash_segments(df, hash_col, digits)
    if isinstance(limit, int):
        quota = F.lit(limit)
        limited = cut
    else:
        quota = F.col("quota")
        limited = cut.join(broadcast_if_small(limit), keys)
    counts = limited.groupBy(*keys, scans.SEG).agg(
        F.count(F.lit(1)).alias("_n"), *([] if isinstance(limit, int) else [F.max("quota").alias("_quota")])
    )
    before = Window.partitionBy(*keys).orderBy(scans.SEG).rowsBetween(Window.unboundedPreceding, -1)
    open_to = F.lit(limit) if isinstance(limit, int) else F.col("_quota")
    live = (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .where(F.col("_before") < open_to)
        .select(*keys, scans.SEG, "_before")
    )
    inside = Window.partitionBy(*keys, scans.SEG).orderBy(hash_col)
    ranked = limited.join(live, [*keys, scans.SEG]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(inside)
    )
    kept = ranked.where(F.col("_rank") <= quota).drop("_before", "quota", scans.SEG)
    return kept.withColumnRenamed("_rank", rank) if rank else kept.drop("_rank")


def cap_groups(groups: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """Keep the ``cap`` lowest-hash groups of each benchmark."""
    return lowest_hashes(groups, keys, cap)


def quotas(groups: DataFrame, keys: list[str], stratum: str, cap: int, at_least_one: bool = False) -> DataFrame:
    """Proportional quota per stratum, largest remainder first, ties by stratum."""
    sizes = groups.groupBy(*keys, stratum).agg(F.count(F.lit(1)).alias("n"))
    of_key = Window.partitionBy(*keys)
    share = F.lit(float(cap)) * F.col("n") / F.sum("n").over(of_key)
    split = sizes.withColumn("share", share).withColumn("base", F.floor("share"))
    split = split.withColumn("left", F.lit(cap) - F.sum("base").over(of_key)).withColumn(
        "rest", F.col("base") - F.col("share")
    )
    turn = F.row_number().over(of_key.orderBy("rest", stratum))
    quota = F.col("base") + F.when(turn <= F.col("left"), 1).otherwise(0)
    if at_least_one:
        quota = F.greatest(F.lit(1), quota)
    return split.select(*keys, stratum, quota.cast("bigint").alias("quota"))


def quota_sample(groups: DataFrame, keys: list[str], stratum: str, cap: int, at_least_one: bool = False) -> DataFrame:
    """Stratified sample: the lowest hashes of each stratum up to its quota."""
    return lowest_hashes(groups, [*keys, stratum], quotas(groups, keys, stratum, cap, at_least_one))


def _walk(budget_col: str):
    """Greedy walk over the few groups that are left of one benchmark."""

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h")
        room = int(pdf[budget_col].iloc[0])
        keep = []
        for size in pdf["size"]:
            fits = size <= room
            room -= size if fits else 0
            keep.append(fits)
        return pdf[keep]

    return take


def budget_sample(
    groups: DataFrame, keys: list[str], budget: int, finish_rows: int = FINISH_ROWS
) -> DataFrame:
    """Whole groups in hash order while they fit a row budget; misfits are skipped.

    Each round takes the fitting stretch before the first misfit by prefix sums,
    then drops every group larger than what is left. Rounds end when no group is
    left; once a benchmark has at most ``finish_rows`` candidates the walk is
    finished directly. ``groups`` has (keys.., group, size, h).
    """
    columns = groups.columns
    live = cut_lineage(groups.where(F.col("size") <= budget).withColumn("_room", F.lit(budget).cast("bigint")))
    taken: list[DataFrame] = []
    while True:
        sizes = live.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        short = sizes.where(F.col("_n") <= finish_rows).select(*keys)
        small = live.join(short, keys, "left_semi")
        taken.append(small.groupBy(*keys).applyInPandas(_walk("_room"), small.schema).select(*columns))
        long = live.join(short, keys, "left_anti")
        if long.isEmpty():
            break
        run = scans.scan(scans.hash_segments(long, "h"), keys, ["h"], {"_cum": ("sum", "size")})
        run = cut_lineage(run.drop(scans.SEG))
        state = run.groupBy(*keys).agg(F.min(F.when(F.col("_cum") > F.col("_room"), F.col("h"))).alias("_stop"))
        marked = run.join(broadcast_if_small(state), keys)
        first = F.col("_stop").isNull() | (F.col("h") < F.col("_stop"))
        used = marked.groupBy(*keys).agg(F.sum(F.when(first, F.col("size")).otherwise(0)).alias("_used"))
        taken.append(marked.where(first).select(*columns))
        left = F.col("_room") - F.col("_used")
        live = cut_lineage(
            marked.where(~first)
            .join(broadcast_if_small(used), keys)
            .withColumn("_room", left)
            .where((F.col("h") > F.col("_stop")) & (F.col("size") <= F.col("_room")))
            .select(*columns, "_room")
        )
    out = taken[0]
    for part in taken[1:]:
        out = out.unionByName(part)
    return out


def round_robin(groups: DataFrame, benchmark: str, n: int, complete_groups: bool = True) -> DataFrame:
    """Cycle through the benchmarks, one whole group each, until ``n`` rows are reached.

    A group of rank r has at least r-1 rows before it, so only ranks up to n
    matter. The walk order (rank, benchmark) is cut at equal rank steps.
    """
    sized = groups if complete_groups else groups.withColumn("size", F.lit(1).cast("bigint"))
    ranked = cut_lineage(lowest_hashes(sized, [benchmark], n, rank="rank"))
    top = ranked.agg(F.max("rank")).first()[0] or 1
    cut = scans.step_segments(ranked, "rank", max(1, -(-top // 512)))
    run = scans.scan(cut, [], ["rank", benchmark], {"_before": ("sum", "size")}, inclusive=False)
    return run.where(F.col("_before") < n).drop("_before", scans.SEG)


def first_per_parent(df: DataFrame, parent: list[str], hash_col: str) -> DataFrame:
    """The lowest-hash row of each parent; combines before the shuffle."""
    rest = [c for c in df.columns if c not in parent]
    picked = df.groupBy(*parent).agg(F.min_by(F.struct(*rest), hash_col).alias("_r"))
    return picked.select(*parent, "_r.*")


def balanced(rows: DataFrame, keys: list[str], klass: str, row_id: str, applies: Column | None = None) -> DataFrame:
    """Equal class counts inside each group by lowest id hash; one-class groups go.

    Rows where ``applies`` is false pass through.
    """
    subject = rows if applies is None else rows.where(applies)
    counts = subject.groupBy(*keys, klass).agg(F.count(F.lit(1)).alias("_n"))
    quota = (
        counts.groupBy(*keys)
        .agg(F.min("_n").alias("quota"), F.count(F.lit(1)).alias("_k"))
        .where("_k >= 2")
        .drop("_k")
    )
    of_class = counts.join(quota, keys).select(*keys, klass, "quota")
    hashed = subject.withColumn("_h", hashing.sha(F.col(row_id)))
    kept = lowest_hashes(hashed, [*keys, klass], of_class, "_h").select(*rows.columns)
    return kept if applies is None else rows.where(~applies).unionByName(kept)


def pairs(
    df: DataFrame, key: str, item: str, value: str, look: str, hash_col: str = "h", min_gap: float = 2, seed: str = "pair"
) -> DataFrame:
    """Consecutive rows in hash order as pairs, kept if values differ enough and looks differ.

    The side is flipped by the last hash digit of ``seed:key:a:b``.
    """
    numbered = scans.row_numbers(scans.hash_segments(df, hash_col), [key], [hash_col])
    odd = F.col("rn") % 2 == 1
    both = numbered.groupBy(key, F.floor((F.col("rn") - 1) / 2).alias("pair")).agg(
        *[
            F.max(F.when(odd if side == "a" else ~odd, F.col(c))).alias(f"{c}_{side}")
            for side in ("a", "b")
            for c in (item, value, look)
        ]
    )
    ia, ib = F.col(f"{item}_a"), F.col(f"{item}_b")
    va, vb = F.col(f"{value}_a"), F.col(f"{value}_b")
    kept = both.where(
        ib.isNotNull() & (F.abs(va - vb) >= min_gap) & (F.col(f"{look}_a") != F.col(f"{look}_b"))
    )
    flip = hashing.last_digit_odd(hashing.sha(seed, F.col(key), ia, ib))
    first_wins = F.when(flip, vb > va).otherwise(va > vb)
    return kept.select(
        key, "pair",
        F.when(flip, ib).otherwise(ia).alias("left_item"),
        F.when(flip, ia).otherwise(ib).alias("right_item"),
        F.col(f"{look}_a").alias("look_a"), F.col(f"{look}_b").alias("look_b"),
        F.when(first_wins, "A").otherwise("B").alias("expected"),
        F.abs(va - vb).alias("gap"),
    )


def leak_free_history(
    targets: DataFrame, history: DataFrame, key: str, item: str, look: str, hash_col: str = "h",
    most: int = 8, least: int = 4,
) -> DataFrame:
    """For each target pair the first ``most`` history rows by hash that share neither look.

    An item has one look, so leaving out the two looks also leaves out the two
    items. At most ``most`` rows of a look can be used and two looks can be
    barred, so the first 3 x ``most`` of those rows per key are all a target needs.
    """
    by_look = Window.partitionBy(key, look).orderBy(hash_col)
    by_key = Window.partitionBy(key).orderBy(hash_col)
    short = (
        history.select(key, item, look, hash_col)
        .withColumn("_r", F.row_number().over(by_look))
        .where(F.col("_r") <= most)
        .withColumn("_r", F.row_number().over(by_key))
        .where(F.col("_r") <= 3 * most)
    )
    # At most 3 x most entries per key: the choice is made inside the target's row.
    entry = F.struct(F.col(hash_col).alias("h"), F.col(item).cast("string").alias("item"), F.col(look).alias("look"))
    lists = short.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    free = F.filter("_all", lambda s: (s["look"] != F.col("look_a")) & (s["look"] != F.col("look_b")))
    met = targets.join(lists, key).withColumn("_h", F.slice(free, 1, most)).where(F.size("_h") >= least)
    return met.withColumn("history", F.transform("_h", lambda s: s["item"])).drop("_h", "_all")
