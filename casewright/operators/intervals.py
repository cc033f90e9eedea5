"""Interval and neighbourhood joins without a pairwise search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import scans


def sounding(
    notes: DataFrame, key: str, start: str, end: str, first: int, step: int, value: Column, out: str
) -> DataFrame:
    """Distinct values sounding at each grid beat (start <= beat < end).

    The beats a note covers follow from its bounds, so a note is expanded to
    them directly; the grid reaches the last end of its key.
    """
    lo = F.greatest(F.ceil((F.col(start) - first) / step), F.lit(0))
    # Last k with first + k*step < end.
    hi = F.ceil((F.col(end) - first) / step) - 1
    hit = notes.where(hi >= lo).select(key, F.explode(F.sequence(lo, hi)).alias("_k"), value.alias("_v"))
    # The key's last grid beat is at most its last end, inclusive.
    top = notes.groupBy(key).agg(F.floor((F.max(end) - first) / step).alias("_top")).where("_top >= 0")
    grid = top.select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_top"))).alias("_k"))
    found = hit.distinct().groupBy(key, "_k").agg(F.array_sort(F.collect_list("_v")).alias(out))
    return grid.join(found, [key, "_k"], "left").select(
        key, (F.col("_k") * step + first).alias("beat"), F.coalesce(out, F.array().cast(found.schema[out].dataType)).alias(out)
    )


def overlap_stats(
    df: DataFrame, key: str, at: str, reach: int, value: str, block: int
) -> DataFrame:
    """Count and sum of rows of the same key within ``reach`` of each row, itself included.

    Each key is cut into blocks of its whole-number order column. A row is also
    copied to the blocks that lie within its reach, so all it needs is in one
    block and no pair of rows is ever built. What lies within reach is the
    difference of two running totals, up to ``at + reach`` and before ``at -
    reach``: a row enters each once, so time grows with the rows however dense a
    key is. Totals are decimals (12 places), so the difference is exact. Smaller
    blocks mean smaller tasks at the price of more copies.
    """
    home = F.floor(F.col(at) / block)
    spots = F.sequence(F.floor((F.col(at) - reach) / block), F.floor((F.col(at) + reach) / block))
    copies = df.withColumns({"_home": home, "_block": F.explode(spots), "_v": F.col(value).cast("decimal(28,12)")})
    ordered = Window.partitionBy(key, "_block").orderBy(at)
    until, before = (ordered.rangeBetween(Window.unboundedPreceding, to) for to in (reach, -reach - 1))
    none = F.lit(0).cast("decimal(38,12)")
    totals = {
        "near_rows": F.count(F.lit(1)).over(until) - F.count(F.lit(1)).over(before),
        "near_sum": (F.coalesce(F.sum("_v").over(until), none) - F.coalesce(F.sum("_v").over(before), none)).cast("double"),
    }
    return copies.withColumns(totals).where("_home = _block").drop("_home", "_block", "_v")


def context(
    points: DataFrame, notes: DataFrame, key: str, at: str, start: str, end: str, reach: float, block: float
) -> DataFrame:
    """Notes with start < t + reach and end > t - reach for each point t; the result is the pairs.

    Points go to the block they lie in, notes to every block they can reach, so
    a pair meets exactly once and only near rows meet at all.
    """
    home = F.floor(F.col(at) / block)
    low = F.floor((F.col(start) - reach) / block)
    high = F.floor((F.col(end) + reach) / block)
    p = points.withColumn("_block", home)
    n = notes.withColumn("_block", F.explode(F.sequence(low, high)))
    return (
        p.join(n, [key, "_block"])
        .where((F.col(start) < F.col(at) + reach) & (F.col(end) > F.col(at) - reach))
        .drop("_block")
    )


def paired_notes(events: DataFrame, keys: list[str], order: list[str], is_start: str, at: str) -> DataFrame:
    """First-in-first-out pairing of start and stop events; stops without an open start are ignored.

    With s the running sum of +1 / -1, a stop is unmatched exactly when it takes
    s below zero and below everything before. Then the n-th start belongs to the
    n-th matched stop.
    """
    cut = scans.range_segments(events, keys, order)
    step = cut.withColumn("_d", F.when(F.col(is_start), 1).otherwise(-1))
    run = scans.scan(step, keys, order, {"_s": ("sum", "_d")})
    low = scans.scan(run, keys, order, {"_low": ("min", "_s")}, inclusive=False)
    unmatched = ~F.col(is_start) & (F.col("_s") < F.least(F.lit(0), F.coalesce("_low", F.lit(0))))
    kept = low.where(~unmatched).withColumns(
        {"_starts": F.when(F.col(is_start), 1).otherwise(0), "_stops": F.when(F.col(is_start), 0).otherwise(1)}
    )
    numbered = scans.scan(kept, keys, order, {"_ns": ("sum", "_starts"), "_ne": ("sum", "_stops")})
    n = F.when(F.col(is_start), F.col("_ns")).otherwise(F.col("_ne"))
    return (
        numbered.groupBy(*keys, n.alias("pair"))
        .agg(
            F.max(F.when(F.col(is_start), F.col(at))).alias("start_at"),
            F.max(F.when(~F.col(is_start), F.col(at))).alias("stop_at"),
        )
        .where("start_at is not null and stop_at is not null")
    )


BOX = ("x0", "y0", "x1", "y1")


def _near(
    left: DataFrame, right: DataFrame, form: str, x: Column, y: Column, rx: Column, ry: Column,
    dx: float, dy: float, hit: Column,
) -> DataFrame:
    """Left boxes with a right box near enough; cells as wide as the search reach."""
    around = F.sequence(F.lit(-1), F.lit(1))
    spread = left.withColumn("_cx0", F.floor(x / dx)).withColumn("_cy0", F.floor(y / dy))
    spread = spread.withColumn("_i", F.explode(around)).withColumn("_j", F.explode(around))
    spread = spread.withColumns({"_cx": F.col("_cx0") + F.col("_i"), "_cy": F.col("_cy0") + F.col("_j")})
    placed = right.withColumns({"_px": F.floor(rx / dx), "_py": F.floor(ry / dy)}).withColumnRenamed(form, "_form")
    same = (F.col(form) == F.col("_form")) & (F.col("_cx") == F.col("_px")) & (F.col("_cy") == F.col("_py"))
    # A semi join: no pair is made, and a left box is there nine times at most.
    return spread.join(placed, same & hit, "left_semi").select(form, *BOX).distinct()


def without_near_answer(questions: DataFrame, answers: DataFrame, form: str = "form") -> DataFrame:
    """Question boxes with no answer box right of them on the line or just below.

    Both tables have (form, id, x0, y0, x1, y1). Boxes that stand at the same place
    of a form meet once, for all their rows, so the comparisons within a cell
    depend on the places taken there and not on the rows.
    """
    boxes = questions.select(form, *BOX).distinct()
    a = answers.select(form, *[F.col(c).alias(f"a{c}") for c in BOX]).distinct()
    mid, amid = (F.col("y0") + F.col("y1")) / 2, (F.col("ay0") + F.col("ay1")) / 2
    gap = F.col("ax0") - F.col("x1")
    right = _near(
        boxes, a, form, F.col("x1"), mid, F.col("ax0"), amid, 250.0, 12.0,
        (F.abs(amid - mid) < 12) & (gap >= 0) & (gap < 250),
    )
    drop = F.col("ay0") - F.col("y1")
    below = _near(
        boxes, a, form, F.col("x0"), F.col("y1"), F.col("ax0"), F.col("ay0"), 60.0, 25.0,
        (drop >= 0) & (drop < 25) & (F.abs(F.col("ax0") - F.col("x0")) < 60),
    )
    near = right.unionByName(below).distinct()
    return questions.join(near, [form, *BOX], "left_anti").select(questions.columns)
