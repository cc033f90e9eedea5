"""Ranks with ties, histories, runs and balanced positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import hashing, scans

HISTORY_BLOCK = 256


def best_with_ties(df: DataFrame, keys: list[str], value: str, tolerance: float = 0.0, smallest: bool = False) -> DataFrame:
    """All rows that reach the best value of their key."""
    best = df.groupBy(*keys).agg((F.min if smallest else F.max)(value).alias("_best"))
    return df.join(best, keys).where(F.abs(F.col("_best") - F.col(value)) <= tolerance).drop("_best")


def chain_ranks(df: DataFrame, entrant: str, score: str, tie: float) -> DataFrame:
    """Leaderboard ranks: a gap of more than ``tie`` to the entry before starts a new rank."""
    ordered = df.where(F.col(score).isNotNull()).select(entrant, score).withColumn("_neg", -F.col(score))
    cut = scans.range_segments(ordered, [], ["_neg", entrant])
    placed = scans.scan(cut, [], ["_neg", entrant], {"_at": ("number", None), "_prev": ("prev", score)})
    starts = placed.withColumn(
        "_start", F.when(F.col("_prev").isNull() | (F.col("_prev") - F.col(score) > tie), F.col("_at"))
    )
    ranked = scans.scan(starts, [], ["_neg", entrant], {"rank": ("max", "_start")})
    ties = ranked.groupBy("rank").agg((F.count(F.lit(1)) > 1).alias("tied"))
    return ranked.join(ties, "rank").select(entrant, score, "rank", "tied")


def history(
    turns: DataFrame, conv: str, turn: str, item: Column, include_current: bool = True,
    at: Column | None = None, block: int = HISTORY_BLOCK,
) -> DataFrame:
    """Ordered items of a conversation up to each row (or up to the row before).

    ``turn`` is a whole number. Rows are scanned in blocks of turn numbers. What
    lies before a block is put together from blocks of powers of two, one for each
    bit of the block's number, and each of these is built once: a conversation of
    n blocks meets them in n log n rows, and is never read by one task. ``at``
    picks the rows that are emitted.
    """
    rows = turns.withColumns({"_item": item, "_block": F.floor(F.col(turn) / block)})
    inside = Window.partitionBy(conv, "_block").orderBy(turn)
    frame = inside.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    local = rows.withColumn("_local", F.collect_list("_item").over(frame))
    emitted = local if at is None else local.where(at)
    ends = turns.agg(F.floor(F.min(turn) / block).alias("low"), F.floor(F.max(turn) / block).alias("high")).first()
    levels = 0 if ends["low"] is None else int(ends["high"] - ends["low"]).bit_length()
    if not levels:
        return emitted.withColumn("history", F.col("_local")).drop("_item", "_block", "_local")
    # Block numbers count from the first block of the table.
    blocks = rows.groupBy(conv, "_block").agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col("_item").alias("i")))).alias("_items"))
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("_level")
    own = F.col("_block") - F.lit(ends["low"])
    # A block of 2**j blocks stands before another exactly at that one's set bit j; its own number is even then.
    parts = blocks.select(conv, own.alias("_n"), "_items", level).withColumn("_part", F.expr("shiftright(_n, _level)")).where("_part % 2 = 0")
    built = parts.groupBy(conv, "_level", "_part").agg(F.array_sort(F.collect_list(F.struct("_n", "_items"))).alias("_p")).select(
        conv, "_level", "_part", F.flatten(F.transform("_p", lambda p: p["_items"])).alias("_items")
    )
    wanted = blocks.select(conv, "_block", own.alias("_n"), level).where("shiftright(_n, _level) % 2 = 1")
    prefix = (
        wanted.select(conv, "_block", "_level", F.expr("shiftright(_n, _level) - 1").alias("_part")).join(built, [conv, "_level", "_part"])
        .groupBy(conv, "_block").agg(F.sort_array(F.collect_list(F.struct("_level", "_items")), asc=False).alias("_p"))
        .select(conv, "_block", F.transform(F.flatten(F.transform("_p", lambda p: p["_items"])), lambda s: s["i"]).alias("_before"))
    )
    out = emitted.join(prefix, [conv, "_block"], "left")
    full = F.when(F.col("_before").isNull(), F.col("_local")).otherwise(F.concat("_before", "_local"))
    return out.withColumn("history", full).drop("_item", "_block", "_local", "_before")


def longest_runs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Longest run of equal values in the sorted values of each key: the largest value count."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.max("_n").alias("max_run"))


def occurrence_ids(df: DataFrame, row_id: str, pos: str) -> DataFrame:
    """Repeated ids get ``#k`` by occurrence; the first keeps its name."""
    cut = scans.range_segments(df, [row_id], [pos])
    numbered = scans.row_numbers(cut, [row_id], [pos], "_k").drop(scans.SEG)
    name = F.when(F.col("_k") == 1, F.col(row_id)).otherwise(
        F.concat(F.col(row_id), F.lit("#"), (F.col("_k") - 1).cast("string"))
    )
    return numbered.withColumn("unique_id", name).drop("_k")


def gold_positions(df: DataFrame, row_id: str, n_options: str, seed: str) -> DataFrame:
    """Gold letter positions used equally often among rows with the same option count."""
    hashed = df.withColumn("_h", hashing.sha(seed, F.col(row_id)))
    numbered = scans.row_numbers(scans.hash_segments(hashed, "_h"), [n_options], ["_h"])
    return numbered.withColumn("position", (F.col("rn") - 1) % F.col(n_options)).drop("rn", "_h", scans.SEG)


def chunks(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Fixed-size blocks of an ordered inventory, numbered from 0."""
    cut = scans.range_segments(df, keys, order)
    return (
        scans.row_numbers(cut, keys, order)
        .withColumn("chunk", F.floor((F.col("rn") - 1) / size))
        .drop("rn", scans.SEG)
    )


def hash_shuffled(df: DataFrame, options: str, seed: str, row_id: str, out: str) -> DataFrame:
    """Options of each row in the order of ``seed:row:option`` hashes."""
    return df.withColumn(out, hashing.hash_order(F.col(options), seed, F.col(row_id)))
