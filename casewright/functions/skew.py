"""Joins whose key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARES = 1000
PLAIN_JOIN_ROWS = 2_000_000
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
# A small table's rounds: rows a task has, and the fewest partitions it is left in.
ROWS_A_TASK = 10_000
LEAST_TASKS = 8


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True when the DataFrame has at most ``rows`` rows that take at most ``size`` bytes; reads no more than needed."""
    width = F.octet_length(F.struct(*[F.col(f"`{c}`") for c in df.columns]).cast("string"))
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return found["n"] <= rows and found["b"] <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast only after counting rows and bytes; otherwise leave the strategy to the optimizer."""
    return F.broadcast(df) if small_enough(df, rows) else df


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more partitions than ``rows`` rows need, without a shuffle; zero rows: as it is.

    For rounds over small tables: a shuffle's partitions follow the largest table of
    a job, and a few rows in hundreds of them cost a task each, round after round.
    """
    return df.coalesce(max(LEAST_TASKS, -(-rows // ROWS_A_TASK))) if rows else df


def hot_keys(df: DataFrame, key: str, total: int, shares: int = HOT_SHARES) -> DataFrame:
    """Keys that hold more than 1/shares of the rows; at most ``shares`` of them exist."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counted.where(F.col("_n") * shares > total).select(key)


def hot_values(df: DataFrame, value: Column, shares: int = HOT_SHARES, plain_rows: int = PLAIN_JOIN_ROWS) -> list:
    """Values of a column without nulls that more than 1/shares of the rows have; none below ``plain_rows``.

    Only a summary of the column leaves the tasks: candidates come from frequent
    items, at most ``shares`` of them, and are then counted.
    """
    named = df.select(value.alias("_k"))
    total = named.count()
    if total <= plain_rows:
        return []
    candidates = named.stat.freqItems(["_k"], 1 / shares).first()[0]
    counted = named.where(F.col("_k").isin(candidates)).groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    return [r["_k"] for r in counted.where(F.col("_n") * shares > total).collect()]


def lookup(left: DataFrame, right: DataFrame, key: str, plain_rows: int = PLAIN_JOIN_ROWS) -> DataFrame:
    """Inner join to a side with one row per key, safe for hot keys on the left.

    Rows of hot keys meet a broadcast of the few matching right rows where they
    stand; all others are shuffled. Below ``plain_rows`` one task can hold any
    key, and a plain join is used.
    """
    total = left.count()
    if total <= plain_rows:
        return left.join(right, key)
    hot = F.broadcast(hot_keys(left, key, total))
    hot_right = right.join(hot, key, "left_semi")
    hot_rows = left.join(F.broadcast(hot_right), key)
    cold_rows = left.join(hot, key, "left_anti").join(right, key)
    return hot_rows.unionByName(cold_rows)


def salted_lookup(left: DataFrame, right: DataFrame, key: str, spread_on: str, salts: int = 16) -> DataFrame:
    """Inner join to a side with one row per key, the left rows of a key spread over ``salts`` tasks.

    For lookups that feed a group-by on the same key, where the adaptive skew
    split is not applied.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread_on), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "_salt"]).drop("_salt")
