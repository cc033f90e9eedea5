"""Digests of row sets and files, and their comparison with pinned values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions import hashing, scans
from casewright.functions.skew import broadcast_if_small

LIST_LIMIT = 1_000_000


def row_set_fingerprint(df: DataFrame, keys: list[str], row_id: str, payload_sha: str) -> DataFrame:
    """Order-free fingerprint of the (id, payload digest) lines of each key.

    Four 60-bit words of every line's sha-256 are summed; sums combine before
    the shuffle, so a key of any size needs one small state.
    """
    line = hashing.sha(F.concat(F.col(row_id).cast("string"), F.lit(" "), F.col(payload_sha)))
    words = [F.conv(F.substring(line, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    summed = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(w).alias(f"_w{i}") for i, w in enumerate(words)])
    text = F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"_w{i}").cast("string") for i in range(4)])
    return summed.withColumn("fingerprint", F.sha2(text, 256)).drop(*[f"_w{i}" for i in range(4)])


def pinned_digests(df: DataFrame, keys: list[str], row_id: str, payload_sha: str) -> DataFrame:
    """sha-256 over the id-sorted lines of each key, as published pins of small suites state it.

    A digest of a byte sequence has no parallel form, so this is an export check
    for suites as small as published ones, and says so for keys of more than a
    million rows; ``segment_digests`` and ``row_set_fingerprint`` have no bound.
    """
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LIST_LIMIT).limit(1).collect()
    if large:
        raise ValueError(f"{large[0].asDict()}: too many rows for a sequential digest, use segment_digests or row_set_fingerprint")
    pair = F.struct(F.col(row_id).cast("string").alias("i"), F.col(payload_sha).alias("p"))
    listed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(pair)).alias("_l"))
    ids = F.concat_ws("", F.transform("_l", lambda s: F.concat(s["i"], F.lit("\n"))))
    lines = F.concat_ws("", F.transform("_l", lambda s: F.concat(s["i"], F.lit(" "), s["p"], F.lit("\n"))))
    return listed.select(
        *keys,
        F.size("_l").cast("bigint").alias("rows"),
        F.sha2(ids, 256).alias("run_ids_sha256"),
        F.sha2(lines, 256).alias("payloads_sha256"),
    )


def segment_digests(df: DataFrame, keys: list[str], row_id: str, payload_sha: str, size: int = 10_000) -> DataFrame:
    """(keys.., segment, rows, digest): sha-256 over each ``size`` id-sorted lines of a key, for keys of any size.

    Rows are numbered by segments of their order, so no task holds more than one of
    those or one digest's lines.
    """
    cut = scans.range_segments(df.select(*keys, row_id, payload_sha), keys, [row_id])
    placed = scans.row_numbers(cut, keys, [row_id]).withColumn("segment", F.floor((F.col("rn") - 1) / size))
    line = F.struct("rn", F.concat(F.col(row_id).cast("string"), F.lit(" "), F.col(payload_sha), F.lit("\n")).alias("t"))
    listed = placed.groupBy(*keys, "segment").agg(F.array_sort(F.collect_list(line)).alias("_l"))
    text = F.concat_ws("", F.transform("_l", lambda s: s["t"]))
    return listed.select(*keys, "segment", F.size("_l").cast("bigint").alias("rows"), F.sha2(text, 256).alias("digest"))


def against_pins(found: DataFrame, pins: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Each pinned key with one match flag per column; a key that was not found matches nothing."""
    want = pins.select(*keys, *[F.col(c).alias(f"_want_{c}") for c in columns])
    joined = broadcast_if_small(want).join(found, keys, "left")
    flags = [F.col(c).eqNullSafe(F.col(f"_want_{c}")).alias(f"{c}_match") for c in columns]
    return joined.select(*keys, *flags)
