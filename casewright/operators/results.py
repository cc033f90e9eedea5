"""Result log semantics: which record of a run counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright import schema


def _latest(log: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Keep one whole record per key; combines before the shuffle, so a hot key costs nothing."""
    rest = [c for c in log.columns if c not in keys]
    picked = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return picked.select(*keys, "_r.*")


def latest(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Last record per key wins, whatever its status."""
    return _latest(log, keys, F.col(seq))


def latest_prediction(log: DataFrame, keys: list[str], pred: str = "pred", seq: str = "seq") -> DataFrame:
    """Last record that has a prediction wins; a failure never erases one."""
    order = F.struct(F.col(pred).isNotNull().alias("has"), F.col(seq).alias("at"))
    return _latest(log, keys, order)


def with_status(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Rows left-joined to their latest result; no result means ``pending``."""
    joined = rows.join(results, "run_id", "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("pending")))


def todo(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Rows still to run: not recorded, or recorded as ``error``."""
    done = results.where("status <> 'error'").select("run_id")
    return rows.join(done, "run_id", "left_anti")


def compact(results: DataFrame) -> DataFrame:
    """Drop payload and raw output."""
    return results.select(*[c for c in schema.COMPACT_COLUMNS if c in results.columns])


def merge_probabilities(answered: DataFrame, keys: list[str], probability: str, seq: str) -> DataFrame:
    """One probability per document over the chunks of a query; the last chunk wins."""
    return answered.groupBy(*keys).agg(F.max_by(probability, seq).alias(probability))
