"""What random guessing would score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators.metrics import binary_f1


def expected_accuracy(df: DataFrame, keys: list[str], n_accepted: str | None = None) -> DataFrame:
    """Mean of accepted / options over the fields."""
    top = F.col(n_accepted).cast("double") if n_accepted else F.lit(1.0)
    return df.groupBy(*keys).agg(F.avg(top / F.col("n_options")).alias("chance"))


def whole_case(df: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Mean over the groups of the product of 1 / options over all their fields."""
    per = df.groupBy(*keys, group).agg(F.product(1.0 / F.col("n_options")).alias("_c"))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"), F.avg("_c").alias("chance"))


def coin_f1(df: DataFrame, keys: list[str], positive: str = "true", gold: str = "gold") -> DataFrame:
    """F1 of a fair coin: p / (p + 0.5) at prevalence p."""
    p = F.avg((F.col(gold) == positive).cast("double"))
    return df.groupBy(*keys).agg(p.alias("prevalence")).withColumn(
        "chance", F.col("prevalence") / (F.col("prevalence") + 0.5)
    )


def always_yes_f1(df: DataFrame, keys: list[str], positive: str = "yes", gold: str = "gold") -> DataFrame:
    """F1 of always answering yes."""
    return binary_f1(df.withColumn("_p", F.lit(positive)), keys, positive, gold, "_p", "chance")


def always_yes_review_f1(df: DataFrame, keys: list[str], group: str, gold_is_yes) -> DataFrame:
    """Per-group F1 of always answering yes."""
    from casewright.operators.metrics import review_f1

    return review_f1(df, keys, group, gold_is_yes, F.lit(True)).withColumnRenamed("review_f1", "chance")


def cluster_accuracy(df: DataFrame, keys: list[str], cluster: str, n_accepted: str | None = None) -> DataFrame:
    """Expected accuracy averaged over clusters."""
    return (
        expected_accuracy(df, [*keys, cluster], n_accepted).groupBy(*keys).agg(F.avg("chance").alias("chance"))
    )


def random_quality(outcomes: DataFrame, keys: list[str], case: str, quality: str) -> DataFrame:
    """Mean over cases of the mean quality over their options."""
    return (
        outcomes.groupBy(*keys, case).agg(F.avg(quality).alias("_q")).groupBy(*keys).agg(F.avg("_q").alias("chance"))
    )
