"""Which rows an edition counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions.skew import broadcast_if_small


def exclude(rows: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Drop rows on the exclusion list."""
    return rows.join(broadcast_if_small(exclusions.select("run_id")), "run_id", "left_anti")


def keep_listed(rows: DataFrame, subset: DataFrame) -> DataFrame:
    """Keep rows whose run id is listed."""
    return rows.join(broadcast_if_small(subset.select("run_id")), "run_id", "left_semi")


def in_edition(rows: DataFrame, retired: DataFrame, replaced: DataFrame, subset: DataFrame) -> DataFrame:
    """Edition filter.

    ``retired(catalog_id)`` benchmarks go; in a ``replaced(catalog_id, prefix)``
    benchmark only ids with the new prefix stay; in a benchmark that has rows in
    ``subset(catalog_id, run_id)`` only listed ids stay; the rest passes.
    """
    gone = retired.select("catalog_id").distinct().withColumn("_gone", F.lit(True))
    new = replaced.select("catalog_id", F.col("prefix").alias("_prefix"))
    cut = subset.select("catalog_id").distinct().withColumn("_cut", F.lit(True))
    listed = subset.select("catalog_id", "run_id").distinct().withColumn("_listed", F.lit(True))
    keep = (
        F.col("_gone").isNull()
        & (F.col("_prefix").isNull() | F.expr("startswith(run_id, _prefix)"))
        & (F.col("_cut").isNull() | F.col("_listed").isNotNull())
    )
    # The three per-catalog tables have at most one row per benchmark.
    return (
        rows.join(broadcast_if_small(gone), "catalog_id", "left")
        .join(broadcast_if_small(new), "catalog_id", "left")
        .join(broadcast_if_small(cut), "catalog_id", "left")
        .join(broadcast_if_small(listed), ["catalog_id", "run_id"], "left")
        .where(keep)
        .drop("_gone", "_prefix", "_cut", "_listed")
    )


def cut_groups(rows: DataFrame, subset_groups: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Group-preserving cut.

    In a benchmark that has rows in ``subset_groups(catalog_id, group_id)`` a row
    stays if its group is listed or holds an excluded row.
    """
    limited = subset_groups.select("catalog_id").distinct().withColumn("_limited", F.lit(True))
    carried = rows.join(broadcast_if_small(exclusions.select("run_id")), "run_id", "left_semi").select(
        "catalog_id", "group_id"
    )
    kept = subset_groups.select("catalog_id", "group_id").unionByName(carried).distinct()
    kept = kept.withColumn("_kept", F.lit(True))
    return (
        rows.join(broadcast_if_small(limited), "catalog_id", "left")
        .join(kept, ["catalog_id", "group_id"], "left")
        .where("_limited is null or _kept")
        .drop("_limited", "_kept")
    )


def resolve_edition(name: str | None, editions: DataFrame) -> DataFrame:
    """One row of ``dim_edition(edition, alias, ...)`` for an id or alias; fails if unknown."""
    wanted = editions if name is None else editions.where((F.col("edition") == name) | (F.col("alias") == name))
    wanted = wanted.where("is_default") if name is None else wanted
    if wanted.limit(1).count() == 0:
        raise ValueError(f"unknown edition {name!r}")
    return wanted.limit(1)


def compatible(editions: DataFrame, digests: list[str]) -> DataFrame:
    """Pairs of editions whose row digests agree; a missing digest agrees with a missing one.

    The editions table has one row per published edition. Equal digests meet by
    key, so only agreeing pairs are built.
    """
    key = F.to_json(F.struct(*[F.coalesce(F.col(c), F.lit("-")).alias(c) for c in digests]))
    keyed = editions.select("edition", key.alias("_k"))
    a = keyed.withColumnRenamed("edition", "edition_a")
    b = keyed.withColumnRenamed("edition", "edition_b")
    return a.join(b, "_k").select("edition_a", "edition_b")
