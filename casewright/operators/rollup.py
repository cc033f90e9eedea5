"""From benchmark scores to area scores, the index and its parts.

The inputs here have one row per benchmark, track or area; their windows are
over those small tables. Row-level work ends in ``track_scores``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import scoring
from casewright.functions.skew import broadcast_if_small
from casewright.operators import metrics


# -- row level: per benchmark and track, unanswered groups count as wrong -----------------


def scored_tracks(rows: DataFrame, own_tracks: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Track name used for scoring: its own in listed benchmarks, else ``all``; skipped tracks go."""
    own = own_tracks.select("catalog_id").distinct().withColumn("_own", F.lit(True))
    out = rows.join(broadcast_if_small(own), "catalog_id", "left")
    if skipped is not None:
        out = out.join(broadcast_if_small(skipped.select("catalog_id", "track").distinct()), ["catalog_id", "track"], "left_anti")
    return out.withColumn("track", F.when(F.col("_own"), F.col("track")).otherwise("all")).drop("_own")


# What the rules below need of a row, and its type where a table of rows does not have it.
TRACK_COLUMNS = {
    "cluster": "string", "gold_label": "string", "pred_label": "string", "hit": "double", "n_accepted": "bigint", "n_options": "bigint",
    "quality": "double", "mean_quality": "double",
}


def track_subtotals(rows: DataFrame, also: tuple[str, ...] = (), small_groups: bool = False) -> DataFrame:
    """One table that all rules by track are taken from: rows by group, track, cluster and labels, with the group's state.

    Rows are read and shuffled once, however many rules follow; store it first.
    ``also`` names further columns that rows are told apart by. ``small_groups``
    is for groups of few rows, which counting does not make fewer.
    """
    full = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in TRACK_COLUMNS.items() if c not in rows.columns})
    dims = ["track", "cluster", "gold_label", "pred_label", *also]
    measures = {
        "_hits": (F.sum, F.col("hit")), "_answered": (F.sum, F.col("hit").isNotNull().cast("bigint")), "_all": (F.min, F.col("hit")),
        "_share": (F.sum, F.col("n_accepted") / F.col("n_options")), "_guess": (F.product, 1.0 / F.col("n_options")),
        "_quality": (F.sum, F.coalesce("quality", F.lit(0.0))), "_mean": (F.sum, F.col("mean_quality")),
    }
    subtotals = metrics.row_subtotals if small_groups else metrics.counted_subtotals
    return subtotals(full, ["catalog_id"], "group_id", dims, measures)


def without_groups(sub: DataFrame) -> DataFrame:
    """Subtotals added up over groups and clusters: few rows, for the rules that ask for neither; store them too."""
    sums = [c for c in ("n", "_hits", "_answered", "_share", "_quality", "_mean") if c in sub.columns]
    dims = [c for c in sub.columns if c not in (*sums, "group_id", "cluster", "_all", "_guess")]
    return sub.groupBy(*dims).agg(*[F.sum(c).alias(c) for c in sums])


def accuracy_of(sub: DataFrame) -> DataFrame:
    """Accuracy and its chance, averaged over clusters (one cluster when ``cluster`` is constant)."""
    value = F.sum(F.when(F.col("complete"), F.col("_hits")).otherwise(0.0))
    per = sub.groupBy("catalog_id", "track", "cluster").agg(
        (value / F.sum("n")).alias("_v"), (F.sum("_share") / F.sum("n")).alias("_c")
    )
    return per.groupBy("catalog_id", "track").agg(F.avg("_v").alias("raw"), F.avg("_c").alias("random"))


def whole_case_of(sub: DataFrame) -> DataFrame:
    """A group counts when every field is right; chance is the product over its fields."""
    per = sub.groupBy("catalog_id", "group_id", "track").agg(F.bool_and("complete").alias("complete"), F.min("_all").alias("_all"), F.product("_guess").alias("_c"))
    value = F.when(F.col("complete"), F.col("_all")).otherwise(0.0)
    return per.groupBy("catalog_id", "track").agg(F.avg(value).alias("raw"), F.avg("_c").alias("random"))


def conservative_of(sub: DataFrame, classes: DataFrame, chances: DataFrame) -> DataFrame:
    """Conservative F1 on the fixed classes; chance from a table (catalog_id, track, chance)."""
    answered = sub.withColumn("pred_label", F.when(F.col("complete"), F.col("pred_label")))
    raw = metrics.conservative_f1(answered, ["catalog_id", "track"], classes, n="n")
    return raw.join(chances, ["catalog_id", "track"]).select(
        "catalog_id", "track", F.col("conservative_f1").alias("raw"), F.col("chance").alias("random")
    )


def quality_of(sub: DataFrame) -> DataFrame:
    """Quality of the chosen route, 0 if the group is incomplete; chance is the mean over the routes."""
    value = F.sum(F.when(F.col("complete"), F.col("_quality")).otherwise(0.0))
    return sub.groupBy("catalog_id", "track").agg((value / F.sum("n")).alias("raw"), (F.sum("_mean") / F.sum("n")).alias("random"))


def accuracy_tracks(rows: DataFrame) -> DataFrame:
    """``accuracy_of`` rows with status, hit (1.0/0.0), n_accepted, n_options and cluster."""
    return accuracy_of(track_subtotals(rows))


def whole_case_tracks(rows: DataFrame) -> DataFrame:
    return whole_case_of(track_subtotals(rows))


def conservative_tracks(rows: DataFrame, classes: DataFrame, chances: DataFrame) -> DataFrame:
    return conservative_of(track_subtotals(rows), classes, chances)


def quality_tracks(rows: DataFrame) -> DataFrame:
    return quality_of(track_subtotals(rows))


def ranking_tracks(groups: DataFrame) -> DataFrame:
    """Mean nDCG over all groups, 0 if incomplete; chance is the random-order expectation."""
    value = F.when(F.col("complete"), F.coalesce("ndcg_at_10", F.lit(0.0))).otherwise(0.0)
    return groups.groupBy("catalog_id", "track").agg(F.avg(value).alias("raw"), F.avg("random_ndcg").alias("random"))


def track_scores(parts: list[DataFrame], rows: DataFrame) -> DataFrame:
    """Union of the rule outputs with skill, planned groups, coverage and pending share; ``rows`` may be their subtotals."""
    scores = parts[0]
    for part in parts[1:]:
        scores = scores.unionByName(part)
    sub = rows if "complete" in rows.columns else metrics.group_subtotals(rows, ["catalog_id"], "group_id", ["track"])
    planned = sub.groupBy("catalog_id", "track", "group_id").agg(F.bool_and("complete").alias("complete"), F.bool_or("pending").alias("pending"))
    cover = planned.groupBy("catalog_id", "track").agg(
        F.count(F.lit(1)).alias("planned_groups"),
        F.avg(F.col("complete").cast("double")).alias("coverage"),
        F.avg(F.col("pending").cast("double")).alias("pending"),
    )
    return scores.join(cover, ["catalog_id", "track"]).withColumn(
        "skill", scoring.skill(F.col("raw"), F.col("random"))
    )


def benchmark_scores(tracks: DataFrame) -> DataFrame:
    """Unweighted mean over the tracks of a benchmark."""
    return tracks.groupBy("catalog_id").agg(
        *[F.avg(c).alias(c) for c in ("raw", "skill", "coverage", "pending")], F.count(F.lit(1)).alias("tracks")
    )


def panel(scored: DataFrame, panel_ids: DataFrame) -> DataFrame:
    """Scores over a fixed panel; benchmarks that were not run score 0 and are fully pending."""
    joined = panel_ids.select("catalog_id").distinct().join(scored, "catalog_id", "left")
    return joined.select(
        "catalog_id",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("raw", "skill", "coverage")],
        F.coalesce("pending", F.lit(1.0)).alias("pending"),
        F.col("raw").isNull().alias("unrun"),
    )


def headline(scored: DataFrame, tracks: DataFrame, heads: DataFrame) -> DataFrame:
    """A named track replaces the mean; its skill is recomputed from its own chance."""
    named = tracks.join(heads.select("catalog_id", F.col("track")), ["catalog_id", "track"], "left_semi").select(
        "catalog_id",
        F.col("raw").alias("_raw"),
        F.when(F.coalesce("random", F.lit(0.0)) < 1, scoring.skill(F.col("raw"), F.coalesce("random", F.lit(0.0))))
        .otherwise(0.0)
        .alias("_skill"),
        F.col("coverage").alias("_coverage"),
        F.col("pending").alias("_pending"),
    )
    names = ("raw", "skill", "coverage", "pending")
    return scored.join(named, "catalog_id", "left").select(
        "catalog_id", *[F.coalesce(f"_{c}", c).alias(c) for c in names]
    )


# -- benchmark level: rules ---------------------------------------------------------------


def benchmark_values(dim: DataFrame, native: DataFrame, tracks: DataFrame) -> DataFrame:
    """Raw, skill and coverage of every benchmark by its rule.

    ``dim(catalog_id, rule, chance, baseline, best)``; ``native(catalog_id,
    score, answered, requests)``; ``tracks(catalog_id, raw, skill, coverage)``.
    The three rules round at different points, on purpose.
    """
    t = tracks.select(
        "catalog_id", F.col("raw").alias("_raw"), F.col("skill").alias("_skill"), F.col("coverage").alias("_cov")
    )
    joined = dim.join(native, "catalog_id", "left").join(t, "catalog_id", "left")
    cov = scoring.share(F.coalesce("answered", F.lit(0)), F.coalesce("requests", F.lit(0)))
    score, chance = F.col("score"), F.col("chance")

    loss = F.coalesce(
        scoring.clip((F.col("baseline") - F.round(score, 4)) / (F.col("baseline") - F.col("best"))) * cov, F.lit(0.0)
    )
    added_raw = F.round(F.coalesce(score * cov, F.lit(0.0)), 4)
    shown_raw = F.coalesce(F.round(score, 4) * cov, F.lit(0.0))

    def corrected(raw: Column) -> Column:
        return F.when(chance < 1, scoring.skill(raw, F.when(chance < 1, chance))).otherwise(raw)

    rule = F.col("rule")
    raw = (
        F.when(rule == "track", F.round("_raw", 4)).when(rule == "loss", loss).when(rule == "added", added_raw).otherwise(shown_raw)
    )
    skill = (
        F.when(rule == "track", F.round("_skill", 4))
        .when(rule == "loss", loss)
        .when(rule == "added", F.round(corrected(added_raw), 4))
        .otherwise(corrected(shown_raw))
    )
    coverage = F.when(rule == "track", F.round("_cov", 4)).otherwise(cov)
    return joined.select(*dim.columns, raw.alias("raw"), skill.alias("skill"), coverage.alias("coverage"))


def benchmark_weights(values: DataFrame) -> DataFrame:
    """Weights inside an area: ``gold_weight`` (1.0 if null) over their sum."""
    w = F.coalesce("gold_weight", F.lit(1.0))
    return values.withColumn("weight", w / F.sum(w).over(Window.partitionBy("area_id")))


def area_weights(areas: DataFrame) -> DataFrame:
    """``areas(area_id, n_benchmarks, fixed)``: fixed weights stay, the rest share what is left by sqrt(count).

    Without any fixed weight the areas are not sized and weigh the same.
    """
    every = Window.partitionBy(F.lit(1))
    root = F.when(F.col("fixed").isNull(), F.sqrt(F.col("n_benchmarks").cast("double")))
    marked = areas.withColumns(
        {"_root": root, "_roots": F.sum(root).over(every), "_fixed": F.sum("fixed").over(every), "_n": F.count(F.lit(1)).over(every)}
    )
    weight = (
        F.when(F.col("_fixed").isNull(), 1.0 / F.col("_n"))
        .when(F.col("fixed").isNotNull(), F.col("fixed"))
        .otherwise((1 - F.col("_fixed")) * F.col("_root") / F.col("_roots"))
    )
    return marked.withColumn("area_weight", weight).drop("_root", "_roots", "_fixed", "_n")


def area_scores(values: DataFrame) -> DataFrame:
    """Weighted means per area of raw, skill and coverage."""
    w = F.coalesce("gold_weight", F.lit(1.0))
    return values.groupBy("area_id").agg(
        *[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in ("raw", "skill", "coverage")],
        F.count(F.lit(1)).alias("n_benchmarks"),
        F.max("fixed").alias("fixed"),
    )


def index_scores(areas: DataFrame) -> DataFrame:
    """One row: weighted skill, weighted raw and breadth (geometric, floor 0.1), each x100."""
    weighted = area_weights(areas)
    w = F.col("area_weight")
    total = F.sum(w)
    breadth = F.exp(F.sum(w * F.log(0.1 + 0.9 * F.col("skill"))) / total)
    return weighted.agg(
        (100 * F.sum(w * F.col("skill")) / total).alias("balanced_skill"),
        (100 * F.sum(w * F.col("raw")) / total).alias("balanced_raw"),
        (100 * (breadth - 0.1) / 0.9).alias("breadth_skill"),
        F.avg("coverage").alias("coverage"),
    )


def weighted_means(df: DataFrame, keys: list[str], weight: str, value: str, floor: float = 0.1) -> DataFrame:
    """Weighted arithmetic mean and floored weighted geometric mean."""
    w, x = F.col(weight), F.col(value)
    total = F.sum(w)
    geo = F.exp(F.sum(w * F.log(floor + (1 - floor) * x)) / total)
    return df.groupBy(*keys).agg(
        (F.sum(w * x) / total).alias("weighted_mean"), ((geo - floor) / (1 - floor)).alias("weighted_geometric")
    )


def folded_index(scored: DataFrame, members: DataFrame, folds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal-weight index with some areas folded into others: (scores, areas).

    ``members(area_id, catalog_id)``; ``folds(area_id, into_area)``.
    """
    placed = members.join(broadcast_if_small(folds), "area_id", "left").select(
        F.coalesce("into_area", "area_id").alias("area_id"), "catalog_id"
    )
    values = placed.join(scored, "catalog_id").withColumns(
        {"gold_weight": F.lit(None).cast("double"), "fixed": F.lit(None).cast("double")}
    )
    areas = area_scores(values)
    return index_scores(areas), areas


def frozen_index(scored: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lower bound over a frozen panel: benchmarks that were not run count as 0."""
    filled = panel(scored, members)
    values = members.join(filled, "catalog_id").withColumns(
        {"gold_weight": F.lit(None).cast("double"), "fixed": F.lit(None).cast("double")}
    )
    areas = area_scores(values)
    return index_scores(areas), areas


def index_report(values: DataFrame, edition: str) -> DataFrame:
    """One nested row: index, scores, areas with their benchmarks, and rows shown but not counted."""
    counted = values.where("in_index")
    areas = area_scores(counted)
    scores = index_scores(areas)
    per_area = counted.groupBy("area_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "catalog_id", F.round("raw", 4).alias("raw"), F.round("skill", 4).alias("skill"),
                    F.round("coverage", 4).alias("coverage"), "rule",
                )
            )
        ).alias("benchmarks")
    )
    nested = areas.join(per_area, "area_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "area_id", F.round("raw", 4).alias("raw"), F.round("skill", 4).alias("skill"),
                    F.round("coverage", 4).alias("coverage"), F.col("n_benchmarks").alias("n"), "benchmarks",
                )
            )
        ).alias("areas")
    )
    shown = values.where("not in_index").agg(
        F.array_sort(
            F.collect_list(F.struct("catalog_id", F.round("raw", 4).alias("raw"), F.round("skill", 4).alias("skill")))
        ).alias("shown_not_counted")
    )
    # Three one-row tables side by side.
    one = F.lit(1).alias("_one")
    joined = (
        scores.select(one, "*").join(nested.select(one, "*"), "_one").join(shown.select(one, "*"), "_one").drop("_one")
    )
    return joined.select(
        F.lit(edition).alias("edition"),
        F.round("balanced_skill", 2).alias("index"),
        F.round("balanced_raw", 2).alias("raw_index"),
        F.round("breadth_skill", 2).alias("breadth_index"),
        F.round("coverage", 4).alias("coverage"),
        "areas",
        "shown_not_counted",
    )


# -- images -------------------------------------------------------------------------------


def vision_scores(rows: DataFrame, predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """Per benchmark: rows, answered, accuracy, chance, skill (not clipped); unanswered is wrong.

    ``rows(benchmark, run_id, gold, n_options)``; ``predictions(run_id, pred)``;
    ``weights(benchmark, weight)``.
    """
    p = predictions.select("run_id", "pred", F.lit(True).alias("_has"))
    joined = rows.join(p, "run_id", "left")
    right = F.coalesce((F.col("pred") == F.col("gold")).cast("double"), F.lit(0.0))
    per = joined.groupBy("benchmark").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("pred").alias("answered"),
        F.count_if(F.col("_has").isNull()).alias("missing"),
        F.avg(right).alias("accuracy"),
        F.avg(1.0 / F.col("n_options")).alias("chance"),
    )
    skill = (F.col("accuracy") - F.col("chance")) / (1 - F.col("chance"))
    return (
        per.withColumn("skill", skill)
        .withColumn("skill_clipped", scoring.clip(F.col("skill")))
        .join(broadcast_if_small(weights), "benchmark")
    )


def vision_index(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean of the clipped skills x100, and whether every benchmark is complete."""
    have = scores.agg(
        (100 * F.sum(F.col("weight") * F.col("skill_clipped")) / F.sum("weight")).alias("public_index"),
        F.sum("missing").alias("missing_rows"),
        F.count(F.lit(1)).alias("_have"),
    )
    planned = weights.agg(F.count(F.lit(1)).alias("_planned"))
    one = F.lit(1).alias("_one")
    both = have.select(one, "*").join(planned.select(one, "*"), "_one").drop("_one")
    return both.select(
        "public_index", "missing_rows", ((F.col("_have") == F.col("_planned")) & (F.col("missing_rows") == 0)).alias("complete")
    )
