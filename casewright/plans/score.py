"""Scoring a run: cases and results in, summary, tracks and index out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators import chance, metrics, rollup
from casewright.operators.metrics import count_of
from casewright.plans import spec
from casewright.session import cut_lineage

ALL_TRACKS = "*"


def summary(fact: DataFrame, wall: str, small_groups: bool = False) -> DataFrame:
    """Per benchmark, and per track of it: statuses, native scores on complete groups, median latency.

    ``fact(catalog_id, group_id, track, status, gold, pred, hit, wall)``. The
    row for all tracks has track ``*``. Latency is over all ok rows, complete
    group or not. ``small_groups`` is for groups of few rows, which counting
    does not make fewer.
    """
    measures = {"_hits": (F.sum, F.col("hit")), "_answered": (F.sum, F.col("hit").isNotNull().cast("bigint"))}
    subtotals = metrics.row_subtotals if small_groups else metrics.counted_subtotals
    sub = subtotals(fact, ["catalog_id"], "group_id", ["track", "status", "gold", "pred"], measures)
    latency = metrics.exact_percentiles(
        fact.where("status = 'ok'"), ["catalog_id"], wall, {"median_ms": metrics.middle()}
    ).select("catalog_id", F.lit(ALL_TRACKS).alias("track"), "median_ms")
    return summary_of(rollup.without_groups(sub)).join(latency, ["catalog_id", "track"], "left")


def summary_of(sub: DataFrame) -> DataFrame:
    """``summary`` without its latency, from subtotals by track, status, gold and pred, with or without their groups."""
    done = F.col("complete")
    g, p = done & (F.col("gold") == "yes"), done & (F.col("pred") == "yes")
    counted = sub.groupingSets([["catalog_id"], ["catalog_id", "track"]], "catalog_id", "track").agg(
        F.when(F.grouping("track") == 1, ALL_TRACKS).otherwise(F.col("track")).alias("_track"),
        F.sum("n").alias("requests"),
        *[metrics.weighed(F.col("status") == s, "n").alias(n) for s, n in
          (("ok", "answered"), ("unsupported", "unsupported"), ("error", "errors"), ("abstained", "abstained"), ("pending", "pending"))],
        metrics.weighed(done, "n").alias("scored_requests"),
        F.try_divide(F.sum(F.when(done, F.col("_hits"))), F.sum(F.when(done, F.col("_answered")))).alias("score"),
        metrics.f1_of(metrics.weighed(g & p, "n"), metrics.weighed(g, "n"), metrics.weighed(p, "n")).alias("positive_f1"),
    )
    return counted.drop("track").withColumnRenamed("_track", "track")


def native_scores(fact: DataFrame, dim: DataFrame, positive: str = "yes") -> DataFrame:
    """(catalog_id, metric, score, answered, requests): each benchmark by its own metric, on complete groups.

    ``fact(catalog_id, group_id, status, gold_label, pred_label, hit, value)``;
    ``dim(catalog_id, metric)`` with metric ``accuracy``, ``macro_f1``,
    ``positive_f1``, ``case_exact`` or ``mean_value``. ``hit`` already accepts ties
    where a benchmark does; ``value`` is a row's own score (gain of a ranking,
    quality of a route, squared error). The fact is read once: rows are counted by
    group and label, and all metrics are taken from that table.
    """
    sub = cut_lineage(metrics.group_subtotals(
        fact.join(dim.select("catalog_id"), "catalog_id", "left_semi"), ["catalog_id"], "group_id", ["status", "gold_label", "pred_label"],
        F.sum("hit").alias("_hits"), F.count("hit").alias("_answered"), F.min("hit").alias("_all"),
        F.sum("value").alias("_value"), F.count("value").alias("_valued"),
    ))
    done = sub.where("complete")
    gold, pred = F.col("gold_label") == positive, F.col("pred_label") == positive
    base = sub.groupBy("catalog_id").agg(
        F.sum("n").alias("requests"), metrics.weighed(F.col("status") == "ok", "n").alias("answered"),
        F.try_divide(F.sum(F.when(F.col("complete"), F.col("_hits"))), F.sum(F.when(F.col("complete"), F.col("_answered")))).alias("accuracy"),
        F.try_divide(F.sum(F.when(F.col("complete"), F.col("_value"))), F.sum(F.when(F.col("complete"), F.col("_valued")))).alias("mean_value"),
        metrics.f1_of(
            metrics.weighed(F.col("complete") & gold & pred, "n"), metrics.weighed(F.col("complete") & gold, "n"),
            metrics.weighed(F.col("complete") & pred, "n"),
        ).alias("positive_f1"),
    )
    macro = metrics.macro_f1(done, ["catalog_id"], n="n")
    macro = macro.select("catalog_id", "macro_f1")
    cases = done.groupBy("catalog_id", "group_id").agg(F.min("_all").alias("_all")).groupBy("catalog_id").agg(F.avg("_all").alias("case_exact"))
    joined = dim.select("catalog_id", "metric").join(base, "catalog_id", "left").join(macro, "catalog_id", "left").join(cases, "catalog_id", "left")
    chosen = F.coalesce(*[F.when(F.col("metric") == m, F.col(m)) for m in ("accuracy", "macro_f1", "positive_f1", "case_exact", "mean_value")])
    return joined.select("catalog_id", "metric", chosen.alias("score"), F.coalesce("answered", F.lit(0)).alias("answered"), F.coalesce("requests", F.lit(0)).alias("requests"))


def edition_report(fact: DataFrame, dim: DataFrame, tracks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(values, index) of an edition from its fact: metric and rule of each benchmark come from ``dim`` (see ``spec``).

    ``tracks(catalog_id, raw, skill, coverage)`` holds the benchmarks scored by
    track; without it they count as not run. ``index`` is one row.
    """
    if tracks is None:
        tracks = dim.sparkSession.createDataFrame([], "catalog_id int, raw double, skill double, coverage double")
    native = native_scores(fact, dim)
    values = rollup.benchmark_values(dim, native.drop("metric"), tracks)
    filled = values.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("raw", "skill", "coverage")})
    return filled, index_of(filled.where("in_index"))


def run_latency(results: DataFrame, wall: str) -> DataFrame:
    """Median, p95 by floor index, and mean over all ok results of a run (one row)."""
    ok = results.where("status = 'ok'").withColumn("_all", F.lit(1))
    ranks = metrics.exact_percentiles(ok, ["_all"], wall, {"median": metrics.middle(), "p95": metrics.floor_index(0.95)})
    mean = ok.groupBy("_all").agg(F.avg(wall).alias("mean"))
    return ranks.join(mean, "_all").select("median", "p95", "mean")


def added_report(fact: DataFrame, wall: str) -> DataFrame:
    """Report of benchmarks scored by plain accuracy over answered fields, with chance on their rows."""
    base = fact.groupBy("catalog_id").agg(
        F.count(F.lit(1)).alias("requests"),
        *[count_of(F.col("status") == s).alias(n) for s, n in
          (("ok", "answered"), ("unsupported", "unsupported"), ("error", "errors"), ("abstained", "abstained"), ("pending", "pending"))],
        F.count("hit").alias("scored_fields"),
        F.avg("hit").alias("score"),
        F.avg(1.0 / F.col("n_options")).alias("chance"),
    )
    latency = metrics.exact_percentiles(
        fact.where("status = 'ok'"), ["catalog_id"], wall, {"median_ms": metrics.middle()}
    ).select("catalog_id", "median_ms")
    return base.join(latency, "catalog_id", "left")


def positive_class_report(fact: DataFrame, positive: str = "yes") -> DataFrame:
    """F1 of one class over answered fields and the fair-coin chance from its prevalence over all fields."""
    answered = fact.where("status = 'ok'")
    f1 = metrics.binary_f1(answered, ["catalog_id"], positive, out="score")
    return f1.join(chance.coin_f1(fact, ["catalog_id"], positive), "catalog_id")


def reference_on_same_cases(fact: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Mean reference hit over the complete cases of the run: (keys.., reference_same_cases).

    ``reference(catalog_id, group_id, hit, keys..)`` holds the reference model's
    answered fields.
    """
    group = ["catalog_id", "group_id"]
    by_group = list(dict.fromkeys([*keys, *group]))
    if set(keys) <= set(group):
        # States and answers of a group come from one count over both tables; nothing is joined.
        states = fact.select(*group, (F.col("status") == "ok").alias("_ok"), F.lit(None).cast("double").alias("hit"))
        answers = reference.select(*group, F.lit(None).cast("boolean").alias("_ok"), F.col("hit").cast("double").alias("hit"))
        both = states.unionByName(answers.withColumn("_answer", F.lit(True)), allowMissingColumns=True).where("catalog_id is not null and group_id is not null")
        counted = both.groupBy(*group).agg(
            F.bool_and("_ok").alias("_complete"), F.bool_or("_answer").alias("_answered"), F.sum("hit").alias("_hits"), F.count("hit").alias("_n")
        )
        same = counted.where("_complete AND _answered")
    else:
        done = metrics.group_state(fact, group).where("complete").select(*group)
        sub = reference.groupBy(*by_group).agg(F.sum("hit").alias("_hits"), F.count("hit").alias("_n"))
        same = sub.join(done, group, "left_semi")
    return same.groupBy(*keys).agg(metrics.mean_of("_hits", "_n").alias("reference_same_cases"))


def completion(cases: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Scoreable requests, requests with a result of any status, and whether a run is complete."""
    # Requests are counted where they lie; only the question whether there is a result needs a join.
    found = cases.join(results.select("run_id"), "run_id", "left_semi")
    both = cases.select(*keys, F.lit(1).alias("_expected"), F.lit(0).alias("_recorded")).unionByName(
        found.select(*keys, F.lit(0).alias("_expected"), F.lit(1).alias("_recorded"))
    )
    counted = both.groupBy(*keys).agg(F.sum("_expected").alias("expected"), F.sum("_recorded").alias("recorded"))
    return _completed(counted)


def completion_of(sub: DataFrame, keys: list[str]) -> DataFrame:
    """``completion`` from subtotals by status; a request without a result is pending."""
    recorded = metrics.weighed(F.col("status") != "pending", "n")
    return _completed(sub.groupBy(*keys).agg(F.sum("n").alias("expected"), recorded.alias("recorded")))


def _completed(counted: DataFrame) -> DataFrame:
    return counted.withColumn("complete", F.col("recorded") >= F.col("expected"))


def index_of(values: DataFrame) -> DataFrame:
    """Index scores of benchmark values that carry ``area_id``, ``gold_weight`` and ``fixed``."""
    return rollup.index_scores(rollup.area_scores(values))


def score_bundle(summary_rows: DataFrame, values: DataFrame, done: DataFrame) -> DataFrame:
    """One row per benchmark: native summary, index value if it has one, and completion.

    ``values(catalog_id, raw, skill)`` are the benchmarks that count; ``done``
    comes from ``completion`` or ``completion_of`` by benchmark. ``run_complete`` is the same on
    every row: each scoreable request of the run has a result of some status.
    """
    whole = done.agg(F.bool_and("complete").alias("run_complete")).withColumn("_one", F.lit(1))
    counted = values.select("catalog_id", "raw", "skill", F.lit(True).alias("in_index"))
    native = summary_rows.where(F.col("track") == ALL_TRACKS).drop("track").withColumn("_one", F.lit(1))
    # The flag is one row.
    return (
        native.join(counted, "catalog_id", "left")
        .join(F.broadcast(whole), "_one")
        .drop("_one")
        .withColumn("in_index", F.coalesce("in_index", F.lit(False)))
    )


def first_edition_report(tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(folded, frozen) index of the first edition from its track scores, one row each.

    The folded one leaves out what needs a player in the loop, folds an area into
    another and takes a benchmark's named track; a benchmark without scores does
    not count. The frozen one is a lower bound over the whole panel: what was not
    run counts as zero.
    """
    members, folds, heads = spec.panel_tables(tracks.sparkSession)
    bench = cut_lineage(rollup.benchmark_scores(tracks))
    named = rollup.headline(bench, tracks, heads)
    folded, _ = rollup.folded_index(named, members.where("NOT interactive").select("area_id", "catalog_id"), folds)
    frozen, _ = rollup.frozen_index(bench, members.where("NOT folded").select("area_id", "catalog_id"))
    return folded, frozen
