"""The whole way from cases to scores with a predictor in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions import scoring
from casewright.operators import facts, inference, metrics, retrieval, rollup
from casewright.operators import results as result_log
from casewright.plans import score
from casewright.session import cut_lineage


# What a case may carry beyond question and gold, and what it means for its score.
#   accepted   map of a field to the options that count as right (ties)
#   outcomes   map of an option to the quality it leads to (routing)
#   event      0.0 or 1.0, what the answered probability forecast
#   documents  map of a field to the document it asks about (ranking; relevance comes with ``qrels``)
#   cluster    accuracy is averaged over these first
SCORING = ("accepted", "outcomes", "event", "documents", "cluster")


def scored_fact(cases: DataFrame, log: DataFrame) -> DataFrame:
    """One row per field with its prediction, hit and own value, from a raw result log.

    ``value`` is the quality of the chosen route, or the squared error of a
    forecast; null where a case has neither, or no answer. The columns of
    ``SCORING`` that the cases have come along.
    """
    last = inference.parsed_log(result_log.latest(log, ["run_id"]))
    yes = {"p_yes": lambda a: F.coalesce(a["noul"], F.try_element_at(a["probabilities"], F.lit("yes")))}
    fact = facts.fact(facts.fields(cases), last, yes)
    own = [c for c in SCORING if c in cases.columns]
    if own:
        fact = fact.join(cases.select("run_id", *own), "run_id")
    kinds = {"accepted": "map<string,array<string>>", "outcomes": "map<string,double>", "event": "double", "documents": "map<string,string>", "cluster": "string"}
    fact = fact.withColumns({c: F.lit(None).cast(kinds[c]) for c in SCORING if c not in own})
    listed = F.coalesce(F.try_element_at("accepted", F.col("field")), F.array("gold"))
    answered = F.col("status") == "ok"
    return fact.withColumns({
        "hit": F.when(answered, metrics.hit(F.col("gold"), F.col("pred"), listed)),
        "n_accepted": F.size(listed).cast("bigint"),
        "value": F.when(answered, F.coalesce(F.try_element_at("outcomes", F.col("pred")), (F.col("p_yes") - F.col("event")) ** 2)),
    })


def evaluate(
    cases: DataFrame, engine: str, predictor: Callable[[], inference.Predictor], log_path: str, waves: int = 8,
    limit: int | None = None,
) -> DataFrame:
    """Run what is not yet in the log, then summarise every benchmark and track from the log."""
    inference.run_in_waves(inference.request_json(cases), engine, predictor, log_path, waves, limit)
    log = inference.read_log(cases.sparkSession, log_path)
    return score.summary(scored_fact(cases, log), "total_wall_ms")


def ranked_groups(fact: DataFrame, qrels: DataFrame) -> DataFrame:
    """(catalog_id, track, group_id, complete, pending, ndcg_at_10, random_ndcg) of each group that ranks documents.

    ``qrels(catalog_id, group_id, doc_id, rel)`` holds what is judged, retrieved or not.
    """
    rows = fact.where("documents IS NOT NULL").withColumn("doc_id", F.try_element_at("documents", F.col("field")))
    query = F.struct("catalog_id", "group_id")
    asked = rows.where("doc_id IS NOT NULL").select(query.alias("query_id"), "doc_id", F.col("p_yes").alias("prob"))
    judged = qrels.select(query.alias("query_id"), F.col("doc_id").cast("string").alias("doc_id"), "rel")
    scored = retrieval.ranking_scores(asked, judged, "query_id", "doc_id", "prob", "rel").select("query_id", "ndcg_at_10")
    chance = retrieval.random_ndcg(asked, judged, "query_id", "doc_id", "rel")
    state = metrics.group_state(rows, ["catalog_id", "track", "group_id"]).withColumn("query_id", query)
    return state.join(scored, "query_id", "left").join(chance, "query_id", "left").drop("query_id")


def track_values(cases: DataFrame, fact: DataFrame, dim: DataFrame, groups: DataFrame, own_tracks: DataFrame | None = None) -> DataFrame:
    """(catalog_id, raw, skill, coverage, ...) of the benchmarks that ``dim`` scores by track, each by its rule.

    Rankings by their groups, routes by quality, the others by their metric: whole
    cases, conservative F1 over all labels that the questions offer, accuracy.
    """
    kept = fact.join(F.broadcast(dim.where("rule = 'track'").select("catalog_id", "metric", "chance")), "catalog_id")
    own = own_tracks if own_tracks is not None else dim.select("catalog_id").limit(0)
    rows = rollup.scored_tracks(kept, own).withColumns({
        "cluster": F.coalesce("cluster", F.lit("all")), "quality": F.try_element_at("outcomes", F.col("pred")),
        "mean_quality": F.aggregate(F.map_values("outcomes"), F.lit(0.0), lambda a, x: a + x) / F.size("outcomes"),
    })
    # The rule of a row is one more part of its track while the rows are counted.
    kind = (
        F.when(F.col("documents").isNotNull(), "ranking").when(F.col("outcomes").isNotNull(), "route")
        .when(F.col("metric").isin("macro_f1", "positive_f1"), "f1").when(F.col("metric") == "case_exact", "case").otherwise("accuracy")
    )
    rows = rows.withColumn("_kind", kind)
    sub = cut_lineage(rollup.track_subtotals(rows.withColumn("track", F.struct("_kind", "track"))))
    sub = sub.select("*", F.col("track._kind").alias("_kind"), F.col("track.track").alias("_track")).drop("track").withColumnRenamed("_track", "track")
    offered = F.explode(F.transform("_q.criteria", lambda c: scoring.semantic_label(F.col("_q.type"), F.col("_q.criteria"), c["option"])))
    labels = cases.select("run_id", F.explode("questions").alias("_q")).select("run_id", F.col("_q.key").alias("field"), offered.alias("label"))
    f1 = rows.where("_kind = 'f1'")
    classes = f1.select("run_id", "field", "catalog_id", "track").join(labels, ["run_id", "field"]).select("catalog_id", "track", "label").distinct()
    chances = f1.select("catalog_id", "track", F.coalesce("chance", F.lit(0.0)).alias("chance")).distinct()
    parts = [
        rollup.accuracy_of(sub.where("_kind = 'accuracy'")),
        rollup.whole_case_of(sub.where("_kind = 'case'")),
        rollup.conservative_of(sub.where("_kind = 'f1'"), classes, chances),
        rollup.quality_of(sub.where("_kind = 'route'")),
        rollup.ranking_tracks(rollup.scored_tracks(groups.join(dim.where("rule = 'track'").select("catalog_id"), "catalog_id", "left_semi"), own)),
    ]
    return rollup.benchmark_scores(rollup.track_scores(parts, sub))


def edition_from_log(
    cases: DataFrame, log: DataFrame, dim: DataFrame, qrels: DataFrame | None = None, own_tracks: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(values, index) of an edition from a raw result log, all rules included.

    Every row carries what its benchmark's rule needs (``SCORING``). A benchmark
    whose rows have no value though its rule needs one fails here, as it would
    count as zero in a published index; one without any case is not run.
    """
    fact = cut_lineage(scored_fact(cases, log))
    if qrels is None and not fact.where("documents IS NOT NULL").isEmpty():
        raise ValueError("cases rank documents, but there are no judgements (qrels)")
    nothing = fact.sparkSession.createDataFrame([], "catalog_id int, track string, group_id string, complete boolean, pending boolean, ndcg_at_10 double, random_ndcg double")
    groups = nothing if qrels is None else cut_lineage(ranked_groups(fact, qrels))
    lacking = (
        fact.join(dim.where("metric = 'mean_value'").select("catalog_id"), "catalog_id", "left_semi")
        .where("status = 'ok' AND value IS NULL AND documents IS NULL").select("catalog_id").distinct().limit(100).collect()
    )
    if lacking:
        raise ValueError(f"no value for rows of benchmarks {sorted(r['catalog_id'] for r in lacking)}")
    # A group's gain counts once: it goes to the group's first row.
    first = fact.where("documents IS NOT NULL").groupBy("catalog_id", "group_id").agg(F.min(F.struct("run_id", "field")).alias("_f"))
    gains = first.join(groups, ["catalog_id", "group_id"]).select(F.col("_f.run_id").alias("run_id"), F.col("_f.field").alias("field"), F.col("ndcg_at_10").alias("_gain"))
    valued = fact.join(gains, ["run_id", "field"], "left").withColumn("value", F.coalesce("value", "_gain")).drop("_gain")
    return score.edition_report(valued, dim, track_values(cases, fact, dim, groups, own_tracks))


def evaluate_edition(
    cases: DataFrame, dim: DataFrame, engine: str, predictor: Callable[[], inference.Predictor], log_path: str, waves: int = 8,
    qrels: DataFrame | None = None, own_tracks: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Run what is not yet in the log, then values and index of an edition from it (``edition_from_log``)."""
    inference.run_in_waves(inference.request_json(cases), engine, predictor, log_path, waves)
    return edition_from_log(cases, inference.read_log(cases.sparkSession, log_path), dim, qrels, own_tracks)
