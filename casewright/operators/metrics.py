"""Metric families over a fact of one row per scored field.

Every group-by here combines before its shuffle and holds no list of rows, so a
benchmark, user or label with most of the rows is no special case. Percentiles,
which need an order, select their ranks by the leading digits of the values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.skew import PLAIN_JOIN_ROWS, broadcast_if_small, hot_values
from casewright.session import cut_lineage


def count_of(condition: Column | str) -> Column:
    return F.count_if(F.expr(condition) if isinstance(condition, str) else condition)


def weighed(condition: Column, n: str | None) -> Column:
    """Rows, or subtotals of ``n`` rows, that meet a condition."""
    return count_of(condition) if n is None else F.sum(F.when(condition, F.col(n)).otherwise(0))


def ratio(n: Column, d: Column) -> Column:
    """n / d, 0 when d is 0."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def f1_of(tp: Column, gold_n: Column, pred_n: Column) -> Column:
    return ratio(2 * tp, gold_n + pred_n)


def status_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Requests and their statuses per key."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        *[count_of(F.col("status") == s).alias(s) for s in ("ok", "unsupported", "error", "abstained", "pending")],
    )


def group_state(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per linked group: complete (all rows ok) and pending (a row is missing or failed)."""
    return rows.groupBy(*keys).agg(
        F.bool_and(F.col("status") == "ok").alias("complete"),
        F.bool_or(F.col("status").isin("pending", "error")).alias("pending"),
    )


def group_coverage(rows: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Planned groups, share of complete and share of pending ones per key."""
    return (
        group_state(rows, [*keys, group])
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("planned_groups"),
            F.avg(F.col("complete").cast("double")).alias("coverage"),
            F.avg(F.col("pending").cast("double")).alias("pending"),
        )
    )


def group_subtotals(rows: DataFrame, keys: list[str], group: str, dims: list[str], *aggs: Column) -> DataFrame:
    """Rows counted per linked group and ``dims``, with the state of the whole group.

    Adds ``n``, the given aggregates, ``complete`` and ``pending``. Counting
    comes first, so a group of any size is down to one row per combination of
    its dims before its state is taken, and the rows are read once.
    """
    counted = rows.groupBy(*keys, group, *dims).agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.col("status") == "ok").alias("_ok"),
        F.bool_or(F.col("status").isin("pending", "error")).alias("_pending"),
        *aggs,
    )
    whole = Window.partitionBy(*keys, group)
    return counted.withColumns(
        {"complete": F.bool_and("_ok").over(whole), "pending": F.bool_or("_pending").over(whole)}
    ).drop("_ok", "_pending")


Measures = dict[str, tuple[Callable[[Column], Column], Column]]


def counted_subtotals(rows: DataFrame, keys: list[str], group: str, dims: list[str], measures: Measures) -> DataFrame:
    """``group_subtotals`` of measures that are given as an aggregate and its value in one row."""
    return group_subtotals(rows, keys, group, dims, *[agg(value).alias(c) for c, (agg, value) in measures.items()])


def row_subtotals(
    rows: DataFrame, keys: list[str], group: str, dims: list[str], measures: Measures, plain_rows: int = PLAIN_JOIN_ROWS
) -> DataFrame:
    """``counted_subtotals`` for groups of few rows: a row is a subtotal of its own, and goes to its group once.

    Counting first would hold nearly every row in memory before the shuffle and
    shuffle it twice. The aggregate of one row has to equal its value in that
    row; a combination of dims may come in several rows. Groups with a large
    share of the rows are counted first.
    """
    code = F.xxhash64(*keys, group)
    hot = hot_values(rows, code, plain_rows=plain_rows)
    whole = Window.partitionBy(*keys, group)
    alone = (rows.where(~code.isin(hot)) if hot else rows).select(
        *keys, group, *dims, F.lit(1).cast("bigint").alias("n"), (F.col("status") == "ok").alias("_ok"),
        F.col("status").isin("pending", "error").alias("_pending"), *[value.alias(c) for c, (_, value) in measures.items()],
    )
    marked = alone.withColumns(
        {"complete": F.bool_and("_ok").over(whole), "pending": F.bool_or("_pending").over(whole)}
    ).drop("_ok", "_pending")
    if not hot:
        return marked
    return marked.unionByName(counted_subtotals(rows.where(code.isin(hot)), keys, group, dims, measures))


def complete_only(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of complete groups, where the rows themselves are wanted; scores use ``group_subtotals``."""
    done = group_state(rows, keys).where("complete").select(*keys)
    return rows.join(done, keys, "left_semi")


def hit(gold: Column, pred: Column, accepted: Column | None = None) -> Column:
    """1.0 or 0.0; with ``accepted`` any listed option counts."""
    right = pred.eqNullSafe(gold) if accepted is None else F.coalesce(F.array_contains(accepted, pred), F.lit(False))
    return right.cast("double")


def mean_by(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Plain mean; an empty set has no row, a set of nulls is null."""
    return df.groupBy(*keys).agg(F.avg(value).alias(out))


def case_exact(rows: DataFrame, keys: list[str], group: str, hit_col: str) -> DataFrame:
    """Share of the complete groups in which every field is right."""
    per_group = rows.groupBy(*keys, group).agg(
        F.bool_and(F.col("status") == "ok").alias("_ok"), F.min(hit_col).alias("_all")
    )
    return per_group.where("_ok").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"), F.avg("_all").alias("case_exact_accuracy")
    )


def _label_counts(df: DataFrame, keys: list[str], gold: str, pred: str, n: str | None) -> DataFrame:
    """tp, gold_n, pred_n per label, from the confusion counts; unanswered golds are left out."""
    rows = F.count(F.lit(1)) if n is None else F.sum(n)
    confusion = df.where(F.col(pred).isNotNull()).groupBy(*keys, gold, pred).agg(rows.alias("_n"))
    sides = F.explode(
        F.array(
            F.struct(F.col(gold).alias("label"), F.lit(True).alias("is_gold")),
            F.struct(F.col(pred).alias("label"), F.lit(False).alias("is_gold")),
        )
    )
    long = confusion.withColumn("_s", sides).select(
        *keys, "_n", "_s.label", "_s.is_gold", (F.col(gold) == F.col(pred)).alias("same")
    )
    return long.groupBy(*keys, "label").agg(
        weighed(F.col("is_gold") & F.col("same"), "_n").alias("tp"),
        weighed(F.col("is_gold"), "_n").alias("gold_n"),
        weighed(~F.col("is_gold"), "_n").alias("pred_n"),
    )


def macro_f1(
    df: DataFrame, keys: list[str], gold: str = "gold_label", pred: str = "pred_label", n: str | None = None
) -> DataFrame:
    """Mean F1 over the labels seen as gold or prediction. ``n`` names a row count, for subtotals."""
    counts = _label_counts(df, keys, gold, pred, n)
    f1 = f1_of(F.col("tp"), F.col("gold_n"), F.col("pred_n"))
    return counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("labels"), F.avg(f1).alias("macro_f1"))


def binary_f1(
    df: DataFrame, keys: list[str], positive: str = "yes", gold: str = "gold", pred: str = "pred", out: str = "f1",
    n: str | None = None,
) -> DataFrame:
    """F1 of one label."""
    g, p = F.col(gold) == positive, F.col(pred) == positive
    counted = df.groupBy(*keys).agg(
        weighed(g & p, n).alias("_tp"), weighed(g, n).alias("_g"), weighed(p, n).alias("_p")
    )
    return counted.withColumn(out, f1_of(F.col("_tp"), F.col("_g"), F.col("_p"))).drop("_tp", "_g", "_p")


def conservative_f1(
    df: DataFrame, keys: list[str], classes: DataFrame, gold: str = "gold_label", pred: str = "pred_label",
    n: str | None = None,
) -> DataFrame:
    """Mean F1 over a fixed class list; every missing prediction weighs on every class.

    ``classes(keys.., label)`` is the label universe, or a single positive label.
    """
    missing = df.groupBy(*keys).agg(weighed(F.col(pred).isNull(), n).alias("_m"))
    counts = _label_counts(df, keys, gold, pred, n)
    joined = classes.select(*keys, "label").distinct().join(missing, keys).join(counts, [*keys, "label"], "left")
    tp = F.coalesce("tp", F.lit(0))
    d = F.coalesce("gold_n", F.lit(0)) + F.coalesce("pred_n", F.lit(0)) + F.col("_m")
    return joined.groupBy(*keys).agg(F.avg(ratio(2 * tp, d)).alias("conservative_f1"))


def mean_of(total: str, n: str) -> Column:
    """Mean from subtotals: null when nothing was counted."""
    return F.try_divide(F.sum(total).cast("double"), F.sum(n))


def cluster_macro(df: DataFrame, keys: list[str], cluster: str, total: str, n: str, out: str) -> DataFrame:
    """Mean of the cluster means, from subtotals."""
    per = df.groupBy(*keys, cluster).agg(mean_of(total, n).alias("_v"))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("clusters"), F.avg("_v").alias(out))


def subgroup_table(df: DataFrame, keys: list[str], subgroup: str, total: str, n: str) -> DataFrame:
    """Count and mean per subgroup, from subtotals."""
    return df.groupBy(*keys, subgroup).agg(mean_of(total, n).alias("mean"), F.sum(n).alias("n"))


def field_f1(df: DataFrame, keys: list[str], gold: str = "gold", pred: str = "pred", n: str | None = None) -> DataFrame:
    """Positive F1 per field, for fields whose golds are all yes or no."""
    g, p = F.col(gold) == "yes", F.col(pred) == "yes"
    per = df.groupBy(*keys, "field").agg(
        F.bool_and(F.col(gold).isin("yes", "no")).alias("_yn"),
        f1_of(weighed(g & p, n), weighed(g, n), weighed(p, n)).alias("f1"),
    )
    return per.where("_yn").drop("_yn")


def category_macro_f1(
    df: DataFrame, keys: list[str], gold: str = "gold", pred: str = "pred", n: str | None = None
) -> DataFrame:
    return field_f1(df, keys, gold, pred, n).groupBy(*keys).agg(F.avg("f1").alias("category_macro_f1"))


def review_f1(
    df: DataFrame, keys: list[str], group: str, gold: Column, pred: Column, complete_groups: bool = False
) -> DataFrame:
    """Per group, F1 of the yes fields; a group without any is 1; mean over groups.

    With ``complete_groups`` only groups whose rows are all ok count.
    """
    whole = F.bool_and(F.col("status") == "ok") if complete_groups else F.bool_and(F.lit(True))
    per = df.groupBy(*keys, group).agg(
        count_of(gold & pred).alias("_b"), (count_of(gold) + count_of(pred)).alias("_d"), whole.alias("_whole")
    )
    f1 = F.coalesce(F.try_divide((2 * F.col("_b")).cast("double"), F.col("_d")), F.lit(1.0))
    return per.where("_whole").groupBy(*keys).agg(F.count(F.lit(1)).alias("groups"), F.avg(f1).alias("review_f1"))


PositionRule = Callable[[Column], list[Column]]


def nearest_rank(p: float) -> PositionRule:
    """x[ceil(n*p)-1]."""
    return lambda n: [F.least(n, F.ceil(n * F.lit(p)))]


def middle() -> PositionRule:
    """True median: mean of the two middle values."""
    return lambda n: [F.floor((n + 1) / 2), F.floor(n / 2) + 1]


def floor_index(p: float) -> PositionRule:
    """x[int(p*(n-1))]."""
    return lambda n: [F.floor((n - 1) * F.lit(p)) + 1]


# Values a bucket may have to be sorted as it is, parts a larger one is cut into, and how often.
SORTED_VALUES, PARTS, CUTS = 100_000, 4096, 6


def _leading(value: Column) -> Column:
    """A bucket by the leading digits of a number, in the order of the numbers; about 0.4 percent wide."""
    x = value.cast("double")
    size = F.when(F.isnan(x), 1000.0).otherwise(F.signum(x) * F.least(F.log1p(F.abs(x)), F.lit(999.0)))
    return F.floor(size * 256)


def _at_ranks(counts: DataFrame, keys: list[str], group: list[str], order: str, rules: dict[str, PositionRule]) -> DataFrame:
    """Rows of a count table (``_n``) that hold a wanted rank, with the rows before them and the rows of the key.

    ``_base`` says how many rows lie before a whole group, ``_total`` how many the key has.
    """
    upto = Window.partitionBy(*keys, *group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    wanted = F.lit(False)
    for rule in rules.values():
        for pos in rule(F.col("_total")):
            wanted = wanted | ((pos > F.col("_before")) & (pos <= F.col("_before") + F.col("_n")))
    return placed.where(wanted).drop("_base")


def exact_percentiles(df: DataFrame, keys: list[str], value: str, rules: dict[str, PositionRule]) -> DataFrame:
    """Exact order statistics of any number of rules, by radix selection.

    Rows are counted by the leading digits of their value before any shuffle, which
    tells the buckets that hold a wanted rank. Only the rows of these buckets are
    looked at again; a bucket with many rows is cut anew between its ends. Values
    are neither sorted nor shuffled as a whole. Nulls do not count; NaN is largest.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), _leading(F.col(value)).cast("string").alias("_b"))
    same_key = Window.partitionBy(*keys)
    ends = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    coarse = rows.groupBy(*keys, "_b").agg(*ends).withColumns({"_total": F.sum("_n").over(same_key), "_base": F.lit(0).cast("bigint")})
    at = cut_lineage(_at_ranks(coarse.withColumn("_order", F.col("_b").cast("bigint")), keys, [], "_order", rules).drop("_order"))
    found = [at.where("_lo = _hi").select(*keys, F.col("_lo").alias("_v"), "_n", "_before", "_total")]
    at = at.where("_lo <> _hi")
    largest = at.agg(F.max("_n")).first()[0]
    if largest is not None:
        # The rows that may hold a rank, in the bucket they belong to: a small part of the table.
        inside = rows.join(broadcast_if_small(at.select(*keys, "_b")), [*keys, "_b"], "left_semi")
        cuts = 0
        while largest is not None and largest > SORTED_VALUES and cuts < CUTS:
            limits = at.select(*keys, "_b", "_lo", "_hi", F.col("_before").alias("_base"), "_total")
            share = (F.col("_v") - F.col("_lo")).cast("double") / (F.col("_hi") - F.col("_lo")).cast("double")
            parts = inside.join(broadcast_if_small(limits), [*keys, "_b"]).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
            inside = cut_lineage(parts.withColumn("_part", F.least(F.floor(share * PARTS), F.lit(PARTS - 1))).drop("_lo", "_hi"))
            fine = inside.groupBy(*keys, "_b", "_part", "_base", "_total").agg(*ends)
            at = cut_lineage(_at_ranks(fine, keys, ["_b"], "_part", rules))
            found.append(at.where("_lo = _hi").select(*keys, F.col("_lo").alias("_v"), "_n", "_before", "_total"))
            # Buckets get new names, so that the next cut tells the parts apart.
            name = F.concat_ws(".", "_b", "_part")
            inside = inside.join(broadcast_if_small(at.where("_lo <> _hi").select(*keys, "_b", "_part")), [*keys, "_b", "_part"], "left_semi").select(*keys, "_v", name.alias("_b"))
            at = at.where("_lo <> _hi").withColumn("_b", name).drop("_part")
            largest, cuts = at.agg(F.max("_n")).first()[0], cuts + 1
        base = at.select(*keys, "_b", F.col("_before").alias("_base"), "_total")
        values = inside.groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_n")).join(broadcast_if_small(base), [*keys, "_b"])
        found.append(_at_ranks(values, keys, ["_b"], "_v", rules).select(*keys, "_v", "_n", "_before", "_total"))
    at_rank = found[0]
    for part in found[1:]:
        at_rank = at_rank.unionByName(part)
    outputs = []
    for name, rule in rules.items():
        positions = rule(F.col("_total"))
        here = [(pos > F.col("_before")) & (pos <= F.col("_before") + F.col("_n")) for pos in positions]
        share = sum((F.when(h, F.col("_v")).otherwise(0.0) for h in here), F.lit(0.0))
        outputs.append((F.sum(share) / len(positions)).alias(name))
    return at_rank.groupBy(*keys).agg(F.max("_total").alias("n"), *outputs)


def totals(df: DataFrame, keys: list[str], sums: list[str], maxima: list[str]) -> DataFrame:
    """Sums and maxima of usage columns."""
    return df.groupBy(*keys).agg(
        *[F.sum(c).alias(f"sum_{c}") for c in sums], *[F.max(c).alias(f"max_{c}") for c in maxima]
    )


def metric_means(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Long form (metric, n, mean) of any set of metric columns."""
    long = df.select(*keys, *metrics).unpivot(keys, metrics, "metric", "value")
    return long.where("value is not null").groupBy(*keys, "metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean")
    )


def profile(df: DataFrame, task: str, model: str, quality: str, cost: str) -> DataFrame:
    """Mean quality and cost per (task, model) and per model over all tasks, in one pass."""
    return df.groupingSets([[task, model], [model]], task, model).agg(
        F.grouping(task).cast("int").alias("all_tasks"),
        F.avg(quality).alias("mean_quality"),
        F.avg(cost).alias("mean_cost"),
        F.count(F.lit(1)).alias("cases"),
    )


def rank_sums(panel: DataFrame, keys: list[str], candidate: str, rank: str) -> DataFrame:
    """Summed rank per candidate; all candidates with the smallest sum are accepted."""
    sums = panel.groupBy(*keys, candidate).agg(F.sum(rank).alias("rank_sum"))
    best = sums.groupBy(*keys).agg(F.min("rank_sum").alias("best"))
    return sums.join(best, keys).withColumn("accepted", F.col("rank_sum") == F.col("best"))


def recall_by_domain(queries: DataFrame, domain: str, recall: str) -> DataFrame:
    return queries.groupBy(domain).agg(
        F.count(F.lit(1)).alias("queries"), F.avg(recall).alias("mean_candidate_recall")
    )


def outcome_scores(
    outcomes: DataFrame, chosen: DataFrame, case: str, option: str, quality: str, cost: str, penalty: float
) -> DataFrame:
    """Quality, utility, oracle match and regret of the chosen option of each case."""
    utility = F.col(quality) - F.lit(penalty) * F.col(cost)
    valued = outcomes.withColumn("utility", utility)
    best = valued.groupBy(case).agg(F.max("utility").alias("best"))
    picked = chosen.select(case, option).join(valued, [case, option], "left").join(best, case)
    valid = F.col("utility").isNotNull()
    close = F.coalesce(F.abs(F.col("best") - F.col("utility")) <= 1e-12, F.lit(False))
    regret = F.greatest(F.lit(0.0), F.col("best") - F.col("utility"))
    return picked.select(
        case, option, quality, cost, "utility", valid.alias("valid"), close.alias("oracle_optimal"),
        F.when(valid, regret).alias("utility_regret"),
    )


def reference_value_scores(values: DataFrame, chosen: DataFrame, case: str, option: str, value: str) -> DataFrame:
    """Hit on any best option and value regret; a choice outside the options has regret 1."""
    best = values.groupBy(case).agg(F.max(value).alias("best"))
    picked = chosen.select(case, option).join(values, [case, option], "left").join(best, case)
    regret = F.coalesce(F.col("best") - F.col(value), F.lit(1.0))
    return picked.select(
        case, option, F.coalesce(F.col(value) == F.col("best"), F.lit(False)).alias("best_choice"),
        regret.alias("value_regret"),
    )


def consensus_scores(
    sums: DataFrame, chosen: DataFrame, case: str, option: str, rank_sum: str, panel_size: str
) -> DataFrame:
    """Hit on a smallest summed rank and regret scaled by panel and option count."""
    best = sums.groupBy(case).agg(
        F.min(rank_sum).alias("best"), F.count(F.lit(1)).alias("_k"), F.max(panel_size).alias("_panel")
    )
    picked = chosen.select(case, option).join(sums.select(case, option, rank_sum), [case, option], "left").join(best, case)
    regret = (F.col(rank_sum) - F.col("best")) / (F.col("_panel") * (F.col("_k") - 1))
    return picked.select(
        case, option, F.coalesce(F.col(rank_sum) == F.col("best"), F.lit(False)).alias("group_preferred"),
        F.coalesce(regret, F.lit(1.0)).alias("normalized_rank_regret"),
    )
