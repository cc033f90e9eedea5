"""Cutting a sorted list of values into bands that are each as wide as their own repeats ask for.

A band of width m starts at place k * q and has k * m places; it is wide enough
when no value fills more than m of them. Walked from the left, each band takes the
least width that is enough. Every possible start q gets a pointer to the end of
its band, found for all starts at once by widening: the longest run that starts
within the first (k - 1) * m places of a band is looked up among maxima over
blocks of powers of two, and m grows to it, until none grows any more. The walk
from place 0 then follows the pointers: within spans of starts in one task each,
and across spans by doubling.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions import scans
from casewright.session import cut_lineage

# Starts of a span, and rows a single row may be exploded to where it stands.
SPAN = 1 << 16
STEP = 1 << 16

# Aligned blocks of powers of two that make up the places from lo to hi - 1: at each level at most one at either end.
_BLOCKS = """flatten(transform(sequence(0, cast(log2(hi - lo) AS int) + 1), j -> filter(array(
    named_struct('j', j, 'b', shiftright(lo + shiftleft(1L, j) - 1, j), 'in', shiftright(lo + shiftleft(1L, j) - 1, j) < shiftright(hi, j) AND shiftright(lo + shiftleft(1L, j) - 1, j) % 2 = 1),
    named_struct('j', j, 'b', shiftright(hi, j) - 1, 'in', shiftright(lo + shiftleft(1L, j) - 1, j) < shiftright(hi, j) AND shiftright(hi, j) % 2 = 1)
), x -> x.in)))"""


def _spread(df: DataFrame, low: str, high: str, out: str, longest: int) -> DataFrame:
    """One row for each whole number from ``low`` to ``high``; a long stretch is cut up and dealt to several tasks first."""
    last = F.least(F.col("_from") + STEP - 1, F.col(high))
    cut = df.where(F.col(low) <= F.col(high)).withColumn("_from", F.explode(F.sequence(F.col(low), F.col(high), F.lit(STEP).cast("bigint"))))
    if longest > STEP:
        cut = cut.repartition("_from", low)
    return cut.withColumn(out, F.explode(F.sequence("_from", last))).drop("_from", low, high)


def pointers(runs: DataFrame, k: int, total: int) -> DataFrame:
    """(q, m, a, c): the least sufficient width of a band from each start, null where the places do not suffice.

    ``runs`` has the first place ``a`` and the length ``c`` of each value's run;
    the run at a band's first place comes along.
    """
    longest = runs.agg(F.coalesce(F.max("c"), F.lit(1)).alias("c")).first()["c"]
    inside = runs.select("a", "c", F.ceil(F.col("a") / k).alias("_low"), F.floor((F.col("a") + F.col("c") - 1) / k).alias("_high"))
    starts = _spread(inside, "_low", "_high", "q", longest // k + 1)
    # The first run counts from the start of the band.
    state = starts.select("q", "a", "c", (F.col("a") + F.col("c") - F.col("q") * k).alias("m"), (F.col("q") * k + 1).alias("lo"))
    levels = int(math.log2(max(1, (k - 1) * longest))) + 1
    maxima = runs.where("c > 1").select("a", "c", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("j"))
    maxima = cut_lineage(maxima.groupBy("j", F.expr("shiftright(a, j)").alias("b")).agg(F.max("c").alias("most")))
    done: list[DataFrame] = []
    waiting = cut_lineage(state)
    while True:
        fits = F.col("q") + F.col("m") <= total
        asked = waiting.where(fits).withColumn("hi", F.col("q") * k + F.col("m") * (k - 1)).where("lo < hi")
        met = asked.select("q", F.explode(F.expr(_BLOCKS)).alias("x")).select("q", "x.j", "x.b").join(maxima, ["j", "b"])
        best = met.groupBy("q").agg(F.max("most").alias("most"))
        grown = waiting.join(best, "q", "left").withColumn("_w", F.greatest(F.col("m"), F.coalesce("most", F.lit(0))))
        seen = F.greatest(F.col("lo"), F.col("q") * k + F.col("m") * (k - 1))
        grown = cut_lineage(grown.select("q", "a", "c", F.when(fits, F.col("_w")).alias("m"), seen.alias("lo"), (fits & (F.col("_w") > F.col("m"))).alias("_on")))
        done.append(grown.where("NOT _on").select("q", F.when(F.col("q") + F.col("m") <= total, F.col("m")).alias("m"), "a", "c"))
        waiting = grown.where("_on").drop("_on")
        if waiting.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return cut_lineage(out)


def walk(steps: DataFrame, total: int, span: int = SPAN) -> DataFrame:
    """The rows of ``pointers`` that a walk from 0 meets, the one without a width last."""

    def ends(frame: pd.DataFrame) -> pd.DataFrame:
        """From each start of a span, the first place beyond the span (none where the walk stops)."""
        frame = frame.sort_values("q")
        first, past = int(frame["q"].iloc[0]), int(frame["q"].iloc[0]) // span * span + span
        width = frame["m"].fillna(-1).to_numpy(np.int64)
        to = np.full(len(frame), -1, np.int64)
        for i in range(len(frame) - 1, -1, -1):
            q = first + i + width[i]
            if width[i] >= 0:
                to[i] = q if q >= past else to[q - first] if q - first < len(to) else -1
        kept = to >= 0
        return pd.DataFrame({"q": frame["q"].to_numpy()[kept], "to": to[kept]})

    def met(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("q").reset_index(drop=True)
        first, places, at = int(frame["q"].iloc[0]), [], int(frame["entry"].iloc[0])
        width = frame["m"].fillna(-1).to_numpy(np.int64)
        while at - first < len(frame):
            places.append(at - first)
            if width[at - first] < 0:
                break
            at += int(width[at - first])
        return frame.iloc[places].drop(columns=["entry", "_span"])

    placed = steps.withColumn("_span", F.expr(f"q div {span}"))
    entries = steps.sparkSession.createDataFrame([(0,)], "entry long")
    spans = -(-total // span)
    if spans > 1:
        jumps = cut_lineage(placed.groupBy("_span").applyInPandas(ends, "q long, to long").where(F.col("to") < total))
        for _ in range(math.ceil(math.log2(spans))):
            further = entries.join(jumps, F.col("entry") == F.col("q")).select(F.col("to").alias("entry"))
            entries = cut_lineage(entries.unionByName(further).distinct())
            jumps = cut_lineage(jumps.alias("x").join(jumps.alias("y"), F.col("x.to") == F.col("y.q")).select("x.q", "y.to"))
    entered = placed.join(entries.withColumn("_span", F.expr(f"entry div {span}")), "_span")
    return cut_lineage(entered.groupBy("_span").applyInPandas(met, "q long, m long, a long, c long"))


def bands(runs: DataFrame, k: int, total: int, span: int = SPAN) -> DataFrame:
    """(q, m): start and width, in units of ``k`` places, of each band.

    The last band takes in as many bands before it as it needs to hold the rest.
    """
    met = walk(pointers(runs, k, total), total, span)
    stop = met.where("m IS NULL").agg(F.max("q").alias("q")).first()["q"]
    if stop is None:
        return met.select("q", "m")
    # From a start on, no run may be longer than the groups that are left; runs come with the longest one behind them.
    backwards = scans.range_segments(runs.withColumn("_back", -F.col("a")), [], ["_back"])
    behind = scans.scan(backwards, [], ["_back"], {"later": ("max", "c")}, inclusive=False).select("a", "later")
    rest = F.greatest(F.col("a") + F.col("c") - F.col("q") * k, F.coalesce("later", F.lit(0)))
    last = met.where(F.col("q") < stop).join(behind, "a").where(rest <= total - F.col("q")).agg(F.max("q").alias("q")).first()["q"]
    return met.where(F.col("q") <= last).select("q", F.when(F.col("q") == last, total - F.col("q")).otherwise(F.col("m")).alias("m"))


def dealt(places: DataFrame, cut: DataFrame, k: int, place: str, out: str) -> DataFrame:
    """Number the groups: the members of a group stand one band width apart."""
    longest = cut.agg(F.coalesce(F.max("m"), F.lit(1)).alias("m")).first()["m"]
    inside = cut.select(F.col("q").alias("_q0"), F.col("m").alias("_m"), F.col("q").alias("_low"), (F.col("q") + F.col("m") - 1).alias("_high"))
    each = _spread(inside, "_low", "_high", "_q", longest)
    joined = places.withColumn("_q", F.expr(f"{place} div {k}")).join(each, "_q")
    group = F.col("_q0") + (F.col(place) - F.col("_q0") * k) % F.col("_m")
    return joined.withColumn(out, group.cast("bigint")).drop("_q", "_q0", "_m")
