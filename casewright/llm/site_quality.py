"""Document quality from the text and from the site it comes from.

A small classifier over properties of a text (signs, capitals, repetition, word
lengths) gives evidence for each document. Evidence is summed by host and by path
in grouped aggregations over all documents; sites differ in how much is known of
them, so their means are shrunk: a path's towards its host's, a host's towards
the global mean, by weights estimated from the spread of the means themselves
(empirical Bayes, by moments). In the logarithm of the odds, a document's own
evidence and what its path says beyond the global mean add up.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions.skew import broadcast_if_small
from casewright.llm.registry import query, table
from casewright.llm.rows import numbered
from casewright.llm.toxicity import fold
from casewright.session import cut_lineage

# Labelled rows the classifier is fitted on, at most.
SAMPLE = 20_000
FEATURES = ("length", "signs", "capitals", "distinct", "repeated", "word_length", "lines", "digits")


def features(text: Column) -> list[Column]:
    """Properties of a text as numbers of about 0 to 1; all 0 for an empty one."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n, n_words = F.greatest(F.length(text), F.lit(1)), F.greatest(F.size(words), F.lit(1))
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, "")) / n
    lines = F.split(text, "\n", -1)
    # Words that equal the one before, each pair within the row.
    pairs = F.zip_with(words, F.slice(words, 2, n_words), lambda a, b: (a == b).cast("int"))
    repeated = F.aggregate(pairs, F.lit(0), lambda t, x: t + F.coalesce(x, F.lit(0))) / n_words
    values = (
        F.log1p(F.length(text)) / 12, left(r"[\p{L}\p{N}\s.,;:'\"()?-]+"), left(r"[^\p{Lu}]+"), F.size(F.array_distinct(words)) / n_words, repeated,
        F.least(n / n_words, F.lit(40)) / 40, F.size(F.array_distinct(lines)) / F.size(lines), left("[^0-9]+"),
    )
    return [v.cast("double").alias(name) for name, v in zip(FEATURES, values, strict=True)]


def _design(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, x**2, np.sqrt(np.maximum(x, 0)), np.ones((len(x), 1))])


def fit(rows: np.ndarray, labels: np.ndarray, l2: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Logistic regression on the features, their squares and roots, by Newton steps."""
    x = _design(rows)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (p - labels) + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _logit(p: Column) -> Column:
    safe = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(safe / (1 - safe))


def _weight(groups: DataFrame, within: str | None) -> float:
    """How many documents a group's prior counts for: mean sampling variance over the variance between groups."""
    mean = F.col("sum") / F.col("n")
    around = F.col(within) if within else F.lit(None)
    stats = groups.where("n > 1").select(
        F.avg((mean - F.coalesce(around, F.lit(0.0))) ** 2).alias("square"), F.avg(mean).alias("mean"),
        F.avg(mean * (1 - mean) / F.col("n")).alias("noise"), F.avg(mean * (1 - mean)).alias("one"),
    ).first()
    if stats["square"] is None:
        return 1.0
    between = stats["square"] - (0.0 if within else stats["mean"] ** 2) - stats["noise"]
    return float(min(1e4, max(1.0, stats["one"] / max(between, 1e-9))))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
          label_col: str = "quality") -> DataFrame:
    """(id_col, held_out, text_score, site_score, score, keep): one row per document.

    Learned from labelled rows outside the held-out fold. A null host or path is a
    site of its own; a null or empty text has the features of an empty one;
    repeated rows and null ids each give a row; other columns are not read; an
    empty table gives no rows. Without labels every text score is one half.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lean = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
                       F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    measured = cut_lineage(numbered(lean, "row").select("row", "id", "host", F.concat_ws("/", "host", "part").alias("path"), *features(F.col("text"))))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~fold(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("label"))
    drawn = known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)  # a bounded sample, so it may be broadcast
    # Of an id that is there more than once, the smallest features: the sample has as many rows as ids.
    one = measured.join(F.broadcast(drawn), "id").groupBy("id").agg(F.max("label").alias("label"), F.min(F.struct(*FEATURES)).alias("f"))
    sample = one.select("label", "f.*").toPandas().sort_values(["label", *FEATURES])
    w = fit(sample[list(FEATURES)].to_numpy(float), sample["label"].to_numpy(float)) if len(sample) else np.zeros(3 * len(FEATURES) + 1)

    k = len(FEATURES)
    z = F.lit(float(w[-1]))
    for i, name in enumerate(FEATURES):
        x = F.col(name)
        z = z + float(w[i]) * x + float(w[k + i]) * x * x + float(w[2 * k + i]) * F.sqrt(F.greatest(x, F.lit(0.0)))
    scored = measured.select("row", "id", "host", "path", (1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))).alias("text_score"))
    evidence = cut_lineage(scored)

    # Sums as decimals, so that they do not depend on the order of the rows.
    total = F.sum(F.col("text_score").cast("decimal(20,12)")).cast("double").alias("sum")
    paths = cut_lineage(evidence.groupBy("host", "path").agg(total, F.count(F.lit(1)).alias("n")))
    hosts = paths.groupBy("host").agg(F.sum(F.col("sum").cast("decimal(28,12)")).cast("double").alias("sum"), F.sum("n").alias("n"))
    whole = hosts.agg(F.sum(F.col("sum").cast("decimal(28,12)")).cast("double").alias("sum"), F.sum("n").alias("n")).first()
    base = whole["sum"] / whole["n"] if whole["n"] else 0.5
    host_weight = _weight(hosts, None)
    posterior = cut_lineage(hosts.select("host", ((F.col("sum") + host_weight * base) / (F.col("n") + host_weight)).alias("host_mean")))
    under = cut_lineage(paths.join(broadcast_if_small(posterior), "host"))
    path_weight = _weight(under, "host_mean")
    sites = under.select("path", ((F.col("sum") + path_weight * F.col("host_mean")) / (F.col("n") + path_weight)).alias("site_score"))

    joined = evidence.join(broadcast_if_small(sites), "path")
    odds = _logit(F.col("text_score")) + _logit(F.col("site_score")) - _logit(F.lit(float(base)))
    final = joined.withColumn("score", 1 / (1 + F.exp(-odds)))
    return final.select(F.col("id").alias(id_col), fold(F.col("id")).alias("held_out"), "text_score", "site_score", "score", (F.col("score") >= 0.5).alias("keep"))


@query()
def op3_site_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality, with its source as host and its language there as path."""
    return score(table(spark, folder, "documents"), table(spark, folder, "labels"))
