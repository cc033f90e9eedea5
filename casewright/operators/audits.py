"""Checks, comparisons, tallies and dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import hashing
from casewright.functions.skew import broadcast_if_small


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule whose condition holds; null when none does."""
    out = None
    for reason, fails in rules:
        out = F.when(fails, reason) if out is None else out.when(fails, reason)
    return out


def split_rejects(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with ``reason``)."""
    marked = df.withColumn("reason", first_reason(rules))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def reason_counts(df: DataFrame, rules: list[tuple[str, Column]], keys: list[str] | None = None) -> DataFrame:
    return df.withColumn("reason", F.coalesce(first_reason(rules), F.lit("kept"))).groupBy(*(keys or []), "reason").agg(
        F.count(F.lit(1)).alias("n")
    )


def tally(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def key_conflicts(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Keys seen more than once: exact duplicates and whether they carry different values."""
    v = df.select(*keys, value.alias("_v"))
    return (
        v.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), (F.min("_v") != F.max("_v")).alias("conflict"))
        .where("n > 1")
        .withColumn("duplicates", F.when(F.col("conflict"), 0).otherwise(F.col("n") - 1))
    )


def one_value_per_key(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per key that carries a single value; conflicting keys are left out."""
    return (
        df.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("_hi")).where(F.col(value) == F.col("_hi")).drop("_hi")
    )


def first_of_identical(df: DataFrame, payload: Column, seq: str, outcome: str) -> tuple[DataFrame, DataFrame]:
    """(first row of each identical payload, payloads with differing outcomes)."""
    hashed = df.withColumn("payload_sha256", hashing.payload_sha(payload))
    rest = [c for c in hashed.columns if c != "payload_sha256"]
    grouped = hashed.groupBy("payload_sha256").agg(
        F.min_by(F.struct(*rest), seq).alias("_r"),
        F.count(F.lit(1)).alias("copies"),
        (F.min(outcome) != F.max(outcome)).alias("conflict"),
    )
    kept = grouped.select("payload_sha256", "copies", "_r.*", "conflict")
    return kept.where("not conflict").drop("conflict"), kept.where("conflict").select("payload_sha256", "copies")


def dedup_outside(df: DataFrame, state: Column, row_id: str, other: DataFrame, other_state: Column) -> DataFrame:
    """Lowest id per distinct state, without states that occur in another split."""
    own = df.groupBy(hashing.payload_sha(state).alias("state_sha256")).agg(
        F.min(row_id).alias(row_id), F.count(F.lit(1)).alias("copies")
    )
    leaked = other.select(hashing.payload_sha(other_state).alias("state_sha256")).distinct()
    return own.join(leaked, "state_sha256", "left_anti")


def compare_runs(new: DataFrame, old: DataFrame, row_id: str, payload: str) -> DataFrame:
    """Full outer comparison: one row per id with its class."""
    a = new.select(row_id, F.col(payload).alias("_new"), F.lit(True).alias("_in_new"))
    b = old.select(row_id, F.col(payload).alias("_old"), F.lit(True).alias("_in_old"))
    kind = (
        F.when(F.col("_in_new").isNull(), "missing")
        .when(F.col("_in_old").isNull(), "extra")
        .when(~F.col("_new").eqNullSafe(F.col("_old")), "payload_changed")
        .otherwise("identical")
    )
    return a.join(b, row_id, "full").select(row_id, kind.alias("class"))


def comparison_counts(compared: DataFrame) -> DataFrame:
    return tally(compared, ["class"])


def comparison_examples(compared: DataFrame, row_id: str, k: int = 10) -> DataFrame:
    """First ``k`` ids of each class that differs."""
    order = Window.partitionBy("class").orderBy(row_id)
    differing = compared.where("class <> 'identical'")
    return differing.withColumn("n", F.row_number().over(order).cast("bigint")).where(F.col("n") <= k)


def set_differences(expected: DataFrame, actual: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Members of one side only, and repeats on the actual side: (keys.., member, class)."""
    e = expected.select(*keys, member, F.lit(1).alias("_e"), F.lit(0).alias("_a"))
    a = actual.select(*keys, member, F.lit(0).alias("_e"), F.lit(1).alias("_a"))
    both = e.unionByName(a).groupBy(*keys, member).agg(F.sum("_e").alias("_e"), F.sum("_a").alias("_a"))
    kind = (
        F.when(F.col("_a") == 0, "missing").when(F.col("_e") == 0, "extra").when(F.col("_a") > 1, "repeated")
    )
    return both.withColumn("class", kind).where("class is not null").select(*keys, member, "class")


def same_members(expected: DataFrame, actual: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Per key: whether both sides hold the same members and the actual side repeats none."""
    all_keys = expected.select(*keys).unionByName(actual.select(*keys)).distinct()
    off = set_differences(expected, actual, keys, member).groupBy(*keys).agg(
        *[F.count_if(F.col("class") == c).alias(c) for c in ("missing", "extra", "repeated")]
    )
    joined = all_keys.join(off, keys, "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("missing", "extra", "repeated")}
    return joined.withColumns(counts).withColumn("same", F.col("missing") + F.col("extra") + F.col("repeated") == 0)


def shared_groups(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that occur in more than one split (empty when the split is leak-free)."""
    return (
        df.groupBy(group)
        .agg(F.min(split).alias("_lo"), F.max(split).alias("_hi"))
        .where(F.col("_lo") != F.col("_hi"))
        .select(group)
    )


def checked_lookup(left: DataFrame, right: DataFrame, keys: list[str], required: str) -> tuple[DataFrame, DataFrame]:
    """Left join plus its violations: right keys that are not unique, left rows without the required value."""
    joined = left.join(right, keys, "left")
    repeated = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit("key not unique").alias("violation"), "n"
    )
    missing = joined.where(F.col(required).isNull()).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(
        F.lit("required value missing").alias("violation"), "n"
    )
    return joined, repeated.groupBy("violation").agg(F.sum("n").alias("n")).unionByName(missing)


def expectations(
    rows: DataFrame, row_id: str, keys: list[str], gold_fits: Column, pins: DataFrame | None = None, pin: str = "rows"
) -> DataFrame:
    """Write-time checks per key: rows, repeated ids, golds outside the options, row count vs pin."""
    per_id = rows.groupBy(*keys, row_id).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(~F.coalesce(gold_fits, F.lit(False))).alias("_bad")
    )
    out = per_id.groupBy(*keys).agg(
        F.sum("_n").alias("rows"),
        F.count_if(F.col("_n") > 1).alias("repeated_ids"),
        F.sum("_bad").alias("gold_outside_options"),
    )
    if pins is None:
        return out
    pinned = out.join(broadcast_if_small(pins.select(*keys, F.col(pin).alias("pinned_rows"))), keys, "full")
    return pinned.withColumn("as_pinned", F.col("rows").eqNullSafe(F.col("pinned_rows")))


def require(checks: DataFrame, bad: Column | str, what: str) -> None:
    """Raise with the first offending rows if any row is bad."""
    failed = checks.where(bad).limit(10).collect()
    if failed:
        raise ValueError(f"{what}: {[r.asDict() for r in failed]}")


def manifest(rows: DataFrame, benchmark: str, group: str, n_fields: str, tokens: str, price_per_million: float) -> DataFrame:
    """Cases, requests, fields, proxy tokens and cost per benchmark, and a grand total (null benchmark)."""
    per_group = rows.groupBy(benchmark, group).agg(
        F.count(F.lit(1)).alias("_r"), F.sum(n_fields).alias("_f"), F.sum(tokens).alias("_t")
    )
    return (
        per_group.rollup(benchmark)
        .agg(
            F.count(F.lit(1)).alias("cases"), F.sum("_r").alias("requests"),
            F.sum("_f").alias("fields"), F.sum("_t").alias("proxy_tokens"),
        )
        .withColumn("estimated_usd", F.col("proxy_tokens") * F.lit(price_per_million) / 1e6)
    )


def corpus_checks(corpus: DataFrame, doc: str, content: str) -> DataFrame:
    """(check, n): documents, ids that occur more than once, those with unlike contents, and rows without id or content.

    Contents are compared by digest, counted by id before anything is shuffled.
    """
    digest = F.sha2(F.col(content), 256)
    ids = corpus.where(F.col(doc).isNotNull()).groupBy(doc).agg(
        F.count(F.lit(1)).alias("n"), F.min(digest).alias("low"), F.max(digest).alias("high"), F.count(content).alias("full")
    )
    unlike = (F.col("low") != F.col("high")) | F.col("full").between(1, F.col("n") - 1)
    by_id = ids.agg(F.count_if(F.col("n") > 1).alias("repeated_ids"), F.count_if(unlike).alias("conflicting_ids"))
    rows = corpus.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col(doc).isNull()).alias("without_id"),
        F.count_if(F.coalesce(F.trim(content), F.lit("")) == "").alias("without_content"),
    )
    stacked = [part.unpivot([], part.columns, "check", "n") for part in (rows, by_id)]
    return stacked[0].unionByName(stacked[1])
