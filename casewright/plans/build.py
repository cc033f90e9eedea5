"""Building and freezing a suite: sources to cases to a sampled, fingerprinted table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions import hashing
from casewright.operators import audits, facts, sampling


@dataclass
class CaseSpec:
    """How a source table becomes choice cases of one benchmark."""

    catalog_id: int
    dataset: str
    track: str
    row_id: Column
    instructions: Column
    options: Column
    gold_index: Column
    state: Column
    group: Column | None = None
    split: str = "test"
    metadata: Column = field(default_factory=lambda: F.lit("{}"))
    rejects: list[tuple[str, Column]] = field(default_factory=list)


def build_cases(df: DataFrame, spec: CaseSpec) -> tuple[DataFrame, DataFrame]:
    """(case rows, rejected source rows with their reason).

    The payload text is built once; its digest and size proxy are taken from it
    and it is never serialised again.
    """
    kept, rejected = audits.split_rejects(df, spec.rejects) if spec.rejects else (df, df.limit(0).withColumn("reason", F.lit("")))
    source_id = spec.row_id.cast("string")
    shaped = kept.select(
        F.concat_ws(":", F.lit(str(spec.catalog_id)), F.lit(spec.track), source_id).alias("run_id"),
        F.lit(spec.catalog_id).alias("catalog_id"), F.lit(spec.dataset).alias("dataset"),
        (spec.group if spec.group is not None else spec.row_id).cast("string").alias("group_id"),
        F.lit(spec.track).alias("track"), F.lit(spec.split).alias("split"), spec.state.alias("state"),
        spec.metadata.alias("metadata"), spec.options.alias("_options"), spec.gold_index.alias("_gold"), spec.instructions.alias("_instr"),
    )
    made = facts.choice_case(shaped, "_options", "_gold", "_instr").drop("_options", "_gold", "_instr")
    payload = F.to_json(F.struct("state", "questions"))
    cases = made.withColumn("_payload", payload).withColumns(
        {"payload_sha256": hashing.payload_sha(F.col("_payload")), "proxy_tokens": hashing.size_proxy(F.col("_payload"))}
    )
    return cases.drop("_payload"), rejected


def select_groups(
    cases: DataFrame, seed: str | int, case_cap: int | None = None, request_budget: int | None = None,
    stratum: str | None = None,
) -> DataFrame:
    """Rows of the groups a benchmark keeps: by cap, by request budget, or by quota per stratum."""
    carry = [F.min(stratum).alias(stratum)] if stratum else []
    groups = sampling.groups_of(cases, ["catalog_id"], "group_id", seed, *carry)
    if stratum and case_cap:
        kept = sampling.quota_sample(groups, ["catalog_id"], stratum, case_cap)
    elif case_cap:
        kept = sampling.cap_groups(groups, ["catalog_id"], case_cap)
    elif request_budget:
        kept = sampling.budget_sample(groups, ["catalog_id"], request_budget)
    else:
        return cases
    return cases.join(kept.select("catalog_id", "group_id"), ["catalog_id", "group_id"], "left_semi")


def frozen_manifest(cases: DataFrame, price_per_million: float) -> DataFrame:
    """Cases, requests, fields, tokens and cost per benchmark, with a grand total."""
    rows = cases.withColumn("_fields", F.size("questions"))
    return audits.manifest(rows, "catalog_id", "group_id", "_fields", "proxy_tokens", price_per_million)
