"""Queries of this package and the SQL that states their results."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = (
    "toxicity", "exact_dedup", "site_quality", "packing", "piece_codec", "topk_search", "line_dedup", "ngram_join", "pii",
    "license_scan", "collocations", "url_filter", "whitening",
)


def query(sql: str | None = None):
    """Register a function of (spark, folder) under its own name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"casewright.llm.{module}")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
