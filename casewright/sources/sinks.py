"""Writing case tables, result logs and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows(df: DataFrame, path: str, partition: str | None = "catalog_id", per_file: int = 2_000_000) -> None:
    """Case rows as Parquet, by benchmark.

    Rows are not shuffled by benchmark first: one that holds most of the rows
    would become one task. Each task writes its share of every benchmark.
    """
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", per_file)
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def export_json(df: DataFrame, path: str, gzip: bool = True) -> None:
    """JSON lines, one file per task."""
    df.write.mode("overwrite").json(path, compression="gzip" if gzip else "none")


def export_sorted(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in a total order over all files; sorting happens here and nowhere before."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def append_results(df: DataFrame, path: str) -> None:
    """Append to a result log; readers take the last record per run."""
    df.write.mode("append").parquet(path)


def report(df: DataFrame, root: str, name: str, run: str | None = None) -> str:
    """A small report in a folder of its own; the folder appears whole or not at all."""
    target = f"{root}/{name}/run={run or uuid.uuid4().hex}"
    df.coalesce(1).write.mode("errorifexists").json(target)
    return target


def export_run(summary: DataFrame, index: DataFrame, scores: DataFrame, root: str, run: str) -> dict[str, str]:
    """Summary, index and scores of one run side by side."""
    parts = {"benchmark-summary": summary, "index": index, "scores": scores}
    return {name: report(df, root, name, run) for name, df in parts.items()}


def to_parquet(df: DataFrame, path: str, key: str = "catalog_id", salt_on: str = "group_id", salts: int = 64) -> None:
    """One-off conversion that lays rows out by benchmark and group hash, salted against hot benchmarks."""
    salt = F.pmod(F.xxhash64(salt_on), F.lit(salts))
    df.repartition(F.col(key), salt).write.mode("overwrite").partitionBy(key).parquet(path)
