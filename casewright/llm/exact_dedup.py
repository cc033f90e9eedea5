"""Exact duplicates, with the heaviest digests removed on the map side.

A few texts may make up a large share of a corpus. Sending their rows to one
task each, as a plain shuffle on the digest would, leaves most of a cluster
idle. The rows are therefore split:

1. A Misra-Gries summary over the digests of all rows (Spark's frequent-items
   aggregate, merged from per-task summaries of ``1 / support`` counters) names
   every digest with at least ``support`` of the rows, and possibly others.
2. The named digests are counted exactly and their winners found, in one
   aggregation with map-side combine. At most ``1 / support`` rows come out:
   that bound, which does not depend on the corpus, makes the broadcast safe.
3. Rows of these digests meet the broadcast winners where they stand. All other
   digests hold less than ``support`` of the rows each and are shuffled.

Everything is built-in DataFrame work: no Python touches a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm.registry import query, table
from casewright.llm.rows import free_name, numbered
from casewright.session import cut_lineage

# A digest with this share of all rows is certain to be treated as heavy; 1/SUPPORT bounds the broadcast rows.
SUPPORT = 1 / 256

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def text_digest(text: Column) -> Column:
    """SHA-256 of a text without ASCII white space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, ""), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, digest, points): what is compared of each row, written once for all later passes."""
    row = free_name(docs, "_row")
    lean = numbered(docs.select(id_col, text_col), row)
    return cut_lineage(
        lean.select(
            F.col(row).alias("row"), F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"),
            F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"),
        )
    )


def frequent_digests(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Candidates for heavy digests: a superset of those with ``support`` of the rows, at most 1/support of them."""
    summary = rows.stat.freqItems(["digest"], support)
    return summary.select(F.explode("digest_freqItems").alias("digest")).where("digest is not null")


def _winners(rows: DataFrame) -> DataFrame:
    """Per digest the row that stays: most code points, then smallest id (null last), then first row."""
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("n"), F.col("id").alias("i"), F.col("row").alias("r")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", "group_size", F.col("best.i").alias("keep_id"), F.col("best.r").alias("keep_row")
    )


def mark(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Add group_size, keep_id and kept to the rows of ``digests``; no row is lost."""
    named = cut_lineage(frequent_digests(rows, support))
    # At most 1/support rows, whatever the size of the table.
    heavy = F.broadcast(cut_lineage(_winners(rows.join(F.broadcast(named), "digest", "left_semi"))))
    light = rows.join(F.broadcast(named), "digest", "left_anti")
    together = rows.join(heavy, "digest").unionByName(light.join(_winners(light), "digest"))
    return together.withColumn("kept", F.col("row") == F.col("keep_row"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with exactly their columns.

    Texts are equal when they are identical without ASCII white space; a null
    text counts as empty. Of equal texts the one with the most code points stays,
    then the smallest id (a null id comes last), then the first row, so of fully
    repeated rows exactly one stays. An empty table gives an empty table; extra
    columns, whatever their names, are passed on. ``docs`` is read twice and has
    to be a table read from files or a checkpoint.
    """
    row = free_name(docs, "_row")
    gone = mark(digests(docs, id_col, text_col), support).where(~F.col("kept")).select(F.col("row").alias(row))
    return numbered(docs, row).join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


@query(
    r"""
    WITH d AS (
        SELECT doc_id, length(coalesce(text, '')) AS points,
               sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
        FROM documents
    )
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           row_number() OVER w = 1 AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
    """
)
def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the one that stays for it."""
    return mark(digests(table(spark, folder, "documents"))).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )
