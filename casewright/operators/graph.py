"""Connected components and leak-free splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions import hashing, skew
from casewright.session import cut_lineage

# Edge tables of this size meet their lookups by broadcast, and stay in a few partitions.
FEW_EDGES = 100_000
FEW_BYTES = 16 << 20


def _directed(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller node."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], int(row["s"] or 0)


def _met(edges: DataFrame, low: DataFrame, few: int) -> DataFrame:
    return edges.join(F.broadcast(skew.packed(low, few)), "u") if few else skew.lookup(edges, low, "u")


def _large_star(edges: DataFrame, few: int = 0) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour; ``few``: edges of a small table."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = _met(both, low, few).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return skew.packed(hung.where("u <> v").distinct(), few)


def _small_star(edges: DataFrame, few: int = 0) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _met(edges, low, few).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select("u", F.col("m").alias("v"))
    return skew.packed(moved.unionByName(skew.packed(own, few)).where("u <> v").distinct(), few)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for all nodes of an edge table; the component is its smallest member.

    Alternating large-star and small-star rounds end in one star per component
    after about log(n) rounds, whatever the shape. Each round is written to the
    checkpoint folder. No round has more edges than the one before, so a table
    that is small at first is joined by broadcast in all of them.
    """
    named = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    nodes = named.select(F.col("a").alias("node")).unionByName(named.select(F.col("b").alias("node"))).distinct()
    current = cut_lineage(_directed(named))
    mark = _fingerprint(current)
    few = max(1, mark[0]) if skew.small_enough(current, FEW_EDGES, FEW_BYTES) else 0
    current = skew.packed(current, few)
    while True:
        current = cut_lineage(_small_star(_large_star(current, few), few))
        now = _fingerprint(current)
        if now == mark:
            break
        mark = now
    found = current.select(F.col("u").alias("node"), "v")
    labelled = nodes.join(F.broadcast(found) if few else found, "node", "left")
    return labelled.select("node", F.coalesce("v", "node").alias("component"))


def hash_split(df: DataFrame, component: str, seed: str, k: int = 5) -> DataFrame:
    """A component belongs to calibration when its hash is divisible by ``k``."""
    h = hashing.sha(seed, F.col(component))
    return df.withColumn("calibration", hashing.hash_mod(h, k) == 0)
