"""Exact top-k search by inner product, with a uniform threshold in three phases.

A score is a sum over parts of the dimensions; each part of each slice of the
candidates gives a list of partial scores.

1. Every list gives the ``k`` best of its partial scores for a query. The totals
   of these candidates are real scores, so the k-th best of them is a cutoff that
   the k-th best score of all cannot fall below.
2. The cutoff goes to all slices with the queries. A candidate whose partial
   scores are all below cutoff / parts cannot reach it. The others are collected,
   and dropped where their known parts plus that share for each unknown one stay
   below the cutoff.
3. What is left is scored exactly; the best of each slice are merged.

Candidates are packed into blocks of vectors where they are read. Blocks of
queries and slices of candidates meet by a join on their two numbers, so each
task holds one bounded slice and one bounded block, at any size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.llm.registry import query, table
from casewright.session import cut_lineage

K = 5
EVERY = 50
SCALE = 256
PARTS = 4
# Vectors of a pack, candidates of a slice, queries of a block, and queries scored at a time.
PACK, SLICE, BLOCK, STEP = 2048, 16_384, 2048, 64

VECTORS = "pack string, number long, count long, asking long, width int, ids binary, vectors binary"


def _packed(ids: np.ndarray, vectors: np.ndarray) -> dict:
    """A matrix of whole numbers in two bytes each where they fit, as doubles else."""
    small = np.abs(vectors).max(initial=0) < 32768
    return {"width": vectors.shape[1], "ids": ids.astype("<i8").tobytes(), "vectors": b"2" + vectors.astype("<i2").tobytes() if small else b"8" + vectors.astype("<f8").tobytes()}


def _matrix(data: bytes, width: int, to: int) -> np.ndarray:
    values = np.frombuffer(data[1:], "<i2" if data[:1] == b"2" else "<f8").astype(np.float64)
    values = values.reshape(-1, width) if width else np.zeros((0, 0))
    return np.pad(values, ((0, 0), (0, to - width)))


def packs(vectors: DataFrame, id_col: str, vector_col: str, every: int, scale: int) -> DataFrame:
    """Blocks of the vectors that take part, each with a number of its own."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number = TaskContext.get().partitionId(), 0
        for frame in frames:
            for at in range(0, len(frame), PACK):
                part = frame.iloc[at : at + PACK]
                width = max(1, max(len(v) for v in part["vector"]))
                rows = np.zeros((len(part), width))
                for i, v in enumerate(part["vector"]):
                    rows[i, : len(v)] = np.floor(scale * np.asarray(v, np.float64))
                ids = part["id"].to_numpy(np.int64)
                yield pd.DataFrame([{"pack": f"{task}-{number}", "number": (task << 32) + (number << 12), "count": len(ids), "asking": int((ids % every == 0).sum())} | _packed(ids, rows)])
                number += 1

    whole = f"`{vector_col}` IS NOT NULL AND forall(`{vector_col}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    lean = vectors.where(F.col(id_col).isNotNull()).where(F.expr(f"coalesce({whole}, false)"))
    return cut_lineage(lean.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).mapInPandas(work, VECTORS))


def _stacked(frame: pd.DataFrame, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, ids and vectors of several packs; a vector's number is its pack's plus its place."""
    ids = [np.frombuffer(b, "<i8") for b in frame["ids"]]
    numbers = [n + np.arange(len(i)) for n, i in zip(frame["number"], ids, strict=True)]
    return np.concatenate(numbers), np.concatenate(ids), np.vstack([_matrix(v, w, to) for v, w in zip(frame["vectors"], frame["width"], strict=True)])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) < 2**53:
        return a @ b.T
    return np.array([[int(v) for v in row] for row in a], object).reshape(a.shape) @ np.array([[int(v) for v in row] for row in b], object).reshape(b.shape).T


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row."""
    return np.argpartition(-scores, k - 1, axis=1)[:, :k] if scores.shape[1] > k else np.tile(np.arange(scores.shape[1]), (len(scores), 1))


def _steps(asked: pd.DataFrame, given: pd.DataFrame, parts: int):
    """For a few queries at a time: their places, the candidates, and partial scores by part (own row excluded by mask)."""
    width = int(max(asked["width"].max(), given["width"].max()))
    q_ids, q_numbers = np.frombuffer(asked["ids"].iloc[0], "<i8"), np.frombuffer(asked["numbers"].iloc[0], "<i8")
    q = _matrix(asked["vectors"].iloc[0], int(asked["width"].iloc[0]), width)
    numbers, ids, c = _stacked(given, width)
    cuts = [width * i // parts for i in range(parts + 1)]
    for at in range(0, len(q), STEP):
        rows = slice(at, at + STEP)
        lists = [_products(q[rows, a:b], c[:, a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        yield at, q_ids[rows], q_numbers[rows, None] == numbers, numbers, ids, lists


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row whose id is divisible by ``every``.

    Components are ``floor(scale * x)``; the score is their inner product, exact;
    ties go to the smaller id. Every other row is a candidate, rows with the
    query's id included if they repeat it. Rows with a null id, a null vector or a
    null or non-finite component take no part; a shorter vector counts as filled
    with zeros. Extra columns are not read; an empty table gives no rows. A score
    beyond a long is an error.
    """
    packed = packs(vectors, id_col, vector_col, every, scale)
    total = packed.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.coalesce(F.sum("asking"), F.lit(0)).alias("q")).first()
    slices, blocks = max(1, -(-total["n"] // SLICE)), max(1, -(-total["q"] // BLOCK))
    given = packed.withColumn("slice", F.pmod(F.xxhash64("pack"), F.lit(slices)).cast("int"))

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        width = int(frame["width"].max())
        numbers, ids, rows = _stacked(frame, width)
        chosen = ids % every == 0
        order = np.argsort(numbers[chosen])
        return pd.DataFrame([{"block": frame["block"].iloc[0], "numbers": numbers[chosen][order].tobytes()} | _packed(ids[chosen][order], rows[chosen][order])])

    asking = packed.where("asking > 0").withColumn("block", F.pmod(F.xxhash64("pack", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = cut_lineage(asking.groupBy("block").applyInPandas(ask, "block int, numbers binary, width int, ids binary, vectors binary"))
    here = given.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("slice", "block")

    def meet(questions: DataFrame, work, schema: str) -> DataFrame:
        there = questions.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).groupBy("slice", "block")
        return there.cogroup(here).applyInPandas(work, schema)

    def lists(asks: pd.DataFrame, gives: pd.DataFrame) -> pd.DataFrame:
        """Phase 1: totals of the best of every list."""
        out = []
        if len(asks) and len(gives):
            for at, _, own, numbers, _, partial in _steps(asks, gives, parts):
                whole = np.where(own, -np.inf, sum(partial))
                picked = np.hstack([_best(np.where(own, -np.inf, p.astype(np.float64)), k) for p in partial])
                for i, row in enumerate(picked):
                    row = np.unique(row)
                    row = row[~own[i, row]]
                    scores = sorted((int(whole[i, j]) for j in row), reverse=True)[:k]
                    out += [(int(asks["block"].iloc[0]), at + i, s) for s in scores]
        return pd.DataFrame(out, columns=["block", "place", "score"])

    listed = meet(asked, lists, "block int, place int, score long")
    by_query = Window.partitionBy("block", "place").orderBy(F.col("score").desc())
    cutoff = listed.withColumn("r", F.row_number().over(by_query)).where(F.col("r") <= k).groupBy("block", "place").agg(F.min("score").alias("cutoff"), F.count(F.lit(1)).alias("n"))
    known = cutoff.where(F.col("n") == k).groupBy("block").agg(F.collect_list(F.struct("place", "cutoff")).alias("cutoffs"))  # at most a block of queries
    informed = cut_lineage(asked.join(known, "block", "left"))

    def collect(asks: pd.DataFrame, gives: pd.DataFrame) -> pd.DataFrame:
        """Phases 2 and 3: candidates that may reach the cutoff, then their exact scores."""
        out = []
        if len(asks) and len(gives):
            least = {c["place"]: c["cutoff"] for c in (asks["cutoffs"].iloc[0] if asks["cutoffs"].iloc[0] is not None else [])}
            for at, q_ids, own, numbers, ids, partial in _steps(asks, gives, parts):
                floor = np.array([least.get(at + i, -np.inf) for i in range(len(q_ids))])[:, None]
                share = floor / len(partial)
                bound = sum(np.maximum(p.astype(np.float64), share) for p in partial)
                entries = np.logical_or.reduce([p >= share for p in partial]) & (bound >= floor) & ~own
                for i in range(len(q_ids)):
                    found = np.flatnonzero(entries[i])
                    scores = [sum(int(p[i, j]) for p in partial) for j in found]
                    best = sorted((-s, int(ids[j]), int(numbers[j])) for s, j in zip(scores, found, strict=True) if s >= floor[i, 0])[:k]
                    out += [(int(asks["block"].iloc[0]), at + i, int(q_ids[i]), v, n, -s) for s, v, n in best]
        return pd.DataFrame(out, columns=["block", "place", "query_id", "vec_id", "number", "score"])

    found = meet(informed, collect, "block int, place int, query_id long, vec_id long, number long, score long")
    order = Window.partitionBy("block", "place").orderBy(F.col("score").desc(), "vec_id", "number")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query(
    """
    WITH v AS (
        SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY rank <= 5
    """
)
def op6_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return search(table(spark, folder, "embeddings"))
