"""Whitening of embeddings by shifted CholeskyQR over distributed rows.

The rows of the centred fit list are orthogonalised in passes. Each pass sums a
Gram matrix (dimensions x dimensions) over blocks of rows, takes its Cholesky
factor on the driver, and the next pass solves the triangular system for each
block. The first factor is taken of the Gram matrix plus a small shift, so that
it exists for any condition of the rows; further passes go on until the columns are
orthogonal at machine precision. The product R of the factors belongs to a QR
decomposition of the rows, so the singular values and right vectors of R are
theirs: components and eigenvalues come from an SVD of R alone, without squaring
the condition as an eigendecomposition of the covariance would.

Dimensions that depend on others (constant ones, for example) have no place in a
QR decomposition of full rank. Those that a pivoted factorisation of the first Gram
matrix cannot tell from dependent ones are left out of the passes, and projected
on the orthogonal columns by one more pass: R then has these columns too. What the
projection leaves is measured on the rows; a dimension that has something of its
own left joins the others, and the passes are made again.

Only sums over rows and matrices of the width of a vector reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm.registry import query, table
from casewright.session import cut_lineage

SCALE = 256
COMPONENTS = 4
# Most passes after the first; they end when no entry of the Gram matrix is further than this from the identity's.
PASSES, ORTHOGONAL = 10, 1e-13
# Whole numbers up to this size are exact as doubles.
EXACT = 2.0**53
# Shares of a dimension's sum of squares that others leave: below the first it is put off, as the Gram matrix is too
# coarse to tell; below the second, measured on the rows themselves, it is dependent.
PUT_OFF, DEPENDENT = 1e-10, 1e-26
# Vectors of a block (so few that a block's sums fit a long), and groups that matrices of tasks are added in.
BLOCK, GROUPS = 512, 256


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, x): rows that take part, each entry as a whole number."""
    entries = F.col("v")
    sound = F.coalesce(F.forall(entries, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
    lean = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(sound)
    big = F.exists(entries, lambda e: F.abs(scale * e) >= EXACT)
    # floor gives a long, so that there is no negative zero.
    whole = F.transform(entries, lambda e: F.floor(scale * e))
    return lean.select("id", F.when(big, F.raise_error("a component is too large to be a whole number in a double")).otherwise(whole).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """Blocks of rows as matrices of whole numbers."""
    for batch in batches:
        whole = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        for at in range(0, len(whole), BLOCK):
            yield whole[at : at + BLOCK]


def sums(rows: DataFrame, width: int) -> list[int]:
    """The exact sum of each dimension; a block's sum fits a long, the blocks are added as decimals."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _matrices(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(block.sum(axis=0))], ["pos", "s"])

    totals = rows.select("x").mapInArrow(work, "pos long, s long").groupBy("pos").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r["pos"]: int(r["s"]) for r in totals.collect()}  # one row per dimension
    return [found.get(i, 0) for i in range(width)]


def summed(rows: DataFrame, width: int, shape: tuple[int, int], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of the matrix that ``of`` gives for each block of rows: one for each task, then for each of a bounded number of groups."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for block in _matrices(batches, width):
            total += of(block.astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for m in batch.column(0):
                total += np.frombuffer(m.as_buffer()).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["m"])

    parts = rows.select("x").mapInArrow(work, "m binary").repartition(F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    # At most as many matrices as the shuffle has partitions.
    return np.sum([np.zeros(shape)] + [np.frombuffer(r["m"]).reshape(shape) for r in parts.mapInArrow(add, "m binary").collect()], axis=0)


def independent(gram: np.ndarray) -> list[int]:
    """Dimensions, largest first, that are not combinations of those before (pivoted Cholesky)."""
    left, rest, chosen = gram.copy(), np.diag(gram).copy(), []
    while len(chosen) < len(gram):
        share = np.where(np.diag(gram) > 0, rest / np.maximum(np.diag(gram), 1e-300), 0)
        share[chosen] = 0
        open_ = np.where(share > PUT_OFF, rest, -1.0)
        p = int(np.argmax(open_))
        if open_[p] <= 0:
            break
        column = left[:, p] / math.sqrt(left[p, p])
        left = left - np.outer(column, column)
        rest = np.maximum(np.diag(left), 0)
        chosen.append(p)
    return chosen


def _solve(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows times the inverse of each upper factor in turn."""
    for r in factors:
        rows = np.linalg.solve(r.T, rows.T).T
    return rows


def _factor(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper Cholesky factor, of the matrix plus a shift where asked for or needed."""
    if not shifted:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    size = len(gram)
    shift = 11 * (n * size + size * (size + 1)) * np.finfo(float).eps / 2 * np.linalg.norm(gram, 2)
    return np.linalg.cholesky(gram + shift * np.eye(size)).T


def fit(fit_rows: DataFrame, width: int) -> dict:
    """n, sums, unit components (as columns), their eigenvalues, and the trace of the covariance."""
    n, total = fit_rows.count(), sums(fit_rows, width)
    mean = np.array([s / max(1, n) for s in total])
    gram = summed(fit_rows, width, (width, width), lambda rows: (rows - mean).T @ (rows - mean))
    chosen = independent(gram)
    if not chosen:
        return {"n": n, "sums": total, "components": np.zeros((width, 0)), "values": np.zeros(0), "trace": 0.0}
    while True:
        size, factors = len(chosen), _factors(fit_rows, width, mean, gram, chosen, n)
        composed = factors[0]
        for r in factors[1:]:
            composed = r @ composed
        whole = np.zeros((size, width))
        whole[:, chosen] = composed
        rest = [j for j in range(width) if j not in set(chosen)]
        if not rest:
            break

        def onto(rows: np.ndarray, chosen=chosen, factors=factors, rest=rest) -> np.ndarray:
            return _solve((rows - mean)[:, chosen], factors).T @ (rows - mean)[:, rest]

        whole[:, rest] = summed(fit_rows, width, (size, len(rest)), onto)

        def beyond(rows: np.ndarray, chosen=chosen, factors=factors, rest=rest, part=whole[:, rest]) -> np.ndarray:
            left = (rows - mean)[:, rest] - _solve((rows - mean)[:, chosen], factors) @ part
            return (left**2).sum(axis=0, keepdims=True)

        share = summed(fit_rows, width, (1, len(rest)), beyond)[0] / np.maximum(np.diag(gram)[rest], 1e-300)
        if share.max() <= DEPENDENT:
            break
        chosen = [*chosen, rest[int(share.argmax())]]
    _, singular, right = np.linalg.svd(whole, full_matrices=False)
    return {"n": n, "sums": total, "components": right.T, "values": singular**2 / n, "trace": float(np.sum(singular**2) / n)}


def _factors(fit_rows: DataFrame, width: int, mean: np.ndarray, gram: np.ndarray, chosen: list[int], n: int) -> list[np.ndarray]:
    """Upper factors, each of the Gram matrix of the rows after the ones before; the first shifted."""
    size = len(chosen)
    factors = [_factor(gram[np.ix_(chosen, chosen)], n, shifted=True)]
    for _ in range(PASSES):
        known = list(factors)

        def orthogonal(rows: np.ndarray, known=known) -> np.ndarray:
            q = _solve((rows - mean)[:, chosen], known)
            return q.T @ q

        own = summed(fit_rows, width, (size, size), orthogonal)
        if np.abs(own - np.eye(size)).max() < ORTHOGONAL:
            break
        factors.append(_factor(own, n, shifted=False))
    return factors


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) for each row that takes part.

    Entries are ``floor(scale * c)``. The components are those of the distinct
    vectors, each counted once, in the order of their eigenvalues; components
    with no variance have no rows, so there may be fewer than ``components``.
    ``deviation`` is the exact sum of ``(n * x - S)^2``, an error beyond a long.

    Rows with a null vector or a null or non-finite entry take no part; a shorter
    vector counts as filled with zeros; an entry of 2**53 or more is an error.
    Repeated rows and null ids come back as often as they are there; an empty
    table, and one whose vectors are all alike, give no rows. Other columns are
    not read.
    """
    rows = quantised(vectors, id_col, vector_col, scale)
    width = max(1, rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0)).alias("w")).first()["w"])
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    rows = rows.select("id", filled.alias("x"))
    fit_rows = cut_lineage(rows.select("x").distinct())
    model = fit(fit_rows, width)
    n, total = model["n"], model["sums"]
    k = min(components, len(model["values"]))
    used = list(range(k))
    mean = np.array([s / max(1, n) for s in total])
    onto = model["components"][:, used] / np.sqrt(model["values"][used])
    explained = model["values"][used] / (model["trace"] or 1.0)
    # The covariance of the whitened fit list, centred by its own mean.
    centre = summed(fit_rows, width, (1, k), lambda m: ((m - mean) @ onto).sum(axis=0, keepdims=True)) / max(1, n)

    def outer(m: np.ndarray) -> np.ndarray:
        z = (m - mean) @ onto - centre
        return z.T @ z

    error = float(np.abs(summed(fit_rows, width, (k, k), outer) / max(1, n) - np.eye(k)).max(initial=0))
    largest = max(map(abs, total), default=0)

    def deviations(rows: np.ndarray) -> list[int]:
        most = n * int(np.abs(rows).max(initial=0)) + largest
        if most * most * max(1, width) < 1 << 62:
            return ((n * rows - np.array(total, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((n * int(x) - s) ** 2 for x, s in zip(row, total, strict=True)) for row in rows]
        if max(exact, default=0) >= 1 << 63:
            raise OverflowError("a deviation does not fit a long")
        return exact

    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                block = next(_matrices(iter([part]), width))
                size = len(block) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(len(block)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(block))),
                        pa.array(np.full(size, n)), pa.array(np.repeat(np.array(deviations(block), np.int64), k)), pa.array(((block - mean) @ onto).ravel()),
                        pa.array(np.tile(explained, len(block))), pa.array(np.full(size, error)),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.where(F.lit(k > 0)).mapInArrow(work, schema).withColumnRenamed("id", id_col)


@query()
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Whitened coordinates of all vectors on the first four components."""
    return whiten(table(spark, folder, "embeddings"))
