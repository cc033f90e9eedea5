"""Ranks, prefix sums and neighbour values over an order too large for one task.

A plain ``Window.partitionBy(key).orderBy(...)`` sorts a whole key in one task.
Here a key is first cut into *segments* whose order agrees with the row order,
each segment is scanned on its own, and the small table of segment totals
carries the state from one segment to the next. No task ever holds more than
one segment, whatever share of the rows a key has.

``order`` is always a list of column names, ascending, that together are unique
inside a key; keys must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.session import cut_lineage

SEG = "_seg"


def hash_segments(df: DataFrame, hash_col: str, digits: int = 3) -> DataFrame:
    """Segments by the leading hex digits of a uniform hash; narrow and repeatable."""
    return df.withColumn(SEG, F.substring(hash_col, 1, digits))


def range_segments(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Segments by a range partitioning over (keys, order).

    The range bounds come from a sample, so the partition number is written to
    the checkpoint folder before anything is derived from it: every later use
    and every retry sees the same segments.
    """
    columns = [*keys, *order]
    cut = df.repartitionByRange(*columns).withColumn(SEG, F.spark_partition_id())
    return cut_lineage(cut)


def step_segments(df: DataFrame, column: str, width: Column | int) -> DataFrame:
    """Segments of a fixed width over a non-negative whole-number order column."""
    return df.withColumn(SEG, F.floor(F.col(column) / width).cast("bigint"))


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    outputs: dict[str, tuple[str, str | None]],
    inclusive: bool = True,
) -> DataFrame:
    """Add running columns over (keys, order) to a segmented DataFrame.

    ``outputs`` maps a new column to ``(kind, column)`` with kind one of
    ``number`` (1-based row number), ``sum``, ``min``, ``max``, ``prev`` (the
    value of the row before) or ``total`` (the sum over the whole key). With
    ``inclusive=False`` the sum, min and max leave out the current row.
    """
    upto = 0 if inclusive else -1
    ordered = Window.partitionBy(*keys, SEG).orderBy(*order)
    frame = ordered.rowsBetween(Window.unboundedPreceding, upto)
    before = Window.partitionBy(*keys).orderBy(SEG)
    carried = before.rowsBetween(Window.unboundedPreceding, -1)

    local: dict[str, Column] = {}
    totals: list[Column] = []
    carry: dict[str, Column] = {}
    merge: dict[str, Column] = {}
    for name, (kind, column) in outputs.items():
        total, brought = f"_t_{name}", f"_c_{name}"
        if kind == "number":
            local[name] = F.row_number().over(ordered).cast("bigint")
            totals.append(F.count(F.lit(1)).alias(total))
            carry[brought] = F.coalesce(F.sum(total).over(carried), F.lit(0))
            merge[name] = F.col(name) + F.col(brought)
        elif kind == "sum":
            local[name] = F.coalesce(F.sum(column).over(frame), F.lit(0))
            totals.append(F.sum(column).alias(total))
            carry[brought] = F.coalesce(F.sum(total).over(carried), F.lit(0))
            merge[name] = F.col(name) + F.col(brought)
        elif kind in ("min", "max"):
            pick = F.min if kind == "min" else F.max
            both = F.least if kind == "min" else F.greatest
            local[name] = pick(column).over(frame)
            totals.append(pick(column).alias(total))
            carry[brought] = pick(total).over(carried)
            merge[name] = both(F.col(name), F.col(brought))
        elif kind == "total":
            totals.append(F.sum(column).alias(total))
            carry[brought] = F.sum(total).over(Window.partitionBy(*keys))
            merge[name] = F.col(brought)
        elif kind == "prev":
            local[name] = F.lag(column).over(ordered)
            local[f"_f_{name}"] = F.row_number().over(ordered) == 1
            totals.append(F.max_by(F.col(column), F.struct(*order)).alias(total))
            carry[brought] = F.lag(total).over(before)
            merge[name] = F.when(F.col(f"_f_{name}"), F.col(brought)).otherwise(F.col(name))
        else:
            raise ValueError(f"unknown scan kind {kind}")

    offsets = df.groupBy(*keys, SEG).agg(*totals)
    offsets = offsets.withColumns(carry).drop(*[f"_t_{n}" for n in outputs])
    rows = df.withColumns(local).join(offsets, [*keys, SEG])
    helper = [c for c in rows.columns if c.startswith(("_c_", "_f_"))]
    return rows.withColumns(merge).drop(*helper)


def row_numbers(df: DataFrame, keys: list[str], order: list[str], out: str = "rn") -> DataFrame:
    """1-based position inside a key for a segmented DataFrame."""
    return scan(df, keys, order, {out: ("number", None)})
