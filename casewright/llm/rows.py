"""Row numbers and free column names for tables whose keys may repeat or be null."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions.skew import broadcast_if_small


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever its extra columns are called."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


# Rows of a file, and with them its rows' numbers, fit these low bits.
PLACE_BITS = 40


def _spellings(path: str) -> set[str]:
    """A file's path as it is listed, and with one or three slashes after its scheme, as rows may name it."""
    return {path, re.sub("^([^:/]+):/+", r"\1:/", path), re.sub("^([^:/]+):/+", r"\1:///", path)}


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Add a row number that tells repeated rows apart and is the same in every job and retry.

    For a table read from Parquet files it is made of the place of the file among
    the table's files and the row's place in the file. Splits do not enter it, so
    it stays when executors come or go between two jobs. A checkpoint, or a table
    made in the session, has partitions that do not change, and is numbered by
    these. A plan with a shuffle in it, or over files of another kind, has to be
    written first.
    """
    files = sorted(set(df.inputFiles()))
    if not files:
        return df.withColumn(name, F.monotonically_increasing_id())
    path, place, number = (free_name(df, base) for base in ("_file", "_place", "_number"))
    spelled = {name: i for i, file in enumerate(files) for name in _spellings(file)}
    # From Arrow, as a list of rows would take Python workers of a second kind on the executors, which stay beside the others.
    known = df.sparkSession.createDataFrame(pa.table({number: pa.array(spelled.values(), pa.int64()), path: pa.array(spelled.keys(), pa.string())}))
    placed = df.withColumns({path: F.col("_metadata.file_path"), place: F.col("_metadata.row_index")})
    found = placed.join(broadcast_if_small(known), path, "left")
    lost = F.raise_error(F.concat(F.lit("not a file of the table: "), F.col(path)))
    row = F.shiftleft(F.coalesce(number, lost.cast("long")), PLACE_BITS) + F.col(place)
    return found.select(*[F.col(f"`{c}`") for c in df.columns], row.alias(name))


def kept_in_worker(name: str, make: Callable):
    """An object that a Python worker makes once and uses in all its tasks, until it is asked for another one.

    Task code is sent anew with each job, so a module variable would not last. One
    object at a time is kept, so memory does not add up over the stages of a
    pipeline. A worker that is lost simply makes its own again.
    """
    kept = sys.__dict__.setdefault("_casewright_worker", {})
    if name not in kept:
        kept.clear()
        kept[name] = make()
    return kept[name]
