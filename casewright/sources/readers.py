"""Scans of the file formats cases and results come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.sources import lines

BAD = "_bad"
TAIL = "_tail"


def _parsed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Lines (``value`` and others) with the parsed row ``_r``, which holds the text of a line that does not fit."""
    with_bad = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    return rows.withColumn("_r", F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))


def _or_raise(parsed: DataFrame) -> DataFrame:
    """The same rows without marked tails; reading another one that does not fit its schema fails."""
    told = F.raise_error(F.concat(F.lit("bad JSON line: "), F.left("value", F.lit(200)))).cast("boolean")
    # One condition over both, so that it cannot be tested before tails are known.
    return parsed.where(F.when(F.col(TAIL), False).when(F.col(f"_r.{BAD}").isNull(), True).otherwise(told))


def json_lines(spark: SparkSession, paths: str | list[str], schema: T.StructType, on_bad: str = "raise", complete_lines: bool = False):
    """JSON lines, plain or gzip; blank lines are skipped.

    A line that does not parse, or has a field of another type, makes the read
    fail (``raise``), comes back in a second DataFrame (``rejects``), or is left
    out (``drop``). With ``complete_lines`` the last line of a file that does not
    end with a line feed, as a writer that was stopped leaves it, is left out
    first. Gzip is read by one task per file: convert large suites once.
    """
    if complete_lines:
        found = lines.ranged_lines(spark, paths).select("value", F.col("torn").alias(TAIL))
    else:
        found = spark.read.text(paths).withColumn(TAIL, F.lit(False))
    return _sorted_out(_parsed(found.where(F.trim("value") != ""), schema), on_bad)


def _sorted_out(parsed: DataFrame, on_bad: str, *more: str):
    """The rows of parsed lines, with what becomes of those that do not fit; marked tails are left out."""
    if on_bad not in ("raise", "rejects", "drop"):
        raise ValueError(f"on_bad: {on_bad}")
    if on_bad == "raise":
        return _or_raise(parsed).select("_r.*", *more).drop(BAD)
    parsed = parsed.where(~F.col(TAIL))
    good = parsed.where(F.col(f"_r.{BAD}").isNull()).select("_r.*", *more).drop(BAD)
    if on_bad == "drop":
        return good
    return good, parsed.where(F.col(f"_r.{BAD}").isNotNull()).select("value", *more)


def _fitting(df: DataFrame, on_bad: str, what: str):
    """Rows of Spark's own readers, whose ``BAD`` column holds the text of those that do not fit."""
    if on_bad not in ("raise", "rejects", "drop"):
        raise ValueError(f"on_bad: {on_bad}")
    columns = [F.col(f"`{c}`") for c in df.columns if c != BAD]
    # A reader looks only at the columns a query names, so a condition that always holds names them all.
    df = df.where(F.xxhash64(*[c.cast("string") for c in columns]) <= F.lit((1 << 63) - 1))
    if on_bad == "raise":
        told = F.raise_error(F.concat(F.lit(f"bad {what}: "), F.left(BAD, F.lit(200)))).cast("boolean")
        return df.where(F.when(F.col(BAD).isNull(), True).otherwise(told)).select(*columns)
    good = df.where(F.col(BAD).isNull()).select(*columns)
    return good if on_bad == "drop" else (good, df.where(F.col(BAD).isNotNull()).select(F.col(BAD).alias("value")))


def suite_rows(spark: SparkSession, paths: list[str], schema: T.StructType, on_bad: str = "raise") -> DataFrame:
    """Base, added and replacement row files as one relation."""
    return json_lines(spark, paths, schema, on_bad)


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Parquet with the filter and the columns pushed into the scan."""
    df = spark.read.parquet(path)
    if where:
        df = df.where(where)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: T.StructType | None = None, on_bad: str = "raise"):
    """CSV with header, quoted line breaks and doubled quotes; all text unless a schema is given.

    A row with a field of another type, or with more or fewer fields than the
    header, makes the read fail, comes back in a second DataFrame (``rejects``) or
    is left out (``drop``).
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    if schema is None:
        # A byte-order mark stays on the first header name.
        names = [c.lstrip("\ufeff") for c in reader.csv(path).columns]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    with_bad = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    kept = reader.schema(with_bad).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
    return _fitting(kept.csv(path), on_bad, "CSV row")


def tab_tuples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines of a text and any number of tab-separated four-part tuples.

    Returns (file, text, pairs) with the distinct ``second|third`` parts of the
    tuples, and the lines with a malformed tuple.
    """
    rows = spark.read.text(path).where("value <> ''").withColumn("file", F.col("_metadata.file_path"))
    parts = F.split("value", "\t")
    tuples = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda q: F.split(F.trim(q), r"\s+"))
    parsed = rows.select("file", F.element_at(parts, 1).alias("text"), tuples.alias("_q"), "value")
    well_formed = F.forall("_q", lambda q: F.size(q) == 4)
    pairs = F.array_distinct(F.transform("_q", lambda q: F.concat_ws("|", q[1], q[2])))
    good = parsed.where(well_formed).select("file", "text", pairs.alias("pairs"))
    return good, parsed.where(~well_formed).select("file", "value")


def json_documents(spark: SparkSession, path: str, schema: T.StructType, on_bad: str = "raise"):
    """Whole-file JSON documents (one document, or an array of them, per file).

    A document that does not fit the schema, or a file that is no JSON, makes the
    read fail, comes back in a second DataFrame (``rejects``) or is left out (``drop``).
    """
    with_bad = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    reader = spark.read.schema(with_bad).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
    return _fitting(reader.json(path), on_bad, "JSON document")


def list_or_scalar(spark_json: str, element: str = "string"):
    """Array from a JSON text value that may be a list, a scalar or null."""
    v = F.col(spark_json)
    wrapped = F.when(F.trim(v).startswith("["), v).otherwise(F.concat(F.lit("["), v, F.lit("]")))
    return F.coalesce(F.from_json(wrapped, f"array<{element}>"), F.array().cast(f"array<{element}>"))


def predictions(spark: SparkSession, directory: str, schema: T.StructType, on_bad: str = "raise", complete_lines: bool = False, glob: str = "*.jsonl"):
    """All JSON-lines files of a folder with ``seq``: the file, and the byte a line begins at.

    Files follow each other by name, lines by place, so the largest ``seq`` of a
    key is its last record. Lines that do not fit are treated as in ``json_lines``.
    """
    found = lines.ranged_lines(spark, directory, glob).where(F.trim("value") != "")
    torn = F.col("torn") if complete_lines else F.lit(False)
    return _sorted_out(_parsed(found.select("value", F.struct("file", "start").alias("seq"), torn.alias(TAIL)), schema), on_bad, "seq")


def containing(spark: SparkSession, path: str, mark: str, schema: T.StructType, on_bad: str = "raise"):
    """JSON lines that contain a substring, tested before any parsing; those that do not fit as in ``json_lines``."""
    found = spark.read.text(path).where(F.contains("value", F.lit(mark))).withColumn(TAIL, F.lit(False))
    return _sorted_out(_parsed(found, schema), on_bad)


def files(spark: SparkSession, directory: str, glob: str = "*") -> DataFrame:
    """Binary files with their sha-256 (up to 2 GB each, one task per file)."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory)
        .select("path", "length", F.sha2("content", 256).alias("sha256"))
    )
