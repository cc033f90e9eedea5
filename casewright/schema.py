"""Table schemas. Readers use these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

CRITERIA = T.ArrayType(
    T.StructType([T.StructField("option", T.StringType()), T.StructField("descr", T.StringType())])
)

QUESTION = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("instructions", T.StringType()),
        T.StructField("criteria", CRITERIA),
    ]
)

CASES = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("catalog_id", T.IntegerType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("group_id", T.StringType()),
        T.StructField("track", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("questions", T.ArrayType(QUESTION)),
        T.StructField("expected", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metadata", T.StringType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("proxy_tokens", T.LongType()),
    ]
)

ANSWER = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("choice", T.StringType()),
        T.StructField("noul", T.DoubleType()),
        T.StructField("probabilities", T.MapType(T.StringType(), T.DoubleType())),
    ]
)

RESULTS = T.StructType(
    [
        T.StructField("engine", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("catalog_id", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("answers", T.MapType(T.StringType(), ANSWER)),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("total_wall_ms", T.DoubleType()),
        T.StructField("http_wall_ms", T.DoubleType()),
        T.StructField("started_utc", T.TimestampType()),
        T.StructField("completed_utc", T.TimestampType()),
        T.StructField("error", T.StringType()),
        T.StructField("exception", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("raw_output", T.StringType()),
    ]
)

# Columns a request may carry; gold, split and metadata never leave the case table.
REQUEST_COLUMNS = ("run_id", "state", "questions")

# Columns kept of a result in compact mode.
COMPACT_COLUMNS = (
    "engine", "run_id", "catalog_id", "seq", "status", "answers", "input_tokens",
    "total_wall_ms", "http_wall_ms", "completed_utc", "error",
)

STATUSES = ("ok", "unsupported", "error", "abstained")
