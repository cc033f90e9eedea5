"""The result log as a stream: append, last record wins, live counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from casewright.operators import results as result_log

# Hash buckets of a kept table, and batches after which their changes are folded into it.
BUCKETS, FOLD = 16, 16


def read_log(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", per_trigger: int = 1000, glob: str | None = None
) -> DataFrame:
    """Stream of the files appended to a log folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.format(fmt).load(path)


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the folders ``name=N`` under a path, in order; at most those of two folds."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    found = [f.getPath().getName() for f in files.listStatus(place)]
    return sorted(int(n.split("=")[1]) for n in found if n.startswith(f"{name}="))


def _drop(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _view(spark: SparkSession, out: str, keys: list[str], before: int | None = None) -> DataFrame:
    """The newest record of each key: of the newest folded table and the changes after it (those of batches up to ``before``)."""
    bases = [n for n in _numbers(spark, f"{out}/base", "log_upto") if before is None or n < before]
    upto = bases[-1] if bases else -1
    batches = [n for n in _numbers(spark, f"{out}/changes", "log_batch") if n > upto and (before is None or n <= before)]
    parts = []
    if bases:
        parts.append(spark.read.parquet(f"{out}/base/log_upto={upto}").withColumn("log_batch", F.lit(upto).cast("bigint")))
    if batches:
        changes = spark.read.option("basePath", f"{out}/changes").parquet(*[f"{out}/changes/log_batch={n}" for n in batches])
        parts.append(changes.withColumn("log_batch", F.col("log_batch").cast("bigint")))
    if not parts:
        raise FileNotFoundError(f"no batch has been written to {out}")
    together = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # Records of one key lie in one bucket, in the folded table and in each batch.
    return result_log.latest(together, ["log_bucket", *keys], "log_batch").drop("log_batch")


def _upsert(stream: DataFrame, keys: list[str], out: str, checkpoint: str, buckets: int, fold: int) -> StreamingQuery:
    """Write the rows that each batch of an update-mode stream changes, by hash bucket; fold them every ``fold`` batches.

    A batch holds only the keys it changed, with their whole new record. A batch
    that is written again after a failure replaces its own folder, and a fold
    starts from the fold before it, whose folders go one fold later.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        placed = batch.withColumn("log_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        placed.write.mode("overwrite").partitionBy("log_bucket").parquet(f"{out}/changes/log_batch={number}")
        if (number + 1) % fold:
            return
        before = [n for n in _numbers(spark, f"{out}/base", "log_upto") if n < number]
        folded = _view(spark, out, keys, number)
        folded.repartition(buckets, "log_bucket").write.mode("overwrite").partitionBy("log_bucket").parquet(f"{out}/base/log_upto={number}")
        for old in before[:-1]:
            _drop(spark, f"{out}/base/log_upto={old}")
        for old in _numbers(spark, f"{out}/changes", "log_batch"):
            if before and old <= before[-1]:
                _drop(spark, f"{out}/changes/log_batch={old}")

    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_latest(
    stream: DataFrame, keys: list[str], seq: str, out: str, checkpoint: str, prediction: str | None = None,
    buckets: int = BUCKETS, fold: int = FOLD,
) -> StreamingQuery:
    """Keep the last record of each key in ``out``.

    The state of the stream holds the last record of each key, so a batch writes
    only the keys it has records of (``_upsert``); ``read_latest`` reads one folded
    table and the few batches after it.
    """
    latest = result_log.latest_prediction(stream, keys, prediction, seq) if prediction else result_log.latest(stream, keys, seq)
    return _upsert(latest, keys, out, checkpoint, buckets, fold)


def read_latest(
    spark: SparkSession, out: str, keys: list[str], seq: str, prediction: str | None = None
) -> DataFrame:
    """Last record per key over all batches written so far; which one that is was settled when it was written."""
    return _view(spark, out, keys).drop("log_bucket")


def fold_batches(spark: SparkSession, out: str, target: str, keys: list[str], seq: str) -> None:
    """The last record of each key as a table of its own."""
    read_latest(spark, out, keys, seq).write.mode("overwrite").parquet(target)


def live_counts(stream: DataFrame, keys: list[str], out: str, checkpoint: str, buckets: int = BUCKETS, fold: int = FOLD) -> StreamingQuery:
    """Running record counts per key (all records of the log, not only the last ones); a batch writes the counts it changed."""
    return _upsert(stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, out, checkpoint, buckets, fold)


def read_counts(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The counts as of the last batch that was written."""
    return _view(spark, out, keys).drop("log_bucket")


class ProgressEvents(StreamingQueryListener):
    """Collects one small record per micro-batch and per query start or end."""

    def __init__(self, sink):
        self.sink = sink

    def onQueryStarted(self, event):
        self.sink({"event": "started", "query": str(event.id)})

    def onQueryProgress(self, event):
        p = event.progress
        self.sink({"event": "progress", "query": str(p.id), "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.sink({"event": "failed" if event.exception else "complete", "query": str(event.id), "error": event.exception})
