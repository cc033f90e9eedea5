"""Session settings and the checkpoint folder every iterative operator uses."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on; cluster sizing stays with the deployment.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def local_session(cores: str = "8", app: str = "casewright", **extra: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    options = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": cores if cores.isdigit() else "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        **extra,
    }
    for key, value in options.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without the setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        configured = context.getConf().get("spark.checkpoint.dir", None)
    if configured is None:
        existing = context.getCheckpointDir()
        if existing:
            return existing
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="casewright-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return configured


@contextmanager
def rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run within give Python at most ``rows`` rows at a time, or what the session has, if that is less.

    Rows with whole texts are large: a batch of them is held several times, by the
    executor and by its Python worker.
    """
    before = spark.conf.get(ARROW_ROWS)
    lower_rows_at_once(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def lower_rows_at_once(spark: SparkSession, rows: int) -> None:
    """The same for the rest of the session, for results that are worked out later."""
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= rows:
        spark.conf.set(ARROW_ROWS, str(rows))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read them from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
