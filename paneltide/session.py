"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Set where the session leaves them open. A shuffle starts with many partitions, which adaptive execution
#: joins up to its advisory size, so a task's share hardly grows with the input; up to 200, writers hold no
#: rows back. Generated methods that HotSpot would only interpret are not used.
ASSUMED = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "200",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str | None = None, app: str = "paneltide", **conf) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE on)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one only on a local master."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def assume(spark: SparkSession) -> None:
    """Give the session the settings in ``ASSUMED`` that it does not have."""
    for key, value in ASSUMED.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table inside the shared folder."""
    assume(spark)
    return f"{shared_folder(spark).rstrip('/')}/tables/{uuid.uuid4().hex}/{name}"


def settle(df: DataFrame) -> DataFrame:
    """Run ``df`` once and keep the result in the shared folder.

    Everything downstream reads the stored rows, so two branches see the same
    digits and a lost executor cannot change them. They are Parquet, so readers
    still take only the columns and row groups they need.
    """
    return stored(df, "settled")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``stored`` and the number of rows, which is observed while they are written."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return out, int(seen.get["rows"])
