"""Session settings the engine relies on."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings of the session, for any size: partitions are coalesced and split at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(app: str = "driftclust", cores: int | str = "*", partitions: int | None = None) -> SparkSession:
    """The running session, or a local one."""
    builder = SparkSession.builder.appName(app)
    if not os.environ.get("SPARK_REMOTE") and not SparkSession.getActiveSession():
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", os.environ.get("DRIFTCLUST_DRIVER_MEMORY", "8g"))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Let Python workers of this session find this package where it lies, whatever folder the driver was started in."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, environment.get("PYTHONPATH", "")]))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share: what ``spark.checkpoint.dir`` names. Where it names none, a
    folder of this machine serves a local session; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or "file:///tmp/checkpoints/driftclust").rstrip("/")


def settled(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, and a lost executor costs no recomputation of what led to it."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a table for each core, as Catalyst estimates them, from which it lies in enough splits.
SPLIT_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table in few files, which may lie in a single row group, dealt to all cores for a costly map stage; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SPLIT_BYTES and len(df.inputFiles()) < cores else df


#: Bytes of a table, as Catalyst estimates them, for each part that what is counted in it is dealt to.
PART_BYTES = 4 << 20


def dealt(found: DataFrame, of: DataFrame, *keys: str) -> DataFrame:
    """``found`` by keys in parts whose number grows with the table ``of`` that it comes from, so that a task's share doesn't; a small table's are left to the
    session's settings."""
    parts = -(-int(of._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // PART_BYTES)
    return found.repartition(parts, *keys) if parts > int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")) else found
