"""Session set-up and lineage cutting."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution and Arrow; settings that are present already are kept."""
    builder = SparkSession.builder.appName("quantafold")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder of spark.checkpoint.dir.

    Only where the session names no folder and runs in one process (tests, a laptop) is a
    temporary folder taken; on a cluster without the setting an error is raised.

    The driver then collects its garbage, on which Spark removes the shuffle files of plans that are no
    longer held; else they'd stay on the executors' disks until the driver happens to do so.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quantafold-")
        context.setCheckpointDir(folder)
    made = df.checkpoint(eager=True)
    gc.collect()
    context._jvm.System.gc()
    return made
