"""Cutting lineage in storage that every executor can reach."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one (single-machine sessions only)."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        if not configured and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tshegflow-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and stored in the shared folder, so that later plans read it and a lost executor costs nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Deletes shuffle files and checkpoints that no plan can need any more: Spark does so when the driver's JVM collects its garbage, which a driver that holds little seldom does."""
    gc.collect()  # frames that Python still holds keep their files
    spark.sparkContext._jvm.System.gc()
