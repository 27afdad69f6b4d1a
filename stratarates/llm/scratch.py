"""Staged tables and folders, and what Python workers need, for the operators here."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from stratarates.sources import staging

release = staging.release
staged = staging.staged
folder = staging.stage_folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below ``spark.checkpoint.dir`` and read it back.  Written tables,
    unlike cached blocks, outlive the executors that made them."""
    return staging.stage(df, name, "zstd")


def checkpoints(spark: SparkSession) -> None:
    """Let ``checkpoint()`` write to the same folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(staging.stage_root(spark))


def workers_find_package(spark: SparkSession) -> None:
    """Python workers import this package from where the driver did, unless it is installed
    or shipped with the job already."""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [home])
