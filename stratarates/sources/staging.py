"""Write a small aggregate once instead of recomputing it per branch.

A rate analysis uses its aggregated cells in many branches (shares,
reallocation, populations, standards, totals).  Catalyst pushes each branch's
filters and columns down to the scan, which makes the branches' plans differ and
would read the big table once per branch.  Writing the cells (strata x years x
units rows) to the shared checkpoint folder reads it exactly once, survives the
loss of any executor, and gives later joins the true size of the table.

What is written is removed by :func:`release`, at the latest when the driver's
Python ends.  If the session has ended by then, its JVM removes the folder, on
whatever file system it is.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}
_homes: dict[tuple[str, str], str] = {}
_local: list[str] = []


def stage_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the folder its context was
    given.  Where neither is set, a session that runs in one process, as in tests,
    gets a temporary folder; on a cluster that is an error, since executors do not
    see each other's folders."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"staged tables need spark.checkpoint.dir, a folder that all of {master} can reach")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="stratarates-"))
    return _local[0]


def _path(spark: SparkSession, path: str):
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(context._jsc.hadoopConfiguration())


def _home(spark: SparkSession) -> str:
    """One folder per application below the root, removed with the JVM if not before."""
    key = spark.sparkContext.applicationId, stage_root(spark)
    if key not in _homes:
        home = f"{key[1]}/stratarates-{key[0]}-{uuid.uuid4().hex[:8]}"
        target, system = _path(spark, home)
        system.mkdirs(target)
        system.deleteOnExit(target)
        _homes[key] = home
    return _homes[key]


def stage_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the root, to be removed by :func:`release`."""
    path = f"{_home(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Materialise ``df`` as Parquet under the checkpoint folder and read it back."""
    spark = df.sparkSession
    path = stage_folder(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged() -> frozenset[str]:
    """The staged folders of now, for ``release(only=...)``."""
    return frozenset(_made)


def release(only: frozenset[str] | None = None) -> None:
    """Remove staged folders, all or ``only`` some; DataFrames that read them can no longer run."""
    for path, spark in list(_made.items()):
        if only is not None and path not in only:
            continue
        try:
            target, system = _path(spark, path)
            system.delete(target, True)
        except Exception:  # the session has ended: local files are removed here, others by its JVM
            local = path.removeprefix("file://")
            if os.path.isdir(local):
                shutil.rmtree(local, ignore_errors=True)
        _made.pop(path, None)
    if not _made and _local and only is None:
        shutil.rmtree(_local.pop(), ignore_errors=True)
        _homes.clear()


atexit.register(release)
