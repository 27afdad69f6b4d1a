"""What must hold for the plans at scale: one pass over the big table, pruned
and pushed-down scans, no cross joins, split hot keys."""

from types import SimpleNamespace

import pytest
from helpers import plan_of
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from catalogue import star
from stratarates.sources import staging
from stratarates.sources.staging import stage, stage_root

QUERIES = entry_module.queries()


def test_scan_reads_only_what_it_needs(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = plan_of(QUERIES["scan_filtered"](spark, sf_dir))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(l for l in plan.splitlines() if "lineitem.parquet" in l)
    assert "l_extendedprice" not in scan and "l_tax" not in scan
    for pushed in ("EqualTo(l_returnflag,R)", "EqualTo(l_linestatus,F)"):
        assert pushed in scan
    part = next(l for l in plan.splitlines() if "part.parquet" in l)
    assert "p_name" not in part


def test_lookup_table_is_broadcast_only_below_the_threshold(spark, sf_dir):
    assert "BroadcastHashJoin" in plan_of(star.typed_lines(spark, sf_dir))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        plan = plan_of(star.typed_lines(spark, sf_dir))
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.set(key, before)


def test_a_part_key_with_a_third_of_all_lines_is_split(spark, sf_dir, tmp_path):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    big = lines.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(20))))
    hot = big.withColumn(
        "l_partkey", F.when(F.col("copy") <= 7, F.lit(3)).otherwise(F.col("l_partkey"))
    ).drop("copy")
    folder = str(tmp_path)
    hot.repartition(8).write.parquet(f"{folder}/lineitem.parquet")
    spark.read.parquet(f"{sf_dir}/part.parquet").write.parquet(f"{folder}/part.parquet")
    want = sorted(map(tuple, star.type_cells(spark, folder).collect()))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        cells = star.type_cells(spark, folder)
        assert sorted(map(tuple, cells.collect())) == want
        assert "skew=true" in plan_of(cells)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_staged_tables_land_in_the_checkpoint_folder(spark):
    df = spark.range(3)
    staged = stage(df, "t")
    assert staged.dtypes == df.dtypes and staged.count() == 3
    root = stage_root(spark).split(":")[-1].strip("/")
    assert all(root in f for f in staged.inputFiles())


def session_stub(conf, master="local[4]"):
    context = SimpleNamespace(
        master=master, applicationId=master, getCheckpointDir=lambda: None
    )
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_the_checkpoint_folder_comes_from_the_session():
    named = session_stub({"spark.checkpoint.dir": "hdfs://x/checkpoints/"}, "spark://x:7077")
    assert stage_root(named) == "hdfs://x/checkpoints"
    for cluster in ("spark://x:7077", "yarn", "k8s://https://x", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            stage_root(session_stub({}, cluster))
    assert stage_root(session_stub({})) == stage_root(session_stub({}))


def test_some_staged_tables_are_released(spark):
    kept = stage(spark.range(3), "kept")
    before = staging.staged()
    gone = stage(spark.range(4), "gone")
    staging.release(only=staging.staged() - before)
    assert kept.count() == 3
    with pytest.raises(Exception):
        gone.count()
