"""Helpers shared by operators: reading tables, cutting lineage, session setup."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("foliospark")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    A table of one small file arrives as one task; before work that is heavy for
    each row its rows are dealt out.  Larger tables have more splits than cores
    and pass through untouched.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    splits = df.select(df.columns[0]).rdd.getNumPartitions()
    return df.repartition(wanted) if splits < wanted else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    Only a session without that setting (local tests) gets a temporary folder.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", context.master):  # local-cluster[...] is a cluster
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="foliospark-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(shared)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
