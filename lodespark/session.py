"""Session helpers: table loading and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    A small table in one file would pass through one task. Rows move only where the scan has fewer partitions than cores, which no large
    table has; they go by ``key``, so that a lost task finds the same rows again.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the session names none (tests, a laptop) a folder of our own is set, and only
    in local mode: on a cluster a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return named or current.get()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"lodespark-{os.getuid()}")
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """``checkpoint()`` into the shared folder; survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)
