"""Shared helpers of the operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder all executors share, ``spark.checkpoint.dir``.

    Where that is unset a local session gets a temporary folder; on a cluster it is an error, as no executor
    could read the driver's folder.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodewright-ckpt-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Spread an input of very few splits over the cores; larger inputs stay as they are.

    Only what comes straight from a scan is counted: the partitions of anything behind a shuffle are its own affair, and
    asking for their number would run the shuffle.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(word in plan for word in ("Repartition", "Join", "Aggregate", "Window", "Sort", "Distinct", "Deduplicate")):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def ordered_blocks(df: DataFrame, *order: str, rows_a_block: int = 50_000) -> DataFrame:
    """Range-partition by ``order`` and add ``_block``; blocks follow each other in that order.

    The checkpoint pins the blocks, as range bounds come from a sample.
    """
    n = max(1, df.count() // rows_a_block + 1)
    return checkpoint(df.repartitionByRange(n, *order).withColumn("_block", F.spark_partition_id()))
