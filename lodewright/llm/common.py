"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\W_]+")
NOT_ALNUM = re.compile(r"[\W_]+")


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A table of the data folder, pruned to ``cols`` when given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def spread(df: DataFrame) -> DataFrame:
    """Spread an input of a few file splits over the cores.

    Inputs that already come in about as many splits as there are cores stay as they are, so
    at scale this adds no shuffle.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(word in plan for word in ("Repartition", "Join", "Aggregate", "Window", "Sort", "Distinct", "Deduplicate")):
        return df  # asking what is behind a shuffle for its partitions would run the shuffle
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder all executors share.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset a local session gets a
    temporary one; on a cluster it is an error, as no executor could read the driver's folder.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodewright-ckpt-"))
    return df.checkpoint(eager=True)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def ship_file(spark: SparkSession, path: str) -> str:
    """Send a file of the driver to all executors, once an application; its name for ``shipped_file``."""
    sc = spark.sparkContext
    if (sc.applicationId, path) not in _SHIPPED:
        sc.addFile(path)
        _SHIPPED.add((sc.applicationId, path))
    return os.path.basename(path)


_SHIPPED: set[tuple[str, str]] = set()


def shipped_file(name: str) -> str:
    """Where a task finds a shipped file."""
    return SparkFiles.get(name)


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; ``LODEWRIGHT_TOKENIZERS`` overrides the folder."""
    return os.path.join(os.environ.get("LODEWRIGHT_TOKENIZERS", "/opt/tokenizers"), name)
