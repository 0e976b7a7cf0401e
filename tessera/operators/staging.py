"""Results of a step as tables in the cluster's shared folder, so that lineage ends there; keys dealt over tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

#: Keys that one task makes files or frames of.
TASK_KEYS = 1 << 15


def spread(keys: DataFrame) -> DataFrame:
    """keys over a task per core, or over more where these would hold over TASK_KEYS each: what a task holds doesn't grow with the input."""
    return keys.repartition(max(keys.sparkSession.sparkContext.defaultParallelism, -(-keys.count() // TASK_KEYS)))


def settled(df: DataFrame, name: str) -> DataFrame:
    """Writes df below spark.checkpoint.dir and reads it back; a lost executor costs no earlier step.

    Where the setting is unset a local master takes its temporary folder; on a cluster that is an error.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    path = f"{base.rstrip('/')}/tessera-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
