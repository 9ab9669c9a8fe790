"""Checkpoints in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, as in tests, a new local one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder; its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def hash_sample(ids: DataFrame, key: str, most: int) -> DataFrame:
    """At most this many rows, chosen by hash of key; a table that is larger is thinned first, so no task sends on more than its share.

    ids should hold little beside the key.
    """
    rows = ids.count()
    if rows > most:
        span = 1 << 30
        ids = ids.where(F.pmod(F.xxhash64(key), F.lit(span)) < int(min(1.0, 1.3 * most / rows + 1e-8) * span))
    return ids.orderBy(F.xxhash64(key), key).limit(most)
