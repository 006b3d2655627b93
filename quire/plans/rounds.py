"""Cutting a plan between the rounds of an iterative operator, or before several uses of what is dear to make."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame


#: Seconds between two times that the driver is told to drop what it no longer refers to, and when it last was.
PAUSE = 15.0
_last = [0.0]


def _let_go(spark) -> None:
    """Shuffle files of rounds that are over go from the disks only when the driver's JVM has collected its garbage, which left to itself it
    seldom does."""
    if time.monotonic() - _last[0] > PAUSE:
        spark.sparkContext._jvm.System.gc()
        _last[0] = time.monotonic()


def settled(df: DataFrame) -> DataFrame:
    """df as written to the shared checkpoint folder of the session, and read back; only where none is set, to a local one."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="quire-rounds-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder}/quire-round-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _let_go(spark)
    return spark.read.schema(df.schema).parquet(path)
