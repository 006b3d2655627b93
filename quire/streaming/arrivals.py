"""Files as they arrive, for the same operators as files at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, path: str, glob: str = "*.pdf", most_a_batch: int = 1000) -> DataFrame:
    """file_id, content, arrived of files that appear under path."""
    source = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", most_a_batch)
    return source.load(path).select(F.col("path").alias("file_id"), "content", F.col("modificationTime").alias("arrived"))


def count_objects(arrivals: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Objects by kind and window of arrival; files later than `late` are left out."""
    from quire.operators.objects import scan

    found = scan(arrivals, keep=("arrived",)).withWatermark("arrived", late)
    return found.groupBy(F.window("arrived", window), "kind").agg(F.count("*").alias("objects"))
