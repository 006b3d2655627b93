"""Files as rows: file_id, content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """file_id (the path), content and length of the files under path that match glob."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("file_id"), "content", "length")


def write_files(files: DataFrame, path: str) -> None:
    """Writes rows of (file_id, content) as Parquet, the format in which millions of small files stay fast to list and read."""
    files.select("file_id", "content").write.parquet(path)
