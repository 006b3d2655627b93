"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_HELD: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """What an operator keeps in a Python worker from task to task. Workers outlive stages, and an executor has more of them
    than tasks; so a worker holds one operator's cache at a time, and that of the one before goes, back to the system."""
    found = _HELD.get(name)
    if found is None:
        if _HELD:
            _HELD.clear()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)
        found = _HELD[name] = {}
    return found


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where neither their path nor their folder has it."""
    here = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    if os.path.realpath(ROOT) in [*here, os.path.realpath(os.getcwd())]:
        return
    sc = spark.sparkContext
    if getattr(sc, "_quire_shipped", False):
        return
    import shutil

    folder = tempfile.mkdtemp(prefix="quire-zip-")
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "quire_src"), "zip", ROOT, "quire"))
    sc._quire_shipped = True


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session; only where none is set (tests on one machine), a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="quire-scratch-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost
    executor costs only the tasks that were running on it."""
    path = f"{scratch_dir(df.sparkSession)}/quire-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._quire_path = path
    return found


def drop(*staged: DataFrame) -> None:
    """Removes tables that stage() wrote and no plan reads any more."""
    for df in staged:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._quire_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that nobody holds any more, before the next ones are written."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def laid_out(df: DataFrame, column: str, label: str) -> Iterator[DataFrame]:
    """df as a table in the shared folder that is bucketed by a column, so that joins and groups on it don't move its
    rows; it is gone when the block ends."""
    spark = df.sparkSession
    name = f"quire_{label}_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{name}"
    df.write.option("compression", "zstd").option("path", path).format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).saveAsTable(name)
    forget(spark)
    found = spark.table(name)
    found._quire_path = path
    try:
        yield found
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop(found)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and splits at space, tab, LF, VT, FF and CR; bytes.split() knows just these."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def narrow(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that others of a clashing name can't get in the way; text as string, null ids kept."""
    return docs.select(*[F.col(f"`{n}`") for n in names])
