"""Where an operator puts tables that cut its lineage, and settings that bound a Python worker's memory."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session may be without it; that session then gets a folder of its own.
    """
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), f"quillmill-{os.getuid()}")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/quillmill/{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends there, and a lost executor costs no
    more than the reading of its part."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    """A small table of the driver's. It goes by Arrow: rows given as a list pass through an RDD, for which every executor starts a second pool of
    Python workers beside that of SQL, and these stay."""
    return spark.createDataFrame(pa.table(columns))


def bound_batches(spark: SparkSession, rows: int = 500) -> None:
    """Keep Arrow batches small, so that a batch of long texts fits in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def task_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_KEPT: dict[str, Callable[[], None]] = {}


def works_for(operator: str, drop: Callable[[], None] = lambda: None) -> None:
    """A Python worker that Spark uses again has what operators before have left in it. Called at the start of a task or a batch, this says whose work it is and how to drop what
    that operator keeps between tasks; what others keep is dropped, and free memory goes back to the system."""
    if operator in _KEPT and len(_KEPT) == 1:
        return
    for other in [o for o in _KEPT if o != operator]:
        _KEPT.pop(other)()
    _KEPT[operator] = drop
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # only some C libraries have it
