"""A session with this engine's settings."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quillmill", **conf: str) -> SparkSession:
    """Get or build a session: adaptive execution with skew handling, UTC, Arrow, and Java's charsets for GBK."""
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.legacy.javaCharsets": "true", "spark.sql.legacy.codingErrorAction": "true"}
    for k, v in {**settings, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Bytes under which a table of few files is likely to be few row groups.
SMALL_TABLE = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small table out where they come from fewer files than the cluster has cores: a file of one row group is
    one task, however small the splits. Larger tables, and those of more files, are left as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # the files of a large table are not listed here
    return df.repartition(cores) if 0 < size < SMALL_TABLE and len(df._jdf.inputFiles()) < cores else df


#: Names the folder that driver and executors share.
SHARED = "spark.checkpoint.dir"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the session's ``spark.checkpoint.dir`` names, deleted when the application ends. Only a local session may be
    without that setting; it gets a folder of its own."""
    folder = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SHARED} must name a folder that driver and executors share")
        folder = os.path.join(tempfile.gettempdir(), f"quillmill-engine-{os.getuid()}")
    path = f"{folder.rstrip('/')}/quillmill/{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def staged(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: its lineage ends there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
