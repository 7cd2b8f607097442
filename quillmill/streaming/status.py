"""The status of a batch whose files are asked for as they arrive.

A stream of requests names files; a file that failed may be asked for again. The state for each path holds how often it was asked for, how
often it failed and how it stands, so the counts after a trigger are those of a batch over all requests so far, and go on from the checkpoint after a
restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmill.sources import files, reader

STATE = "attempts long, failures long, error string"
UPDATE = f"path string, {STATE}"


def read_requests(requests: DataFrame, longest: int = reader.LONGEST) -> DataFrame:
    """path, encoding, charset, text and error of the file that each row's ``path`` names, in a batch or a stream. Faults: as in ``files.scan_files``. Null paths are left out."""
    files.legacy_charsets(requests.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                one = reader.FilesReader({"paths": "1", "path0": path, "longest": str(longest)})
                for work in one.partitions():
                    for found in one.read(work):
                        yield pa.RecordBatch.from_arrays([pa.array([path] * found.num_rows, pa.string()), found.column("content"), found.column("error")], ["path", "content", "error"])

    found = requests.select("path").where(F.col("path").isNotNull()).mapInArrow(run, "path string, content binary, error string")
    labelled = found.withColumn("encoding", files.detect_encoding(F.col("content")))
    return labelled.select("path", "encoding", files.charset_of(F.col("encoding")).alias("charset"), files.decode(F.col("content"), F.col("encoding")).alias("text"), "error")


def _counted(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    attempts, failures, error = state.get if state.exists else (0, 0, None)
    for frame in frames:
        bad = frame["error"].dropna()
        attempts, failures = attempts + len(frame), failures + len(bad)
        # of attempts in one trigger, one that went well decides
        error = None if len(bad) < len(frame) else bad.min()
    state.update((attempts, failures, error))
    yield pd.DataFrame({"path": [key[0]], "attempts": [attempts], "failures": [failures], "error": [error]})


def status_updates(results: DataFrame) -> DataFrame:
    """A streaming table of path, attempts, failures and error (null where the last trigger that asked for the path went well), one row for each path of a trigger,
    from a stream of results (path, error). One number and a text a path are kept as state."""
    return results.select("path", "error").groupBy("path").applyInPandasWithState(_counted, UPDATE, STATE, "update", GroupStateTimeout.NoTimeout)


def batch_status(results: DataFrame, order: str) -> DataFrame:
    """The same for a table of results with the number ``order`` of the trigger that asked: path, attempts, failures and error."""
    each = results.groupBy("path", order).agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("bad"), F.min("error").alias("error"))
    each = each.withColumn("error", F.when(F.col("bad") == F.col("n"), F.col("error")))
    return each.groupBy("path").agg(F.sum("n").alias("attempts"), F.sum("bad").alias("failures"), F.max_by("error", order).alias("error"))


def start(requests: DataFrame, path: str, longest: int = reader.LONGEST, **trigger) -> StreamingQuery:
    """Read the files that a stream of requests names, and keep their status in the folder ``path``, with state and checkpoint. A trigger that is run again replaces
    what it wrote. ``trigger``: as for ``writeStream.trigger``."""
    root = path.rstrip("/")

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/status/trigger={number}")

    return status_updates(read_requests(requests, longest)).writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", f"{root}/checkpoint").trigger(**trigger).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """path, attempts, failures and error after the last trigger; ``joiner.batch_summary`` counts them."""
    updates = spark.read.schema(f"{UPDATE}, trigger long").parquet(f"{path.rstrip('/')}/status")
    last = F.max_by(F.struct("attempts", "failures", "error"), "trigger").alias("last")
    return updates.groupBy("path").agg(last).select("path", "last.*")
