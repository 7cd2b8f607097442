"""One joined output a group, from many writers.

A piece's byte offset is the size of all pieces before it. Sizes are added up by blocks of pieces (small rows), a block goes to the part that its offset falls
in, and each task streams its parts' pieces, in order, into files named after its attempt. What it writes down, where each part begins, its
bytes and their checksum, is the manifest, a table that Spark commits when all tasks are done: it names the files of the attempts that
counted. Files of lost and repeated attempts, and of a job that fails, are named by nothing. ``to_one_file`` puts the parts of a group at their offsets
in one file, where the store can write in the middle of files.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillmill.sources import stores
from quillmill.sources.sinks import BOM

#: Bytes from one part to the next, pieces of a block, and bytes read at a time.
PART_BYTES, BLOCK_PIECES, READ_BYTES = 128 << 20, 256, 1 << 22
MANIFEST = "manifest"


def write_joined(pieces: DataFrame, path: str, group: str, seq: str = "seq", piece: str = "piece", part_bytes: int = PART_BYTES, mark: bytes = BOM) -> None:
    """Write the pieces (group, seq from 1 without gaps, piece) of each group, in order and behind ``mark``, as parts of about ``part_bytes`` under ``path``, a new folder
    that all machines see. Null pieces are empty. A null group is a group. A table without rows writes a manifest without rows.

    No task holds more than a batch of pieces; a part ends with the block of pieces that passes its bound.
    """
    stores.check(path)
    kind = pieces.schema[group].dataType
    rows = pieces.select(F.col(group).alias("g"), F.col(seq).cast("long").alias("seq"), F.coalesce(F.col(piece).cast("binary"), F.lit(b"")).alias("piece"))
    block = F.floor((F.col("seq") - 1) / BLOCK_PIECES)
    before = Window.partitionBy("g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("g", block.alias("block")).agg(F.sum(F.octet_length("piece").cast("long")).alias("bytes"))
    offsets = sizes.select("g", "block", (F.coalesce(F.sum("bytes").over(before), F.lit(0)) + len(mark)).alias("start"))
    offsets = offsets.select(F.col("g").alias("g2"), F.col("block").alias("b2"), "start", F.floor((F.col("start") - len(mark)) / part_bytes).alias("part"))
    met = rows.withColumn("block", block).join(offsets, F.col("g").eqNullSafe(F.col("g2")) & (F.col("block") == F.col("b2"))).select("g", "part", "seq", "start", "piece")
    folder, run_id = f"{path.rstrip('/')}/parts", uuid.uuid4().hex[:8]
    stores.make_folder(folder)
    columns = [("g", to_arrow_type(kind)), ("part", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("bytes", pa.int64()), ("crc", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name, n = f"{run_id}-{context.partitionId()}-{context.taskAttemptId()}", 0
        key, out, file, start, size, crc = None, None, "", 0, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip((*key, file, start, size, crc), columns)], [c for c, _ in columns])

        for b in batches:
            for g, part, at, data in zip(*(b.column(c).to_pylist() for c in ("g", "part", "start", "piece"))):
                if out is None or (g, part) != key:
                    if out is not None:
                        yield close()
                    key, file, n = (g, part), f"{folder}/{name}-{n}", n + 1
                    out = stores.open_write(file)
                    start, size, crc = (0 if part == 0 else at), 0, 0
                    data = mark + data if part == 0 else data
                out.write(data)
                size, crc = size + len(data), zlib.crc32(data, crc)
        if out is not None:
            yield close()

    ordered = met.repartition("g", "part").sortWithinPartitions("g", "part", "seq")
    report = ordered.mapInArrow(run, f"g {kind.simpleString()}, part long, file string, start long, bytes long, crc long")
    report.withColumnRenamed("g", group).write.parquet(f"{path.rstrip('/')}/{MANIFEST}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """group, part, file, start, bytes and crc of the parts that count."""
    return spark.read.parquet(f"{path.rstrip('/')}/{MANIFEST}")


def read_joined(spark: SparkSession, path: str, read_bytes: int = READ_BYTES) -> DataFrame:
    """group, start and content of what ``write_joined`` wrote, in chunks; contents in the order of start are the group's bytes. A part whose bytes are
    not those written fails the job."""
    parts = manifest(spark, path)
    group = parts.columns[0]
    names = parts.select(F.col(group).alias("g"), "file", "start", "bytes", "crc")
    kind = to_arrow_type(names.schema["g"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                crc = done = 0
                with stores.open_read(r["file"]) as f:
                    while done < r["bytes"]:
                        data = stores.read_range(f, done, min(read_bytes, r["bytes"] - done))
                        if not data:
                            break
                        yield pa.RecordBatch.from_arrays([pa.array([r["g"]], kind), pa.array([r["start"] + done], pa.int64()), pa.array([data], pa.binary())], ["g", "start", "content"])
                        crc, done = zlib.crc32(data, crc), done + len(data)
                if done != r["bytes"] or crc != r["crc"]:
                    raise OSError(f"{r['file']} is not what was written")

    # a part is a task's work
    chunks = names.repartition("file").mapInArrow(run, f"g {names.schema['g'].dataType.simpleString()}, start long, content binary")
    return chunks.withColumnRenamed("g", group)


def to_one_file(spark: SparkSession, path: str, group, target: str) -> int:
    """The parts of one group as the file ``target``, in a file system that all machines see; its bytes. Tasks write at their parts' offsets in a file of
    another name, which takes the place of ``target`` when all are done."""
    place = stores.local_path(target)
    if place is None:
        raise ValueError(f"{target}: only file systems write in the middle of a file")
    chunks = read_joined(spark, path)
    own = chunks.where(F.col(chunks.columns[0]).eqNullSafe(F.lit(group))).select("start", "content")
    draft = f"{place}.{uuid.uuid4().hex[:8]}.tmp"
    with open(draft, "wb"):
        pass

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        with open(draft, "r+b") as out:
            for b in batches:
                for start, data in zip(b.column("start").to_pylist(), b.column("content").to_pylist()):
                    out.seek(start)
                    out.write(data)
                    done += len(data)
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])

    try:
        size = own.mapInArrow(run, "n long").agg(F.sum("n")).head()[0] or 0
        if os.path.getsize(draft) != size:
            raise OSError(f"{target}: {os.path.getsize(draft)} bytes written of {size}")
        os.replace(draft, place)
    finally:
        if os.path.exists(draft):
            os.remove(draft)
    return size
