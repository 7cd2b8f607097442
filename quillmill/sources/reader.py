"""A data source of files whose faults stay with their rows, and of files in byte ranges.

``spark.read.format("binaryFile")`` ends a job at the first file it cannot read and refuses files of 2 GB. Here a file that is gone, that
cannot be read or that is longer than wanted is a row with an error, and a file can be dealt out in splits of bounded size. A
partition is a bounded number of bytes; a task holds one file, or one split, at a time, of short ones BATCH_BYTES.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillmill.sources import stores

FORMAT = "quillmill_files"
SCHEMA = "path string, length long, split int, start long, head binary, content binary, ahead int, error string"
_ARROW = pa.schema([("path", pa.string()), ("length", pa.int64()), ("split", pa.int32()), ("start", pa.int64()), ("head", pa.binary()), ("content", pa.binary()), ("ahead", pa.int32()), ("error", pa.string())])
#: Bytes of a file's start that every row of it has (what encoding detection looks at), bytes beyond its end that a split has, and bytes of a partition;
#: a file counts for OPEN_COST bytes at least.
HEAD, AHEAD, PARTITION_BYTES, OPEN_COST = 4096, 4, 128 << 20, 1 << 20
#: Partitions beyond which short files are dealt out more to a partition, and bytes that rows are gathered up to.
MOST, BATCH_BYTES = 2048, 1 << 20
#: The longest file that is one row, unless the option says less.
LONGEST = (1 << 31) - (1 << 20)


class Work(InputPartition):
    """Files or splits that one task reads: (path, length, first split, number of splits). They are kept in packed groups, since the driver holds them all."""

    def __init__(self, packed: list[bytes]) -> None:
        self.packed = packed

    def items(self) -> Iterator[tuple[str, int | None, int, int]]:
        for group in self.packed:
            yield from pickle.loads(zlib.decompress(group))


class FilesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [options[f"path{k}"] for k in range(int(options["paths"]))]
        self.name = re.compile(options["name"]) if options.get("name") else None
        self.split = int(options.get("split_bytes", 0))
        self.longest = int(options.get("longest", LONGEST))
        self.partition = int(options.get("partition_bytes", PARTITION_BYTES))
        self.whole = {"true": True, "false": False}.get(options.get("whole"))
        for p in self.paths:
            stores.check(p)

    def partitions(self) -> list[Work]:
        """The files in the order of the paths and of what is listed there, dealt out by bytes. The splits of a file of a partition's size at most stay together."""
        groups, held, size, real = [], [], 0, 0
        for item, n in self._items():
            held.append(item)
            size += max(n, OPEN_COST if item[2] == 0 else 0)
            real += n
            if size >= self.partition:
                groups.append((zlib.compress(pickle.dumps(held), 1), real))
                held, size, real = [], 0, 0
        groups += [(zlib.compress(pickle.dumps(held), 1), real)] if held or not groups else []
        each, works, real = -(-len(groups) // MOST), [], 0
        for group, n in groups:
            if works and len(works[-1].packed) < each and real + n <= self.partition:
                works[-1].packed.append(group)
                real += n
            else:
                works.append(Work([group]))
                real = n
        return works

    def _items(self) -> Iterator[tuple[tuple[str, int | None, int, int], int]]:
        """Files, or runs of their splits, with their bytes."""
        for path in self.paths:
            try:
                for f in stores.children(path, self.name):
                    if self.name is not None and not self.name.match(f.path.rsplit("/", 1)[-1]) or self.whole is (f.length is not None and f.length > self.partition):
                        continue
                    if not self.split or not f.length:
                        yield (f.path, f.length, 0, 1), f.length or 0
                        continue
                    splits = -(-f.length // self.split)
                    each = splits if f.length <= self.partition else max(1, self.partition // self.split)
                    for k in range(0, splits, each):
                        yield (f.path, f.length, k, min(each, splits - k)), min(each * self.split, f.length - k * self.split)
            except OSError:
                # reading it says what is wrong
                if self.whole is not False:
                    yield (path, None, 0, 1), 0

    def read(self, partition: Work) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in self._rows(partition):
            held.append(row)
            size += len(row["content"] or b"") + len(row["head"] or b"")
            if size >= BATCH_BYTES or len(held) >= 1000:
                yield pa.RecordBatch.from_pylist(held, _ARROW)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _ARROW)

    def _rows(self, partition: Work) -> Iterator[dict]:
        for path, length, first, n in partition.items():
            headed = False
            for split in range(first, first + n):
                start = split * self.split
                size = min(self.split, length - start) if self.split and length else length or 0
                head = content = error = None
                ahead = 0
                try:
                    if size > self.longest:
                        raise ValueError(f"{size} bytes, more than {self.longest}")
                    with stores.open_read(path) as f:
                        # a file whose length is not known is read up to the limit
                        content = stores.read_range(f, start, size if length is not None else self.longest + 1)
                        if len(content) > self.longest:
                            raise ValueError(f"more than {self.longest} bytes")
                        if len(content) < size:
                            raise OSError(f"ends after {start + len(content)} of {length} bytes")
                        if self.split:
                            ahead = min(AHEAD, length - start - size) if length is not None else 0
                            content += stores.read_range(f, start + size, ahead) if ahead else b""
                        if not (headed and self.whole):
                            head = stores.read_range(f, 0, HEAD) if start else content[:HEAD]
                            headed = True
                except Exception as e:  # noqa: BLE001 - the row says so
                    head = content = None
                    error = f"{type(e).__name__}: {e}"
                yield {"path": path, "length": length, "split": split, "start": start, "head": head, "content": content, "ahead": ahead, "error": error}


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FilesReader(self.options)


def read_files(spark: SparkSession, paths: str | list[str], name: str | None = None, split_bytes: int = 0, longest: int = LONGEST, partition_bytes: int = PARTITION_BYTES, whole: bool | None = None) -> DataFrame:
    """A row for every file at the paths or right in them whose name matches the regular expression ``name``: path, length, head, content and error. With
    ``split_bytes`` a row for every split (split from 0, start), whose content has ``ahead`` bytes of the next one at its end.

    A path where there is nothing, a file that cannot be read, one that has become shorter and one of more than ``longest`` bytes have an error and no
    content. A file of no bytes is one row. The driver lists the files; it holds about ten bytes for each, and as much for each partition of a longer one.

    ``whole``: only the files of ``partition_bytes`` at most, whose splits follow each other in one task, and of which only the first split that is read has the
    head; if false, only the others.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    spark.dataSource.register(Files)
    options = {"paths": len(paths), "split_bytes": split_bytes, "longest": longest, "partition_bytes": partition_bytes, **{f"path{k}": p for k, p in enumerate(paths)}}
    options |= ({"name": name} if name else {}) | ({"whole": str(whole).lower()} if whole is not None else {})
    return spark.read.format(FORMAT).options(**options).load()
