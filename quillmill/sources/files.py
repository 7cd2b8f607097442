"""Files in mixed encodings: listing, detection from the first 4096 bytes, decoding."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.charsets import CHARSETS
from quillmill.sources import reader, stores

#: Bytes that detection looks at.
PROBE = 4096
#: Paths of a listing that go together.
LISTED = 1 << 13
_CUT_TAIL = r"^[\x80-\xBF]*\z|[\xC0-\xDF]\z|[\xE0-\xEF][\x80-\xBF]?\z|[\xF0-\xF7][\x80-\xBF]{0,2}\z"


def legacy_charsets(spark: SparkSession) -> None:
    """Let this session decode GBK and put U+FFFD for malformed bytes."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")


def detect_encoding(content: Column) -> Column:
    """The label of a file's encoding: by its byte-order mark, else UTF-8 if its first bytes decode without U+FFFD once an
    incomplete sequence at their end is cut, else GBK. Null content gives null."""
    head = F.substring(content, 1, PROBE)
    whole = F.encode(F.regexp_replace(F.decode(head, "ISO-8859-1"), F.lit(_CUT_TAIL), F.lit("")), "ISO-8859-1")
    marked = F.hex(F.substring(content, 1, 3))
    valid = F.call_function("is_valid_utf8", whole.cast("string")) & ~F.contains(whole, F.lit(b"\xef\xbf\xbd"))
    return (
        F.when(content.isNull(), F.lit(None).cast("string"))
        .when(marked == "EFBBBF", "UTF-8 (BOM)")
        .when(F.startswith(marked, F.lit("FFFE")), "UTF-16 LE")
        .when(F.startswith(marked, F.lit("FEFF")), "UTF-16 BE")
        .when(valid, "UTF-8")
        .otherwise("GBK (ANSI)")
    )


def charset_of(label: Column) -> Column:
    """The charset that decodes a label's files."""
    return F.create_map(*[F.lit(x) for pair in CHARSETS.items() for x in pair])[label]


def decode(content: Column, label: Column) -> Column:
    """The text of a file's bytes, without a byte-order mark; U+FFFD for malformed bytes. Needs ``legacy_charsets``."""
    return F.regexp_replace(decode_part(content, label), "\\A\\x{FEFF}", "")


def decode_part(content: Column, label: Column) -> Column:
    """The same with the mark."""
    text = F.lit(None).cast("string")
    for name, charset in CHARSETS.items():
        text = F.when(label == name, F.decode(content, charset)).otherwise(text)
    return text


def _glob(pattern: str) -> str:
    """A file pattern as a Hadoop glob that ignores case, in which only ``*`` and ``?`` are special: files that don't match are not
    even opened."""
    one = lambda c: c if c in "*?" else f"[{c.lower()}{c.upper()}]" if len(c.lower()) == len(c.upper()) == 1 and c.lower() != c.upper() else "\\" + c if c in "[]{}\\" else c
    return "".join(map(one, pattern))


def name_like(pattern: str) -> str:
    """A file pattern as a regular expression that ignores case."""
    return "(?iu)\\A" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "\\Z"


def _empty_files(spark: SparkSession, paths: list[str], pattern: str | None) -> list[str]:
    """The files of no bytes at the paths or right in them, which Spark's reader leaves out. The driver lists them, as it does for
    the reader."""
    wanted = re.compile(name_like(pattern)) if pattern else None
    found = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in store.listStatus(at) if store.exists(at) else []:
            if status.isFile() and status.getLen() == 0 and (wanted is None or wanted.match(status.getPath().getName())):
                found.append(status.getPath().toString())
    return found


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path and length of the files right in ``folder`` whose names match ``pattern`` (``*`` and ``?``, either case). A folder that all machines see is listed by a
    task, its names streaming by, and the lengths by many; one in another store by Spark's reader, in the driver, which leaves out names that begin with ``_`` or ``.``."""
    local = stores.local_path(folder)
    if local is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", _glob(pattern)).load(folder).select("path", "length")
        empty = _empty_files(spark, [folder], pattern)
        return files.union(spark.createDataFrame([(p, 0) for p in empty], "path string, length long")) if empty else files
    folder, name = stores.local_uri(local), name_like(pattern)
    if not os.path.exists(local):
        raise FileNotFoundError(folder)

    def names(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = re.compile(name)
        found = (f.path for f in stores.children(folder, wanted, lengths=False) if wanted.match(f.path.rsplit("/", 1)[-1]))
        while held := list(islice(found, LISTED)):
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["path"])

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [stores.file_length(p) for p in b.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(found, pa.int64())], ["path", "length"])

    dealt = spark.range(0, 1, 1, 1).mapInArrow(names, "path string").repartition("path")
    return dealt.mapInArrow(lengths, "path string, length long").where("length IS NOT NULL")


def scan_files(spark: SparkSession, paths: str | list[str], pattern: str | None = None, longest: int = reader.LONGEST) -> DataFrame:
    """path, content, encoding (label), charset, text and error of files. One task reads a file whole. ``pattern``: as in ``list_files``. A file that is
    gone, unreadable or longer than ``longest`` bytes has an error, and null in the other columns; the others are read."""
    legacy_charsets(spark)
    found = reader.read_files(spark, paths, name_like(pattern) if pattern else None, longest=longest)
    files = found.select("path", "content", "error").withColumn("encoding", detect_encoding(F.col("content")))
    return files.select("path", "content", "encoding", charset_of(F.col("encoding")).alias("charset"), decode(F.col("content"), F.col("encoding")).alias("text"), "error")


def existing(paths: list[str]) -> list[str]:
    """Those of the paths, in any store, that are files, in order, repeats kept."""
    return [p for p in paths if [f.length for f in stores.children(p)] != [None] and not stores.is_folder(p)]
