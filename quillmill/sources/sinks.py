"""Text files with a byte-order mark, one for each row, written by the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.sources import stores

BOM = b"\xef\xbb\xbf"


def output_path(path: Column, suffix: str = "_Processed") -> Column:
    """The path of a processed file: the suffix goes before the extension."""
    return F.regexp_replace(path, r"^(.*?)(\.[^./\\]*)?$", f"$1{suffix}$2")


def lines_to_text(lines: Column, newline: str = "\r\n") -> Column:
    """A newline after every line."""
    return F.concat(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit(newline))), ""), F.lit(""))


def preview(lines: Column, newline: str = "\n") -> Column:
    """The lines as one text for display."""
    return F.array_join(lines, newline)


def write_files(df: DataFrame, path: str = "path", content: str = "content", error: str | None = None) -> DataFrame:
    """Write each row's bytes to its path in a store that the executors share, over what is there. Returns path, bytes and error (null if
    all went well): a row that fails does not stop the others. Null bytes are none. A null path is an error. Rows whose column ``error`` holds one are not written and keep it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = str(TaskContext.get().taskAttemptId())
        for b in batches:
            sizes, errors = [], []
            for p, data, fault in zip(*(b.column(c).to_pylist() for c in ("p", "c", "e"))):
                size = 0
                if fault is None:
                    try:
                        stores.replace_file(p, data or b"", attempt)
                        size = len(data or b"")
                    except Exception as e:  # noqa: BLE001 - reported by row
                        fault = f"{type(e).__name__}: {e}"
                sizes.append(size)
                errors.append(fault)
            yield pa.RecordBatch.from_arrays([b.column("p"), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], ["path", "bytes", "error"])

    fault = (F.col(error) if error else F.lit(None)).cast("string")
    return df.select(F.col(path).alias("p"), F.col(content).cast("binary").alias("c"), fault.alias("e")).mapInArrow(run, "path string, bytes long, error string")


def with_bom(text: Column) -> Column:
    """A text as UTF-8 bytes with a byte-order mark."""
    return F.concat(F.lit(BOM), F.coalesce(text, F.lit("")).cast("binary"))


def write_texts(df: DataFrame, path: str = "output_path", text: str = "text", error: str = "error") -> DataFrame:
    """``write_files`` for texts, as UTF-8 with a byte-order mark. If ``df`` has the column ``error``, rows with one are not written and keep it. The rows are made once."""
    kept = error if error in df.columns else None
    content = F.when(F.col(kept).isNull(), with_bom(F.col(text))) if kept else with_bom(F.col(text))
    return write_files(df.select(F.col(path).alias("path"), content.alias("content"), *([F.col(kept).alias("error")] if kept else [])), error="error" if kept else None)
