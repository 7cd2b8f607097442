"""Texts and lines of files that are read in splits.

A split begins anywhere, so inside a character perhaps. What a split needs to know is how many of its first bytes belong to a character that began
before it: none to three. Each split turns that number into the one for the next split, so it is a function on {0, 1, 2, 3}; the functions of
a file's splits are composed in order (a few bytes a split), and then every split is decoded by itself. The functions:

- UTF-16: pairs of bytes, and pairs of surrogates, as far back as there are high ones.
- UTF-8: an automaton over lead and continuation bytes; it is settled by a split's last bytes.
- Code page 936: a byte is a character's first or second one by what went before it, as far back as there are bytes from 0x40 on, since a second
  byte may look like a letter. The functions of single bytes are composed by halving. Which pairs are one character is asked of the decoder.

A malformed byte is a character of its own here as it is to the decoder, so the pieces give the text of the whole file.

A file of a partition's size at most needs none of that: its splits follow each other in one task, which hands the number on. Its lines are cut there too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill import session
from quillmill.sources import files, reader

DOUBLE_BYTE = "x-mswin-936"
#: States of the UTF-8 automaton: between characters; one, two continuation bytes wanted; after E0, F0, F1 to F3, F4.
_BETWEEN, _ONE, _TWO, _E0, _F0, _F1, _F4 = range(7)


def _utf8_step(state: int, byte: int) -> int:
    """The next state. A byte that does not go on begins anew."""
    low, high, to = {_ONE: (0x80, 0xBF, _BETWEEN), _TWO: (0x80, 0xBF, _ONE), _E0: (0xA0, 0xBF, _ONE), _F0: (0x90, 0xBF, _TWO), _F1: (0x80, 0xBF, _TWO), _F4: (0x80, 0x8F, _TWO)}.get(state, (1, 0, 0))
    if low <= byte <= high:
        return to
    if 0xC2 <= byte <= 0xDF:
        return _ONE
    return _E0 if byte == 0xE0 else _TWO if 0xE1 <= byte <= 0xEF else _F0 if byte == 0xF0 else _F1 if 0xF1 <= byte <= 0xF3 else _F4 if byte == 0xF4 else _BETWEEN


def _utf8_carry(data: bytes, size: int, skip: int) -> int:
    # from the eighth byte before the end on, the state no longer depends on how it starts
    state = _BETWEEN
    for byte in data[max(skip, size - 8) : size]:
        state = _utf8_step(state, byte)
    taken = 0
    for byte in data[size:]:
        if state == _BETWEEN:
            break
        after = _utf8_step(state, byte)
        if not 0x80 <= byte <= 0xBF or (after == _BETWEEN and state != _ONE):
            break
        state, taken = after, taken + 1
    return taken


def _utf16_carry(data: bytes, size: int, skip: int, high: int) -> int:
    """``high``: the place of the high byte in a pair. The decoder takes a high surrogate with whatever pair follows, so of a run of high ones
    every other one is a first; behind any other pair a character begins."""
    last = size - 2 + (size - skip) % 2
    if last < skip:
        return 0
    at = last
    while at >= skip and data[at + high : at + high + 1] and data[at + high] & 0xFC == 0xD8:
        at -= 2
    end = last + (4 if (last - at) // 2 % 2 else 2)
    return min(end, len(data)) - size


def _double_carries(data: bytes, size: int, pairs: np.ndarray) -> list[int]:
    """``pairs``: which of the 65,536 pairs of bytes are one character."""
    values = np.frombuffer(data, np.uint8).astype(np.int32)
    following = np.append(values[1:], 0)[:size]
    # the function of a byte on (it is a first byte, it is a second one): is the next one a second one?
    first = pairs[values[:size] << 8 | following].copy()
    if len(values) == size and size:
        first[-1] = False
    second = np.zeros(size, bool)
    while len(first) > 1:
        odd = len(first) % 2
        tail = (first[-1:], second[-1:]) if odd else (first[:0], second[:0])
        a0, a1, b0, b1 = first[: len(first) - odd : 2], second[: len(first) - odd : 2], first[1 : len(first) - odd + 1 : 2], second[1 : len(first) - odd + 1 : 2]
        first, second = np.append(np.where(a0, b1, b0), tail[0]), np.append(np.where(a1, b1, b0), tail[1])
    return [int(first[0]), int(second[0])] if size else [0, 1]


def carried(data: bytes, size: int, skip: int, charset: str, pairs: np.ndarray | None = None) -> int:
    """``carries`` for one number."""
    if skip > size:
        return skip - size
    if charset == "UTF-8":
        return _utf8_carry(data, size, skip)
    if charset.startswith("UTF-16"):
        return _utf16_carry(data, size, skip, 0 if charset == "UTF-16BE" else 1)
    return carries(data, size, charset, pairs)[skip]


def carries(data: bytes, size: int, charset: str, pairs: np.ndarray | None = None) -> list[int]:
    """For 0 to 3 first bytes that belong to the character before: how many bytes of the next split belong to this one's last character. ``data``: a
    split of ``size`` bytes with the first few of the next one."""
    found = _double_carries(data, size, pairs) + [0, 0] if charset == DOUBLE_BYTE else [0] * 4
    for skip in range(4):
        if skip > size:
            found[skip] = skip - size
        elif charset.startswith("UTF-16"):
            found[skip] = _utf16_carry(data, size, skip, 0 if charset == "UTF-16BE" else 1)
        elif charset == "UTF-8":
            found[skip] = _utf8_carry(data, size, skip)
    return found


@lru_cache(maxsize=1)
def _pairs_of(application: str) -> bytes:
    spark = SparkSession.active()
    files.legacy_charsets(spark)
    two = F.unhex(F.lpad(F.hex("id"), 4, "0"))
    table = spark.range(0, 65536, 1, 1).select("id", (F.length(F.decode(two, DOUBLE_BYTE)) == 1).alias("one")).orderBy("id")
    one = np.array([r["one"] for r in table.collect()], bool)
    return np.packbits(one).tobytes()


def double_byte_pairs(spark: SparkSession) -> np.ndarray:
    """Which pairs of bytes the JVM's decoder of code page 936 takes as one character, 65,536 of them."""
    return np.unpackbits(np.frombuffer(_pairs_of(spark.sparkContext.applicationId), np.uint8)).astype(bool)


def _split_rows(spark: SparkSession, paths: str | list[str], split_bytes: int, pattern: str | None, partition_bytes: int, whole: bool | None) -> DataFrame:
    files.legacy_charsets(spark)
    name = files.name_like(pattern) if pattern else None
    rows = reader.read_files(spark, paths, name, split_bytes=split_bytes, partition_bytes=partition_bytes, whole=whole)
    label = files.detect_encoding(F.col("head"))
    return rows.withColumns({"encoding": label, "charset": files.charset_of(label), "size": F.octet_length("content") - F.col("ahead")})


def _decoded(content: Column) -> Column:
    text = files.decode_part(content, F.col("encoding"))
    return F.when(F.col("split") == 0, F.regexp_replace(text, "\\A\\x{FEFF}", "")).otherwise(text)


def text_pieces(spark: SparkSession, paths: str | list[str], split_bytes: int, pattern: str | None = None, partition_bytes: int = reader.PARTITION_BYTES, whole: bool | None = None) -> DataFrame:
    """path, split, encoding, charset, text and error of every split; the texts of a file's splits in order are its text. ``whole``: as in ``reader.read_files``.

    A file with a fault has an error where the fault is and null there; its other splits are read. Files of no bytes have one empty text. The files are read twice, first for
    the functions, of which there are four numbers a split; those are put in order by file and joined to the second reading.
    """
    rows = _split_rows(spark, paths, split_bytes, pattern, partition_bytes, whole)
    pairs = double_byte_pairs(spark)

    @F.arrow_udf("array<int>")
    def function(content: pa.Array, size: pa.Array, charset: pa.Array) -> pa.Array:
        each = zip(content.to_pylist(), size.to_pylist(), charset.to_pylist())
        return pa.array([None if c is None else carries(c, n, e, pairs) for c, n, e in each], pa.list_(pa.int32()))

    functions = rows.select("path", "split", function("content", "size", "charset").alias("f"))
    in_order = functions.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("split", "f"))).alias("all"))
    # a split that cannot be read leaves the next one between characters
    go_on = lambda s, x: F.struct((F.coalesce(F.element_at(x["f"], s["k"] + 1), F.lit(0))).alias("k"), F.array_append(s["o"], s["k"]).alias("o"))
    start = F.struct(F.lit(0).alias("k"), F.array().cast("array<int>").alias("o"))
    carried = in_order.select("path", F.aggregate("all", start, go_on, lambda s: F.array_append(s["o"], s["k"])).alias("o"))
    both = F.arrays_zip(F.slice("o", 1, F.size("o") - 1).alias("skip"), F.slice("o", 2, F.size("o") - 1).alias("over"))
    placed = carried.select("path", F.posexplode(both).alias("split", "at")).select("path", "split", "at.skip", "at.over")
    met = rows.join(placed, ["path", "split"])
    text = _decoded(F.substring(F.col("content"), F.col("skip") + 1, F.col("size") - F.col("skip") + F.col("over")))
    return met.select("path", "split", "encoding", "charset", text.alias("text"), "error")


def _whole_lines(spark: SparkSession, paths: str | list[str], split_bytes: int, pattern: str | None, partition_bytes: int) -> DataFrame:
    """path, line_no and line of the files of ``partition_bytes`` at most."""
    rows = _split_rows(spark, paths, split_bytes, pattern, partition_bytes, True)
    pairs = double_byte_pairs(spark)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip, encoding, charset = 0, None, None
        for b in batches:
            held = []
            for split, content, size, label, name in zip(*(b.column(c).to_pylist() for c in ("split", "content", "size", "encoding", "charset"))):
                if split == 0:
                    skip, encoding, charset = 0, None, None
                encoding, charset = label or encoding, name or charset
                if content is None:
                    over, body = 0, None
                else:
                    over = 0 if size == len(content) else carried(content, size, skip, charset, pairs)
                    body = content[skip : size + over]
                held.append((body, encoding))
                skip = over
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("split"), pa.array([x for x, _ in held], pa.binary()), pa.array([x for _, x in held], pa.string())], ["path", "split", "content", "encoding"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, n, rest, cr = None, 1, [], False
        broken = re.compile("\r\n|\r|\n")
        for b in batches:
            found, numbers, lines = [], [], []

            def put(line: str) -> None:
                nonlocal n
                found.append(path)
                numbers.append(n)
                lines.append(line)
                n += 1

            for p, split, text in zip(*(b.column(c).to_pylist() for c in ("path", "split", "text"))):
                if split == 0:
                    if last := "".join(rest):
                        put(last)
                    path, n, rest, cr = p, 1, [], False
                # CR LF over the end of a split is one break
                body = text[1:] if text and cr and text[0] == "\n" else text
                if text:
                    cr = text.endswith("\r")
                if body:
                    first, *more = broken.split(body)
                    rest.append(first)
                    for x in more:
                        put("".join(rest))
                        rest = [x]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(numbers, pa.int64()), pa.array(lines, pa.string())], ["path", "line_no", "line"])
        if last := "".join(rest):
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([n], pa.int64()), pa.array([last], pa.string())], ["path", "line_no", "line"])

    settled = rows.mapInArrow(settle, "path string, split int, content binary, encoding string")
    texts = settled.select("path", "split", _decoded(F.col("content")).alias("text"))
    return texts.mapInArrow(cut, "path string, line_no long, line string")


def lines_of_pieces(pieces: DataFrame, path: str = "path", split: str = "split", text: str = "text") -> DataFrame:
    """path, line_no (from 1) and line of texts in pieces: broken at CR LF, LF and CR, no line after a final break. A null text is an empty one.

    A piece says how many breaks it has and how it begins and ends; sums of those over the pieces before it number its lines. The lines
    inside a piece are its own. The first and the last of each are put together by file and number, as far as pieces share a line.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    parts = F.split(body, "\r\n|\r|\n", -1)
    own = pieces.select(F.col(path).alias("path"), F.col(split).alias("split"), parts.alias("parts"), F.startswith(body, F.lit("\n")).alias("lf"), F.when(body != "", F.endswith(body, F.lit("\r"))).alias("cr"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    facts = own.select("path", "split", (F.size("parts") - 1).cast("long").alias("breaks"), "lf", "cr")
    facts = facts.withColumn("joined", F.col("lf") & F.coalesce(F.last("cr", True).over(before), F.lit(False)))
    facts = facts.select("path", "split", "joined", F.coalesce(F.sum(F.col("breaks") - F.col("joined").cast("long")).over(before), F.lit(0)).alias("base"))
    # CR LF over the end of a piece is one break: the empty part before that LF is none
    parts = F.when(F.col("joined"), F.slice("parts", 2, F.size("parts"))).otherwise(F.col("parts"))
    met = own.select("path", "split", "parts").join(facts, ["path", "split"]).select("path", "split", "base", parts.alias("parts"))
    rows = met.select("path", "split", "base", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "text"))
    rows = rows.select("path", F.lit(0).alias("part"), F.col("split").alias("block"), (F.col("base") + F.col("k") + 1).alias("line_no"), "text", (F.col("k") < F.col("n") - 1).alias("closed"), ((F.col("k") == 0) | (F.col("k") == F.col("n") - 1)).alias("edge"))
    return assembled(rows, "path", drop_empty_rest=True)


def assembled(rows: DataFrame, key: str, drop_empty_rest: bool) -> DataFrame:
    """key, line_no and line of parts of lines (part, block, line_no, text, closed: it ends with the line, edge: the line may have more parts). Only
    edges are grouped. ``drop_empty_rest``: a line that nothing closes is none if it is empty."""
    inside = rows.where("NOT edge").select(key, "line_no", F.col("text").alias("line"))
    parts = F.array_sort(F.collect_list(F.struct("part", "block", "text")))
    shared = rows.where("edge").groupBy(key, "line_no").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("line"), F.max("closed").alias("closed"))
    if drop_empty_rest:
        shared = shared.where("closed OR line <> ''")
    return inside.union(shared.select(key, "line_no", "line"))


def file_lines(spark: SparkSession, paths: str | list[str], split_bytes: int, pattern: str | None = None, partition_bytes: int = reader.PARTITION_BYTES) -> DataFrame:
    """path, line_no and line of files of any length, of which no task holds more than a split and a line. Files of ``partition_bytes`` at most are read once, without a
    shuffle; the texts of longer ones are a table, from which lines are put together."""
    short = _whole_lines(spark, paths, split_bytes, pattern, partition_bytes)
    name = files.name_like(pattern) if pattern else None
    if reader.read_files(spark, paths, name, split_bytes=split_bytes, partition_bytes=partition_bytes, whole=False).select("path").head() is None:
        return short
    long = session.staged(text_pieces(spark, paths, split_bytes, pattern, partition_bytes, whole=False).select("path", "split", "text"), "pieces")
    return short.union(lines_of_pieces(long))
