"""Operators on the ordered lines of a document.

Lines are an ``array<string>`` column, so every operator is narrow: no shuffle, whatever the number of documents. The two
regrouping rules look back over the text that has accumulated; both have a closed form on the joined lines, where a line
break goes exactly if it stands in the run of white space after a character that asks for more. That form is a single
linear pass inside the JVM. Only the threshold merge, a cumulative sum that restarts, runs in an Arrow UDF.
"""

from __future__ import annotations

from enum import Enum

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import charsets

FULL_COMMA = "，"


class Width(str, Enum):
    """How the threshold merge measures a line."""

    CHARS = "chars"
    BYTES = "bytes"


def to_lines(text: Column) -> Column:
    """The lines of a text: broken at CR LF, LF and CR; no line after a final break, none in an empty text."""
    parts = F.split(text, "\r\n|\r|\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def explode_lines(df: DataFrame, lines: str = "lines", number: str = "line_no", line: str = "line") -> DataFrame:
    """One row for each line, numbered from 1, with the other columns."""
    kept = [c for c in df.columns if c != lines]
    # the inner form would put a filter on the array's size below everything that makes the array, and so run it twice
    rows = df.select(*kept, F.posexplode_outer(lines).alias(number, line)).where(F.col(number).isNotNull())
    return rows.withColumn(number, F.col(number) + 1)


def _regroup(lines: Column, asks: str) -> Column:
    """Join lines where the last character that is no white space, of what has accumulated, is in the class ``asks``."""
    text = F.regexp_replace(F.array_join(lines, "\n"), f"(?:([{asks}])|\\G(?!\\A))([{charsets.BLANK}&&[^\\n]]*)\\n", "$1$2")
    return F.when(F.size(lines) > 0, F.split(text, "\n", -1)).otherwise(lines)


def fix_cjk(lines: Column, no_merge: str | None = None) -> Column:
    """Re-join paragraphs that were cut after a CJK ideograph, unless it is in ``no_merge``. Blank lines inside a cut go with it."""
    asks = f"{charsets.CJK}&&[^{charsets.class_of(no_merge)}]" if no_merge else charsets.CJK
    return _regroup(lines, asks)


def fix_punctuation(lines: Column, merge: str, no_merge: str | None = None) -> Column:
    """Re-join paragraphs that were cut after one of the characters ``merge``; ``no_merge`` wins over ``merge``."""
    asks = "".join(c for c in merge if c not in (no_merge or ""))
    return _regroup(lines, charsets.class_of(asks)) if asks else lines


def trim_leading_comma(lines: Column) -> Column:
    """Take one full-width comma off the start of every line that begins with it."""
    return F.transform(lines, lambda x: F.when(F.startswith(x, F.lit(FULL_COMMA)), F.substring(x, 2, 2147483647)).otherwise(x))


def has_leading_comma(lines: Column) -> Column:
    return F.exists(lines, lambda x: F.startswith(x, F.lit(FULL_COMMA)))


#: Characters of two bytes in code page 936 that Python's codec does not have (fixed values): the area for users' own.
_OWN_FIRST, _OWN_LAST = "\ue000", "\ue864"


def _bytes_936(s: str) -> int:
    """Bytes in code page 936, one for a character that it lacks."""
    return len(s.encode("gbk", "replace")) + sum(_OWN_FIRST <= c <= _OWN_LAST for c in s)


def _measure(mode: Width, charset: str | None):
    """The width of a line."""
    if mode is Width.CHARS or charset in ("UTF-16LE", "UTF-16BE"):
        factor = 1 if mode is Width.CHARS else 2
        return lambda s: factor * (len(s) + sum(c > "￿" for c in s)) if not s.isascii() else factor * len(s)
    if charset == "x-mswin-936":
        return lambda s: len(s) if s.isascii() else _bytes_936(s)
    return lambda s: len(s) if s.isascii() else len(s.encode("utf-8", "replace"))


def merge_list(lines: list[str], threshold: int, mode: Width, charset: str | None, no_merge: str | None) -> list[str]:
    """Join lines until their width reaches ``threshold`` or a line ends with a character of ``no_merge``; what is left at the end is a
    line unless it is empty."""
    measure = _measure(mode, charset)
    ends = tuple(no_merge or "")
    out: list[str] = []
    held: list[str] = []
    width = 0
    for line in lines:
        held.append(line)
        width += measure(line)
        if width >= threshold or ends and line.rstrip(charsets.WHITESPACE).endswith(ends):
            out.append("".join(held))
            held, width = [], 0
    rest = "".join(held)
    return out + [rest] if rest else out


def merge_lines(lines: Column, threshold: int = 20, mode: Width = Width.BYTES, no_merge: str | None = None, charset: Column | None = None) -> Column:
    """The threshold merge of every document's lines. ``charset``: of the source, for byte widths (UTF-8 where null); a column, since
    it differs between documents. Null lines give null. Linear in the document; one Arrow batch at a time."""
    if threshold < 1:
        raise ValueError("threshold must be at least 1")
    mode = Width(mode)

    @F.arrow_udf("array<string>")
    def run(lines: pa.Array, charsets_: pa.Array) -> pa.Array:
        names = charsets_.to_pylist()
        return pa.array([None if x is None else merge_list(x, threshold, mode, c, no_merge) for x, c in zip(lines.to_pylist(), names)], pa.list_(pa.string()))

    return run(lines, charset if charset is not None else F.lit("UTF-8"))


def merge_lines_folded(lines: Column, threshold: int, width, no_merge: str | None = None) -> Column:
    """The same as a fold inside the JVM, for short documents (the cost grows with the square of the number of lines). ``width``: the
    width of a line as a column."""
    empty = F.struct(F.array().cast("array<string>").alias("o"), F.lit("").alias("b"), F.lit(0).cast("long").alias("w"))

    def step(s: Column, x: Column) -> Column:
        b, w = F.concat(s["b"], x), s["w"] + width(x)
        flush = (w >= threshold) | charsets.ends_with_any(x, no_merge)
        return F.struct(
            F.when(flush, F.array_append(s["o"], b)).otherwise(s["o"]).alias("o"), F.when(flush, F.lit("")).otherwise(b).alias("b"), F.when(flush, F.lit(0)).otherwise(w).cast("long").alias("w")
        )

    return F.aggregate(lines, empty, step, lambda s: F.when(s["b"] != "", F.array_append(s["o"], s["b"])).otherwise(s["o"]))
