"""Character classes, suffix predicates and text widths as column expressions.

Membership is by code point. A line's last character is its last one that is not white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space (fixed values): what Unicode calls so, which no engine's ``\\s`` covers.
WHITESPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: CJK ideographs (fixed values): the unified block, extension A and the compatibility block.
CJK_RANGES = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0xF900, 0xFAFF)]

#: Labels of encodings and the charsets that decode them (fixed values). Code page 936 is what GBK text on the desktop is in.
CHARSETS = {"UTF-8 (BOM)": "UTF-8", "UTF-16 LE": "UTF-16LE", "UTF-16 BE": "UTF-16BE", "UTF-8": "UTF-8", "GBK (ANSI)": "x-mswin-936"}


def _code(c: int) -> str:
    return f"\\x{{{c:X}}}"


def class_of(chars: str) -> str:
    """The inside of a Java character class that holds exactly ``chars``."""
    return "".join(_code(ord(c)) for c in dict.fromkeys(chars))


BLANK = class_of(WHITESPACE)
CJK = "".join(f"{_code(a)}-{_code(b)}" for a, b in CJK_RANGES)


def ends_with_any(text: Column, chars: str | None) -> Column:
    """Whether the last character of ``text`` that is no white space is one of ``chars``. Blank text, and no characters: false."""
    if not chars:
        return F.when(text.isNotNull(), F.lit(False))
    return text.rlike(f"[{class_of(chars)}][{BLANK}]*\\z")


def is_cjk(char: Column) -> Column:
    """Whether ``char`` is one CJK ideograph."""
    return char.rlike(f"\\A[{CJK}]\\z")


def width_chars(text: Column) -> Column:
    """UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def width_bytes(text: Column, charset: str = "UTF-8") -> Column:
    """Bytes in a charset of CHARSETS. Only GBK needs the session's Java charsets (``sources.files.legacy_charsets``)."""
    if charset == "UTF-8":
        return F.octet_length(text).cast("int")
    if charset in ("UTF-16LE", "UTF-16BE"):
        return F.octet_length(F.encode(text, "UTF-16BE")).cast("int")
    return F.octet_length(F.encode(text, charset)).cast("int")
