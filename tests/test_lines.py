"""Golden cases of the line operators, and properties against small models."""

import random

import pytest
from pyspark.sql import functions as F

from quillmill.functions import charsets
from quillmill.operators import lines
from quillmill.sources import files

W = lines.Width

MERGE = [
    ([], 5, W.CHARS, None, []),
    (None, 5, W.CHARS, None, None),
    (["", "", ""], 2, W.CHARS, None, []),
    (["only one line"], 50, W.BYTES, None, ["only one line"]),
    (["red", "green", "blue"], 8, W.CHARS, None, ["redgreen", "blue"]),
    (["12", "345", "6", "78"], 4, W.BYTES, None, ["12345", "678"]),
    (["one", "", "two"], 6, W.CHARS, None, ["onetwo"]),
    (["山川", "草", "木"], 5, W.BYTES, None, ["山川", "草木"]),
    (["山", "川", "草木"], 2, W.CHARS, None, ["山川", "草木"]),
    (["𝄞", "z"], 2, W.CHARS, None, ["𝄞", "z"]),
    (["Stop;", "go"], 90, W.CHARS, None, ["Stop;go"]),
    (["Stop;", "go", "on;", "end"], 90, W.CHARS, ";：", ["Stop;", "goon;", "end"]),
    (["；", " ", "y"], 90, W.CHARS, "；", ["；", " y"]),
]
CJK = [
    ([], None, []),
    (["", "", ""], None, ["", "", ""]),
    (["春", "夏", "秋冬", "到了。"], None, ["春夏秋冬到了。"]),
    (["水长！", "第二段"], None, ["水长！", "第二段"]),
    (["山高", "水长"], "高", ["山高", "水长"]),
    (["水长。"], "。", ["水长。"]),
    (["山高   ", "水长"], None, ["山高   水长"]),
    (["山高", " ", "水长"], None, ["山高 水长"]),
    (["  ", "山", "川"], None, ["  ", "山川"]),
    (["山　", "川"], None, ["山　川"]),
    (["山", ""], None, ["山"]),
    (["𠀁", "word"], None, ["𠀁", "word"]),
]
PUNCT = [
    (["其一；", "其二：", "其三、", "完"], "：；、", None, ["其一；其二：其三、完"]),
    (["先吃饭、", "再走"], "", None, ["先吃饭、", "再走"]),
    (["先吃饭", "再走"], "、", None, ["先吃饭", "再走"]),
    (["先吃饭！", "再走"], "、", "！", ["先吃饭！", "再走"]),
    (["先吃饭、", "再走！", "快、", "走"], "、！", "！", ["先吃饭、再走！", "快、走"]),
    (["山高、 ", "水长"], "、", None, ["山高、 水长"]),
    (["山高、水长"], "、", None, ["山高、水长"]),
    (["m、", "", "n"], "、", None, ["m、n"]),
    (["p^", "q]", "r\\", "s"], "]^-\\", None, ["p^q]r\\s"]),
]


def run(spark, rows, change):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, lines array<string>")
    return [r["x"] for r in df.select("k", change(F.col("lines")).alias("x")).orderBy("k").collect()]


@pytest.mark.parametrize("given, threshold, mode, no_merge, want", MERGE)
def test_merge(given, threshold, mode, no_merge, want):
    assert want is None or lines.merge_list(given, threshold, mode, "UTF-8", no_merge) == want


def test_merge_columns(spark):
    for threshold, mode, no_merge in {c[1:4] for c in MERGE}:
        cases = [c for c in MERGE if c[1:4] == (threshold, mode, no_merge)]
        assert run(spark, [c[0] for c in cases], lambda x: lines.merge_lines(x, threshold, mode, no_merge)) == [c[4] for c in cases]
        width = charsets.width_chars if mode is W.CHARS else charsets.width_bytes
        assert run(spark, [c[0] for c in cases], lambda x: lines.merge_lines_folded(x, threshold, width, no_merge)) == [c[4] for c in cases]


def test_merge_width_follows_the_source(spark):
    df = spark.createDataFrame([("UTF-8",), ("UTF-16LE",), ("x-mswin-936",)], "charset string").withColumn("lines", F.array(F.lit("你"), F.lit("a"), F.lit("b")))
    got = {r["charset"]: r["x"] for r in df.select("charset", lines.merge_lines(F.col("lines"), 3, W.BYTES, charset=F.col("charset")).alias("x")).collect()}
    assert got == {"UTF-8": ["你", "ab"], "UTF-16LE": ["你a", "b"], "x-mswin-936": ["你a", "b"]}


def test_threshold_must_be_positive():
    with pytest.raises(ValueError):
        lines.merge_lines(None, 0)


def test_cjk(spark):
    for no_merge in {c[1] for c in CJK}:
        cases = [c for c in CJK if c[1] == no_merge]
        assert run(spark, [c[0] for c in cases], lambda x: lines.fix_cjk(x, no_merge)) == [c[2] for c in cases]


def test_punctuation(spark):
    for merge, no_merge in {c[1:3] for c in PUNCT}:
        cases = [c for c in PUNCT if c[1:3] == (merge, no_merge)]
        assert run(spark, [c[0] for c in cases], lambda x: lines.fix_punctuation(x, merge, no_merge)) == [c[3] for c in cases]


def model(given, asks):
    out, held, some = [], "", False
    for line in given:
        held, some = held + line, True
        solid = held.rstrip(charsets.WHITESPACE)
        if not solid or not asks(solid[-1]):
            out.append(held)
            held, some = "", False
    return out + [held] if some and held else out


def test_regrouping_matches_a_model(spark):
    pick = random.Random(3)
    rows = [["".join(pick.choice("你好a，。 　 𠀀") for _ in range(pick.randint(0, 3))) for _ in range(pick.randint(0, 9))] for _ in range(400)]
    cjk = lambda c: any(a <= ord(c) <= b for a, b in charsets.CJK_RANGES)
    assert run(spark, rows, lines.fix_cjk) == [model(r, cjk) for r in rows]
    assert run(spark, rows, lambda x: lines.fix_cjk(x, "好")) == [model(r, lambda c: cjk(c) and c != "好") for r in rows]
    assert run(spark, rows, lambda x: lines.fix_punctuation(x, "，。", "。")) == [model(r, lambda c: c == "，") for r in rows]


def test_long_document(spark):
    rows = [["你"] * 200_000]
    assert run(spark, rows, lines.fix_cjk) == [["你" * 200_000]]


def test_trim_and_lines(spark):
    given = ["，，x", " ，x", ",x", "，", ""]
    assert run(spark, [given], lines.trim_leading_comma) == [["，x", " ，x", ",x", "", ""]]
    df = spark.createDataFrame([("a\r\nb\rc\n",), ("",), ("\n",), ("a\u0085b",), (None,)], "t string")
    assert [r[0] for r in df.select(lines.to_lines(F.col("t"))).collect()] == [["a", "b", "c"], [], [""], ["a\u0085b"], None]


@pytest.mark.parametrize("text, chars, want", [("hello.", ".!", True), ("hello", ".!", False), ("hello.", None, False), ("hello.", "", False), ("hello.   ", ".", True), ("   ", ".", False), ("", ".", False), ("hello。", "。！", True), ("a.　 \n", ".", True), ("a]", "]", True)])
def test_ends_with_any(spark, text, chars, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(charsets.ends_with_any(F.col("t"), chars)).head()[0] is want


def test_byte_widths_are_those_of_the_decoder(spark):
    files.legacy_charsets(spark)
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE")
    df = spark.range(0, 65536).where("id < 55296 OR id > 57343").select(char.alias("c"), F.octet_length(F.encode(char, "x-mswin-936")).alias("n"))
    measure = lines._measure(lines.Width.BYTES, "x-mswin-936")
    assert all(measure(r["c"]) == r["n"] for r in df.collect()) and measure("🙂") == 1
    assert lines._measure(lines.Width.BYTES, "UTF-16BE")("a🙂") == 6
