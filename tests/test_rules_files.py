"""Rules and their stores, encodings, files, concatenation and the pipeline."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import joiner, lines, rules
from quillmill.operators.rules import Rule, RuleSet, SchemeCatalog
from quillmill.plans import pipeline
from quillmill.sources import files, sinks

CASES = [
    ("", [Rule("k", "m")], ""),
    ("plain", [], "plain"),
    ("plain", [Rule("q", "z")], "plain"),
    ("plain", [Rule("", "q"), Rule("plain", "fancy")], "fancy"),
    ("word", [Rule(None, "q")], "word"),
    ("klm", [Rule("l", None)], "km"),
    ("kl", [Rule("l", "m"), Rule("k", "l")], "lm"),
    ("k", [Rule("k", "m"), Rule("m", "n")], "n"),
    ("等等，，，好", [Rule("，，", "，")], "等等，，好"),
    ("山；水：", [Rule("；", ";"), Rule("：", ":")], "山;水:"),
]


def one(spark, text, change):
    return spark.createDataFrame([(text,)], "t string").select(change(F.col("t"))).head()[0]


@pytest.mark.parametrize("text, found, want", CASES)
def test_rules(spark, text, found, want):
    assert one(spark, text, lambda c: rules.apply_rules(c, found)) == want
    table = F.array(*[F.struct(F.lit(r.find).cast("string").alias("find"), F.lit(r.replace).cast("string").alias("replace")) for r in found]) if found else F.array().cast("array<struct<find:string,replace:string>>")
    assert one(spark, text, lambda c: rules.apply_rule_table(c, table)) == want


def test_fused_rules_equal_the_chain(spark):
    pick = random.Random(5)
    alphabet = ".,!?;:“”『（□♪-…—、。，？「」 Ａｚ０9哈嗯唷chapter※"
    texts = ["".join(pick.choice(alphabet) for _ in range(40)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    schemes = rules.builtin_schemes()
    for found in [list(s.rules) for s in schemes] + [[r for s in schemes for r in s.rules], [r for s in reversed(schemes) for r in s.rules]]:
        got = [r[0] for r in df.select(rules.apply_rules(F.col("t"), found)).collect()]
        want = []
        for t in texts:
            for r in found:
                t = t.replace(r.find, r.replace)
            want.append(t)
        assert got == want


def test_scheme_order_matters(spark):
    s = rules.builtin_schemes()
    assert one(spark, "a...b", lambda c: rules.apply_rules(c, s[0].rules + s[3].rules)) == "a。。。b"
    assert one(spark, "a...b", lambda c: rules.apply_rules(c, s[3].rules + s[0].rules)) == "a，b"
    assert [len(x.rules) for x in s] == [6, 18, 23, 13, 15, 62, 10, 24, 5]


def test_rule_set(tmp_path):
    r = RuleSet().put(Rule("a", "b")).put(Rule("c", "d")).put(Rule("e", "f"), 0)
    assert [x.find for x in r.rules] == ["e", "c"]
    assert [x.find for x in r.move(1, -1).rules] == ["c", "e"] and r.move(0, -1) == r and r.move(1, 1) == r
    assert r.delete(0).rules == (Rule("c", "d"),) and r.rules[0].display() == "e  →  f"
    with pytest.raises(ValueError):
        r.put(Rule("", "x"))
    path = str(tmp_path / "rules.json")
    r.save(path)
    assert RuleSet.load(path) == r and json.load(open(path))[0] == {"Find": "e", "Replace": "f"}
    open(path, "w").write("{broken")
    assert RuleSet.load(path) == RuleSet() == RuleSet.load(str(tmp_path / "none.json"))


def test_catalog(spark, tmp_path):
    c = SchemeCatalog.default().create("  mine ", " x ", [Rule("a", "b"), Rule("a", "b")])
    assert c.schemes[-1].name == "mine" and c.schemes[-1].display() == "* mine  —  x" and not c.schemes[0].display().startswith("*")
    names = ["mine", c.schemes[0].name]
    assert c.selected(names)[-2:] == [Rule("a", "b")] * 2 and c.summary(names) == (2, 8) and c.summary([]) == (0, 0)
    table = c.to_df(spark)
    assert [(r["find"], r["replace"]) for r in rules.selected_rules(table, names).orderBy("scheme_ord", "pos").collect()] == [(r.find, r.replace) for r in c.selected(names)]
    assert tuple(rules.scheme_summary(table, names).head()) == (2, 8) and tuple(rules.scheme_summary(table, ["none"]).head()) == (0, 0)
    path = str(tmp_path / "s.json")
    c.edit(9, name="new").delete(0).save(path)
    assert [s.name for s in SchemeCatalog.load(path).schemes][-1] == "new"
    open(path, "w").write("[]")
    assert SchemeCatalog.load(path) == SchemeCatalog.default()
    with pytest.raises(ValueError):
        c.create("  ")
    stored = rules.export_config(str(tmp_path / "out"), {"s.json": path, "no.json": str(tmp_path / "no")})
    assert stored == ["s.json"] and rules.import_config([str(tmp_path / "out" / "s.json"), "/x/other"], {"s.json": str(tmp_path / "back")}) == ["s.json"]


ENCODINGS = [
    (b"\xef\xbb\xbfhello", "UTF-8 (BOM)", "hello"),
    (b"\xff\xfeh\x00e\x00", "UTF-16 LE", "he"),
    (b"\xfe\xff\x00h\x00e", "UTF-16 BE", "he"),
    ("Hello世界".encode(), "UTF-8", "Hello世界"),
    (b"Hello", "UTF-8", "Hello"),
    (b"\xc4\xe3\xba\xc3", "GBK (ANSI)", "你好"),
    (b"", "UTF-8", ""),
    (b"a" * 10_000, "UTF-8", "a" * 10_000),
    (b"a" * 4094 + b"\xe4\xb8", "UTF-8", "a" * 4094 + "�"),
    (b"\x80\x81\xbf", "UTF-8", None),
    ("�".encode(), "GBK (ANSI)", None),
    (b"a" * 4095 + "你".encode(), "UTF-8", "a" * 4095 + "你"),
]


def test_encodings(spark):
    files.legacy_charsets(spark)
    df = spark.createDataFrame([(k, bytearray(b)) for k, (b, _, _) in enumerate(ENCODINGS)] + [(99, None)], "k int, content binary")
    found = df.withColumn("e", files.detect_encoding(F.col("content"))).withColumn("t", files.decode(F.col("content"), F.col("e"))).orderBy("k").collect()
    assert [r["e"] for r in found] == [e for _, e, _ in ENCODINGS] + [None]
    assert all(want is None or r["t"] == want for r, (_, _, want) in zip(found, ENCODINGS))


JOIN = [
    ({"note.bin": b"raw"}, 0, ""),
    ({"note.txt": b"alone"}, 1, "alone\n"),
    ({"two.txt": b"rest", "one.txt": b"start"}, 2, "start\nrest\n"),
    ({"k.txt": b"done\n", "m.txt": b"more"}, 2, "done\nmore\n"),
    ({"k.txt": b"", "m.txt": b"q"}, 2, "\nq\n"),
    ({"note.bin": b"raw", "n[2].TXT": b"q"}, 1, "q\n"),
    ({"D.txt": b"2", "c.txt": b"1", "y_.txt": b"4", "yy.txt": b"3"}, 4, "1\n2\n3\n4\n"),
    ({"gbk.txt": b"\xb2\xdd\xc4\xbe", "utf8.txt": b"\xef\xbb\xbf\xe5\xb1\xb1\xe6\xb0\xb4"}, 2, "草木\n山水\n"),
]


@pytest.mark.parametrize("given, count, want", JOIN)
def test_join(spark, tmp_path, given, count, want):
    for name, data in {**given, "out.txt": b"old"}.items():
        (tmp_path / name).write_bytes(data)
    row = joiner.join_files(spark, str(tmp_path), "*.txt", "out.txt", newline="\n").head()
    assert (row["file_count"], row["text"]) == (count, want) and row["output_path"].endswith("/out.txt")
    with pytest.raises(ValueError):
        joiner.join_files(spark, str(tmp_path), " ", "x")
    assert {r["path"].rsplit("/", 1)[-1] for r in files.list_files(spark, str(tmp_path), "*.TXT").collect()} == {n for n in given if n.lower().endswith(".txt")} | {"out.txt"}


def test_listing_is_not_the_drivers(spark, tmp_path):
    folder = tmp_path / "x[1]"
    (folder / "in.txt").mkdir(parents=True)
    for name in ("a.txt", "B.TXT", "_c.txt", "d.bin", "e.txt"):
        (folder / name).write_bytes(b"x" * (name != "e.txt"))
    found = files.list_files(spark, str(folder), "*.txt")
    assert sorted((r["path"], r["length"]) for r in found.collect()) == [(f"file:{folder}/{n}", k) for n, k in (("B.TXT", 1), ("_c.txt", 1), ("a.txt", 1), ("e.txt", 0))]
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, str(tmp_path / "gone"))


@pytest.mark.parametrize("write", [pipeline.process_files, lambda *a: pipeline.replace_files(*a, (rules.Rule("a", "b"),))])
def test_files_are_read_once_to_be_written(spark, tmp_path, write):
    (tmp_path / "a.txt").write_bytes(b"a")
    report = sinks.write_texts(write(spark, [str(tmp_path / "a.txt"), str(tmp_path / "gone.txt")]))
    assert report._jdf.queryExecution().executedPlan().toString().count("BatchScan") == 1
    assert sorted((r["path"].rsplit("/", 1)[-1], r["bytes"], r["error"] is None) for r in report.collect()) == [("a_Processed.txt", 4 if write is not pipeline.process_files else 6, True), ("gone_Processed.txt", 0, False)]


def test_join_pieces_of_repeated_and_null_names(spark):
    rows = [("g", "b", "2", "k"), ("g", "b", "2", "k"), ("g", None, "0", "k"), ("g", None, None, "k"), (None, "x", "3", "k"), ("g", "A", "1", "k")] + [("big", f"f{k:04}", str(k), "k") for k in range(300)]
    df = spark.createDataFrame(rows, "g string, n string, text string, k string")
    found = joiner.join_pieces(df, "g", "n", newline="\n").orderBy("g", "seq").collect()
    assert [(r["seq"], r["n"], r["piece"]) for r in found if r["g"] == "big"] == [(k + 1, f"f{k:04}", f"{k}\n") for k in range(300)]
    assert [(r["seq"], r["n"], r["piece"]) for r in found if r["g"] is None] == [(1, "x", "3\n")]
    small = [(r["seq"], r["n"], r["piece"]) for r in found if r["g"] == "g"]
    assert sorted(x[2] for x in small[:2]) == ["\n", "0\n"] and [x[1] for x in small[:2]] == [None, None]
    assert small[2:] == [(3, "A", "1\n"), (4, "b", "2\n"), (5, "b", "2\n")] and len(found) == len(rows)
    assert joiner.join_pieces(df.limit(0), "g", "n").count() == 0


def test_join_pieces_and_batch(spark):
    df = spark.createDataFrame([("g", "b", "2"), ("g", "A", "1\n"), ("h", "x", None)], "g string, n string, text string")
    assert [tuple(r) for r in joiner.join_pieces(df, "g", "n", newline="\n").orderBy("g", "seq").collect()] == [("g", 1, "A", "1\n"), ("g", 2, "b", "2\n"), ("h", 1, "x", "\n")]
    assert tuple(joiner.batch_summary(spark.createDataFrame([(None,), ("bad",)], "error string")).head()) == (2, 1, "Partial")
    assert tuple(joiner.batch_summary(spark.createDataFrame([(None,)], "error string")).head()) == (1, 1, "Complete")


@pytest.mark.parametrize("path, want", [("/d/a.txt", "/d/a_Processed.txt"), ("/d/a.tar.gz", "/d/a.tar_Processed.gz"), ("/d.x/noext", "/d.x/noext_Processed"), ("/d/.rc", "/d/_Processed.rc")])
def test_output_path(spark, path, want):
    assert one(spark, path, sinks.output_path) == want


def test_pipeline_on_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("短行1\n短行2\n你好\n吗？\n结束", encoding="utf-8")
    post = pipeline.PostProcess(fix_cjk=True, fix_punctuation=True, trim_leading_comma=False, apply_rules=True, rules=(Rule("吗", "嘛"),))
    done = pipeline.process_files(spark, str(tmp_path / "a.txt"), pipeline.MergeOptions(10, lines.Width.CHARS), post)
    row = done.head()
    assert row["lines"] == ["短行1短行2你好嘛？", "结束"] and row["replaced"] and not row["cjk_fixed"] and row["output_path"].endswith("a_Processed.txt")
    report = sinks.write_texts(done).head()
    assert report["error"] is None and (tmp_path / "a_Processed.txt").read_bytes() == b"\xef\xbb\xbf" + "短行1短行2你好嘛？\r\n结束\r\n".encode()
    assert files.existing([str(tmp_path / "a.txt"), "/none"]) == [str(tmp_path / "a.txt")]
    bad = spark.createDataFrame([("/proc/none/x", "t")], "output_path string, text string")
    assert sinks.write_texts(bad).head()["error"]
    kept = pipeline.replace_files(spark, str(tmp_path / "a.txt"), (Rule("\n你", "你"),)).head()
    assert kept["text"] == "短行1\n短行2你好\n吗？\n结束"


@pytest.mark.parametrize(
    "given, merge, post, want, flags",
    [
        (["a", "b", "c"], (3, "chars"), pipeline.PostProcess(fix_cjk=False, trim_leading_comma=False), ["abc"], (False, False, False, False)),
        (["hello", "，world"], (1, "chars"), pipeline.PostProcess(fix_cjk=False), ["hello", "world"], (False, False, True, False)),
        (["test"], (100, "chars"), pipeline.PostProcess(fix_cjk=False, trim_leading_comma=False), ["test"], (False, False, False, False)),
        (["你好", "吗", "x，", "y"], (1, "chars"), pipeline.PostProcess(fix_punctuation=True, apply_rules=True, rules=(Rule("q", "r"),)), ["你好吗x，y"], (True, True, False, True)),
    ],
)
def test_pipeline(spark, given, merge, post, want, flags):
    df = spark.createDataFrame([(given,)], "lines array<string>")
    row = pipeline.process(df, pipeline.MergeOptions(merge[0], lines.Width(merge[1])), post).head()
    assert row["lines"] == want and (row["cjk_fixed"], row["punct_fixed"], row["trimmed"], row["replaced"]) == flags


def test_stream(spark, tmp_path):
    from quillmill.streaming import clean_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("你\n好\n，x".encode("gbk"))
    (tmp_path / "in" / "long.txt").write_bytes(b"x" * 99)
    stream = clean_stream(spark, str(tmp_path / "in"), pipeline.MergeOptions(1), longest=50).writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    stream.awaitTermination()
    found = {r["path"].rsplit("/", 1)[-1]: (r["lines"], r["error"]) for r in spark.table("cleaned").collect()}
    assert found == {"a.txt": (["你好，x"], None), "long.txt": (None, "ValueError: 99 bytes, more than 50")}
