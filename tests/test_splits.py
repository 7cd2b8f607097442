"""Files with faults, files in splits, and documents whose lines are dealt over many partitions."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import joiner, lines
from quillmill.plans import pipeline
from quillmill.sources import files, reader, sinks, splits, stores

GBK = "x-mswin-936"


def test_faults_stay_with_their_files(spark, tmp_path):
    for k in range(20):
        (tmp_path / f"f{k:02}.txt").write_text(f"line {k}\nmore", encoding="utf-8")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "long.txt").write_bytes(b"x" * 500)
    os.symlink(tmp_path / "loop.txt", tmp_path / "loop.txt")
    (tmp_path / "other.bin").write_bytes(b"x")
    gone = str(tmp_path / "gone.txt")
    found = files.scan_files(spark, [str(tmp_path), gone], "*.TXT", longest=400).collect()
    bad = {r["path"].rsplit("/", 1)[-1]: r["error"] for r in found if r["error"]}
    assert set(bad) == {"gone.txt", "long.txt", "loop.txt"} and "500 bytes" in bad["long.txt"] and bad["gone.txt"].startswith("FileNotFoundError")
    good = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in found if not r["error"]}
    assert good == {**{f"f{k:02}.txt": f"line {k}\nmore" for k in range(20)}, "empty.txt": ""} and all(r["text"] is None and r["encoding"] is None for r in found if r["error"])
    # the batch goes on to the writer, and its status says so
    done = pipeline.process_files(spark, [*(str(tmp_path / f"f{k:02}.txt") for k in range(20)), gone], pipeline.MergeOptions(1))
    report = sinks.write_texts(done).collect()
    assert len(report) == 21 and sum(r["error"] is not None for r in report) == 1 and (tmp_path / "f07_Processed.txt").read_bytes() == b"\xef\xbb\xbfline 7\r\nmore\r\n"
    assert not os.path.exists(tmp_path / "gone_Processed.txt")
    assert tuple(joiner.batch_summary(spark.createDataFrame(report)).head()) == (21, 20, "Partial")
    # a folder of a bounded number of bytes a partition
    many = reader.read_files(spark, str(tmp_path), r".*\.txt$", partition_bytes=5 * reader.OPEN_COST)
    assert many.rdd.getNumPartitions() >= 5


def test_vanished_after_listing(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"a")
    (tmp_path / "b.txt").write_bytes(b"b")
    work = reader.FilesReader({"paths": "1", "path0": str(tmp_path)}).partitions()
    os.remove(tmp_path / "a.txt")
    (tmp_path / "b.txt").write_bytes(b"")
    rows = [r for w in work for b in reader.FilesReader({"paths": "0"}).read(w) for r in b.to_pylist()]
    assert [r["error"].split(":")[0] for r in rows] == ["FileNotFoundError", "OSError"] and "ends after 0 of 1" in rows[1]["error"]


def test_stores(tmp_path):
    assert stores.local_path("file:/a/b") == stores.local_path("file:///a/b") == "/a/b" and stores.local_path("/a://b") == "/a://b" and stores.local_path("s3a://x/y") is None
    with pytest.raises(ValueError):
        stores.check("dbfs://x/y")
    path = str(tmp_path / "x")
    stores.replace_file(path, b"1", "a")
    stores.replace_file("file:" + path, b"2", "b")
    assert open(path, "rb").read() == b"2" and os.listdir(tmp_path) == ["x"]
    assert files.existing([path, str(tmp_path), path, path + "no"]) == [path, path]


def raw_files():
    """Bytes of texts in all encodings, with odd ends and malformed bytes."""
    rnd = random.Random(7)
    pool = ["a", "Z", "|", "中", "文", "é", "🙂", "\n", "\r\n", "\r", " ", "\n\n", "丂", "～", "漢"]
    out = {}
    for k in range(6):
        text = "".join(rnd.choice(pool) for _ in range(rnd.choice([5, 60, 200])))
        bmp = text.replace("🙂", "丁").replace("é", "e")
        out |= {f"mark{k}": b"\xef\xbb\xbf" + text.encode(), f"le{k}": b"\xff\xfe" + text.encode("utf-16-le"), f"be{k}": b"\xfe\xff" + text.encode("utf-16-be")}
        out |= {f"utf8-{k}": text.encode(), f"gbk{k}": "中文".encode("gbk") + bmp.encode("gbk")}
        out |= {f"odd-le{k}": b"\xff\xfe" + bytes(rnd.choice([0xD8, 0xDC, 0x00, 0x0A, 0x41]) for _ in range(81))}
        out |= {f"bad-mark{k}": b"\xef\xbb\xbf" + bytes(rnd.choice([0xE4, 0xB8, 0xAD, 0xF0, 0x9F, 0x90, 0x80, 0xED, 0xA0, 0xC3, 0xC0, 0xF4, 0xE0, 0x41, 0x0A]) for _ in range(150))}
        out |= {f"bad-gbk{k}": b"\xd6\xd0\xff" + bytes(rnd.choice([0x81, 0xFE, 0xFF, 0x80, 0x7F, 0x40, 0x39, 0x0A, 0x0D, 0xD6, 0xD0, 0xA2, 0xA1, 0x7C]) for _ in range(150))}
    return {**out, "empty": b"", "bom": b"\xef\xbb\xbf", "break": b"\n", "crlf": b"123456\r\n\r\n", "twice": b"\xef\xbb\xbf1234\xef\xbb\xbfx", "cut": "中文".encode("gbk") + b"\x81"}


@pytest.mark.parametrize("size", [7, 1, 2, 64])
def test_splits_give_the_whole_file(spark, tmp_path, size):
    given = raw_files() if size == 7 else dict(list(raw_files().items())[::3])
    for name, data in given.items():
        (tmp_path / name).write_bytes(data)
    whole = files.scan_files(spark, str(tmp_path)).select("path", "text", F.posexplode(lines.to_lines(F.col("text"))).alias("k", "line"))
    want = sorted((r["path"].rsplit("/", 1)[-1], r["k"] + 1, r["line"]) for r in whole.collect())
    got = sorted((r["path"].rsplit("/", 1)[-1], r["line_no"], r["line"]) for r in splits.file_lines(spark, str(tmp_path), size, partition_bytes=4096).collect())
    assert got == want and len(got) > 40
    texts = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in files.scan_files(spark, str(tmp_path)).collect()}
    pieces = splits.text_pieces(spark, str(tmp_path), size).orderBy("path", "split").collect()
    joined = {n: "".join(p["text"] for p in pieces if p["path"].rsplit("/", 1)[-1] == n) for n in given}
    assert joined == texts


@pytest.mark.parametrize("size", [7, 64])
def test_lines_of_files_longer_than_a_partition(spark, tmp_path, size):
    given = dict(list(raw_files().items())[::2])
    for name, data in given.items():
        (tmp_path / name).write_bytes(data)
    whole = files.scan_files(spark, str(tmp_path)).select("path", F.posexplode(lines.to_lines(F.col("text"))).alias("k", "line"))
    got = splits.file_lines(spark, str(tmp_path), size, partition_bytes=100)
    assert sorted(map(tuple, got.collect())) == sorted((r["path"], r["k"] + 1, r["line"]) for r in whole.collect())
    assert 0 < sum(len(d) > 100 for d in given.values()) < len(given)


def test_lines_of_short_files_need_no_shuffle(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"f{k}").write_bytes(b"a\r\nb" * 50)
    plan = splits.file_lines(spark, str(tmp_path), 16)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("BatchScan") == 1


def test_folder_streams_by(tmp_path, monkeypatch):
    """The driver neither holds all names of a folder nor looks at files whose names don't match."""
    for k in range(30):
        (tmp_path / f"{k:02}.txt").write_bytes(b"x")
        (tmp_path / f"{k:02}_Processed.txt").write_bytes(b"xy")
    seen, looked, real, length = [], [], os.scandir, stores._length

    class Watched:
        def __init__(self, path):
            self.entries = real(path)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.entries.close()

        def __iter__(self):
            for e in self.entries:
                seen.append(e.name)
                yield e

    monkeypatch.setattr(os, "scandir", Watched)
    monkeypatch.setattr(stores, "SORTED", 4)
    monkeypatch.setattr(stores, "_length", lambda p: looked.append(p) or length(p))
    found = reader.FilesReader({"paths": "1", "path0": str(tmp_path), "name": files.name_like("*_processed.txt")})._items()
    next(found)
    assert len(looked) == 1 and len(seen) < 60
    assert len(list(found)) == 29 and len(looked) == 30


def test_listing_of_many_files_is_small(monkeypatch):
    n = 300_000
    monkeypatch.setattr(stores, "children", lambda *a, **k: (stores.Found(f"file:/folder/{i}.txt", 3000 + i % 7) for i in range(n)))
    works = reader.FilesReader({"paths": "1", "path0": "/folder", "split_bytes": "1000"}).partitions()
    assert len(works) <= reader.MOST and sum(len(g) for w in works for g in w.packed) < 20 * n
    assert sum(k for w in works for *_, k in w.items()) == sum(-(-(3000 + i % 7) // 1000) for i in range(n))
    # what is in a partition stays bounded in bytes
    monkeypatch.setattr(stores, "children", lambda *a, **k: (stores.Found(f"file:/folder/{i}", 1 << 26) for i in range(10_000)))
    assert len(reader.FilesReader({"paths": "1", "path0": "/folder"}).partitions()) == 5000


# --- lines over many partitions ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def dealt(spark):
    """One long document, one without text, one of a single line, some small ones; dealt over 50 partitions."""
    rnd = random.Random(3)
    pool = ["", " ", "　", "你", "好。", "a", "bc ", "x，", "，y", "long line of text", "，　", "人", "é"]
    docs = {"long": [rnd.choice(pool) for _ in range(4000)], "empty": [""] * 300, None: ["只"], "wide": ["w" * 50] * 40, **{f"d{k}": [rnd.choice(pool) for _ in range(rnd.randint(1, 30))] for k in range(40)}}
    rows = [(d, k + 1, x, "clash") for d, ls in docs.items() for k, x in enumerate(ls)]
    rnd.shuffle(rows)
    return docs, spark.createDataFrame(rows, "doc_id string, line_no long, line string, part string").repartition(50)


def by_document(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["line_no"]):
        out.setdefault(r["doc_id"], []).append((r["line_no"], r["line"]))
    assert all([n for n, _ in v] == list(range(1, len(v) + 1)) for v in out.values())
    return {d: [x for _, x in v] for d, v in out.items()}


@pytest.fixture()
def many_ranges(spark, monkeypatch):
    from quillmill.operators import long_documents

    monkeypatch.setattr(long_documents, "BLOCK_LINES", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield long_documents
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("threshold, mode, stop", [(20, "bytes", None), (1, "chars", None), (12, "chars", "。人"), (200, "bytes", "。"), (10**9, "bytes", None)])
def test_merge_over_partitions(dealt, many_ranges, threshold, mode, stop):
    docs, df = dealt
    want = {d: lines.merge_list(ls, threshold, lines.Width(mode), "UTF-8", stop) for d, ls in docs.items()}
    assert by_document(many_ranges.merge_lines(df, threshold, mode, stop)) == {d: v for d, v in want.items() if v}


@pytest.mark.parametrize("change", ["fix_cjk", "fix_cjk_stop", "fix_punct", "fix_none"])
def test_regroup_over_partitions(spark, dealt, many_ranges, change):
    docs, df = dealt
    one, many = {
        "fix_cjk": (lambda c: lines.fix_cjk(c), lambda d: many_ranges.fix_cjk(d)),
        "fix_cjk_stop": (lambda c: lines.fix_cjk(c, "人"), lambda d: many_ranges.fix_cjk(d, "人")),
        "fix_punct": (lambda c: lines.fix_punctuation(c, "，。", "。"), lambda d: many_ranges.fix_punctuation(d, "，。", "。")),
        "fix_none": (lambda c: c, lambda d: many_ranges.fix_punctuation(d, "。", "。")),
    }[change]
    whole = spark.createDataFrame(list(docs.items()), "doc_id string, lines array<string>")
    assert by_document(many(df)) == {r["doc_id"]: r["lines"] for r in whole.select("doc_id", one(F.col("lines")).alias("lines")).collect()}


@pytest.mark.parametrize("step", [1, 3])
def test_lines_that_come_in_order_are_not_sorted(spark, many_ranges, monkeypatch, step):
    rnd = random.Random(step)
    docs = {f"d{k}": [rnd.choice(["", " ", "你", "好。", "a", "bc ", "x，", "w" * 30]) for _ in range(n)] for k, n in enumerate([1, 500, 7, 8, 0, 60, *range(20)])}
    # a document's fourths lie in four partitions, the last first
    fourths = [[(d, step * i, ls[i]) for d, ls in docs.items() for i in range(k * len(ls) // 4, (k + 1) * len(ls) // 4)] for k in (3, 2, 1, 0)]
    df = spark.sparkContext.parallelize(fourths, 4).flatMap(lambda x: x).toDF("doc_id string, line_no long, line string")
    monkeypatch.setattr(type(df), "repartitionByRange", lambda *a, **k: pytest.fail("lines are sorted in ranges"))
    for threshold, stop in ((20, "。"), (10**9, None)):
        want = {d: lines.merge_list(ls, threshold, lines.Width.BYTES, "UTF-8", stop) for d, ls in docs.items()}
        assert by_document(many_ranges.merge_lines(df, threshold, "bytes", stop)) == {d: v for d, v in want.items() if v}
    whole = spark.createDataFrame([x for x in docs.items() if x[1]], "doc_id string, lines array<string>")
    assert by_document(many_ranges.fix_cjk(df)) == {r["doc_id"]: r["lines"] for r in whole.select("doc_id", lines.fix_cjk(F.col("lines")).alias("lines")).collect()}


def test_punctuation_of_lines_in_order_is_not_sorted(spark, many_ranges, monkeypatch):
    rnd = random.Random(8)
    docs = {f"d{k}": [rnd.choice(["，", "a，", "b", " ", "", "c。", "，　", "x" * 20]) for _ in range(n)] for k, n in enumerate([300, 1, 7, 14, *range(1, 20)])}
    whole = spark.createDataFrame(list(docs.items()), "doc_id string, lines array<string>")
    monkeypatch.setattr(type(whole), "repartitionByRange", lambda *a, **k: pytest.fail("lines are sorted in ranges"))
    want = {r["doc_id"]: r["lines"] for r in whole.select("doc_id", lines.fix_punctuation(F.col("lines"), "，。", "。").alias("lines")).collect()}
    assert by_document(many_ranges.fix_punctuation(lines.explode_lines(whole), "，。", "。")) == want


def test_documents_of_one_block_are_not_shuffled(spark):
    rows = spark.range(0, 40, 1, 4).select((F.col("id") % 3 == 0).alias("even"), F.col("id").alias("doc_id"), F.array(*map(F.lit, ["a", "你", "", "b。", "c"])).alias("lines"))
    from quillmill.operators import long_documents

    done = long_documents.merge_lines(lines.explode_lines(rows), 3, no_merge="。")
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
    assert by_document(done) == {k: ["a你", "b。", "c"] for k in range(40)}


def test_tangled_documents_beside_others(spark, many_ranges):
    """Numbers that repeat, that are none, or that are dealt out; of other types too."""
    rnd = random.Random(5)
    rows = [(1.5, None, "z"), (1.5, None, "b"), (1.5, 1, "c"), (2.5, None, "q"), (2.5, 4, "r"), (None, 7, "y"), (None, 7, "x"), (0.5, 1, "only")] + [(9.5, k, str(k % 10)) for k in range(100)]
    rnd.shuffle(rows)
    df = spark.sparkContext.parallelize(rows, 6).toDF("doc_id double, line_no int, line string")
    want = {1.5: ["bzc"], 2.5: ["qr"], None: ["xy"], 0.5: ["only"], 9.5: ["0123456789" * 10]}
    assert by_document(many_ranges.merge_lines(df, 1000)) == want
    assert by_document(many_ranges.merge_lines(df.withColumn("doc_id", F.struct("doc_id")), 1000).withColumn("doc_id", F.col("doc_id.doc_id"))) == want


def test_long_documents_of_odd_rows(spark, many_ranges):
    df = spark.createDataFrame([(1, None, None), (1, 5, "b"), (1, 5, "a"), (1, 9, "c")], "doc_id int, line_no long, line string")
    assert [r["line"] for r in many_ranges.merge_lines(df, 2).orderBy("line_no").collect()] == ["ab", "c"]
    assert many_ranges.merge_lines(df.limit(0)).count() == 0 and many_ranges.fix_cjk(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        many_ranges.merge_lines(df, 0)


def test_line_ends_by_bytes(spark, monkeypatch):
    """What a line's end asks for is seen in its bytes, as the expressions on text say."""
    from quillmill.operators import long_documents
    import numpy as np
    import pyarrow as pa
    from quillmill.functions import charsets

    rnd = random.Random(11)
    pool = [*charsets.WHITESPACE, *"a。，你人é", "🙂", "㐀", "\uf900", "\u9fff", "\ua000", "\x00"]
    texts = ["", *("".join(rnd.choice(pool) for _ in range(rnd.randint(0, 5))) for _ in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for asks, refuses, operator in (
        (f"{charsets.CJK}&&[^{charsets.class_of('人')}]", "人", long_documents.Regroup(tuple(charsets.CJK_RANGES), "人")),
        (charsets.class_of("，🙂　"), "", long_documents.Regroup(long_documents._singles("，🙂　"), "")),
    ):
        want = F.when(~F.col("t").rlike(f"[^{charsets.BLANK}]"), -1).when(F.col("t").rlike(f"[{asks}][{charsets.BLANK}]*\\z"), 1).otherwise(0)
        lined = pa.array(texts, pa.string()).slice(1)
        got = operator.values(*long_documents._offsets(lined))
        assert got.dtype == np.int64 and got.tolist() == [r["v"] for r in df.orderBy("k").select(want.alias("v")).collect()][1:]
    rows = spark.createDataFrame([("d", 1, "你"), ("d", 2, "x")], "doc_id string, line_no int, line string")
    monkeypatch.setattr(type(F.lit(1)), "rlike", lambda *a: pytest.fail("an expression a line"))
    assert by_document(long_documents.fix_cjk(rows)) == {"d": ["你x"]}


def test_block_functions():
    from quillmill.operators.long_documents import Merge
    import numpy as np

    rnd = random.Random(2)
    for _ in range(500):
        threshold = rnd.choice([1, 5, 20])
        m, values = Merge(threshold), np.array([rnd.choice([0, 1, 3, 8, 30, -1, -4]) if rnd.random() < 0.9 else 0 for _ in range(rnd.randint(1, 40))], np.int64)
        summary = m.summary(values)
        for state in range(threshold):
            width, flushed = state, []
            for k, v in enumerate(values.tolist()):
                width += v if v >= 0 else -1 - v
                if width >= threshold or v < 0:
                    flushed.append(k)
                    width = 0
            assert m.carry(summary, state) == (width, len(flushed)) and m.breaks(values, state).tolist() == flushed
