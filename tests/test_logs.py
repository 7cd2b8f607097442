"""Rules by the thousand, joined output from many writers, edit logs, and the status of arriving files."""

import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillmill.operators import edit_log, joiner, rule_index
from quillmill.operators.rules import Rule, RuleSet
from quillmill.sources import joined, stores
from quillmill.streaming import status


def chain(text, found):
    for r in found:
        if r.find:
            text = text.replace(r.find, r.replace or "")
    return text


def test_rule_index_equals_the_chain():
    rnd = random.Random(1)
    for _ in range(1500):
        letters = rnd.choice(["ab", "abc", "abcd。，"])
        word = lambda n: "".join(rnd.choice(letters) for _ in range(n))
        found = [Rule(word(rnd.choice([0, 1, 1, 2, 3, 4])) or None, rnd.choice([None, "", word(rnd.randint(0, 5))])) for _ in range(rnd.choice([3, 10, 40]))]
        index = rule_index.RuleIndex(found)
        for _ in range(4):
            text = word(rnd.randint(0, 40))
            assert index.apply(text) == chain(text, found)
            assert index.found(text) == [k for k, r in enumerate(found) if r.find and r.find != (r.replace or "") and r.find in text]


def test_thousands_of_rules(spark):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcdefghij 。，") for _ in range(n))
    found = [Rule(word(rnd.randint(2, 6)), rnd.choice(["", word(rnd.randint(1, 4))])) for _ in range(5000)]
    texts = [None, "", *(word(rnd.randint(1, 500)) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r["k"]: r["x"] for r in df.select("k", rule_index.apply_many(F.col("t"), found).alias("x")).collect()}
    assert got == {k: t if t is None else chain(t, found) for k, t in enumerate(texts)}
    hits = df.select("k", rule_index.rules_in(F.col("t"), found).alias("x")).collect()
    assert hits[0]["x"] is None and hits[1]["x"] == [] and hits[5]["x"] == [k for k, r in enumerate(found) if r.find in texts[5] and r.find != r.replace]
    assert RuleSet.from_df(RuleSet(tuple(found[:9])).to_df(spark)).rules == tuple(found[:9])


@pytest.fixture()
def pieces(spark):
    rnd = random.Random(2)
    rows = [(g, k + 1, rnd.choice(["", "漢字\n", "x" * rnd.randint(1, 90), None]), "clash") for g, n in (("a", 900), (None, 300), ("b", 1), ("c", 257)) for k in range(n)]
    want = {g: b"\xef\xbb\xbf" + b"".join((p or "").encode() for h, _, p, _ in rows if h == g) for g in ("a", None, "b", "c")}
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "g string, seq int, piece string, part string").repartition(7), want


def test_joined_output(spark, tmp_path, pieces, monkeypatch):
    df, want = pieces
    monkeypatch.setattr(joined, "BLOCK_PIECES", 16)
    path = str(tmp_path / "out")
    joined.write_joined(df, path, "g", part_bytes=2000)
    parts = joined.manifest(spark, path).collect()
    assert len(parts) > 8 and all(zlib.crc32(want[r["g"]][r["start"] : r["start"] + r["bytes"]]) == r["crc"] for r in parts)
    for g in want:
        own = sorted((r["start"], r["bytes"]) for r in parts if r["g"] == g)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) == len(want[g])
    assert max(r["bytes"] for r in parts) < 2000 + 16 * 90
    chunks = sorted(joined.read_joined(spark, path, read_bytes=700).collect(), key=lambda r: r["start"])
    assert {g: b"".join(r["content"] for r in chunks if r["g"] == g) for g in want} == want
    for g in ("a", None):
        assert joined.to_one_file(spark, path, g, str(tmp_path / "one")) == len(want[g]) and (tmp_path / "one").read_bytes() == want[g]
    assert sorted(os.listdir(tmp_path)) == ["one", "out"]
    # a part that is not what was written
    broken = stores.local_path(parts[0]["file"])
    open(broken, "r+b").write(b"??")
    with pytest.raises(Exception, match="not what was written"):
        joined.read_joined(spark, path).collect()


def test_a_job_that_fails_names_nothing(spark, tmp_path, pieces):
    df, _ = pieces
    bad = F.when((F.col("seq") == 899) & (F.rand() < 2), F.raise_error(F.lit("no"))).otherwise(F.col("piece"))
    with pytest.raises(Exception):
        joined.write_joined(df.withColumn("piece", bad), str(tmp_path / "out"), "g")
    with pytest.raises(Exception):
        joined.manifest(spark, str(tmp_path / "out")).collect()
    joined.write_joined(df.limit(0), str(tmp_path / "none"), "g")
    assert joined.read_joined(spark, str(tmp_path / "none")).count() == 0


def test_join_to(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in {"D.txt": b"2", "c.txt": b"1", "gbk.txt": "草木".encode("gbk"), "other": b"x"}.items():
        (tmp_path / "in" / name).write_bytes(data)
    os.symlink(tmp_path / "in" / "loop.txt", tmp_path / "in" / "loop.txt")
    bad = joiner.join_to(spark, str(tmp_path / "in"), "*.txt", str(tmp_path / "out"), newline="\n").collect()
    assert [r["path"].rsplit("/", 1)[-1] for r in bad] == ["loop.txt"]
    assert joined.to_one_file(spark, str(tmp_path / "out"), 0, str(tmp_path / "one.txt")) == 14 and (tmp_path / "one.txt").read_bytes() == b"\xef\xbb\xbf1\n2\n" + "草木\n".encode()


def test_frequent_names_are_ranges_of_their_own(spark):
    rnd = random.Random(8)
    rows = [("g", "same", "t")] * 900 + [("g", None, str(k % 40)) for k in range(800)] + [("g", f"n{k % 50:02}", str(k)) for k in range(300)] + [("h", "z", "1")]
    rnd.shuffle(rows)
    found = joiner.join_pieces(spark.createDataFrame(rows, "g string, n string, text string"), "g", "n", newline="\n").collect()
    got = sorted((r["seq"], r["n"] or "", r["piece"]) for r in found if r["g"] == "g")
    assert [s for s, _, _ in got] == list(range(1, 2001)) and len(found) == 2001
    names = [n for _, n, _ in got]
    assert names == sorted(names, key=lambda n: (n != "", n.upper(), n)) and sorted((n, p) for _, n, p in got) == sorted((n or "", t + "\n") for g, n, t in rows if g == "g")


def test_edit_logs(spark):
    rnd = random.Random(6)
    rows, want = [], {}
    for catalog in ["a", "b", None, *(f"c{k}" for k in range(30))]:
        rules = RuleSet()
        for step in range(rnd.randint(1, 2500 if catalog == "a" else 60)):
            op = rnd.choice(["add"] * 5 + ["replace", "delete", "up", "down", "other"])
            index, rule = rnd.randint(0, max(len(rules.rules) + 1, 3)), Rule(f"f{step}", rnd.choice([None, f"r{step}"]))
            rows.append((catalog, step, op, index, rule.find, rule.replace, "clash"))
            known = Rule(rule.find, rule.replace or "")
            if op in ("add", "replace"):
                rules = rules.put(known, None if op == "add" else index)
            elif op == "delete":
                rules = rules.delete(index)
            elif op in ("up", "down"):
                rules = rules.move(index, 1 if op == "down" else -1)
        if rules.rules:
            want[catalog] = [(r.find, r.replace) for r in rules.rules]
    rows += [("a", 10**6, "add", None, "", "x", "k"), ("a", 10**6, "delete", -1, None, None, "k"), ("a", 10**6, None, 0, "y", None, "k")]
    rnd.shuffle(rows)
    log = spark.createDataFrame(rows, "catalog string, step long, op string, index long, find string, replace string, c string")
    got = {}
    for r in sorted(edit_log.replay(log).collect(), key=lambda r: r["pos"]):
        got.setdefault(r["catalog"], []).append((r["find"], r["replace"]))
    assert got == want and edit_log.replay(log.limit(0)).collect() == []


def test_indexed_list(monkeypatch):
    monkeypatch.setattr(edit_log, "CHUNK", 4)
    rnd, own, plain = random.Random(3), edit_log.IndexedList(), []
    for k in range(2000):
        if plain and rnd.random() < 0.4:
            i = rnd.randrange(len(plain))
            own.delete(i)
            del plain[i]
        elif plain and rnd.random() < 0.3:
            i = rnd.randrange(len(plain))
            own.put(i, -k)
            plain[i] = -k
        else:
            own.append(k)
            plain.append(k)
        assert list(own) == plain and own.size == len(plain)
    with pytest.raises(IndexError):
        own.get(len(plain))


def test_status_of_arriving_files(spark, tmp_path):
    files_ = tmp_path / "files"
    files_.mkdir()
    for k in range(6):
        (files_ / f"{k}.txt").write_text("x" * (50 if k == 3 else 5))
    path = lambda k: f"{files_}/{k}.txt"
    asked, results = [], []

    def ask(*names):
        spark.createDataFrame([(p,) for p in names], "path string").coalesce(1).write.mode("append").parquet(str(tmp_path / "requests"))
        for p in names:
            fails = not os.path.exists(p) or os.path.getsize(p) > 20
            results.append((p, len(asked), ("ValueError" if os.path.exists(p) else "FileNotFoundError") if fails else None))
        asked.append(names)

    def run():
        stream = spark.readStream.schema("path string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "requests"))
        status.start(stream, str(tmp_path / "status"), longest=20, availableNow=True).awaitTermination()
        got = status.current(spark, str(tmp_path / "status")).withColumn("error", F.substring_index("error", ":", 1))
        want = status.batch_status(spark.createDataFrame(results, "path string, trigger int, error string"), "trigger")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert joiner.batch_summary(got).head() == joiner.batch_summary(want).head()
        return {r["path"]: (r["attempts"], r["failures"], r["error"]) for r in got.collect()}, joiner.batch_summary(got).head()["status"]

    ask(path(0), path(1), path(9))
    found, said = run()
    assert found[path(9)] == (1, 1, "FileNotFoundError") and said == "Partial"
    (files_ / "9.txt").write_text("now")
    ask(path(9), path(3), path(2), path(2))
    found, said = run()
    assert found[path(9)] == (2, 1, None) and found[path(2)] == (2, 0, None) and found[path(3)][2] == "ValueError"
    (files_ / "3.txt").write_text("short")
    ask(path(3))
    assert run()[1] == "Complete"
