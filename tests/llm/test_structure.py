"""Conversation repair, fill-in-the-middle forms and license scans against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmill.llm import conversation, fim, licenses, queries

SPACES = "\x20\x09-\x0d"
UNIT = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def rows_of(df, key):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[key] is not None, *map(repr, r)))


def same(df, want):
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, want))


# --- conversations ----------------------------------------------------------------------------------------------------


def in_order(rows):
    """(turn, role, text) in the operator's order."""
    return sorted(((t, r or "", x or "") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))


def cheapest(rows):
    """(cost, audit, repaired) of ordered (role, text, fault): all edits, by least (cost, audit) of each state, insertions as steps of their own."""
    pattern = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    new = (("user", "u"), ("assistant", "a"))

    def inserted(best):
        for _ in range(6):
            for q, (cost, audit, made) in list(best.items()):
                for role, x in new:
                    if (q, x) in pattern:
                        to, way = pattern[q, x], (cost + 3, audit + "I", (*made, (role, "")))
                        best[to] = min(best.get(to, way), way)
        return best

    best = inserted({0: (0, "", ())})
    for role, text, fault in rows:
        after = {}

        def put(to, way):
            after[to] = min(after.get(to, way), way)

        for q, (cost, audit, made) in best.items():
            put(q, (cost + 4, audit + "D", made))
            if fault in ("truncated", None):
                more = 3 if fault else 0
                if (q, role[:1]) in pattern:
                    put(pattern[q, role[:1]], (cost + more, audit + "K", (*made, (role, text))))
                for other, x in new:
                    if (q, x) in pattern:
                        put(pattern[q, x], (cost + 3 + more, audit + "R", (*made, (other, text))))
        best = inserted(after)
    return min(best[q] for q in (0, 3) if q in best)


def expected(conv, rows):
    rows = in_order(rows)
    counts, seen, faulty = defaultdict(int), set(), []
    for _, role, text in rows:
        last = re.findall(f"[^{SPACES}]", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None
        seen.add((role, text))
        counts[fault] += 1
        faulty.append((role, text, fault))
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, made = cheapest(faulty)
    return (conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in made))), made


def some_rows(rnd, n):
    roles, texts = ["user", "assistant", "system", "tool", "u", "", None], ["a.", "b?", "c", " ", "", None, "d.\n", "é!", "a."]
    return [(rnd.choice([None, *range(n + 2)]), rnd.choice(roles[: rnd.choice([2, 3, 7])]), rnd.choice(texts)) for _ in range(n)]


@pytest.fixture()
def conversations(spark):
    rnd = random.Random(11)
    found = {k: some_rows(rnd, rnd.randint(1, 9)) for k in range(300)}
    found[None] = some_rows(rnd, 7)
    found[500] = [(k, rnd.choice(["user", "assistant", "system"]), rnd.choice("xyz") * rnd.randint(0, 9) + rnd.choice(".!?,")) for k in range(1500)]
    found[501] = [(3, "user", "Yes.")] * 700
    rows = [(c, t, r, x, "clash") for c, rs in found.items() for t, r, x in rs]
    rnd.shuffle(rows)
    return found, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string").repartition(5)


@pytest.mark.parametrize("piece", [1 << 13, 3])
def test_repair(spark, conversations, monkeypatch, piece):
    monkeypatch.setattr(conversation, "PIECE_ROWS", piece)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        found, df = conversations
        want = {c: expected(c, rows) for c, rows in found.items()}
        same(conversation.repair(df), [w[0] for w in want.values()])
        turns = conversation.repaired_turns(df).collect()
        made = defaultdict(list)
        for r in sorted(turns, key=lambda r: r["seq"]):
            made[r["conv_id"]].append((r["role"], r["text"]))
        assert dict(made) == {c: list(w[1]) for c, w in want.items() if w[1]}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_repair_of_edges(spark, conversations):
    none = conversations[1].where("conv_id = -1")
    assert conversation.repair(none).collect() == [] and conversation.repaired_turns(none).collect() == []
    one = spark.createDataFrame([(None, None, None, None)], "conv_id string, turn int, role string, text string")
    assert [tuple(r) for r in conversation.repair(one).collect()] == [(None, 0, 1, 0, 0, 0, 4, "D", sha(""))]
    lost = conversation.repair(conversations[1].where("conv_id < 3"), present=F.lit(False))
    same(lost, [(k, 0, 0, 0, 0, 0, 0, "", sha("")) for k in range(3)])


def test_joined_counts():
    rnd = random.Random(3)
    for _ in range(300):
        rows, whole, parts = sorted(((rnd.choice([None, 1, 2, 3]), rnd.choice(["user", "", "system"])) for _ in range(rnd.randint(0, 8))), key=lambda r: (r[0] is not None, r[0] or 0)), conversation.Piece(), None
        for k, (turn, role) in enumerate(rows):
            p = conversation.Piece()
            for piece in (whole, p):
                piece.add(role, turn, 1 + k % 2, False, False, None)
            parts = conversation._joined(parts, p.stats())
        assert not rows or parts == whole.stats()


def damaged(rows):
    out = defaultdict(list)
    for c, t, r, x in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        r, x, kind = " " if r is None else r, " " if x is None else x, zlib.crc32(key.encode()) % 20
        out[c] += [] if kind == 0 else [(t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x)] * (2 if kind == 3 else 1)
    return out


def test_op11(spark, con, small):
    got = queries.op11_conversation_repair(spark, small)
    same(got, con.sql(queries.ORACLE_SQL["op11_conversation_repair"]).fetchall())
    rows = con.sql("select conv_id, turn, role, text from conversations").fetchall()
    same(got, [expected(c, rs)[0] for c, rs in damaged(rows).items()])


def test_op11_of_nulls(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, 1, 2, 3, 4]), *r) for r in some_rows(rnd, 60)] + [(k, 1, "user", "Alone.") for k in range(100, 160)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    same(queries.op11_conversation_repair(spark, str(tmp_path)), [expected(c, rs)[0] for c, rs in damaged(rows).items()])


# --- fill in the middle -----------------------------------------------------------------------------------------------


def fim_form(key, text, sentinels=fim.SENTINELS, rate=50, spm_rate=80):
    text, units = text or "", UNIT.findall(text or "")
    h = [int(sha(f"42:{'' if key is None else key}")[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    P, S, M = sentinels
    if not text or any(x in text for x in sentinels) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    return (len(units), "spm", len(p), len(m), S + s + P + p + M + m) if h[3] % 100 < spm_rate else (len(units), "psm", len(p), len(m), P + p + S + s + M + m)


@pytest.mark.parametrize("sentinels", [fim.SENTINELS, ("<a", "<ab>", "é<"), ("aab", "aaa", "b")])
def test_scan(monkeypatch, sentinels):
    monkeypatch.setattr(fim, "WINDOW", 64)
    monkeypatch.setattr(fim, "STRIPE", 7)
    rnd = random.Random(1)
    for _ in range(400):
        texts = ["".join(rnd.choice(["a", "b", "é", "🙂", " ", "\n", "<", "P", "S", "M", ">", "<P>", "　", *sentinels]) for _ in range(rnd.choice([0, 1, 3, 10, 50, 300]))) for _ in range(rnd.randint(0, 6))]
        column = pa.array([x if rnd.random() > 0.1 else None for x in texts], pa.string())
        first, second = (np.array([rnd.randrange(1 << 32) for _ in texts], np.int64) for _ in range(2))
        plain = np.zeros(len(texts), bool)
        got = fim.transform_batch(column, first, second, plain, ~plain, sentinels)
        for k, x in enumerate(column.to_pylist()):
            units = UNIT.findall(x or "")
            a, b = sorted(int(h[k]) % (len(units) + 1) for h in (first, second))
            p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
            keep = not x or any(w in x for w in sentinels)
            want = (len(units), "plain", None, None, x or "") if keep else (len(units), "spm", len(p), len(m), sentinels[1] + s + sentinels[0] + p + sentinels[2] + m)
            assert (got["n"][k], got["form"][k], got["prefix_chars"][k], got["middle_chars"][k], got["output"][k].decode()) == want


def test_fim_of_odd_rows(spark, odd, none):
    for options in ({}, {"rate": 100, "spm_rate": 0}, {"rate": 100, "spm_rate": 100}):
        out = fim.with_fim(odd.withColumn("fim", F.lit(1)), **options)
        rows = out.select("*", fim.restored(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
        assert len(rows) == odd.count() and rows[0]["k"] == "k"
        for r in rows:
            assert tuple(r["fim"]) == fim_form(r["doc_id"], r["text"], **options) and r["back"] == (r["text"] or "")
    assert fim.with_fim(none).collect() == []


def test_fim_sentinels():
    with pytest.raises(ValueError):
        fim.scanner(("<a b>", "x", "y"))


def test_op12(spark, con, small):
    got = queries.op12_fim(spark, small)
    same(got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"), con.sql(f"select doc_id, n, form, prefix_chars::bigint, middle_chars::bigint, output_sha256, restored_sha256 from ({queries.ORACLE_SQL['op12_fim']})").fetchall())
    texts = dict(con.sql("select doc_id, text from documents").fetchall())
    for r in got.collect():
        n, form, p, m, out = fim_form(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == (n, form, p, m, sha(out), sha(texts[r["doc_id"]] or ""))


# --- licenses ---------------------------------------------------------------------------------------------------------


def lowered(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def phrase_places(words, templates=licenses.PHRASES):
    return sorted((k, t.label) for t in templates for p in [lowered(t.text)] for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p)


def notices_by_brute_force(words, index):
    """Every beginning of every notice, with the same vote, key phrases and share as the operator states."""
    found = set()
    for t in index.templates:
        own, keys = lowered(t.text), [lowered(k) for k in t.key_phrases]
        if not keys or any(not any(words[k : k + len(p)] == p for k in range(len(words))) for p in keys):
            continue
        has = set(words)
        looked = sorted({w for w in own if w in has}, key=lambda w: (-index.idf[index.number[w.encode()]], index.number[w.encode()]))[: licenses.LOOKED_UP]
        for start in range(1 - len(own), len(words)):
            at = {q: words[start + q] for q in range(len(own)) if 0 <= start + q < len(words)}
            votes = sum(at.get(q) == own[q] and own[q] in looked for q in range(len(own)))
            inside = all(any(start <= k and k + len(p) <= start + len(own) and words[k : k + len(p)] == p for k in range(max(start, 0), len(words))) for p in keys)
            share = sum(at.get(q) == own[q] for q in range(len(own))) / len(own)
            if votes >= max(-(-len(looked) // 2), min(2, len(looked))) and inside and share >= licenses.COVERAGE:
                found.add((t.label, max(start, 0), len(own), round(share, 9)))
    return found


def test_matches():
    rnd, pool = random.Random(9), [w for t in licenses.PHRASES + licenses.NOTICES for w in (t.text.split(), t.text.split()[:-1], t.text.upper().split())]
    index = licenses.Index(licenses.PHRASES + licenses.NOTICES).with_counts(100, {k: 7 * k % 31 for k in range(1, 120)})
    hits = 0
    for _ in range(150):
        words = []
        for _ in range(rnd.randint(0, 5)):
            part = list(rnd.choice(pool))
            for _ in range(rnd.choice([0, 0, 1, 3])):
                part[rnd.randrange(len(part))] = rnd.choice(["x", "the", "license", "by", "É", "CC"])
            words += part + ["filler"] * rnd.randint(0, 2)
        text = rnd.choice([" ", "-", "\n", " / "]).join(words)
        count, places, numbers = index.read(text.encode())
        got, own = index.matches(places, numbers), lowered(text)
        assert count == len(own)
        assert sorted((m[2], m[0]) for m in got if m[1]) == phrase_places(own)
        notices = {(m[0], m[2], m[3], round(m[4], 9)) for m in got if not m[1]}
        assert notices == notices_by_brute_force(own, index)
        hits += len(notices)
    assert hits > 50


def test_windows(monkeypatch):
    monkeypatch.setattr(licenses, "WINDOW", 16)
    index = licenses.Index(licenses.PHRASES)
    for text in ("All rights reserved. " * 9, "x" * 100 + " cc by " + "é" * 70 + "-CC-BY", "", "CC", "a" * 16 + " cc by", "😀" * 30 + " general public license"):
        count, places, numbers = index.read(text.encode())
        words = lowered(text)
        assert count == len(words) and [(m[2], m[0]) for m in index.matches(places, numbers)] == phrase_places(words)


def test_licenses_of_odd_rows(spark, odd, none):
    more = odd.union(odd.limit(1).withColumn("text", F.lit("ALL RIGHTS RESERVED (c) cc-by; Released under the MIT License.")))
    rows = licenses.with_licenses(more.withColumn("licenses", F.lit(1)), licenses.fit(more)).collect()
    assert [r["licenses"]["n_words"] for r in rows] == [len(lowered(r["text"] or "")) for r in rows] and rows[0]["k"] == "k"
    assert [(m["label"], m["exact"], m["start"], m["coverage"]) for m in rows[-1]["licenses"]["matches"]] == [("reserved", True, 0, 1.0), ("cc-by", True, 4, 1.0), ("mit", False, 6, 1.0), ("mit", False, 6, 0.8)]
    assert not any(r["licenses"]["matches"] for r in rows[:-1])
    index = licenses.fit(none)
    assert licenses.with_licenses(none, index).collect() == []
    with pytest.raises(ValueError):
        licenses.Index((licenses.Template("x", "--"),))


def test_op13(spark, con, small):
    texts, labelled = dict(con.sql("select doc_id, text from documents").fetchall()), 0
    for r in queries.op13_licenses(spark, small).collect():
        words = lowered(texts[r["doc_id"]] or "")
        places = phrase_places(words)
        starts = [p for p, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        base = {label for _, label in places}
        assert r["base_labels"] == ",".join(sorted(base)) and r["labels"].split(",") == sorted(r["labels"].split(",")) and base <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
        said = "released under the mit license" in " ".join(words)
        assert ("mit" in r["labels"].split(",")) == said
        labelled += said
    assert labelled
