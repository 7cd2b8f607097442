"""Exact and near duplicates against brute force, components, and the pipeline."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quillmill.llm import components, dedup, ngramjoin, queries


def test_op9(spark, small, con):
    got = queries.op9_exact_dedup(spark, small).toPandas()
    want = con.sql(queries.ORACLE_SQL["op9_exact_dedup"]).df()
    columns = list(want.columns)
    assert sorted(map(repr, got[columns].values.tolist())) == sorted(map(repr, want.values.tolist()))


@pytest.mark.parametrize("keep", ["max", "min"])
@pytest.mark.parametrize("leaves", [1, 100])
def test_copies(spark, odd, none, keep, leaves):
    pick = random.Random(leaves)
    extra = spark.createDataFrame([(k, pick.choice(["a", "b", f"own {k}"])) for k in range(100, 300)], "doc_id long, text string")
    for df in (odd.select("doc_id", "text"), extra):
        groups = {}
        for r in df.collect():
            groups.setdefault(r["text"] or "", []).append(r["doc_id"])
        best = {t: (max if keep == "max" else min)([k for k in ks if k is not None], default=None) for t, ks in groups.items()}
        rows = dedup.copy_groups(df, keep=keep, leaves=leaves).collect()
        want = Counter((k, best[t], len(ks)) for t, ks in groups.items() for k in ks)
        assert Counter((r["id"], r["keep_id"], r["group_size"]) for r in rows) == want
        assert Counter(r["digest"] for r in rows if r["kept"]) == Counter(set(r["digest"] for r in rows))
        assert all(r["id"] == r["keep_id"] for r in rows if r["kept"])
    assert dedup.copy_groups(none, keep=keep).count() == 0
    kept = dedup.deduplicate(odd, keep=keep)
    assert kept.columns == odd.columns and Counter(r["text"] or "" for r in kept.collect()) == Counter({r["text"] or "" for r in odd.collect()})
    assert dedup.deduplicate(none, keep=keep).count() == 0


def test_native_plan(spark, small):
    plan = queries.op9_exact_dedup(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute(docs, words=5, percent=80):
    """Component id of each (key, text) by position."""
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    root = list(range(len(docs)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    low = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            low[top(i)] = min(low.get(top(i), k), k)
    return [(k, len(sets[i]), low.get(top(i)) if sets[i] else k) for i, (k, _) in enumerate(docs)]


def near_copies(seed, n=260):
    pick = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    common = " ".join(pick.choices(vocabulary, k=60))
    docs, texts = [], []
    for k in range(n):
        if texts and pick.random() < 0.6:
            words = pick.choice(texts).split()
            for _ in range(pick.choice([0, 1, 1, 2, 3, 5])):
                at = pick.randrange(len(words))
                words[at : at + pick.choice([0, 1, 1])] = [pick.choice(vocabulary)] * pick.choice([0, 1, 1])
                words = words or ["x"]
            text = " ".join(words)
        else:
            text = " ".join(pick.choices(vocabulary, k=pick.choice([2, 5, 8, 40, 120, 200])))
            if pick.random() < 0.4:
                text += " " + common
        texts.append(text)
        docs.append((k, text if pick.random() < 0.9 else text.upper()))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_near_components(spark, seed, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK", 7)
    docs = near_copies(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in ngramjoin.jaccard_components(df).collect())
    assert got == sorted(brute(docs))
    kept = ngramjoin.keep_one(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in brute(docs)})


def test_op10(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op10_ngram_jaccard(spark, small).collect()) == sorted(brute(docs))


def test_near_odd_rows(spark, odd, none):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted((tuple(r) for r in ngramjoin.jaccard_components(odd).collect()), key=key) == sorted(brute(docs), key=key)
    kept = ngramjoin.keep_one(odd)
    rows = kept.collect()
    assert kept.columns == odd.columns and sum(1 for r in rows if not (r["text"] or "").strip()) == 4
    assert Counter(r["text"][:9] for r in rows if (r["text"] or "").strip()) == Counter(["the same ", "word word", "don't 漢字 ", "x"])
    assert ngramjoin.jaccard_components(none).count() == 0 and ngramjoin.keep_one(none).count() == 0


def test_search_by_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 80).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(30, 80), replace=False), rng.integers(0, 2**63, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(120)]
    sets.sort(key=len)
    lists, sizes = ngramjoin.inverted(sets), np.array([len(s) for s in sets])
    for percent in (50, 80):
        for q in sets[::3]:
            want = [k for k, s in enumerate(sets) if 100 * (n := len(np.intersect1d(q, s))) >= percent * (len(q) + len(s) - n)]
            assert sorted(ngramjoin.search(q, lists, sizes, percent).tolist()) == want


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 60)], [(5, 5), (None, 3), (9, 8), (8, 9)]])
def test_components(spark, edges):
    found = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            root.setdefault(a, a)
            root.setdefault(b, b)
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    assert found == root


def test_pipeline(spark, odd, none, small):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{small}/documents.parquet")
    now, sizes = docs, []
    for name, stage in p.STAGES[:-1]:
        before = Counter(tuple(r) for r in now.collect())
        now = stage(spark, now, small).cache()
        after = Counter(tuple(r) for r in now.collect())
        assert now.columns == docs.columns and not after - before, name
        sizes.append(sum(after.values()))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * docs.count()
    texts = [r["text"] for r in now.collect()]
    assert len(set(texts)) == len(texts) and len({c for _, _, c in brute(list(enumerate(texts)))}) == len(texts)
    last = p.STAGES[-1][1](spark, now, small)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in now.collect()}
    for df in (odd, none):
        frame = df.selectExpr("doc_id", "text", "lang", "name AS source", "n AS n_chars")
        for _, stage in p.STAGES:
            frame = stage(spark, frame, small)
            frame.collect()
    assert p.run(spark, small).count() == last.count()


def test_frequent_and_rare_classes_alike(spark, monkeypatch):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    texts = [words(0)] * 30 + [words(k) for k in range(1, 9)] + [words(1) + " more", None, "", " \n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {k: 0 if k < 30 else 30 if k == 38 else k for k in range(len(texts))}
    for hot in (1, 2, 1 << 16):
        monkeypatch.setattr(ngramjoin, "HOT", hot)
        rows = ngramjoin.jaccard_components(df).collect()
        assert len(rows) == len(texts) and {r["id"]: r["component_id"] for r in rows} == want
