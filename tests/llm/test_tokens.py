"""Pre-tokens, BPE, token counts and id files against the public libraries, and packing."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import regex
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmill.llm import bpe, packing, queries, rangecoder, tokencount, vectext

PATTERN = regex.compile(P.PATTERN)
LIBRARY = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
PIECES = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.MULTI_RANKS, "rb"))}
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
texts = st.lists(st.text(st.sampled_from(" \n\t　 'stremdlvTab1²é漢🙂.!▁<|"), max_size=30), max_size=6)


def documents(spark, path):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{path}/documents.parquet").collect()]


def token_counts(path, parts):
    """What the operator computes, without Spark: distinct pre-tokens, their pieces, sums by text."""
    own, seen = tokencount.counter(path), tokencount.Distinct()
    ready, whole = own.prepare(parts)
    total = [whole.get(k, 0) for k in range(len(parts))]
    for text, row, n in tokencount.frequencies(own, ready, seen):
        pieces = own.pieces(seen.tokens)
        for k, r, m in zip(text, row, n):
            total[k] += int(pieces[r] * m)
    return total


@settings(max_examples=400, deadline=None)
@given(texts)
def test_pretokens(parts):
    joined, points, starts = vectext.flatten(parts)
    begin = bpe.token_starts(points, starts).tolist()
    assert [joined[a:b] for a, b in zip(begin, begin[1:] + [len(joined)])] == [w for p in parts for w in PATTERN.findall(p)]


@settings(max_examples=100, deadline=None)
@given(texts)
def test_ids(parts):
    for got, text in zip(bpe.encoder(queries.MULTI_RANKS).encode(parts), parts):
        assert got.tolist() == TIKTOKEN.encode_ordinary(text)
    for got, text in zip(bpe.library_encoder(queries.BYTE_BPE).encode(parts), parts):
        assert got.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert token_counts(queries.PIECES, parts) == [len(PIECES.encode(t)) for t in parts]
    assert token_counts(queries.BYTE_BPE, parts) == [len(LIBRARY.encode(t, add_special_tokens=False).ids) for t in parts]


def test_special_strings():
    text = "a<|endoftext|> b <|endoftext|>"
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert 50256 in want and bpe.library_encoder(queries.BYTE_BPE).encode([text, None])[0].tolist() == want
    assert token_counts(queries.BYTE_BPE, [text])[0] == len(want)


def test_long_texts_are_cut_safely(monkeypatch):
    pick = random.Random(1)
    text = "".join(pick.choice(["the ", "don't", "  ", "\n\n", "x", " 12", "漢", ", "]) for _ in range(4000))
    for limit in (7, 50, 1000):
        groups = list(vectext.segments([text, None, text], limit))
        assert "".join(p for parts, _ in groups for p in parts) == text * 2
        words = [w for parts, _ in groups for p in parts for w in PATTERN.findall(p)]
        assert words == PATTERN.findall(text) * 2
    monkeypatch.setattr(vectext, "segments", lambda t, limit=64, cut=vectext.safe_cut, real=vectext.segments: real(t, limit, cut))
    assert bpe.Encoder(bpe.Vocabulary.from_ranks(queries.MULTI_RANKS)).encode([text])[0].tolist() == TIKTOKEN.encode_ordinary(text)
    assert token_counts(queries.PIECES, [text])[0] == len(PIECES.encode(text))


@pytest.mark.parametrize("text", ["ab1cdEf9" * 125_000, "abcdefgh" * 20_000, "漢字仮名交" * 60_000, "zq" * 300 + " " + "k" * 511 + " " + "k" * 513])
def test_texts_without_a_space(text):
    assert bpe.Encoder(bpe.Vocabulary.from_ranks(queries.MULTI_RANKS)).encode([text])[0].tolist() == TIKTOKEN.encode_ordinary(text)
    assert bpe.library_encoder(queries.BYTE_BPE).encode([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ROWS", 3)
    e = bpe.Encoder(bpe.Vocabulary.from_ranks(queries.MULTI_RANKS))
    for text in ("one two three four five", "six seven eight nine", "one two"):
        assert e.encode([text])[0].tolist() == TIKTOKEN.encode_ordinary(text)


def test_op2(spark, small):
    got = {r["doc_id"]: r for r in queries.op2_byte_bpe(spark, small).collect()}
    docs = documents(spark, small)
    assert len(got) == len(docs)
    for k, text in docs:
        ids = TIKTOKEN.encode_ordinary(text)
        assert tuple(got[k])[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_columns(spark, odd, none):
    coded = bpe.with_decoded(bpe.with_ids(odd, queries.MULTI_RANKS, offsets="offsets"), queries.MULTI_RANKS)
    rows = coded.collect()
    assert len(rows) == odd.count() and coded.columns == odd.columns + ["offsets", "decoded"]  # ids replaces the column of its name
    for r in rows:
        text = r["text"] or ""
        assert r["ids"] == TIKTOKEN.encode_ordinary(text) and bytes(r["decoded"]).decode() == text
        assert r["offsets"] == np.cumsum([0] + [len(TIKTOKEN.decode_single_token_bytes(i)) for i in r["ids"]]).tolist()
    assert bpe.with_decoded(bpe.with_ids(none, queries.MULTI_RANKS), queries.MULTI_RANKS).count() == 0


def test_op8(spark, small, odd, none):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op8_token_counts(spark, small).collect()}
    assert got == {k: (len(t.encode()), n := len(PIECES.encode(t)), n > 4096) for k, t in documents(spark, small)}
    counted = tokencount.with_token_count(odd, queries.PIECES, out="n")
    assert counted.columns == odd.columns
    rows = counted.collect()
    assert [r["n"] for r in rows] == [len(PIECES.encode(r["text"] or "")) for r in rows]
    assert Counter(str(r.asDict() | {"n": 1}) for r in rows) == Counter(str(r.asDict()) for r in odd.collect())
    assert tokencount.with_token_count(none, queries.PIECES).count() == 0


@pytest.mark.parametrize("path", [queries.PIECES, queries.BYTE_BPE])
def test_token_counts_by_the_join(spark, odd, path, monkeypatch):
    """Few frequent pre-tokens and texts, so nearly all go by the shuffled joins; caches that start anew; long pre-tokens; copies."""
    monkeypatch.setattr(tokencount, "HOT", 3)
    monkeypatch.setattr(tokencount, "HOT_TEXTS", 3)
    pick = random.Random(2)
    some = [" ".join(pick.choice(["the", "of", "x" * 40, "漢字", "a1b2", "don't"]) for _ in range(pick.randint(0, 60))) for _ in range(60)]
    some += [some[0]] * 40 + ["z" * 5000, "  ", "the the", "Z" * 5000 + " y"]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")).repartition(3)
    rows = tokencount.with_token_count(df, path).collect()
    size = (lambda t: len(PIECES.encode(t))) if path == queries.PIECES else (lambda t: len(LIBRARY.encode(t, add_special_tokens=False).ids))
    assert len(rows) == df.count() and all(r["n_tokens"] == size(r["text"] or "") for r in rows)


@pytest.mark.parametrize("most, held", [(2, 1), (3, 3), (100, 3), (0, 0)])
def test_frequent_pretokens_fill_their_bound(spark, monkeypatch, most, held):
    """However small their share: only the bound, and a tie at it, leaves pre-tokens that come more than once to the shuffle."""
    monkeypatch.setattr(tokencount, "HOT", most)
    df = spark.createDataFrame([("a " * 500 + "b c d",), ("b c e",)], "text string")
    frequent = tokencount.frequent_counts(df, queries.PIECES)
    assert (frequent.pieces([" a", " b", " c", " d", " e"]) >= 0).sum() == len(frequent.counts) == held


def test_distinct_tells_equal_hashes_apart(monkeypatch):
    monkeypatch.setattr(vectext.SliceHasher, "__call__", lambda self, a, b: np.ones(len(a), np.uint64))
    parts = ["ab cd ab ef", " abc", "cd"]
    assert token_counts(queries.PIECES, parts) == [len(PIECES.encode(t)) for t in parts]


# --- id files --------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 65535)), max_size=3000))
def test_id_file_round_trip(ids):
    data = rangecoder.IdChunk([(5, len(ids))], np.array(ids, np.int64)).to_bytes()
    back = rangecoder.IdChunk.from_bytes(data)
    assert back.ids.tolist() == ids and back.docs == [(5, len(ids))]


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 5000, 40_000])
def test_blocks(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_000) % 50_000
    for length in (64, 1024):
        ranked, prior = rangecoder.ranking(ids), np.arange(64) % 62
        assert (rangecoder.decode_blocks(rangecoder.encode_blocks(ids, ranked, prior, length), ranked, prior) == ids).all()


def test_repeats_compress():
    assert len(rangecoder.IdChunk([(1, 60_000)], np.tile(np.arange(200), 300)).to_bytes()) < 30_000


def test_damage_is_found():
    data = bytearray(rangecoder.IdChunk([(1, 3000)], np.arange(3000)).to_bytes())
    for at in (0, 30, len(data) // 3, len(data) - 5):
        hurt = data.copy()
        hurt[at] ^= 0x40
        with pytest.raises(ValueError):
            rangecoder.IdChunk.from_bytes(bytes(hurt))
    with pytest.raises(ValueError):
        rangecoder.IdChunk([(1, 1)], np.array([70_000])).to_bytes()


@pytest.mark.parametrize("path", [queries.BYTE_BPE, queries.MULTI_RANKS])
def test_merges_are_sparse(path):
    # pairs without a merge, most of those that are looked up, end at the first place
    vocabulary = bpe.encoder(path).vocabulary
    table = vocabulary.table
    assert table.rows == len(vocabulary._pairs) and len(table.keys) >= bpe.PLACES * table.rows
    left, right = np.random.default_rng(5).integers(0, len(vocabulary.tokens), (2, 20_000))
    want = [vocabulary.rank_of.get(p, int(bpe._NONE)) for p in (left << 32 | right).tolist()]
    assert vocabulary.ranks(left, right).tolist() == want


def test_op6(spark, small):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op6_id_files(spark, small).collect()}
    at, want = 0, {}
    for k, t in sorted(documents(spark, small)):
        ids = np.array(LIBRARY.encode(t, add_special_tokens=False).ids + [2], "<u4")
        want[k] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert got == want


def test_id_files_of_odd_rows(spark, odd, none, tmp_path):
    manifest = rangecoder.write_files(odd, queries.BYTE_BPE, f"file://{tmp_path}/a")
    rows = rangecoder.read_files(manifest, f"file://{tmp_path}/a").orderBy("start").collect()
    given_ = sorted((r for r in odd.collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert [r["id"] for r in rows] == [r["doc_id"] for r in given_]
    ids = lambda t: np.array(LIBRARY.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
    assert Counter((r["id"], bytes(r["ids"])) for r in rows) == Counter((r["doc_id"], ids(r["text"])) for r in given_)
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    assert rangecoder.read_files(rangecoder.write_files(none, queries.BYTE_BPE, f"file://{tmp_path}/b"), f"file://{tmp_path}/b").count() == 0


# --- packing ---------------------------------------------------------------------------------------------------------


def check_packing(rows, docs, capacity):
    """docs: (key, text) of all rows, keys not unique."""
    sizes = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sizes[r["sequence_id"]] and 0 < r["length"]
        sizes[r["sequence_id"]] += r["length"]
    assert not sizes or max(sizes.values()) <= capacity and sorted(sizes) == list(range(len(sizes)))
    want = Counter()
    for k, t in docs:
        ids = np.array(LIBRARY.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for a in range(0, len(ids), capacity):
            want[k, a, min(capacity, len(ids) - a), zlib.crc32(ids[a : a + capacity].tobytes()), len(ids)] += 1
    assert want == Counter((r["id"], r["start"], r["length"], r["crc"], r["doc_tokens"]) for r in rows)
    return sizes


def test_packing(spark, small, odd, none):
    docs = documents(spark, small)
    rows = packing.pack(spark.read.parquet(f"{small}/documents.parquet"), queries.BYTE_BPE).collect()
    sizes = check_packing(rows, docs, 2048)
    assert sum(sizes.values()) > 0.95 * 2048 * len(sizes)
    check_packing(packing.pack(odd, queries.BYTE_BPE, capacity=100).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()], 100)
    assert packing.pack(none, queries.BYTE_BPE).count() == 0
    assert len(queries.op7_packing(spark, small).columns) == 7


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 60), min_size=1), st.integers(30, 40))
def test_cutting_stock(demand, capacity):
    weights = np.array(sorted(demand))
    wanted = np.array([demand[w] for w in weights.tolist()])
    found = packing.solve(wanted, weights, capacity)
    assert sum(n * p for n, p in found).tolist() == wanted.tolist()
    assert all(int((p * weights).sum()) <= capacity and n > 0 for n, p in found)
    first_fit = []
    for w in sorted(np.repeat(weights, wanted).tolist(), reverse=True):
        home = next((k for k, left in enumerate(first_fit) if left >= w), None)
        if home is None:
            first_fit.append(capacity - w)
        else:
            first_fit[home] -= w
    assert sum(n for n, _ in found) <= len(first_fit) + 2


def test_knapsack():
    value, counts = packing.best_pattern(np.array([0.6, 0.5, 0.26]), np.array([6, 5, 3]), 10)
    assert value == pytest.approx(1.0) and counts.tolist() == [0, 2, 0]
