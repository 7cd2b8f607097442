"""Token counts without ids.

1. *Frequent pre-tokens.* Tasks reduce their texts to distinct pre-tokens with their numbers; a shuffle by pre-token adds the numbers up. The
   most frequent ones of those that come more than once, HOT at most and all or none of one number, are 20 bytes each (a 128-bit digest and the count of pieces): their pieces are
   counted, once, and they go to every task.
2. *Frequencies.* A task sums frequency times count over the frequent pre-tokens of a text. The frequencies of the others (text, pre-token, number) are
   shuffled by pre-token and sorted, so each distinct one meets all its frequencies in one place, where its pieces are counted, once, and joined to them. More than
   HOT are as frequent as any of these, so none is more than one in HOT of all, and none is a task by itself.
3. *Sums.* The products are summed by text.
4. Rows get the count of their text by its digest; texts that make up one in HOT_TEXTS of all rows, HOT_TEXTS at most, by a broadcast.

A pre-token of the piece model is a run of spaces with the non-space characters after it. No piece of such a model holds a
space behind another character (``check`` verifies that when the model is loaded), so no merge crosses the start of a run, and
counts of pre-tokens add up to the count of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm import bpe, vectext, workspace

#: How the piece model writes a space.
MARK = "▁"
#: Distinct pre-tokens, and code points of them, that a worker holds before it starts anew.
CACHE_ROWS, CACHE_POINTS = 1 << 19, 1 << 24
#: Characters up to which a pre-token is its own key; a longer one's key is its SHA-256 in 64 digits, and the key of a text's own row has OWN.
KEY, OWN = 24, 33
#: Most pre-tokens (84 MB), and most texts (2 MB), that are broadcast.
HOT, HOT_TEXTS = 1 << 22, 1 << 16
_DIGEST, _COUNT = "quillmill_text_digest", "quillmill_token_count"


class PieceCounter:
    """Pre-tokens and their piece counts for a sentencepiece model."""

    cut = staticmethod(vectext.safe_cut)

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.check()

    def check(self) -> None:
        for k in range(self.model.get_piece_size()):
            if MARK in self.model.id_to_piece(k).lstrip(MARK):
                raise ValueError(f"piece {k} of the model holds a space behind another character")

    def prepare(self, texts: list) -> tuple[list, dict[int, int]]:
        """The texts to cut into pre-tokens, and the counts of those that the library has to count whole."""
        # the model writes its own mark and a space alike, and puts a space before a text that isn't empty
        return [" " + t.replace(MARK, " ") if t else "" for t in texts], {}

    def pretokens(self, parts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The joined parts, their code points, and the starts, ends and parts of the pre-tokens."""
        joined, points, starts = vectext.flatten(parts)
        space = points == 0x20
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[starts[:-1][starts[:-1] < len(points)]] = True
        begin = np.flatnonzero(first)
        return joined, points, begin, np.append(begin[1:], len(points)), np.searchsorted(starts, begin, "right") - 1

    def pieces(self, tokens: list[str]) -> np.ndarray:
        """Pieces of each pre-token. Each begins with a space, which is the one that the model puts first itself."""
        bare = [t[1:] for t in tokens]
        return np.array([len(x) if b else 1 for x, b in zip(self.model.encode(bare, num_threads=1), bare)], np.int64)


class BytePieceCounter(PieceCounter):
    """The same over the pre-tokens of a byte-level BPE file of the tokenizers library. A text that holds one of the file's
    added tokens is left to the library, which takes those out first."""

    cut = staticmethod(bpe.safe_cut)

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.vocabulary = bpe.Vocabulary.from_json(path)

    def prepare(self, texts: list) -> tuple[list, dict[int, int]]:
        whole = {k: len(self.library.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts) if t and any(a in t for a in self.added)}
        return [None if k in whole else t for k, t in enumerate(texts)], whole

    def pretokens(self, parts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        joined, points, starts = vectext.flatten(parts)
        begin = bpe.token_starts(points, starts)
        return joined, points, begin, np.append(begin[1:], len(points)), np.searchsorted(starts, begin, "right") - 1

    def pieces(self, tokens: list[str]) -> np.ndarray:
        return bpe.merge_many(self.vocabulary, [t.encode("utf-8", "surrogatepass") for t in tokens])[1]


@lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter:
    return BytePieceCounter(path) if path.endswith(".json") else PieceCounter(path)


class Distinct:
    """Rows of distinct pre-tokens. Each is held whole and compared, so two of one hash are two rows."""

    def __init__(self) -> None:
        self.table, self.tokens, self.clashes = vectext.SliceTable(), [], {}
        self.ends, self.pool = np.zeros(1, np.int64), np.zeros(1 << 16, np.uint32)

    @property
    def full(self) -> bool:
        return len(self.tokens) > CACHE_ROWS or int(self.ends[-1]) > CACHE_POINTS

    def rows(self, joined: str, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The row of each slice; new ones get the next rows."""
        hashes = vectext.SliceHasher(points)(begin, end)
        row = self.table.find(hashes).astype(np.int64)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            new, where, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            where = miss[where]
            row[miss] = self.table.add(new)[back]
            self._keep([joined[a:b] for a, b in zip(begin[where].tolist(), end[where].tolist())])
        # a hash that another slice had before
        size = end - begin
        other = np.flatnonzero(self.ends[row + 1] - self.ends[row] != size)
        if not len(other):
            at = np.cumsum(size) - size
            spread = np.arange(int(size.sum())) - np.repeat(at, size)
            differs = self.pool[spread + np.repeat(self.ends[row], size)] != points[spread + np.repeat(begin, size)]
            other = np.flatnonzero(np.logical_or.reduceat(differs, at)) if differs.any() else other
        else:
            other = np.array([k for k, (r, a, b) in enumerate(zip(row.tolist(), begin.tolist(), end.tolist())) if self.tokens[r] != joined[a:b]])
        for k in other.tolist():
            token = joined[begin[k] : end[k]]
            if token not in self.clashes:
                self.clashes[token] = len(self.tokens)
                self.table.rows += 1
                self._keep([token])
            row[k] = self.clashes[token]
        return row

    def _keep(self, tokens: list[str]) -> None:
        _, points, starts = vectext.flatten(tokens)
        used = int(self.ends[-1])
        if used + len(points) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(points)), np.uint32)])
        self.pool[used : used + len(points)] = points
        self.ends = np.concatenate([self.ends, used + starts[1:]])
        self.tokens += tokens


def frequencies(own: PieceCounter, texts: list, seen: Distinct) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts (places in ``texts``), rows of ``seen`` and how often that pre-token is in that text, for groups of bounded size. ``seen`` may be emptied
    between two groups."""
    for parts, owner in vectext.segments(texts, cut=own.cut):
        joined, points, begin, end, part = own.pretokens(parts)
        if len(begin):
            keys, number = np.unique(owner[part] << 32 | seen.rows(joined, points, begin, end), return_counts=True)
            yield keys >> 32, keys & 0xFFFFFFFF, number


def _key(token: str) -> str:
    return token if len(token) <= KEY else hashlib.sha256(token.encode("utf-8", "surrogatepass")).hexdigest()


def pretoken_numbers(texts: DataFrame, path: str) -> DataFrame:
    """key, long (the pre-token, where the key is not it) and n (how often it is in all texts) of every pre-token of the one column of ``texts`` that comes more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, number = counter(path), Distinct(), np.zeros(0, np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            order = sorted(range(len(seen.tokens)), key=seen.tokens.__getitem__)  # sorted keys compress better
            for a in range(0, len(order), 10_000):
                part = order[a : a + 10_000]
                tokens = [seen.tokens[k] for k in part]
                yield pa.RecordBatch.from_arrays([pa.array(map(_key, tokens), pa.string()), _long(tokens), pa.array(number[part])], ["key", "long", "n"])

        for b in batches:
            for _, row, n in frequencies(own, own.prepare(b.column(0).to_pylist())[0], seen):
                number = np.concatenate([number, np.zeros(len(seen.tokens) - len(number), np.int64)])
                number += np.bincount(row, weights=n, minlength=len(number)).astype(np.int64)
                if seen.full:
                    yield from flush()
                    seen.__init__()
                    number = np.zeros(0, np.int64)
        yield from flush()

    found = texts.mapInArrow(run, "key string, long string, n long").groupBy("key", "long").agg(F.sum("n").alias("n"))
    return workspace.stage(found.where("n > 1"), "pretokens")


def _long(tokens: list[str]) -> pa.Array:
    return pa.array([t if len(t) > KEY else None for t in tokens], pa.string())


def least_frequent(numbers: DataFrame) -> int:
    """The least n that HOT rows of ``numbers`` at most have or exceed."""
    # different numbers: fewer than the root of twice their sum
    held, least = 0, None
    for n, rows in sorted(((r["n"], r["rows"]) for r in numbers.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).collect()), reverse=True):
        held += rows
        if held > HOT:
            return n + 1 if least is None else least
        least = n
    return least or 0


def frequent_counts(texts: DataFrame, path: str) -> Frequent:
    """The piece counts of the frequent pre-tokens, which the driver holds."""
    numbers = pretoken_numbers(texts, path)
    least = least_frequent(numbers)

    @F.arrow_udf("long")
    def pieces(tokens: pa.Array) -> pa.Array:
        return pa.array(counter(path).pieces(tokens.to_pylist()), pa.int64())

    chosen = numbers.where(F.col("n") >= least)
    return Frequent(chosen.select(F.unhex(F.md5("key")).alias("digest"), pieces(F.coalesce("long", "key")).alias("pieces")).toArrow())


class Frequent:
    """Piece counts by the MD5 of a key, in arrays ordered by its first half."""

    def __init__(self, found: pa.Table) -> None:
        """found: digest (16 bytes) and pieces."""
        # straight from the buffers, without an object for each
        chunks = [c.cast(pa.binary(16)) for c in found.column("digest").chunks if len(c)]
        raw = [np.frombuffer(c.buffers()[1], ">u8")[2 * c.offset : 2 * (c.offset + len(c))] for c in chunks]
        digests = np.concatenate(raw or [np.zeros(0, ">u8")]).astype(np.uint64).reshape(-1, 2)
        order = np.lexsort((digests[:, 1], digests[:, 0]))
        self.first, self.second = digests[order].T.copy()
        self.counts = found.column("pieces").to_numpy()[order].astype(np.int32)

    def pieces(self, keys: list[str]) -> np.ndarray:
        """Pieces of each key, -1 for those that are not held."""
        out = np.full(len(keys), -1, np.int64)
        if not len(keys):
            return out
        want = np.frombuffer(b"".join([hashlib.md5(k.encode("utf-8", "surrogatepass")).digest() for k in keys]), ">u8").astype(np.uint64).reshape(-1, 2)
        at, last = np.searchsorted(self.first, want[:, 0]), np.searchsorted(self.first, want[:, 0], "right")
        left = np.flatnonzero(at < last)
        while len(left):  # once, unless two share the first half
            hit = self.second[at[left]] == want[left, 1]
            out[left[hit]] = self.counts[at[left[hit]]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < last[left]]
        return out


def _rest(texts: DataFrame, path: str, frequent: Frequent) -> DataFrame:
    """The frequencies ``n`` of each text's pre-tokens that are not ``frequent``; and for each row of ``texts`` (digest, text) a row with its
    sum over the frequent ones as ``n``, under a key that no pre-token has and without ``long``."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)
    names = ["digest", "key", "long", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, known, value = counter(path), Distinct(), shared.value, np.zeros(0, np.int64)
        for b in batches:
            ready, whole = own.prepare(b.column(1).to_pylist())
            digests, total = b.column(0), np.zeros(len(ready), np.int64)
            for k, n in whole.items():
                total[k] = n
            for text, row, n in frequencies(own, ready, seen):
                value = np.concatenate([value, known.pieces([_key(t) for t in seen.tokens[len(value) :]])])
                worth = value[row]
                total += vectext.joined_sums(n * np.maximum(worth, 0), text, len(ready))
                left = np.flatnonzero(worth < 0)
                if len(left):
                    each, back = np.unique(row[left], return_inverse=True)
                    tokens, at = [seen.tokens[r] for r in each.tolist()], pa.array(back)
                    yield pa.RecordBatch.from_arrays([digests.take(pa.array(text[left])), pa.array(map(_key, tokens), pa.string()).take(at), _long(tokens).take(at), pa.array(n[left].astype(np.int64))], names)
                if seen.full:
                    seen.__init__()
                    value = np.zeros(0, np.int64)
            # keys differ from text to text, so that these rows are spread over the tasks of the join
            keys = pa.array(["." + d.hex().zfill(OWN - 1) for d in digests.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([digests, keys, pa.nulls(len(keys), pa.string()), pa.array(total)], names)

    return texts.mapInArrow(run, "digest binary, key string, long string, n long")


def _products(rows: DataFrame, path: str) -> DataFrame:
    """digest, tokens and copies (1 for a text's own row) of the rows of ``_rest``. Rows of one key follow one another, so its pieces are counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, worth = counter(path), None, 0
        for b in batches:
            keys, long, n = b.column("key").to_pylist(), b.column("long"), b.column("n").to_numpy()
            mine = np.array([len(k) == OWN for k in keys], bool)
            new = np.array([not m and k != before for k, m, before in zip(keys, mine.tolist(), [last, *keys[:-1]])], bool)
            at = np.flatnonzero(new)
            tokens = [t if t is not None else keys[k] for k, t in zip(at.tolist(), long.take(pa.array(at)).to_pylist())]
            # the pieces of the key before the batch, then of each new one
            pieces = np.concatenate([[worth], own.pieces(tokens) if tokens else np.zeros(0, np.int64)]).astype(np.int64)
            products = np.where(mine, n, n * pieces[np.cumsum(new)])
            if keys:
                last, worth = keys[-1], int(pieces[-1])
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(products), pa.array(mine.astype(np.int64))], ["digest", "tokens", "copies"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "digest binary, tokens long, copies long")


def text_counts(texts: DataFrame, path: str) -> DataFrame:
    """digest, copies (rows with that text) and tokens of every distinct text of ``texts`` (digest, text)."""
    products = _products(_rest(texts, path, frequent_counts(texts.select("text"), path)), path)
    sums = products.groupBy("digest").agg(F.sum("tokens").alias("all"), F.sum("copies").alias("copies"))
    # every copy of a text brought the same sum
    return workspace.stage(sums.select("digest", "copies", F.expr("`all` div copies").alias("tokens")), "token-counts")


def with_token_count(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add the number of tokens (long) of every whole text under a sentencepiece ``.model`` or a byte-level BPE ``.json`` file
    at ``path``, which every executor must be able to open.

    Null and empty texts have 0 tokens. No begin, end or added special tokens, no truncation. Repeated rows each get their
    count; other columns pass through, nulls included, and a column named like the output is replaced. ``df`` is read four times and must
    give the same texts each time. An empty table gives an empty one.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.withColumn(_DIGEST, F.substring(F.unhex(F.sha2(body, 256)), 1, 12))
    found = text_counts(rows.select(F.col(_DIGEST).alias("digest"), body.alias("text")), path)
    every = found.agg(F.sum("copies")).head()[0] or 0
    counts = found.select(F.col("digest").alias(_DIGEST), F.col("tokens").alias(_COUNT), (F.col("copies") * HOT_TEXTS >= every).alias("often"))
    often, others = counts.where("often").drop("often"), counts.where("NOT often").drop("often")
    frequent = rows.join(F.broadcast(often), _DIGEST)
    rare = rows.join(F.broadcast(often.select(_DIGEST)), _DIGEST, "left_anti").join(others, _DIGEST)
    return frequent.unionByName(rare).withColumn(out, F.col(_COUNT)).drop(_DIGEST, _COUNT)
