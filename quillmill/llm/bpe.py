"""Byte-level BPE, encoding and decoding, over arrays.

Pre-tokenisation follows the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` without
a regular expression. A table gives every code point a class (letter, number, space, other white space, other); an
associative scan of keep-or-reset transition functions (``vectext.run_starts``) finds the run that each position lies in;
which run starts are token starts then depends on the neighbouring classes alone:

* a run of white space before a non-blank character gives up its last character: a space joins what follows, any other
  character is a token by itself; at the end of a text the run is one token;
* an apostrophe that begins a run of "other" characters, and has no space before it, takes the suffix letters s t m d,
  re ve ll with it; the rest of the letter run is a token of its own.

Every distinct slice is merged once per worker and cached (``merge_many`` merges new slices of about one size in lockstep, very
long ones with a heap each); the ids of a text are gathered from the cache by slice. Token byte lengths give each id's byte offset, which decoding uses.
"""

from __future__ import annotations

import base64
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache
from heapq import heappop, heappush
from itertools import islice
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm import vectext

if TYPE_CHECKING:
    from tokenizers import Tokenizer

LETTER, NUMBER, SPACE, BLANK, OTHER = range(5)
#: Slices that a cache holds before it starts anew.
CACHE_ROWS = 1 << 20
#: Bytes of a slice that merges in lockstep, slices that do so together, and the fewest of a size over 16 bytes for which that pays.
LONG, COLUMNS, FEW = 512, 1 << 13, 12
#: Groups of texts whose new slices merge together.
TOGETHER = 8
#: Places in the table of merges for each merge. Most pairs that are looked up have none, and in a sparse table they end at the first place.
PLACES = 16
_NONE = np.int64(2**31 - 1)
_LAST = np.int64(2**63 - 1)


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point. White space is what the Unicode property White_Space holds."""
    blank = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    major = np.frombuffer("".join(map(unicodedata.category, map(chr, range(sys.maxunicode + 1)))).encode(), np.uint8)[::2]
    table = np.full(len(major), OTHER, np.uint8)
    table[major == ord("L")] = LETTER
    table[major == ord("N")] = NUMBER
    table[blank] = BLANK
    table[0x20] = SPACE
    return table


def token_starts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the tokens of the pattern begin. ``starts``: of the texts, with the end; no token crosses one."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = class_table()[points]
    blank = (kind == SPACE) | (kind == BLANK)
    group = kind - (kind == BLANK).view(np.uint8)  # one class of white space
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    new |= edge[:n]
    # the last character of a run of white space that a non-blank character of the same text follows
    final = np.zeros(n, bool)
    final[:-1] = blank[:-1] & ~blank[1:] & ~edge[1:n]
    token = new | final
    after_space = np.zeros(n, bool)
    after_space[1:] = final[:-1] & (kind[:-1] == SPACE)
    token &= ~after_space
    quote = np.flatnonzero((points == ord("'")) & token)
    if len(quote):
        # The suffix must lie in the same text and be letters, so it is the head of the letter run that follows.
        at = lambda k: np.where(quote + k < n, points[np.minimum(quote + k, n - 1)], 0) * _same(quote, k, edge, n)
        one, two = at(1), at(2)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        size = np.where(short, 2, np.where(long, 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        token[quote + 1] = False
        rest = quote + size
        inside = rest < n
        rest = rest[inside]
        # a token begins right after the suffix, whatever is there, unless white space begins or a space joins it
        run = vectext.run_starts(new)
        cut = (run[rest] == run[rest - 1]) & ~edge[rest]
        token[rest[cut]] = True
    return np.flatnonzero(token)


def safe_cut(text: str, start: int, limit: int) -> int:
    """As ``vectext.safe_cut``, for this pattern alone: also before any white space behind another character, and between letters,
    numbers and others, unless an apostrophe stands before the cut. Only a run of one class longer than ``limit`` stays whole."""
    if len(text) - start <= limit:
        return len(text)
    at, step = start + limit // 2, limit // 2
    while at < len(text):
        kind = class_table()[np.frombuffer(text[at - 1 : at + step].encode("utf-32-le", "surrogatepass"), np.uint32)]
        blank = (kind == SPACE) | (kind == BLANK)
        good = ~blank[:-1] & (kind[1:] != kind[:-1])
        for k in np.flatnonzero(good)[::-1].tolist():
            if text[at - 1 + k] != "'":
                return at + k
        at += step
    return len(text)


def _same(at: np.ndarray, k: int, edge: np.ndarray, n: int) -> np.ndarray:
    """Whether ``at + k`` lies in the text of ``at``."""
    out = np.ones(len(at), bool)
    for j in range(1, k + 1):
        out &= ~edge[np.minimum(at + j, n)]
    return out


class Vocabulary:
    """Token bytes by id, with the merge of every pair of adjacent tokens that the ranks allow."""

    def __init__(self, tokens: list[bytes], pairs: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> None:
        """pairs: left id, right id, rank and merged id of each merge."""
        self.tokens = tokens
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.byte_ids = np.zeros(256, np.int32)
        for k, t in enumerate(tokens):
            if len(t) == 1:
                self.byte_ids[t[0]] = k
        left, right, rank, merged = (x.astype(np.int64) for x in pairs)
        self.table = vectext.SliceTable(max(16, (PLACES * len(rank) - 1).bit_length()))
        self.rank = np.append(rank, _NONE)
        keys = self._key(left, right)
        self.table.add(keys)
        # a byte for each place in the table, whether a key begins its search there: far smaller than the table, it answers most look-ups
        self.home = np.uint64(64 - self.table.bits)
        self.begun = np.zeros(1 << self.table.bits, bool)
        self.begun[keys >> self.home] = True
        # by rank: the id that comes of it; the rank of a pair of ids, one after the other in 32 bits
        self.merged = np.zeros(int(rank.max(initial=0)) + 1, np.int32)
        self.merged[rank] = merged
        self._pairs = left << 32 | right
        pair = np.arange(1 << 16)
        self.byte_ranks = self.ranks(self.byte_ids[pair >> 8], self.byte_ids[pair & 255])

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        # a product with an odd number differs for different pairs, and its high bits, which name the place, depend on both ids
        out = left.astype(np.uint64)
        out <<= np.uint64(32)
        out += right.astype(np.uint64)
        out += np.uint64(1)
        out *= np.uint64(0x9E3779B97F4A7C15)
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, _NONE where there is no merge."""
        keys = self._key(left, right)
        some = np.flatnonzero(self.begun.take((keys >> self.home).view(np.int64)))
        out = np.full(len(keys), _NONE)
        out[some] = self.rank.take(self.table.find(keys.take(some)))
        return out

    @cached_property
    def rank_of(self) -> dict[int, int]:
        return dict(zip(self._pairs.tolist(), self.rank.tolist()))

    @classmethod
    def from_ranks(cls, path: str) -> Vocabulary:
        """A file of lines "base64 rank": two tokens merge if their joined bytes have a rank, the lowest first."""
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        found: list[tuple[int, int, int]] = []
        for t, k in ranks.items():
            tokens[k] = t
            for j in range(1, len(t)):
                a, b = ranks.get(t[:j]), ranks.get(t[j:])
                if a is not None and b is not None:
                    found.append((a, b, k))
        a, b, k = np.array(found, np.int64).T
        return cls(tokens, (a, b, k, k))

    @classmethod
    def from_json(cls, path: str) -> Vocabulary:
        """A tokenizers file of a byte-level BPE model: its list of merges in order of rank."""
        model = json.load(open(path, encoding="utf-8"))["model"]
        # printable stand-ins for bytes, in the public byte-to-character table of byte-level BPE
        kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
        byte_of = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(kept))}
        vocab = model["vocab"]
        tokens: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for t, k in vocab.items():
            tokens[k] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        a = np.array([vocab[x] for x, _ in pairs])
        b = np.array([vocab[y] for _, y in pairs])
        k = np.array([vocab[x + y] for x, y in pairs])
        return cls(tokens, (a, b, np.arange(len(pairs)), k))


def _merge_columns(vocabulary: Vocabulary, data: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Merge slices of about one size in lockstep: each round every slice merges its leftmost pair of lowest rank.

    data: bytes (places, slices), of which a slice has the first of ``sizes``. Yields slices that are done, as places in ``sizes``, with
    the columns of their ids, where -1 is no id."""
    w, n = data.shape
    step, who = np.arange(w)[:, None], np.arange(n)
    ids = np.where(step < sizes, vocabulary.byte_ids[data], np.int32(-1))
    # rank and place of the pair that begins at each place; the places of the next and the last id
    key = np.full((w, n), _LAST)
    rank = vocabulary.byte_ranks[data[:-1].astype(np.int64) << 8 | data[1:]]
    np.copyto(key[:-1], rank << 20 | step[:-1], where=(rank != _NONE) & (step[1:] < sizes))
    after, before = np.tile(step + 1, n), np.tile(step - 1, n)
    while True:
        best = key.min(axis=0)
        on = np.flatnonzero(best != _LAST)
        if 3 * len(on) < 2 * len(who) or not len(on):
            done = best == _LAST
            yield who[done], ids[:, done]
            if not len(on):
                return
            # take, unlike an index, keeps rows one after another, so that the flat forms below are views
            ids, key, after, before = (x.take(on, axis=1) for x in (ids, key, after, before))
            who, sizes, best = who[on], sizes[on], best[on]
            on, n = np.arange(len(who)), len(who)
        best = best[on]
        at = best & 0xFFFFF
        flat_ids, flat_key, flat_after, flat_before = ids.reshape(-1), key.reshape(-1), after.reshape(-1), before.reshape(-1)
        here = at * n + on
        right = flat_after[here] * n + on
        merged = vocabulary.merged[best >> 20]
        flat_ids[here], flat_ids[right] = merged, -1
        beyond, left = flat_after[right], flat_before[here]
        flat_after[here] = beyond
        flat_key[here], flat_key[right] = _LAST, _LAST
        some, more = np.flatnonzero(beyond < sizes[on]), np.flatnonzero(left >= 0)
        beyond, left = beyond[some] * n + on[some], left[more] * n + on[more]
        flat_before[beyond] = at[some]
        rank = vocabulary.ranks(np.concatenate([merged[some], flat_ids[left]]), np.concatenate([flat_ids[beyond], merged[more]]))
        flat_key[np.concatenate([here[some], left])] = np.where(rank == _NONE, _LAST, rank << 20 | np.concatenate([at[some], left // n]))


def _merge_alone(vocabulary: Vocabulary, data: bytes) -> np.ndarray:
    """The ids of one slice of at least two bytes, with a heap of its pairs: time in proportion to n log n, memory to n."""
    ids = vocabulary.byte_ids[np.frombuffer(data, np.uint8)]
    n = len(ids)
    rank = vocabulary.ranks(ids[:-1], ids[1:])
    there = np.flatnonzero(rank != _NONE)
    heap = np.sort(rank[there] << 32 | there).tolist()  # in order, so a heap
    now, after, before = array("i", ids.tobytes()), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
    ranks, merged = vocabulary.rank_of, vocabulary.merged
    while heap:
        best = heappop(heap)
        at, rank = best & 0xFFFFFFFF, best >> 32
        right = after[at]
        # a pair that is no longer there has another rank, or an id that went
        if now[at] < 0 or right >= n or ranks.get(now[at] << 32 | now[right]) != rank:
            continue
        here = now[at] = int(merged[rank])
        now[right] = -1
        beyond, left = after[right], before[at]
        after[at] = beyond
        if beyond < n:
            before[beyond] = at
            if (rank := ranks.get(here << 32 | now[beyond])) is not None:
                heappush(heap, rank << 32 | at)
        if left >= 0 and (rank := ranks.get(now[left] << 32 | here)) is not None:
            heappush(heap, rank << 32 | left)
    out = np.frombuffer(now, np.int32)
    return out[out >= 0]


def merge_many(vocabulary: Vocabulary, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all slices one after another, and how many each has. Slices of up to LONG bytes merge in lockstep with others of about
    their size, longer ones and those of a rare size alone."""
    sizes = np.fromiter(map(len, slices), np.int64, len(slices))
    flat = np.frombuffer(b"".join(slices), np.uint8)
    start = np.cumsum(sizes) - sizes
    found: list[tuple[np.ndarray, np.ndarray]] = []
    width = np.where(sizes <= 10, 10, np.where(sizes <= 16, 16, -(-sizes // 32) * 32))
    for w in np.unique(width[sizes > 0]).tolist():
        own = np.flatnonzero(width == w)
        if w > LONG or w > 16 and len(own) < FEW:
            found += [(np.array([k]), _merge_alone(vocabulary, slices[k])[:, None]) for k in own.tolist()]
            continue
        for a in range(0, len(own), COLUMNS):
            mine = own[a : a + COLUMNS]
            places = np.minimum(start[mine] + np.arange(w)[:, None], len(flat) - 1)
            found += [(mine[who], ids) for who, ids in _merge_columns(vocabulary, flat[places], sizes[mine])]
    counts = np.zeros(len(slices), np.int64)
    for who, ids in found:
        counts[who] = (ids >= 0).sum(axis=0)
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.int32)
    for who, ids in found:
        n = counts[who]
        own = ids.T
        out[np.arange(int(n.sum())) + np.repeat(first[who] - np.cumsum(n) + n, n)] = own[own >= 0]
    return out, counts


class Encoder:
    """Texts to ids, with a cache of slices that lasts as long as the worker."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self._reset()

    def _reset(self) -> None:
        self.table = vectext.SliceTable()
        # of each slice, where its ids are in the pool and how many
        self.spans = np.zeros((1 << 12, 2), np.int64)
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = 0
        # new slices, in the order of their rows, that are not merged yet
        self.waiting: list[bytes] = []

    def slices(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cache rows of the tokens of the pattern in ``parts``, in order, and how many each part has. New rows have their ids after ``settle``."""
        joined, points, starts = vectext.flatten(parts)
        begin = token_starts(points, starts)
        per_part = np.diff(np.searchsorted(begin, starts))
        if not len(begin):
            return np.zeros(0, np.int32), per_part
        end = np.append(begin[1:], len(points))
        hashes = vectext.SliceHasher(points)(begin, end)
        row = self.table.find(hashes)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            new, where, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            where = miss[where]
            self.waiting += [joined[a:b].encode("utf-8", "surrogatepass") for a, b in zip(begin[where].tolist(), end[where].tolist())]
            row[miss] = self.table.add(new)[back]
        return row, per_part

    def settle(self) -> None:
        """Merge the slices that wait."""
        if self.waiting:
            self.keep(*merge_many(self.vocabulary, self.waiting))
            self.waiting = []

    def keep(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Take up the ids of the table's newest rows. Both arrays double where they are full, so a row is copied a few times, however many come."""
        rows = self.table.rows
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.int32)])
        if rows > len(self.spans):
            self.spans = np.concatenate([self.spans, np.zeros((max(len(self.spans), rows - len(self.spans)), 2), np.int64)])
        self.pool[self.used : self.used + len(ids)] = ids
        new = self.spans[rows - len(counts) : rows]
        new[:, 0] = self.used + np.cumsum(counts) - counts
        new[:, 1] = counts
        self.used += len(ids)

    def ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of slices by cache row, one after another, and where those of each begin, with the end."""
        spans = self.spans.take(rows, axis=0)
        bounds = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(spans[:, 1], out=bounds[1:])
        at = np.repeat(spans[:, 0] - bounds[:-1], spans[:, 1])
        at += np.arange(len(at))
        return self.pool.take(at), bounds

    def encode(self, texts: list) -> list[np.ndarray]:
        """Ids of each text (None: empty)."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        groups = vectext.segments(texts, cut=safe_cut)
        while found := [(*self.slices(parts), owner) for parts, owner in islice(groups, TOGETHER)]:
            self.settle()
            for rows, per_part, owner in found:
                ids, per_slice = self.ids(rows)
                bounds = per_slice[np.concatenate([[0], np.cumsum(per_part)])]
                for k, a, b in zip(owner.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    out[k].append(ids[a:b])
            if self.table.rows > CACHE_ROWS:
                self._reset()
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids."""
        tokens = self.vocabulary.tokens
        return b"".join([tokens[k] for k in ids.tolist()])

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte offset of each id in the decoded text, with the end."""
        return np.concatenate([[0], np.cumsum(self.vocabulary.lengths[ids])])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """This worker's encoder for a file of ranks (.tiktoken) or of the tokenizers library (.json)."""
    return Encoder(Vocabulary.from_json(path) if path.endswith(".json") else Vocabulary.from_ranks(path))


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list array of the parts."""
    starts = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=starts[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False), kind))


def with_ids(df: DataFrame, path: str, text: str = "text", ids: str = "ids", offsets: str | None = None) -> DataFrame:
    """Add the ids of every whole text (``array<int>``) and, if ``offsets`` names a column, the byte offset of each id in the
    UTF-8 text (``array<int>``, one more than ids).

    ``path``: a rank or tokenizers file that every executor can open. Null and empty texts have no ids. Special strings are
    ordinary text. Other columns, null or not, pass through; a column named like an output is replaced. Row by row, without a
    shuffle; a text of any length is encoded in pieces of bounded size.
    """

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return list_array(encoder(path).encode(texts.to_pylist()), pa.int32())

    df = df.withColumn(ids, encode(F.col(text)))
    if offsets is None:
        return df

    @F.arrow_udf("array<int>")
    def place(of: pa.Array) -> pa.Array:
        e = encoder(path)
        return list_array([e.offsets(np.asarray(x.values, np.int64)) for x in of], pa.int32())

    return df.withColumn(offsets, place(F.col(ids)))


def with_decoded(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes (``binary``) that the ids of every row stand for. Null ids give null, no ids give no bytes."""

    @F.arrow_udf("binary")
    def decode(of: pa.Array) -> pa.Array:
        e = encoder(path)
        flat, ends = np.asarray(of.flatten()), np.cumsum(of.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        starts = [0, *ends[:-1].tolist()]
        return pa.array([e.decode(flat[a:b]) if there else None for a, b, there in zip(starts, ends.tolist(), of.is_valid().to_pylist())], pa.binary())

    return df.withColumn(out, decode(F.col(ids)))


class LibraryEncoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file, without its truncation, padding or added tokens at
    the ends. A text that holds one of the file's added tokens is left to the library, which takes those out first."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.added = [t["content"] for t in json.load(open(path, encoding="utf-8")).get("added_tokens") or []]
        self.encoder = encoder(path)

    @cached_property
    def library(self) -> Tokenizer:
        """The library's own tokenizer. A worker whose texts hold no added token never loads it."""
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.path)
        library.no_truncation()
        library.no_padding()
        return library

    def encode(self, texts: list) -> list[np.ndarray]:
        special = {k for k, t in enumerate(texts) if t and any(a in t for a in self.added)}
        out = self.encoder.encode([None if k in special else t for k, t in enumerate(texts)])
        for k in special:
            out[k] = np.array(self.library.encode(texts[k], add_special_tokens=False).ids, np.int32)
        return out


@lru_cache(maxsize=4)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def forget() -> None:
    """Drop this worker's encoders with their tables and caches, also those that a library encoder is made of."""
    library_encoder.cache_clear()
    encoder.cache_clear()
