"""Token-id files: an adaptive context-mixing range coder over blocks that are reset and checked one by one.

*Predictions.* Ids are ranked by their number in the chunk. Order 2 and order 1 each predict one rank from a table by the last two ranks or
the last one, with a confidence from 0 to 3; only the ranks below NEVER are predicted. Order 0 is a distribution over classes of
ranks: the first eight ranks alone, then quarters of an octave, of at most 4096 ranks; ranks of a class count as equally frequent.

*Mixing.* The probability of a rank is w2 [order 2 predicts it] + w1 [order 1 predicts it] + w0 (order 0). The weights depend on both confidences
and adapt: they follow how often each order was the one to name the id so far in the block. So does the distribution over the
classes. Both are renewed at the end of windows of 32, 64 and then 128 ids, from what encoder and decoder have both seen.

*Coder.* A range coder with a range of 31 to 63 bits and words of 32 bits, carries kept in the words until the end.

*Blocks.* Each begins with empty tables and weights and the chunk's frequencies of the classes, so a damaged block costs no other. All
blocks of a group are coded in lockstep: step t codes the t-th id of every block, as rows of arrays, in the encoder and the decoder
alike. The encoder, which knows the ids, looks up probabilities for BATCH steps at once.

*Files* are chunks one after another, each of about CHUNK ids and at least one document, so memory is bounded on both sides and chunks are read
apart from one another. A chunk (little-endian): ``QMID`` magic, format (u16), flags (u16), number of documents (u32), of blocks (u32), of
ids (u64); for each document its identifier (i64), a null mark (u8) and its ids (u32); for each block its ids (u32), its words (u32), CRC-32
of its words (u32) and of its ids (u32); the number of ids in each class (64 u32); the number of ranks (u32) and the id of each (u16); CRC-32
of all of that (u32); the words of the blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm import bpe, workspace
from quillmill.sources import stores

MAGIC, FORMAT = b"QMID", 2
_HEAD = struct.Struct("<4sHHIIQ")
#: Ids in a block, and blocks that are coded in lockstep: a chunk has the shortest blocks that make one group of it.
SMALLEST, LARGEST, GROUP = 1024, 2048, 4096
#: Ids from which a chunk is full, and chunks of a file.
CHUNK, FILE_CHUNKS = LARGEST * GROUP, 32
#: Ids must be below this.
LIMIT = 1 << 16
#: Parts of the mixing weights and of the classes' distribution, and entries of a block's table of predictions, in bits.
WEIGHT_BITS, CLASS_BITS, TABLE_BITS = 10, 9, 10
#: The first rank that is not predicted.
NEVER = (1 << 14) - 1
#: Steps whose probabilities the encoder looks up at once; ids of the windows after which weights are renewed, the last one repeated.
BATCH, WINDOWS = 8, (32, 64, 128)
#: What an id adds to the counts behind the weights and behind the classes, and the sums from which they are halved.
GAIN, CLASS_GAIN, MOST, CLASS_MOST = 16, 2, 2000, 1000
#: Parts of the chunk's frequencies that a block begins with.
PRIOR = 300
_SIZES = [1] * 8 + [1 << (k - 2) for k in range(3, 13) for _ in range(4)] + [1 << 12] * 14
#: First rank and bits of place of each class; HIT stands for an id that a prediction named.
HIT = 63
_START, _PLACE = np.zeros(64, np.uint64), np.zeros(64, np.uint64)
_START[: len(_SIZES)], _PLACE[: len(_SIZES)] = np.cumsum([0, *_SIZES[:-1]]), np.log2(_SIZES)
CLASS_OF = np.repeat(np.arange(len(_SIZES), dtype=np.uint8), _SIZES)
# numbers as arrays, which operations on arrays take up faster
_ONE, _TWO, _THREE, _FOUR, _NEVER, _FIRST, _SECOND, _SHIFT, _SLOT = (np.array(k, np.uint16) for k in (1, 2, 3, 4, NEVER, 0x9E5B, 0x6D2B, 16 - TABLE_BITS, (1 << TABLE_BITS) - 1))
_WEIGHT, _CLASS, _FLOOR, _HALF, _SIXTEEN, _TOP, _WORD, _REST, _LAST = (np.array(k, np.uint64) for k in (WEIGHT_BITS, CLASS_BITS, 1 << 31, 0xFFFF, 16, 31, 32, (1 << 31) - 1, (1 << CLASS_BITS) - 1))


class _Model:
    """Predictions, mixing weights and class distributions of ``n`` blocks. ``prior``: ids of the chunk in each class.

    Every table has a row for each context and a column for each block: blocks that are in one of the few frequent contexts find their entries side by side."""

    def __init__(self, n: int, prior: np.ndarray) -> None:
        self.n, self.lane = n, np.arange(n)
        # order 1, then order 2; an entry is a rank and its confidence
        self.tables = np.full(2 * n << TABLE_BITS, NEVER << 2, np.uint16)
        second, first = np.divmod(np.arange(16), 4)
        begin = np.stack([8 + 24 * second, 8 + 8 * first, 64 - 8 * second]).astype(np.int32)
        self.counts = np.repeat(begin[:, :, None], n, axis=2)
        self.used = int(np.flatnonzero(prior)[-1]) + 1 if prior.any() else 1
        share = prior[: self.used].astype(np.int64) * PRIOR // max(int(prior.sum()), 1)
        self.order0 = np.repeat(np.maximum(1, share).astype(np.int32)[:, None], n, axis=1)
        # bounds of the parts of order 2 and order 1 by confidences; start and size of parts by confidences and order, and of classes: low and high halves
        self.weights, self.parts, self.classes = np.zeros((16, n), np.uint64), np.zeros((16, 4, n), np.uint64), np.zeros((64, n), np.uint64)
        self.classes[HIT] = 1 << CLASS_BITS << 16
        self.closes, self.windows = 0, 0
        self._spread()

    def begin(self, t: int) -> bool:
        """Called before step t; whether a window begins, with what was learned from the one before."""
        if t < self.closes:
            return False
        if t:
            self._learn()
        size = WINDOWS[min(self.windows, len(WINDOWS) - 1)]
        self.opened, self.closes, self.windows = t, t + size, self.windows + 1
        # what was coded: confidences and order, class; 3 and HIT count for nothing
        self.orders, self.seen = np.full((size, self.n), 3, np.uint8), np.full((size, self.n), HIT, np.uint8)
        return True

    def _tally(self, codes: np.ndarray) -> np.ndarray:
        at = codes.astype(np.int64)
        at *= self.n
        at += self.lane
        return np.bincount(at.reshape(-1), minlength=self.n << 6).astype(np.int32).reshape(64, self.n)

    def _learn(self) -> None:
        found = self._tally(self.orders).reshape(16, 4, self.n)
        for k, own in enumerate(self.counts):
            own += found[:, k] * np.int32(GAIN)
        self.counts >>= (self.counts.sum(axis=0, dtype=np.int32) > MOST).view(np.int8)
        self.order0 += self._tally(self.seen)[: self.used] * np.int32(CLASS_GAIN)
        self.order0 -= (self.order0 >> 1) * (self.order0.sum(axis=0, dtype=np.int32) > CLASS_MOST)
        self._spread()

    def _spread(self) -> None:
        """Weights and distributions from the counts. Order 0 keeps at least 8 parts, the others 1, every class in use 1."""
        two, one, none = self.counts
        upper = two + one
        whole = upper + none
        room = (1 << WEIGHT_BITS) - 10
        lower, upper = two * room // whole + 1, upper * room // whole + 2
        np.copyto(self.weights, lower | upper << 16, casting="unsafe")
        for k, (start, end) in enumerate(((0, lower), (lower, upper), (upper, 1 << WEIGHT_BITS))):
            np.copyto(self.parts[:, k], start | (end - start) << 16, casting="unsafe")
        edge = np.cumsum(self.order0, axis=0, dtype=np.int32)
        whole = edge[-1].copy()
        edge *= (1 << CLASS_BITS) - self.used
        edge //= whole
        edge += np.arange(1, self.used + 1, dtype=np.int32)[:, None]
        sizes = edge.copy()
        sizes[1:] -= edge[:-1]
        edge -= sizes
        self.firsts = edge
        np.copyto(self.classes[: self.used], edge | sizes << 16, casting="unsafe")

    def lookup(self) -> np.ndarray:
        """The class at each part of the distributions."""
        marks = np.zeros((1 << CLASS_BITS, self.n), np.uint8)
        marks.reshape(-1)[self.firsts[1:] * np.int64(self.n) + self.lane] = 1
        for above, row in zip(marks, marks[1:]):
            np.add(row, above, out=row)
        return marks.reshape(-1)


def _renew(entries: np.ndarray, ranked: np.ndarray, sure: np.ndarray, hit: np.ndarray) -> None:
    """``sure``: the confidences of ``entries`` (both are overwritten). It becomes the new entries: the rank that came (``ranked``, in the place
    of entries), more sure if it was the one predicted, and unsure if not."""
    np.bitwise_xor(entries, ranked, out=entries)
    np.less(entries, _FOUR, out=hit)
    np.add(sure, _ONE, out=sure)
    np.minimum(sure, _THREE, out=sure)
    np.multiply(sure, hit, out=sure)
    np.add(sure, ranked, out=sure)


def _live(lengths: np.ndarray) -> np.ndarray:
    """How many of the blocks (longest first) have a t-th id, for each t."""
    return np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left")


def _encode_group(ranks: np.ndarray, lengths: np.ndarray, prior: np.ndarray) -> list[bytes]:
    """The words of blocks, longest first. ``ranks``: (steps, blocks)."""
    steps, n = ranks.shape
    model = _Model(n, prior)
    tables, parts, classes, live, lane, blocks = model.tables, model.parts.reshape(-1), model.classes.reshape(-1), _live(lengths), model.lane, np.array(n)
    low, span = np.zeros(n, np.uint64), np.full(n, (1 << 63) - 1, np.uint64)
    room = steps // 3 + BATCH + 8
    words = np.zeros((n, room), np.uint64)
    flat, rows = words.reshape(-1), lane * room
    count = rows.copy()
    last, before = np.zeros(n, np.uint16), np.zeros(n, np.uint16)
    t = 0
    while t < steps:
        model.begin(t)
        m = int(live[t])
        w = min(BATCH, model.closes - t, int(np.searchsorted(-live[t:], -m, "right")))
        if int((count - rows).max()) + BATCH + 4 > room:  # an id adds a word at most
            words, count, rows = np.concatenate([words, np.zeros_like(words)], axis=1), count + lane * room, rows + lane * room
            flat, room = words.reshape(-1), 2 * room
        own = ranks[t : t + w, :m]
        run = np.concatenate([before[None, :m], last[None, :m], own])
        before[:m], last[:m] = run[-2], run[-1]
        at = np.empty((w, 2, m), np.int64)
        at[:, 0] = run[1:-1] & _SLOT
        at[:, 1] = (run[:-2] * _SECOND + run[1:-1] * _FIRST) >> _SHIFT
        at[:, 1] += 1 << TABLE_BITS
        at *= n
        at += lane[:m]
        ranked = np.minimum(own, _NEVER) << _TWO
        entries = np.empty((w, 2, m), np.uint16)
        work, sure, hit = np.empty((2, m), np.uint16), np.empty((2, m), np.uint16), np.empty((2, m), bool)
        for place, entry, s in zip(at, entries, ranked):
            tables.take(place, out=entry, mode="clip")
            np.bitwise_and(entry, _THREE, out=sure)
            np.copyto(work, entry)
            _renew(work, s, sure, hit)
            tables[place] = sure
        named = (entries >> _TWO) == own[:, None]
        order = 2 - named[:, 0].view(np.uint8)  # 0 for order 2, 1 for order 1, 2 for order 0
        order *= ~named[:, 1]
        sure = (entries & _THREE).astype(np.uint8)
        context = (sure[:, 1] << 2) + sure[:, 0]
        kind = CLASS_OF.take(own)
        kind |= (order < 2) * np.uint8(HIT)
        k = t - model.opened
        context <<= 2
        context += order
        model.orders[k : k + w, :m], model.seen[k : k + w, :m] = context, kind
        share = parts.take(context * blocks + lane[:m])
        start, size = share & _HALF, share >> _SIXTEEN
        share = classes.take(kind * blocks + lane[:m])
        first, width, bits = share & _HALF, share >> _SIXTEEN, _PLACE.take(kind)
        place = own - _START.take(kind)
        place *= order == 2
        r, o, c = span[:m], low[:m], count[:m]
        part, ahead, small = np.empty(m, np.uint64), np.empty(m, np.uint64), np.empty(m, bool)
        for k in range(w):
            for bits_of, begin, wide in ((_WEIGHT, start[k], size[k]), (_CLASS, first[k], width[k])):
                np.right_shift(r, bits_of, out=part)
                np.multiply(part, begin, out=ahead)
                np.add(o, ahead, out=o)
                np.multiply(part, wide, out=r)
            np.right_shift(r, bits[k], out=r)
            np.multiply(r, place[k], out=ahead)
            np.add(o, ahead, out=o)
            np.less(r, _FLOOR, out=small)
            who = small.nonzero()[0]
            if len(who):
                settled, to = o.take(who), c.take(who)
                flat[to] = settled >> _TOP
                to += 1
                c[who] = to
                settled &= _REST
                settled <<= _WORD
                o[who] = settled
                r[who] = r.take(who) << _WORD
        t += w
    flat[count] = low >> _TOP
    flat[count + 1] = (low & _REST) << _ONE.astype(np.uint64)
    count += 2
    while (carry := words >> _WORD).any():
        words &= np.uint64(0xFFFFFFFF)
        words[:, :-1] += carry[:, 1:]
    return [words[k, :size].astype("<u4").tobytes() for k, size in enumerate((count - rows).tolist())]


def _decode_group(blocks: list[bytes], lengths: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """The ranks (steps, blocks) of the words of blocks, longest first."""
    n, steps = len(blocks), int(lengths[0])
    model = _Model(n, prior)
    tables, live = model.tables, _live(lengths)
    weights, parts, classes = (x.reshape(-1) for x in (model.weights, model.parts, model.classes))
    longest = max(map(len, blocks)) // 4 + 2
    words = np.zeros((n, longest), np.uint32)
    for k, b in enumerate(blocks):
        words[k, : len(b) // 4] = np.frombuffer(b, "<u4")
    # the register holds 63 bits, so what follows it is a word from the middle of two
    register = words[:, 0].astype(np.uint64) << _TOP | words[:, 1] >> np.uint32(1)
    following = (words & np.uint32(1)) << np.uint32(31)
    following[:, :-1] |= words[:, 1:] >> np.uint32(1)
    flat, count = following.reshape(-1), np.arange(n) * longest + 1
    span = np.full(n, (1 << 63) - 1, np.uint64)
    out = np.zeros((steps, n), np.uint16)
    one = two_back = np.zeros(n, np.uint16)
    hit_class, two, blocks = np.array(HIT, np.uint8), np.array(2, np.uint8), np.array(n)
    m = -1
    for t in range(steps):
        if model.begin(t):
            lookup = model.lookup()
        if live[t] != m:
            m = int(live[t])
            lane = model.lane[:m]
            slots = np.stack([lane, lane + (n << TABLE_BITS)])
            r, code, c = span[:m], register[:m], count[:m]
            part, value, x, y = np.empty((4, m), np.uint64)
            place, at = np.empty((2, m), np.int64), np.empty(m, np.int64)
            entries, predicted, sure = np.empty((3, 2, m), np.uint16)
            a, b = np.empty((2, m), np.uint16)
            above, beyond, named, small = np.empty((4, m), bool)
            hit, order = np.empty((2, m), bool), np.empty(m, np.uint8)
        np.bitwise_and(one, _SLOT, out=a)
        np.multiply(a, blocks, out=place[0])
        np.multiply(two_back, _SECOND, out=a)
        np.multiply(one, _FIRST, out=b)
        np.add(a, b, out=a)
        np.right_shift(a, _SHIFT, out=a)
        np.multiply(a, blocks, out=place[1])
        np.add(place, slots, out=place)
        tables.take(place, out=entries, mode="clip")
        np.right_shift(entries, _TWO, out=predicted)
        np.bitwise_and(entries, _THREE, out=sure)
        # which order
        np.left_shift(sure[1], _TWO, out=a)
        np.add(a, sure[0], out=a)
        np.multiply(a, blocks, out=at)
        np.add(at, lane, out=at)
        weights.take(at, out=x, mode="clip")
        np.bitwise_and(x, _HALF, out=y)
        np.right_shift(x, _SIXTEEN, out=x)
        np.right_shift(r, _WEIGHT, out=part)
        np.floor_divide(code, part, out=value)
        np.greater_equal(value, y, out=above)
        np.greater_equal(value, x, out=beyond)
        np.add(above.view(np.uint8), beyond.view(np.uint8), out=order)
        k = t - model.opened
        np.left_shift(a, _TWO, out=a)
        np.add(a, order, out=a)
        np.copyto(model.orders[k, :m], a, casting="unsafe")
        np.multiply(a, blocks, out=at)
        np.add(at, lane, out=at)
        parts.take(at, out=y, mode="clip")
        np.bitwise_and(y, _HALF, out=x)
        np.multiply(x, part, out=x)
        np.subtract(code, x, out=code)
        np.right_shift(y, _SIXTEEN, out=y)
        np.multiply(y, part, out=r)
        # which class, HIT where a prediction holds
        np.right_shift(r, _CLASS, out=part)
        np.floor_divide(code, part, out=value)
        np.minimum(value, _LAST, out=value)
        np.multiply(value.view(np.int64), blocks, out=at)
        np.add(at, lane, out=at)
        kind = model.seen[k, :m]
        lookup.take(at, out=kind, mode="clip")
        np.less(order, two, out=named)
        np.multiply(named.view(np.uint8), hit_class, out=order)
        np.bitwise_or(kind, order, out=kind)
        np.multiply(kind, blocks, out=at)
        np.add(at, lane, out=at)
        classes.take(at, out=y, mode="clip")
        np.bitwise_and(y, _HALF, out=x)
        np.multiply(x, part, out=x)
        np.subtract(code, x, out=code)
        np.right_shift(y, _SIXTEEN, out=y)
        np.multiply(y, part, out=r)
        # the place in the class
        np.copyto(at, kind)
        _PLACE.take(at, out=x, mode="clip")
        np.right_shift(r, x, out=r)
        np.floor_divide(code, r, out=value)
        np.multiply(value, r, out=x)
        np.subtract(code, x, out=code)
        _START.take(at, out=x, mode="clip")
        np.add(value, x, out=value)
        row = out[t, :m]
        np.copyto(row, value, casting="unsafe")
        np.copyto(row, predicted[0], where=named)
        np.logical_not(above, out=above)
        np.copyto(row, predicted[1], where=above)
        np.less(r, _FLOOR, out=small)
        who = small.nonzero()[0]
        if len(who):
            to = c.take(who)
            got = code.take(who)
            got <<= _WORD
            got |= flat.take(to, mode="clip")
            code[who] = got
            to += 1
            c[who] = to
            r[who] = r.take(who) << _WORD
        np.minimum(row, _NEVER, out=a)
        np.left_shift(a, _TWO, out=a)
        _renew(entries, a, sure, hit)
        tables[place] = sure
        if t + 1 < steps:
            two_back, one = one[: live[t + 1]], row[: live[t + 1]]
    return out


def ranking(ids: np.ndarray) -> np.ndarray:
    """The distinct ids (u16) from the most frequent to the rarest, ties in ascending order."""
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= LIMIT):
        raise ValueError(f"ids must be from 0 to {LIMIT - 1}")
    counts = np.bincount(ids, minlength=1)
    order = np.argsort(-counts, kind="stable")
    return order[: int((counts > 0).sum())].astype(np.uint16)


def encode_blocks(ids: np.ndarray, ranked: np.ndarray, prior: np.ndarray, length: int) -> list[tuple[int, bytes, int]]:
    """(ids, words, CRC-32 of the ids) of the blocks of ``length`` ids each; the last one may be shorter."""
    out = []
    rank_of = np.zeros(LIMIT, np.uint16)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint16)
    for a in range(0, len(ids), length * GROUP):
        part = ids[a : a + length * GROUP]
        lengths = np.full(-(-len(part) // length), length, np.int64)
        lengths[-1] = len(part) - length * (len(lengths) - 1)
        grid = np.zeros((len(lengths), length), np.uint16)
        grid.reshape(-1)[: len(part)] = rank_of[part]
        raw = part.astype("<u4")
        for k, words in enumerate(_encode_group(np.ascontiguousarray(grid[:, : int(lengths[0])].T), lengths, prior)):
            out.append((int(lengths[k]), words, zlib.crc32(raw[k * length : k * length + int(lengths[k])])))
    return out


def decode_blocks(blocks: list[tuple[int, bytes, int]], ranked: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """The ids of the blocks. A block whose ids don't match its CRC-32 raises ValueError."""
    out = []
    id_of = np.zeros(LIMIT, "<u4")
    id_of[: len(ranked)] = ranked
    for a in range(0, len(blocks), GROUP):
        part = blocks[a : a + GROUP]
        lengths = np.array([b[0] for b in part], np.int64)
        order = np.argsort(-lengths, kind="stable")
        ranks = _decode_group([part[k][1] for k in order], lengths[order], prior).T
        column = np.empty(len(order), np.int64)
        column[order] = np.arange(len(order))
        for k, (n, _, crc) in enumerate(part):
            ids = id_of.take(ranks[column[k], :n])
            if zlib.crc32(ids) != crc:
                raise ValueError(f"block {a + k}: the ids don't match their checksum")
            out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, "<u4")


@dataclass
class IdChunk:
    """Documents (identifier or None, number of ids) and the ids of all of them in order."""

    docs: list[tuple[int | None, int]]
    ids: np.ndarray

    def to_bytes(self) -> bytes:
        n = len(self.ids)
        ranked = ranking(self.ids)
        counts = np.zeros(64, np.int64)
        if n:
            by_rank = np.bincount(self.ids)[ranked]
            counts += np.bincount(CLASS_OF[: len(ranked)], weights=by_rank, minlength=64).astype(np.int64)
        blocks = encode_blocks(self.ids, ranked, counts, max(SMALLEST, min(LARGEST, -(-n // GROUP))))
        head = [_HEAD.pack(MAGIC, FORMAT, 0, len(self.docs), len(blocks), n)]
        head += [struct.pack("<qBI", k or 0, k is None, size) for k, size in self.docs]
        head += [struct.pack("<IIII", size, len(words) // 4, zlib.crc32(words), crc) for size, words, crc in blocks]
        head += [counts.astype("<u4").tobytes(), struct.pack("<I", len(ranked)), ranked.astype("<u2").tobytes()]
        first = b"".join(head)
        return b"".join([first, struct.pack("<I", zlib.crc32(first)), *(words for _, words, _ in blocks)])

    @classmethod
    def from_bytes(cls, data: bytes) -> IdChunk:
        """Read a chunk; ValueError where it is damaged."""
        magic, form, _, docs, blocks, n = _HEAD.unpack_from(data)
        if magic != MAGIC or form != FORMAT:
            raise ValueError("not an id file of this format")
        listed = _HEAD.size + 13 * docs + 16 * blocks
        ranks = listed + 256 + 4
        if ranks > len(data):
            raise ValueError("the directory is cut off")
        at = ranks + 2 * struct.unpack_from("<I", data, ranks - 4)[0]
        if at + 4 > len(data) or zlib.crc32(data[:at]) != struct.unpack_from("<I", data, at)[0]:
            raise ValueError("the directory doesn't match its checksum")
        named = [(None if null else k, size) for k, null, size in struct.iter_unpack("<qBI", data[_HEAD.size : _HEAD.size + 13 * docs])]
        place, found = at + 4, []
        for size, words, crc, ids_crc in struct.iter_unpack("<IIII", data[listed - 16 * blocks : listed]):
            raw = data[place : place + 4 * words]
            if zlib.crc32(raw) != crc:
                raise ValueError(f"block {len(found)} doesn't match its checksum")
            found.append((size, raw, ids_crc))
            place += 4 * words
        ids = decode_blocks(found, np.frombuffer(data[ranks:at], "<u2"), np.frombuffer(data[listed : listed + 256], "<u4"))
        if len(ids) != n or sum(size for _, size in named) != n:
            raise ValueError("the number of ids doesn't match")
        return cls(named, ids)


class _Writer:
    """The files of one task: ``part-PPPPP-NNNN-ATTEMPT.qmid``. A name holds its attempt, so no attempt touches another's file."""

    def __init__(self, uri: str, part: int, attempt: int) -> None:
        self.store, self.folder = stores.file_system(uri)
        self.store.create_dir(self.folder, recursive=True)
        self.part, self.attempt, self.chunks, self.out = part, attempt, 0, None

    def add(self, chunk: IdChunk) -> pa.RecordBatch:
        """Write a chunk; its row of the manifest."""
        if self.chunks % FILE_CHUNKS == 0:
            self.close()
            self.name = f"part-{self.part:05d}-{self.chunks // FILE_CHUNKS:04d}-{self.attempt}.qmid"
            self.out = self.store.open_output_stream(f"{self.folder}/{self.name}")
        data, offset = chunk.to_bytes(), self.out.tell()
        self.out.write(data)
        self.chunks += 1
        kinds = zip(("part", "seq", "offset", "bytes", "docs", "ids"), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), (self.part, self.chunks - 1, offset, len(data), len(chunk.docs), len(chunk.ids)))
        return pa.RecordBatch.from_pydict({"file": pa.array([self.name])} | {name: pa.array([x], kind) for name, kind, x in kinds})

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


MANIFEST = "file string, part int, seq int, offset long, bytes long, docs long, ids long"


def write_files(df: DataFrame, tokenizer: str, uri: str, key: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """Encode every whole text with the tokenizers file ``tokenizer``, append ``end_id`` to each, and write the ids in ascending order of ``key``
    to files under ``uri``, a folder that all executors share. Returns the manifest, a row for each chunk: ``file`` (its name), ``part``, ``seq``
    (int: its place in the part), ``offset``, ``bytes``, ``docs`` and ``ids`` (long). The ids of a part follow those of the parts before it.

    Null and empty texts have the end id alone. Null keys come first; rows that repeat a key are ordered by a hash of their text,
    and equal ones as they are read. An empty table writes no file. The rows are shuffled once, by ranges of the key. Files of
    attempts that were lost may stay in the folder; no manifest names them.
    """
    spark = df.sparkSession
    workspace.bound_batches(spark)
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).select("k", "t", F.xxhash64("t").alias("h"), F.monotonically_increasing_id().alias("n"))
    # the last two columns of the order split rows that repeat a key, however many
    dealt = rows.repartitionByRange(workspace.task_count(spark), "k", "h", "n").sortWithinPartitions("k", "h", "n").select("k", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encoder = bpe.library_encoder(tokenizer)
        writer = None
        docs: list[tuple[int | None, int]] = []
        ids: list[np.ndarray] = []
        end, held = np.array([end_id], np.uint16), 0
        for b in batches:
            for k, own in zip(b.column("k").to_pylist(), encoder.encode(b.column("t").to_pylist())):
                if len(own) and int(own.max()) >= LIMIT:
                    raise ValueError(f"ids must be from 0 to {LIMIT - 1}")
                docs.append((k, len(own) + 1))
                ids += [own.astype(np.uint16), end]
                held += len(own) + 1
                if held >= CHUNK:
                    writer = writer or _Writer(uri, task.partitionId(), task.taskAttemptId())
                    yield writer.add(IdChunk(docs, np.concatenate(ids)))
                    docs, ids, held = [], [], 0
        if docs:
            writer = writer or _Writer(uri, task.partitionId(), task.taskAttemptId())
            yield writer.add(IdChunk(docs, np.concatenate(ids)))
        if writer:
            writer.close()

    return workspace.stage(dealt.mapInArrow(run, MANIFEST), "manifest")


def read_files(manifest: DataFrame, uri: str) -> DataFrame:
    """The documents of the chunks that ``manifest`` lists under ``uri``: ``id`` (long), ``start`` (long, the ids of all documents before it), ``n_tokens``
    (long) and ``ids`` (binary, little-endian unsigned 32-bit). A damaged chunk fails the job with the block's number. Each chunk is
    read apart from the others, and a lost executor costs the chunks that it was reading."""
    spark = manifest.sparkSession
    schema = "id long, start long, n_tokens long, ids binary"
    # one row for each part, so no more than the tasks that wrote
    sizes = sorted((r["part"], r["n"]) for r in manifest.groupBy("part").agg(F.sum("ids").alias("n")).collect())
    if not sizes:
        return spark.createDataFrame([], schema)
    ends = np.cumsum([n for _, n in sizes]).tolist()
    bases = workspace.local_table(spark, {"part": pa.array([part for part, _ in sizes], pa.int32()), "below": pa.array([end - n for (_, n), end in zip(sizes, ends)], pa.int64())})
    ahead = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.join(F.broadcast(bases), "part").withColumn("base", F.col("below") + F.coalesce(F.sum("ids").over(ahead), F.lit(0)))
    tasks = workspace.task_count(spark)
    # neighbours in a part are a prime number of tasks apart
    dealt = placed.repartitionById(tasks, F.pmod(F.col("part") + F.col("seq") * 7919, F.lit(tasks)).cast("int")).select("file", "offset", "bytes", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = stores.file_system(uri)
        for b in batches:
            for file, offset, size, base in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "bytes", "base"))):
                with store.open_input_file(f"{folder}/{file}") as source:
                    chunk = IdChunk.from_bytes(source.read_at(size, offset))
                ends = np.cumsum([n for _, n in chunk.docs])
                step = 500
                for a in range(0, len(chunk.docs), step):
                    docs = chunk.docs[a : a + step]
                    last = ends[a : a + step].tolist()
                    first = [e - n for e, (_, n) in zip(last, docs)]
                    yield pa.RecordBatch.from_pydict({"id": pa.array([k for k, _ in docs], pa.int64()), "start": pa.array([base + x for x in first], pa.int64()), "n_tokens": pa.array([n for _, n in docs], pa.int64()), "ids": pa.array([chunk.ids[x:y].tobytes() for x, y in zip(first, last)], pa.binary())})

    return dealt.mapInArrow(run, schema)
