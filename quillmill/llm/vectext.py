"""Text as NumPy arrays: code points, class scans, slice hashes and hashed slice tables.

Every operator of this subpackage that looks at characters or words goes through the same three steps:

1. ``segments`` turns a list of texts into groups of bounded size. A text longer than the bound is cut where no token of
   any tokeniser used here can cross (before a single space between two non-blank characters); a text without such a place is
   one piece, unless the operator knows more places (``bpe.safe_cut``).
2. ``flatten`` lays a group out as one array of code points with the segment starts.
3. ``SliceHasher`` hashes any slices of that array at once from one prefix sum, and ``SliceTable`` maps hashes to rows of
   a cache by vectorised open addressing.

Memory is a fixed multiple of the group bound or of the longest piece without a place to cut, whichever is more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

#: Code points in a group of segments.
GROUP = 1 << 18
_BASE = 0x9E3779B97F4A7C13  # odd, 3 mod 8
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def safe_cut(text: str, start: int, limit: int) -> int:
    """The end of the piece of ``text`` that starts at ``start``: at most ``limit`` on where there is a safe place, else
    the first safe place beyond it, else the end of the text."""

    def good(j: int) -> bool:
        return j > start and not text[j - 1].isspace() and j + 1 < len(text) and not text[j + 1].isspace()

    if len(text) - start <= limit:
        return len(text)
    j = text.rfind(" ", start, start + limit)
    floor = start + limit // 2
    while j > floor:
        if good(j):
            return j
        j = text.rfind(" ", start, j)
    j = text.find(" ", start + limit)
    while j >= 0:
        if good(j):
            return j
        j = text.find(" ", j + 1)
    return len(text)


def segments(texts: list, limit: int = GROUP, cut: Callable[[str, int, int], int] = safe_cut) -> Iterator[tuple[list[str], np.ndarray]]:
    """Groups of pieces with the index of the text that each belongs to. A text's pieces come in order; None is empty. ``cut`` says
    where a piece ends, and may go beyond the limit where it must."""
    held: list[str] = []
    owner: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        text = text or ""
        at = 0
        while True:
            end = cut(text, at, limit)
            if held and size + end - at > limit:
                yield held, np.array(owner, np.int64)
                held, owner, size = [], [], 0
            held.append(text[at:end] if at or end < len(text) else text)
            owner.append(k)
            size += end - at
            at = end
            if at >= len(text):
                break
    if held:
        yield held, np.array(owner, np.int64)


def flatten(parts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The joined text, its code points (uint32) and the starts of the parts with the end (int64, one more than parts)."""
    joined = "".join(parts)
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)), out=starts[1:])
    return joined, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), starts


@lru_cache(maxsize=4)
def _char_table(lower_ascii: bool) -> np.ndarray:
    table = mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if lower_ascii:
        table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) >= n:
            return
        n = max(n, 2 * len(self.up))
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            out = np.ones(n, np.uint64)
            done, factor = 1, base
            while done < n:
                m = min(done, n - done)
                out[done : done + m] = out[:m] * np.uint64(pow(base, done, 1 << 64))
                done += m
            del factor
            setattr(self, name, out)


_POWERS = _Powers()


class SliceHasher:
    """Hashes of slices of one array of code points: equal slices have equal hashes, wherever they stand."""

    def __init__(self, points: np.ndarray, lower_ascii: bool = False) -> None:
        _POWERS.grow(len(points) + 1)
        value = _char_table(lower_ascii)[points]
        value *= _POWERS.up[: len(points)]
        self.sums = np.empty(len(points) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(value, out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = self.sums[ends] - self.sums[starts]
        out *= _POWERS.down[starts]
        out += (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        out = mix(out)
        out[out == 0] = 1
        return out


class SliceTable:
    """Hash -> row number, by open addressing over arrays. ``add`` gives unseen hashes the next rows."""

    def __init__(self, bits: int = 16) -> None:
        self.clear(bits)

    def clear(self, bits: int = 16) -> None:
        self.bits, self.rows = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.vals = np.zeros(1 << bits, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of ``hashes``, -1 where there is none."""
        mask = np.int64((1 << self.bits) - 1)
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.keys.take(slot)
        same = got == hashes
        hits = np.flatnonzero(same)
        if 2 * len(hits) < len(hashes):
            out = np.full(len(hashes), -1, np.int32)
            out[hits] = self.vals.take(slot.take(hits))
        else:
            out = np.where(same, self.vals.take(slot), np.int32(-1))
        left = np.flatnonzero(~same & (got != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & mask
            got, want = self.keys[slot], hashes[left]
            hit = got == want
            out[left[hit]] = self.vals[slot[hit]]
            on = ~hit & (got != 0)
            left, slot = left[on], slot[on]
        return out

    def add(self, hashes: np.ndarray) -> np.ndarray:
        """Rows for distinct hashes that are not held yet."""
        rows = np.arange(self.rows, self.rows + len(hashes), dtype=np.int32)
        self.rows += len(hashes)
        if self.rows * 2 > len(self.keys):
            used = self.keys != 0
            keys, vals = self.keys[used], self.vals[used]
            while self.rows * 2 > 1 << self.bits:
                self.bits += 1
            self.keys = np.zeros(1 << self.bits, np.uint64)
            self.vals = np.zeros(1 << self.bits, np.int32)
            self._put(keys, vals)
        self._put(hashes, rows)
        return rows

    def _put(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        mask = np.int64((1 << self.bits) - 1)
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[left[free]]
            won = free & (self.keys[slot] == hashes[left])
            self.vals[slot[won]] = rows[left[won]]
            on = ~won
            left, slot = left[on], (slot[on] + 1) & mask


def run_starts(change: np.ndarray) -> np.ndarray:
    """For every position the start of its run, where ``change`` marks the first position of each run.

    Each position stands for a transition function on the state "start of the current run": reset it to here, or keep it.
    Composition of such functions is the maximum of the last reset, which is associative, so one scan composes them all.
    """
    return np.maximum.accumulate(np.where(change, np.arange(len(change)), 0))


@lru_cache(maxsize=1)
def space_table() -> np.ndarray:
    """White space of the word-based operators: U+0020 and U+0009 to U+000D."""
    table = np.zeros(0x110000, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def words(points: np.ndarray, starts: np.ndarray, blank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-blank characters inside the parts."""
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~(space_table() if blank is None else blank)[points]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = starts[:-1][starts[:-1] < len(points)]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    tail = starts[1:][starts[1:] > 0] - 1
    last[tail] = solid[tail]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def joined_sums(counts: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by owner."""
    return np.bincount(owner, weights=counts, minlength=n).astype(np.int64)
