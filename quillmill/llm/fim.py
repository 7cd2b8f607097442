"""Fill-in-the-middle forms of documents.

One table-driven automaton over the bytes of a text knows where code points and units begin and where a sentinel ends: its state is the kind of
the last byte (white space or not) and the longest part of a sentinel that the bytes just read can be the start of. Both are settled by
the last few bytes, so a buffer is cut into stripes, each with a short run-in, and one table look-up moves all stripes on by a byte. The
scan emits a byte of marks for each byte and counts them by text; a second pass over the marks finds the bytes of the two cuts.

A unit is a run of white space (``[\\x20\\x09-\\x0D]``) with the run of other characters after it, or white space at the end.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of prefix, suffix and middle (fixed values of the file format).
SENTINELS = ("<P>", "<S>", "<M>")
#: Marks: a code point begins here, a unit begins here, a sentinel ends here.
POINT, UNIT, SENTINEL = 1, 2, 4
#: Bytes scanned at once, and bytes of a stripe.
WINDOW, STRIPE = 1 << 22, 1 << 11
PLAIN, PSM, SPM = "plain", "psm", "spm"
_SPACE = frozenset(b" \t\n\x0b\x0c\r")
_FORM = "n long, form string, prefix_chars long, middle_chars long, output string"


class Scanner:
    """The automaton of a set of sentinels. ``step[state, byte class]`` is the next state, ``marks`` the same shape. The classes from
    ``first`` on are those of a text's first byte, for which the state before does not count."""

    def __init__(self, sentinels: tuple[str, ...]) -> None:
        words = [s.encode() for s in sentinels]
        if not all(words) or any(_SPACE & set(w) for w in words):
            raise ValueError("a sentinel needs characters, and none may be white space")
        self.run_in = max(map(len, words))
        # nodes: the distinct starts of sentinels, the empty one first
        nodes = sorted({w[:k] for w in words for k in range(len(w) + 1)}, key=lambda w: (len(w), w))
        number = {w: k for k, w in enumerate(nodes)}

        def after(node: bytes, byte: int) -> bytes:
            read = node + bytes([byte])
            return next(read[k:] for k in range(len(read) + 1) if read[k:] in number)

        follow = np.array([[number[after(w, b)] for b in range(256)] for w in nodes])
        ends = np.array([any(w.endswith(s) for s in words) for w in nodes])
        space = np.array([b in _SPACE for b in range(256)])
        # states: node, and whether the last byte was white space
        step, marks = np.empty((len(nodes), 2, 256), np.int64), np.empty((len(nodes), 2, 256), np.int64)
        point = np.where((np.arange(256) & 0xC0) != 0x80, POINT, 0)
        for node in range(len(nodes)):
            for was_space in (0, 1):
                step[node, was_space] = follow[node] * 2 + space
                marks[node, was_space] = point + np.where(ends[follow[node]], SENTINEL, 0) + np.where(space & (not was_space), UNIT, 0)
        step, marks = step.reshape(-1, 256), marks.reshape(-1, 256)
        opening = np.broadcast_to(step[0], step.shape), np.broadcast_to(marks[0] & ~np.int64(UNIT) | UNIT, marks.shape)
        both = np.concatenate([np.concatenate([step, marks]), np.concatenate(opening)], axis=1)
        columns, classes = np.unique(both, axis=1, return_inverse=True)
        classes = classes.reshape(-1).astype(np.uint8)
        self.byte_class, self.first_class = classes[:256], classes[256:]
        self.step = columns[: len(step)].astype(np.uint8)
        self.marks = columns[len(step) :].astype(np.uint8)

    def scan(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A byte of marks for each byte of ``data``; ``starts`` are the places of first bytes of texts, in order."""
        out = np.empty(len(data), np.uint8)
        for a in range(0, len(data), WINDOW):
            b = min(a + WINDOW, len(data))
            lead = min(a, self.run_in)
            classes = self.byte_class[data[a - lead : b]]
            inside = starts[np.searchsorted(starts, a - lead) : np.searchsorted(starts, b)]
            classes[inside - (a - lead)] = self.first_class[data[inside]]
            out[a:b] = self._stripes(classes, lead)
        return out

    def _stripes(self, classes: np.ndarray, lead: int) -> np.ndarray:
        """The marks of ``classes`` from ``lead`` on, all stripes moving together."""
        size = len(classes) - lead
        # at least a hundred stripes if there is so much, none longer than STRIPE
        width = max(min(STRIPE, size // 128), self.run_in, 1)
        count = -(-size // width)
        padded = np.zeros(self.run_in + count * width, np.uint8)
        padded[self.run_in - lead : self.run_in + size] = classes
        # row k: the run-in and the k-th stripe; columns are what one step reads
        rows = np.lib.stride_tricks.as_strided(padded, (count, self.run_in + width), (width, 1))
        columns = np.ascontiguousarray(rows.T)
        kinds = self.step.shape[1]
        step, marks = self.step.ravel(), self.marks.ravel()
        state, found = np.zeros(count, np.intp), np.empty((width, count), np.uint8)
        for j in range(self.run_in + width):
            at = state * kinds + columns[j]
            if j >= self.run_in:
                found[j - self.run_in] = marks[at]
            state = step[at].astype(np.intp)
        return np.ascontiguousarray(found.T).ravel()[:size]


@lru_cache(maxsize=8)
def scanner(sentinels: tuple[str, ...]) -> Scanner:
    return Scanner(sentinels)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the places where each begins, with one place more for the end. Nulls have none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    pool = texts.buffers()[2]
    data = np.frombuffer(pool, np.uint8) if pool is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def transform_batch(texts: pa.Array, first: np.ndarray, second: np.ndarray, plain: np.ndarray, spm: np.ndarray, sentinels: tuple[str, ...]) -> dict[str, list]:
    """What ``with_fim`` adds, for one batch. ``first`` and ``second`` are the numbers that choose the cuts, ``plain`` and ``spm`` the forms wanted."""
    data, offsets = _bytes_of(texts)
    begin, end = offsets[:-1], offsets[1:]
    marks = scanner(sentinels).scan(data, begin[end > begin])
    # the count of each text
    units = np.flatnonzero(marks & UNIT)
    unit_from = np.searchsorted(units, begin)
    n = np.searchsorted(units, end) - unit_from
    ends = np.flatnonzero(marks & SENTINEL)
    marked = np.searchsorted(ends, end) > np.searchsorted(ends, begin)
    plain = plain | marked | (end == begin)
    # the second pass: from unit numbers to bytes
    a, b = first % (n + 1), second % (n + 1)
    bounds = np.append(units, len(data))
    place = lambda k: np.where(k < n, bounds[np.minimum(unit_from + k, len(bounds) - 1)], end)
    low, high = place(np.minimum(a, b)), place(np.maximum(a, b))
    p, s, m = (x.encode() for x in sentinels)
    out: dict[str, list] = {"n": n.tolist(), "form": [], "prefix_chars": [], "middle_chars": [], "output": []}
    for k, (i, x, y, j) in enumerate(zip(begin.tolist(), low.tolist(), high.tolist(), end.tolist())):
        prefix, middle, suffix = data[i:x].tobytes(), data[x:y].tobytes(), data[y:j].tobytes()
        if plain[k]:
            form, text = PLAIN, prefix + middle + suffix
        elif spm[k]:
            form, text = SPM, b"".join((s, suffix, p, prefix, m, middle))
        else:
            form, text = PSM, b"".join((p, prefix, s, suffix, m, middle))
        out["form"].append(form)
        out["output"].append(text)
        out["prefix_chars"].append(None if plain[k] else int(np.count_nonzero(marks[i:x] & POINT)))
        out["middle_chars"].append(None if plain[k] else int(np.count_nonzero(marks[x:y] & POINT)))
    return out


def with_fim(
    df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "fim", seed: int = 42, rate: int = 50, spm_rate: int = 80, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """Add the struct ``out``: n (units), form, prefix_chars, middle_chars (code points; null in plain form) and output.

    The cuts and the form depend on ``seed`` and the row's key alone, by the first four groups of eight digits of the SHA-256 of ``seed:key``: a
    text is cut after h1 mod (n + 1) and h2 mod (n + 1) of its units, is given in its plain form if h3 mod 100 >= ``rate``, and else as suffix,
    prefix, middle if h4 mod 100 < ``spm_rate`` and prefix, suffix, middle if not.

    Null and empty texts are empty and plain, with no units; a text that holds a sentinel is plain, so ``restored`` is exact. A null key
    counts as an empty one. Rows that repeat each get their form; other columns pass through, whatever their names, except that one named
    like the output is replaced. An empty table gives an empty one. No shuffle; memory is a fixed multiple of a batch of texts.
    """

    @F.arrow_udf(_FORM)
    def run(texts: pa.Array, digests: pa.Array) -> pa.Array:
        h = np.array([[int(d[k : k + 8], 16) for k in (0, 8, 16, 24)] for d in digests.to_pylist()], np.int64).reshape(-1, 4)
        found = transform_batch(texts, h[:, 0], h[:, 1], h[:, 2] % 100 >= rate, h[:, 3] % 100 < spm_rate, sentinels)
        numbers = [pa.array(found[c], pa.int64()) for c in ("n", "prefix_chars", "middle_chars")]
        output = pa.array(found["output"], pa.binary()).cast(pa.string(), safe=False)
        return pa.StructArray.from_arrays([numbers[0], pa.array(found["form"], pa.string()), numbers[1], numbers[2], output], ["n", "form", "prefix_chars", "middle_chars", "output"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return df.withColumn(out, run(F.col(text).cast("binary"), digest))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of: a text that holds a sentinel is never cut, so the sentinels of an output are those put in."""
    p, s, m = sentinels

    def between(start: str, end: str | None) -> Column:
        after = F.substr(output, F.locate(start, output) + F.lit(len(start)))
        return F.substr(after, F.lit(1), F.locate(end, after) - 1) if end else after

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == PLAIN, output).when(form == PSM, psm).otherwise(spm)
