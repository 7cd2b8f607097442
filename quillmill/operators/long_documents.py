"""The line operators on documents whose lines are dealt over many partitions.

``lines.py`` has a document's lines in one array. Here a line is a row (document, number, line), and a document may have more lines than a task
holds. Each of the operators decides after which lines a break stays. What it needs to know of all lines before a block is one number:

- threshold merge: the width that has accumulated. A block of lines turns it into the width at its end: up to the first flush the two differ
  by a constant, and from there on all is settled by the pointers from each line to the flush after it, which are doubled until they leave the block. So a
  block is a step function, with one step for each line that may be the first flush.
- regrouping: whether the last character that is no white space asks for more. A block sets that or keeps it.

A task packs lines of a document that come to it in the order of their numbers into blocks, and the blocks become a table, once; no line is sorted or shuffled
for that. A document of one block needs nothing else. Of the others, the blocks are put in order by their first numbers, and a scan over their functions (small
rows) gives each block its number and how many lines come out before it. The blocks then make their lines apart from each other; only the first
and the last of a block can have parts elsewhere and are put together. Documents whose blocks overlap, since their lines are dealt out at random or numbers repeat, are
taken apart again, sorted by line in ranges and packed anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegralType

from quillmill import session
from quillmill.functions import charsets
from quillmill.operators.lines import Width
from quillmill.sources.splits import assembled

#: Lines and bytes of a block.
BLOCK_LINES, BLOCK_BYTES = 1 << 16, 1 << 22


class Merge:
    """The threshold merge. A line's value is its width, or -1 - width where it ends with a character that stops merging."""

    drop_empty_rest = True

    def __init__(self, threshold: int) -> None:
        self.threshold = threshold

    def _flushes(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Widths up to each line (none before the first), stopping lines, and for each line the flush of what begins there; the number of lines if none."""
        stops = np.flatnonzero(values < 0)
        sums = np.concatenate([[0], np.cumsum(np.where(values < 0, -1 - values, values))])
        wide = np.searchsorted(sums[1:], sums[:-1] + self.threshold)
        stop = np.append(stops, len(values))[np.searchsorted(stops, np.arange(len(values)))]
        return sums, stops, np.minimum(wide, stop)

    def summary(self, values: np.ndarray) -> list[int]:
        """The function: total width, then for each line that may be the first flush, in order: the width at which it is, the width at the end, and breaks."""
        n = len(values)
        sums, stops, flush = self._flushes(values)
        # what begins at line s: the width at the end and the breaks, by doubling; line n begins nothing
        to, breaks = np.append(np.where(flush < n, flush + 1, np.arange(n)), n), np.append((flush < n).astype(np.int64), 0)
        while True:
            further = to[to]
            if (further == to).all():
                break
            breaks = breaks + breaks[to]
            to = further
        rest = sums[n] - sums[to]
        first_stop = int(stops[0]) if len(stops) else n
        last = min(first_stop, int(np.searchsorted(sums[1:], self.threshold)), n - 1)
        out = [int(sums[n])]
        before = -1
        for k in range(last + 1):
            # only a stop flushes whatever the width is
            needs = self.threshold if k == first_stop else min(int(sums[k + 1]), self.threshold)
            if needs > before:
                out += [needs, int(rest[k + 1]), 1 + int(breaks[k + 1])]
                before = needs
        return out

    def carry(self, summary: list[int], state: int) -> tuple[int, int]:
        """The state after a block, and its breaks."""
        steps = np.asarray(summary[1:], np.int64).reshape(-1, 3)
        k = int(np.searchsorted(steps[:, 0], self.threshold - state))
        return (int(steps[k, 1]), int(steps[k, 2])) if k < len(steps) else (state + summary[0], 0)

    def breaks(self, values: np.ndarray, state: int) -> np.ndarray:
        """The lines of a block after which a break stays."""
        sums, stops, flush = self._flushes(values)
        at = min(int(np.searchsorted(sums[1:], self.threshold - state)), int(stops[0]) if len(stops) else len(values))
        found, following = [], flush.tolist()
        while at < len(values):
            found.append(at)
            at = following[at + 1] if at + 1 < len(values) else len(values)
        return np.array(found, np.int64)


@lru_cache(maxsize=8)
def _members(ranges: tuple[tuple[int, int], ...], without: str) -> np.ndarray:
    """For each code point, whether it is in one of the ranges and not in ``without``."""
    found = np.zeros(0x110000, bool)
    for a, b in ranges:
        found[a : b + 1] = True
    found[[ord(c) for c in without]] = False
    return found


def _singles(chars: str) -> tuple[tuple[int, int], ...]:
    return tuple((ord(c), ord(c)) for c in dict.fromkeys(chars))


def _characters(octets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points that end right before ``ends`` in UTF-8, and their bytes."""
    code, width = octets[ends - 1].astype(np.int64), np.ones(len(ends), np.int64)
    wide = np.flatnonzero(code >= 0x80)
    if len(wide):
        b1, b2, b3, b4 = (octets[np.maximum(ends[wide] - k, 0)].astype(np.int64) for k in (1, 2, 3, 4))
        two, three = b2 >= 0xC0, (b2 < 0xC0) & (b3 >= 0xC0)
        low = (b2 & 0x3F) << 6 | b1 & 0x3F
        code[wide] = np.where(two, (b2 & 0x1F) << 6 | b1 & 0x3F, np.where(three, (b3 & 0xF) << 12 | low, (b4 & 7) << 18 | (b3 & 0x3F) << 12 | low))
        width[wide] = np.where(two, 2, np.where(three, 3, 4))
    return code, width


class Regroup:
    """Lines go on the one before them while its last character that is no white space asks for more. A line's value is 1 where its own does, 0
    where it doesn't, and -1 where it has none. Characters that ask: those of ``asks`` (ranges of code points) without those of ``refuses``."""

    drop_empty_rest = False

    def __init__(self, asks: tuple[tuple[int, int], ...], refuses: str) -> None:
        self.asks, self.refuses = asks, refuses

    def values(self, offsets: np.ndarray, data: pa.Buffer) -> np.ndarray:
        """The values of lines in UTF-8: from their ends back as far as there is white space, all lines at a time."""
        octets, asks, blank = np.frombuffer(data, np.uint8), _members(self.asks, self.refuses), _members(_singles(charsets.WHITESPACE), "")
        starts, ends = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
        known, asked = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
        left = np.flatnonzero(ends > starts)
        while len(left):
            code, width = _characters(octets, ends[left])
            asked[left] |= asks[code]
            known[left] = ~blank[code]
            ends[left] -= width
            left = left[blank[code] & (ends[left] > starts[left])]
        return np.where(known, asked, -1).astype(np.int64)

    @staticmethod
    def _states(values: np.ndarray, state: int) -> np.ndarray:
        known = np.maximum.accumulate(np.where(values >= 0, np.arange(len(values)), -1))
        return np.where(known >= 0, values[np.maximum(known, 0)], state)

    def summary(self, values: np.ndarray) -> list[int]:
        found = [self._states(values, s) for s in (0, 1)]
        return [x for f in found for x in (int(f[-1]), int((f == 0).sum()))]

    def carry(self, summary: list[int], state: int) -> tuple[int, int]:
        return summary[2 * state], summary[2 * state + 1]

    def breaks(self, values: np.ndarray, state: int) -> np.ndarray:
        return np.flatnonzero(self._states(values, state) == 0)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as they need."""
    most = max(int(values.max()), -1 - int(values.min())) if len(values) else 0
    size = 1 if most < 1 << 7 else 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([size]) + values.astype(f"<i{size}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)


def _codes(column: pa.Array) -> np.ndarray:
    """A number for each value; null is one."""
    try:
        return column.dictionary_encode(null_encoding="encode").indices.to_numpy()
    except (pa.ArrowNotImplementedError, pa.ArrowInvalid, pa.ArrowTypeError):
        values = column.to_pylist()
        return np.array(list(accumulate([0, *(int(x != y) for x, y in zip(values, values[1:]))])) if values else [], np.int64)


def _offsets(lines: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    _, offsets, data = lines.buffers()
    return np.frombuffer(offsets, np.int32)[lines.offset : lines.offset + len(lines) + 1], data or pa.py_buffer(b"")


def _regrouped(df: DataFrame, operator: Merge | Regroup, value: Column | None, document: str, number: str, line: str) -> DataFrame:
    kind, number_kind = df.schema[document].dataType, df.schema[number].dataType
    key_type, number_type = to_arrow_type(kind), to_arrow_type(number_kind)
    counted, given = isinstance(number_kind, IntegralType), value is not None
    rows = df.select(F.col(document).alias("document"), F.col(number).alias("number"), F.coalesce(F.col(line), F.lit("")).alias("line"), (value if given else F.lit(0).cast("long")).alias("value"))
    name, number_name = kind.simpleString(), number_kind.simpleString()
    row_schema = f"document {name}, number {number_name}, line string, value long"
    schema = f"document {name}, part int, block int, first {number_name}, last {number_name}, text binary, sizes binary, values binary, numbers array<{number_name}>"

    def pack(batches: Iterator[pa.RecordBatch], in_order: bool = False) -> Iterator[pa.RecordBatch]:
        """``in_order``: all lines come as they are to go, whatever their numbers."""
        part, block = TaskContext.get().partitionId(), 0

        def starts_of(table: pa.Table) -> tuple[pa.Table, list[int]]:
            codes = _codes(table.column("document").combine_chunks())
            new = np.append(True, codes[1:] != codes[:-1])
            if not in_order:
                later = lambda t: pc.greater(t[1:], t[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
                numbers = table.column("number").combine_chunks()
                new[1:] |= ~later(numbers)
                if new.sum() > len(np.unique(codes)):
                    order = pc.sort_indices(pa.table({"d": codes, "n": numbers}), sort_keys=[("d", "ascending"), ("n", "ascending")])
                    table, codes = table.take(order).combine_chunks(), codes[order.to_numpy()]
                    new = np.append(True, codes[1:] != codes[:-1])
                    new[1:] |= ~later(table.column("number").combine_chunks())
            return table, np.flatnonzero(new).tolist()

        def close(held: list[pa.RecordBatch], rest: bool) -> tuple[pa.RecordBatch, list[pa.RecordBatch]]:
            """The blocks of the lines held, and the lines of the last one if it may go on."""
            nonlocal block
            table, starts = starts_of(pa.Table.from_batches(held).combine_chunks())
            lines, numbers = (table.column(c).combine_chunks() for c in ("line", "number"))
            offsets, data = _offsets(lines)
            cuts = []
            for i, j in zip(starts, [*starts[1:], len(table)]):
                while i < j:
                    cuts.append(i)
                    i = j if j - i <= BLOCK_LINES and offsets[j] - offsets[i] <= BLOCK_BYTES else min(j, i + BLOCK_LINES, max(i + 1, int(np.searchsorted(offsets, int(offsets[i]) + BLOCK_BYTES, "right")) - 1))
            ends = [*cuts[1:], len(table)]
            kept = table.slice(cuts[-1]).to_batches() if not rest and len(cuts) > 1 else []
            if kept:
                cuts.pop(), ends.pop()
            values = table.column("value").to_numpy() if given else operator.values(offsets, data)
            sizes, first, last = np.diff(offsets), numbers.take(pa.array(cuts)), numbers.take(pa.array([e - 1 for e in ends]))
            gapless = [False] * len(cuts)
            if counted:
                gapless = [x is not None and y - x + 1 == j - i for x, y, i, j in zip(first.to_pylist(), last.to_pylist(), cuts, ends)]
            columns = [
                table.column("document").combine_chunks().take(pa.array(cuts)), pa.array([part] * len(cuts), pa.int32()), pa.array(range(block, block + len(cuts)), pa.int32()), first, last,
                pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets[[*cuts, ends[-1]]].copy()), data]),
                pa.array([_packed(sizes[i:j]) for i, j in zip(cuts, ends)], pa.binary()), pa.array([_packed(values[i:j]) for i, j in zip(cuts, ends)], pa.binary()),
                pa.array([None if g or in_order else numbers.slice(i, j - i).to_pylist() for g, i, j in zip(gapless, cuts, ends)], pa.list_(number_type)),
            ]
            block += len(cuts)
            return pa.RecordBatch.from_arrays(columns, ["document", "part", "block", "first", "last", "text", "sizes", "values", "numbers"]), kept

        held = []
        for b in batches:
            if b.num_rows:
                held.append(b.cast(pa.schema([("document", key_type), ("number", number_type), ("line", pa.string()), ("value", pa.int64())])))
            if sum(x.num_rows for x in held) >= BLOCK_LINES or sum(x.column("line").nbytes for x in held) >= BLOCK_BYTES:
                done, held = close(held, False)
                yield done
        if held:
            yield close(held, True)[0]

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks, as many at a time as have BLOCK_BYTES."""
        for b in batches:
            at, _ = _offsets(b.column("text"))
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(at, int(at[i]) + BLOCK_BYTES)))
                yield b.slice(i, j - i)
                i = j

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some(batches):
            at, data = _offsets(b.column("text"))
            sizes, values = ([_unpacked(x) for x in b.column(c).to_pylist()] for c in ("sizes", "values"))
            counts = [len(x) for x in sizes]
            offsets = (np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) + at[0]).astype(np.int32)
            given_numbers = zip(b.column("numbers").to_pylist(), b.column("first").to_pylist(), counts)
            numbers = [x for listed, first, n in given_numbers for x in (listed if listed is not None else range(first, first + n))]
            documents = b.column("document").take(pa.array(np.repeat(np.arange(b.num_rows), counts)))
            lines = pa.Array.from_buffers(pa.string(), sum(counts), [None, pa.py_buffer(offsets), data])
            yield pa.RecordBatch.from_arrays([documents, pa.array(numbers, number_type), lines, pa.array(np.concatenate(values))], ["document", "number", "line", "value"])

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [operator.summary(_unpacked(v)) for v in b.column("values").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("document", "part", "block", "seq", "final")), pa.array(found, pa.list_(pa.int64()))], ["document", "part", "block", "seq", "final", "summary"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, base = 0, 0
        for b in batches:
            states, bases = [], []
            for seq, summary in zip(b.column("seq").to_pylist(), b.column("summary").to_pylist()):
                if seq == 0:
                    state, base = 0, 0
                states.append(state)
                bases.append(base)
                state, n = operator.carry(summary, state)
                base += n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("part", "block", "seq", "final")), pa.array(states, pa.int64()), pa.array(bases, pa.int64())], ["part", "block", "seq", "final", "state", "base"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some(batches):
            yield made(b)

    def made(b: pa.RecordBatch) -> pa.RecordBatch:
        """The lines of blocks: their bytes lie as they lay, only fewer offsets cut them."""
        at, data = _offsets(b.column("text"))
        columns = ("sizes", "values", "state", "base", "seq", "final")
        offsets, counts, numbers, closes, edges, keep = [at[:1]], [], [], [], [], []
        for start, sizes, values, state, base, seq, final in zip(at.tolist(), *(b.column(c).to_pylist() for c in columns)):
            sizes = _unpacked(sizes)
            ends = operator.breaks(_unpacked(values), state) + 1
            closed = len(ends)
            if not closed or ends[-1] < len(sizes):
                ends = np.append(ends, len(sizes))
            n = len(ends)
            offsets.append((start + np.cumsum(sizes)[ends - 1]).astype(np.int32))
            counts.append(n)
            numbers.append(np.arange(base + 1, base + n + 1))
            closes.append(np.arange(n) < closed)
            # a line that begins or goes on in another block
            edge = np.zeros(n, bool)
            edge[0] = seq > 0
            edge[closed:] |= not final
            edges.append(edge)
            stays = np.ones(n, bool)
            if operator.drop_empty_rest and closed < n and not edge[-1]:
                stays[-1] = int(offsets[-1][-1]) > (int(offsets[-1][-2]) if n > 1 else start)
            keep.append(stays)
        texts = pa.Array.from_buffers(pa.string(), sum(counts), [None, pa.py_buffer(np.concatenate(offsets)), data])
        owner = np.repeat(np.arange(b.num_rows), counts)
        document, seq = b.column("document").take(pa.array(owner)), b.column("seq").take(pa.array(owner))
        out = [document, pa.array(np.zeros(len(owner), np.int32)), seq, pa.array(np.concatenate(numbers)), texts, pa.array(np.concatenate(closes)), pa.array(np.concatenate(edges))]
        found = pa.RecordBatch.from_arrays(out, ["document", "part", "block", "line_no", "text", "closed", "edge"])
        stays = np.concatenate(keep)
        return found if stays.all() else found.filter(pa.array(stays))

    def lined(blocks: DataFrame) -> DataFrame:
        return blocks.select("document", "text", "sizes", "values", "state", "base", "seq", "final").mapInArrow(cut, f"document {name}, part int, block int, line_no long, text string, closed boolean, edge boolean")

    def results(blocks: DataFrame, in_order: bool) -> DataFrame:
        """The lines of the documents of ``blocks``."""
        document = Window.partitionBy("document")
        goes = [F.col("part"), F.col("block")] if in_order else [F.col("first").asc_nulls_first(), F.col("part"), F.col("block")]
        placed = document.orderBy(*goes)
        before = F.max("last").over(placed.rowsBetween(Window.unboundedPreceding, -1))
        nth = F.row_number().over(placed)
        overlaps = F.lit(False) if in_order else (nth > 1) & (F.col("first").isNull() | F.coalesce(F.col("first") <= before, F.lit(False)))
        facts = blocks.select("document", "part", "block", "first", "last").withColumns({"n": F.count(F.lit(1)).over(document), "seq": (nth - 1).cast("int"), "overlaps": overlaps}).where("n > 1")
        facts = facts.withColumns({"final": F.col("seq") == F.col("n") - 1, "tangled": F.max("overlaps").over(document)})
        several = session.staged(facts.select("part", "block", "seq", "final", "tangled"), "line-blocks-placed")
        lone = {"state": F.lit(0).cast("long"), "base": F.lit(0).cast("long"), "seq": F.lit(0), "final": F.lit(True)}
        if several.head() is None:
            return lined(blocks.withColumns(lone)).select("document", "line_no", F.col("text").alias("line"))
        # part and block alone name a block
        others = several.select("part", "block")
        found = lined(blocks.join(others, ["part", "block"], "left_anti").withColumns(lone)).select("document", "line_no", F.col("text").alias("line"))
        plain = several.where("NOT tangled").select("part", "block", "seq", "final")
        summed = blocks.select("document", "part", "block", "values").join(plain, ["part", "block"]).select("document", "part", "block", "seq", "final", "values").mapInArrow(summarize, f"document {name}, part int, block int, seq int, final boolean, summary array<long>")
        known = summed.repartition("document").sortWithinPartitions("document", "seq").mapInArrow(scan, "part int, block int, seq int, final boolean, state long, base long")
        found = found.union(assembled(lined(blocks.join(session.staged(known, "line-blocks-known"), ["part", "block"])), "document", operator.drop_empty_rest))
        tangled = several.where("tangled").select("part", "block")
        if tangled.head() is None:
            return found
        apart = blocks.join(tangled, ["part", "block"], "left_semi").mapInArrow(unpack, row_schema)
        ranged = apart.repartitionByRange("document", "number").sortWithinPartitions("document", "number", "line")
        return found.union(results(stored(ranged, True), True))

    def stored(lines: DataFrame, in_order: bool) -> DataFrame:
        return session.staged(lines.mapInArrow(lambda batches: pack(batches, in_order), schema), "line-blocks", "zstd")

    return results(stored(rows, False), False).select(F.col("document").alias(document), F.col("line_no").alias(number), F.col("line").alias(line))


def merge_lines(df: DataFrame, threshold: int = 20, mode: Width = Width.BYTES, no_merge: str | None = None, charset: str = "UTF-8", document: str = "doc_id", number: str = "line_no", line: str = "line") -> DataFrame:
    """The threshold merge of ``lines.merge_lines`` on rows (document, number, line); the result is such rows, numbered from 1.

    Lines go by number, nulls first, and by text where a number repeats; a null line is an empty one, a null document is a document. Other
    columns are not read. An empty table gives an empty one. One line of the result must fit a row; neither a document nor its lines must fit a task.
    """
    if threshold < 1:
        raise ValueError("threshold must be at least 1")
    text = F.coalesce(F.col(line), F.lit(""))
    width = (charsets.width_chars(text) if Width(mode) is Width.CHARS else charsets.width_bytes(text, charset)).cast("long")
    value = F.when(charsets.ends_with_any(text, no_merge), -1 - width).otherwise(width) if no_merge else width
    return _regrouped(df, Merge(threshold), value, document, number, line)


def fix_cjk(df: DataFrame, no_merge: str | None = None, document: str = "doc_id", number: str = "line_no", line: str = "line") -> DataFrame:
    """``lines.fix_cjk`` on rows (document, number, line), as ``merge_lines`` is ``lines.merge_lines``."""
    return _regrouped(df, Regroup(tuple(charsets.CJK_RANGES), no_merge or ""), None, document, number, line)


def fix_punctuation(df: DataFrame, merge: str, no_merge: str | None = None, document: str = "doc_id", number: str = "line_no", line: str = "line") -> DataFrame:
    """``lines.fix_punctuation`` on rows (document, number, line), as ``merge_lines`` is ``lines.merge_lines``. Without characters all lines stay; they are numbered
    anew all the same."""
    return _regrouped(df, Regroup(_singles(merge), no_merge or ""), None, document, number, line)
