"""Rule lists from logs of edits, for many catalogs at once.

An edit adds a rule, replaces the one at an index, deletes it, or swaps it with a neighbour. An index counts the rules that are there at that moment, so a catalog's edits run
in order; catalogs run apart from each other. The rules of the catalog at hand are held in chunks (an order-statistic list: finding, inserting and
deleting at an index cost a chunk and the number of chunks), the log streams by.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Items of a chunk before it is halved, and rules of a batch of results.
CHUNK, BATCH = 512, 10_000
ADD, REPLACE, DELETE, UP, DOWN = "add", "replace", "delete", "up", "down"


class IndexedList:
    """A list in chunks."""

    def __init__(self) -> None:
        self.chunks: list[list] = [[]]
        self.size = 0

    def _at(self, index: int) -> tuple[int, int]:
        """Chunk and place in it of an index that is there."""
        for k, chunk in enumerate(self.chunks):
            if index < len(chunk):
                return k, index
            index -= len(chunk)
        raise IndexError(index)

    def get(self, index: int):
        k, i = self._at(index)
        return self.chunks[k][i]

    def put(self, index: int, item) -> None:
        k, i = self._at(index)
        self.chunks[k][i] = item

    def append(self, item) -> None:
        last = self.chunks[-1]
        last.append(item)
        self.size += 1
        if len(last) > CHUNK:
            self.chunks[-1:] = [last[: CHUNK // 2], last[CHUNK // 2 :]]

    def delete(self, index: int) -> None:
        k, i = self._at(index)
        del self.chunks[k][i]
        self.size -= 1
        if not self.chunks[k] and len(self.chunks) > 1:
            del self.chunks[k]

    def __iter__(self) -> Iterator:
        return (x for chunk in self.chunks for x in chunk)


def edit(rules: IndexedList, op: str | None, index: int | None, rule: tuple) -> None:
    """One edit. Adding or replacing by a rule without a find does nothing, nor does an index that is not there, except that replacing behind
    the end adds; an edit of no known name does nothing."""
    if op in (ADD, REPLACE) and not rule[0]:
        return
    if op == ADD or op == REPLACE and (index is None or index >= rules.size):
        rules.append(rule)
    elif index is None or not 0 <= index < rules.size:
        return
    elif op == REPLACE:
        rules.put(index, rule)
    elif op == DELETE:
        rules.delete(index)
    elif op in (UP, DOWN):
        other = index + (1 if op == DOWN else -1)
        if 0 <= other < rules.size:
            one, two = rules.get(index), rules.get(other)
            rules.put(index, two)
            rules.put(other, one)


def replay(log: DataFrame, catalog: str = "catalog", step: str = "step", op: str = "op", index: str = "index", find: str = "find", replace: str = "replace") -> DataFrame:
    """catalog, pos (from 0), find and replace of the rules that the edits of each catalog leave.

    Edits go by step, nulls first; edits of one step by their other columns. A null catalog is a catalog; one without rules left has no row. A null ``replace`` is an empty one.
    Other columns are not read, whatever their names. An empty log gives an empty table. A task holds the rules of one catalog, not its log.
    """
    kind = log.schema[catalog].dataType
    rows = log.select(
        F.col(catalog).alias("c"), F.col(step).alias("s"), F.col(op).alias("o"), F.col(index).cast("long").alias("i"), F.col(find).alias("f"), F.coalesce(F.col(replace), F.lit("")).alias("r")
    )
    key_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, some, rules = None, False, IndexedList()

        def close() -> Iterator[pa.RecordBatch]:
            held, pos = [], 0
            for rule in rules:
                held.append(rule)
                if len(held) == BATCH:
                    yield pack(held, pos)
                    held, pos = [], pos + BATCH
            if held:
                yield pack(held, pos)

        def pack(held: list, pos: int) -> pa.RecordBatch:
            columns = [pa.array([key] * len(held), key_type), pa.array(range(pos, pos + len(held)), pa.int64()), pa.array([f for f, _ in held], pa.string()), pa.array([r for _, r in held], pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["c", "pos", "find", "replace"])

        for b in batches:
            for c, o, i, f, r in zip(*(b.column(x).to_pylist() for x in ("c", "o", "i", "f", "r"))):
                if some and c != key:
                    yield from close()
                    rules = IndexedList()
                key, some = c, True
                edit(rules, o, i, (f, r))
        if some:
            yield from close()

    ordered = rows.repartition("c").sortWithinPartitions("c", "s", "o", "i", "f", "r")
    return ordered.mapInArrow(run, f"c {kind.simpleString()}, pos long, find string, replace string").withColumnRenamed("c", catalog)
