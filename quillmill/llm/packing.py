"""Packing of token sequences by cutting-stock column generation.

A document's ids, with an end id, are cut into pieces of the capacity and one rest. The rests' lengths make a histogram of
CLASSES length classes, which is all that the driver sees. On it, a linear program chooses patterns (multisets of classes
that fit the capacity) with the fewest sequences: revised simplex, where a knapsack dynamic program over the duals prices the
next column. Pattern counts are rounded down, and what the roundings leave over, at most a few pieces for each class, goes by
first fit decreasing into patterns used once.

Pieces are ranked within their class by counts of (class, salt) groups, so that no class, however large, is ranked in one task;
rank intervals then say which pattern, sequence and place a piece has. Texts are tokenised once, and only pieces (a few
numbers each) are shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm import bpe, workspace

CAPACITY = 2048
#: Length classes of rests: class c holds lengths over (c - 1) * capacity / CLASSES, up to c * capacity / CLASSES.
CLASSES = 256


def best_pattern(values: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: the most valuable multiset of items of these weights, by dynamic programming."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    order = np.argsort(weights, kind="stable")
    w, v = weights[order], values[order]
    for c in range(1, capacity + 1):
        n = int(np.searchsorted(w, c, "right"))
        best[c] = best[c - 1]
        if n:
            got = best[c - w[:n]] + v[:n]
            k = int(got.argmax())
            if got[k] > best[c] + 1e-12:
                best[c], choice[c] = got[k], order[k]
    counts = np.zeros(len(weights), np.int64)
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= int(weights[choice[c]])
    return float(best[capacity]), counts


def solve(demand: np.ndarray, weights: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(uses, pieces of each class) of the patterns that hold exactly ``demand`` pieces of each class. Columns are priced until none helps; a basis
    that comes back (which only steps without gain can do) ends it too, so it ends."""
    m = len(demand)
    if not m:
        return []
    columns = np.diag(capacity // weights).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    use = inverse @ demand.astype(float)
    bases: set[bytes] = set()
    while (basis := hashlib.sha256(columns.tobytes()).digest()) not in bases:
        bases.add(basis)
        duals = inverse.sum(axis=0)
        worth, pattern = best_pattern(np.maximum(duals, 0), weights, capacity)
        if worth <= 1 + 1e-7:
            break
        move = inverse @ pattern
        ratio = np.where(move > 1e-10, use / np.where(move > 1e-10, move, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = max(ratio[out], 0)
        use = np.maximum(use - step * move, 0)
        use[out] = step
        columns[:, out] = pattern
        row = inverse[out] / move[out]
        inverse = inverse - np.outer(move, row)
        inverse[out] = row
    left = demand.astype(np.int64).copy()
    found: list[tuple[int, np.ndarray]] = []
    for k in np.argsort(-use, kind="stable"):
        pattern = columns[:, k].astype(np.int64)
        on = pattern > 0
        n = min(int(use[k] + 1e-9), int((left[on] // pattern[on]).min()) if on.any() else 0)
        if n > 0:
            found.append((n, pattern))
            left -= n * pattern
    bins: list[list] = []
    for k in np.argsort(-weights, kind="stable"):
        for _ in range(int(left[k])):
            home = next((b for b in bins if b[0] >= weights[k]), None)
            if home is None:
                bins.append(home := [capacity, np.zeros(m, np.int64)])
            home[0] -= int(weights[k])
            home[1][k] += 1
    return found + [(1, b[1]) for b in bins]


def _pieces(df: DataFrame, path: str, key: str, text: str, capacity: int, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workspace.works_for("token ids", bpe.forget)
        encoder = bpe.library_encoder(path)
        for b in batches:
            out: dict[str, list] = {"id": [], "start": [], "length": [], "crc": [], "doc_tokens": []}
            for k, ids in zip(b.column("k").to_pylist(), encoder.encode(b.column("t").to_pylist())):
                raw = np.append(ids, end_id).astype("<u4").tobytes()
                n = len(raw) // 4
                for a in range(0, n, capacity):
                    size = min(capacity, n - a)
                    for name, x in zip(out, (k, a, size, zlib.crc32(raw[4 * a : 4 * (a + size)]), n)):
                        out[name].append(x)
            yield pa.RecordBatch.from_pydict({name: pa.array(x, pa.int64()) for name, x in out.items()})

    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, "id long, start long, length long, crc long, doc_tokens long")


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """The pieces of all rows of ``df`` in sequences of at most ``capacity`` tokens: ``id`` (``key`` as long), ``start``, ``length``, ``crc`` (of the
    ids as little-endian unsigned 32-bit numbers), ``doc_tokens``, ``sequence_id`` (gapless from 0), ``offset`` (gapless from 0 in its
    sequence); all long.

    Ids are those of the tokenizers file at ``path``, which every executor must be able to open, then ``end_id``. Null and empty
    texts are one piece, the end id. Repeated rows and null keys are documents of their own. An empty table gives an empty
    result; other columns are not read. A piece is a whole ``capacity``, or what is left of its document.
    """
    spark = df.sparkSession
    workspace.bound_batches(spark)
    pieces = workspace.stage(_pieces(df, path, key, text, capacity, end_id), "pieces")
    unit = -(-capacity // CLASSES)
    limit = capacity // unit
    # class 0: pieces that fill a sequence, or would in whole units
    level = F.ceil(F.col("length") / unit).cast("int")
    salts = workspace.task_count(spark)
    classed = pieces.withColumn("class", F.when(level >= limit, F.lit(0)).otherwise(level)).withColumn("salt", F.pmod(F.xxhash64("id", "start", "crc"), F.lit(salts)).cast("int"))
    counts = classed.groupBy("class", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    weights = np.array(sorted(c for c in histogram if c), np.int64)
    patterns = solve(np.array([histogram[c] for c in weights.tolist()], np.int64), weights, limit)
    # rank intervals: at most a few for each pattern and class, so bounded by CLASSES
    spans: list[tuple[int, int, int, int, int, int]] = []
    used, base = dict.fromkeys(weights.tolist(), 0), 0
    for n, pattern in patterns:
        place = 0
        for k in np.flatnonzero(pattern).tolist():
            c, a = int(weights[k]), int(pattern[k])
            spans.append((c, used[c], used[c] + n * a, base, a, place))
            used[c] += n * a
            place += a
        base += n
    if histogram.get(0):
        spans.append((0, 0, histogram[0], base, 1, 0))
    kinds = {"class": pa.int32(), "low": pa.int64(), "high": pa.int64(), "base": pa.int64(), "each": pa.int64(), "place": pa.int64()}
    plan = workspace.local_table(spark, {name: pa.array([s[k] for s in spans], kind) for k, (name, kind) in enumerate(kinds.items())})
    before = counts.select("class", "salt", (F.sum("n").over(Window.partitionBy("class").orderBy("salt")) - F.col("n")).alias("before"))
    order = Window.partitionBy("class", "salt").orderBy("id", "start", "crc")
    ranked = classed.withColumn("rank", F.row_number().over(order) - 1).join(before, ["class", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    met = ranked.join(F.broadcast(plan.withColumnRenamed("class", "of")), (F.col("class") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    step = F.col("rank") - F.col("low")
    placed = met.select("id", "start", "length", "crc", "doc_tokens", (F.col("base") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"), (F.col("place") + step % F.col("each")).alias("place"))
    ahead = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("id", "start", "length", "crc", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long").alias("offset"))
