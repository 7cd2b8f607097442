"""SimHash fingerprints and the search for near fingerprints.

Terms are runs of three words (lower-cased A-Z, split at ASCII white space; a text with fewer words is one term, a text without
words has none). A term that occurs n times has weight 1 + ln n. Every term's 128-bit hash votes with its weight on each bit; a
bit is set where the votes for it are more than half the weight. The fingerprint is 32 lower-case hex digits; a text without
words has 32 zeros.

``near_pairs`` finds all pairs within a Hamming radius r by permuted block tables: the bits are cut into r + ``extra`` blocks;
two fingerprints within r differ in at most r blocks, so they agree in ``extra`` of them, and one table for each choice of
``extra`` blocks, keyed by those blocks' bits, brings them together. Equal fingerprints are one entry of the tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm import vectext, workspace

BITS = 128
#: Words in a term.
TERM = 3
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _term_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and owners of the terms of each text, in order of owner."""
    hashes: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    for parts, owner in vectext.segments(texts):
        _, points, starts = vectext.flatten(parts)
        begin, end = vectext.words(points, starts)
        hashes.append(vectext.SliceHasher(points, lower_ascii=True)(begin, end))
        owners.append(owner[np.searchsorted(starts, begin, "right") - 1])
    word = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    own = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    if not len(word):
        return word, own
    whole = len(word) - TERM + 1
    inside = own[: max(whole, 0)] == own[TERM - 1 :] if whole > 0 else np.zeros(0, bool)
    term = np.zeros(max(whole, 0), np.uint64)
    for k in range(TERM):
        term += word[k : k + whole] * _ODD[k] if whole > 0 else 0
    counts = np.bincount(own, minlength=len(texts))
    few = np.flatnonzero((counts > 0) & (counts < TERM))
    first = np.searchsorted(own, few)
    short = np.array([np.sum(word[a : a + n] * _ODD[:n], dtype=np.uint64) + np.uint64(n) for a, n in zip(first.tolist(), counts[few].tolist())], np.uint64)
    term, owner = np.concatenate([term[inside], short]), np.concatenate([own[: len(inside)][inside], few])
    return vectext.mix(term), owner


def fingerprints(texts: list) -> np.ndarray:
    """One row of BITS / 8 bytes for each text; None is empty."""
    term, owner = _term_hashes(texts)
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    if not len(term):
        return out
    order = np.lexsort((term, owner))
    term, owner = term[order], owner[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    weight = 1 + np.log(np.diff(np.append(first, len(term)))).astype(np.float32)
    term, owner = term[first], owner[first]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    step = 1 << 14  # terms whose bits are laid out at once
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        votes = np.zeros(BITS, np.float64)
        for a in range(int(bounds[k]), int(bounds[k + 1]), step):
            b = min(a + step, int(bounds[k + 1]))
            halves = np.stack([term[a:b], vectext.mix(term[a:b] + np.uint64(0x632BE59BD9B4E019))], axis=1)
            bits = np.unpackbits(halves.view(np.uint8).reshape(b - a, -1), axis=1)
            votes += weight[a:b] @ bits.astype(np.float32)
        out[k] = np.packbits(2 * votes > weight[bounds[k] : bounds[k + 1]].sum(dtype=np.float64))
    return out


def hexed(prints: np.ndarray) -> list[str]:
    flat = prints.tobytes().hex()
    width = 2 * prints.shape[1]
    return [flat[k : k + width] for k in range(0, len(flat), width)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits of rows of fingerprints."""
    return 1.0 - np.unpackbits(a ^ b, axis=1).sum(axis=1) / BITS


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of every whole text. Null counts as empty; rows and other columns pass through, and a column named
    like the output is replaced. Row by row, without a shuffle."""

    @F.arrow_udf("string")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(hexed(fingerprints(texts.to_pylist())), pa.string())

    return df.withColumn(out, prints(F.col(text)))


def _in_order(df: DataFrame, key: str, text: str) -> DataFrame:
    """(slot, key, text) dealt into slots of neighbouring keys; the first row of a slot in descending order also goes, marked
    ``guest``, to the slot whose last row it follows. Null keys come last."""
    n = workspace.task_count(df.sparkSession)
    ids = df.select(F.col(key).cast("long").alias("k"))
    cuts = sorted({int(x) for x in ids.where("k IS NOT NULL").approxQuantile("k", [i / n for i in range(1, n)], 1 / (4 * n))})
    # slot 0 has the largest keys; a key equal to a cut lies above it
    edges = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    slot = F.when(F.col("k").isNull(), F.lit(len(cuts) + 1)).otherwise(F.size(F.filter(edges, lambda e: e > F.col("k"))))
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).withColumn("slot", slot.cast("int"))
    heads = [(r["slot"], r["k"]) for r in ids.withColumn("slot", slot.cast("int")).groupBy("slot").agg(F.max("k").alias("k")).orderBy("slot").collect()]
    if not heads:
        return rows.select("slot", "k", "t", F.lit(False).alias("guest"))
    # the slot before each one in order, the first slot following the last
    before = {s: heads[i - 1][0] for i, (s, _) in enumerate(heads)}
    # one row a slot, so as many as there are slots
    lead = df.sparkSession.createDataFrame([(s, k, before[s]) for s, k in heads], "slot int, head long, lead int")
    met = rows.join(F.broadcast(lead), (rows["slot"] == lead["slot"]) & rows["k"].eqNullSafe(lead["head"]), "left").select(rows["slot"], "k", "t", "lead")
    own = F.struct("slot", F.lit(False).alias("guest"))
    targets = F.when(F.col("lead").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("lead").alias("slot"), F.lit(True).alias("guest"))))
    return met.select(F.explode(targets).alias("to"), "k", "t").select("to.slot", "k", "t", "to.guest")


def edited_likeness(df: DataFrame, key: str = "doc_id", text: str = "text", share: int = 3) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they are.

    The edited text: its last floor(n / ``share``) code points replaced by the first as many (or all) of the next row's text,
    in descending order of ``key`` with null keys last, the first row following the last one. Rows that repeat a key are
    ordered by their texts. Columns: key (long), n_chars (long), edited (string), fingerprint, edited_fingerprint (string),
    near_edited, near_next (double). Null texts are empty; an empty table gives an empty result; other columns are not read.

    The rows are dealt once, by ranges of the key; the last row of a range finds the row that follows it as a copy beside it.
    """
    tasks = workspace.task_count(df.sparkSession)
    dealt = _in_order(df, key, text).repartitionById(tasks, F.pmod("slot", F.lit(tasks)).cast("int"))
    # ties of a key: by text; a guest is the largest row of its slot, so the first of its ties is the right one
    ordered = dealt.sortWithinPartitions("slot", "guest", F.col("k").desc_nulls_last(), "t")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row of the batch before waits for its successor

        def emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            """rows: in order; those but the last get results if the last is their successor or of another slot."""
            keys, texts, edits = [], [], []
            for (slot, k, t, guest), (slot2, _, t2, _) in zip(rows, rows[1:]):
                if not guest and slot == slot2:
                    cut = len(t) // share
                    keys.append(k)
                    texts.append((t, t2))
                    edits.append(t[: len(t) - cut] + t2[:cut])
            if keys:
                base = fingerprints([t for t, _ in texts])
                following = np.concatenate([base[1:], base[:1]])
                other = [i for i, (_, t2) in enumerate(texts) if i + 1 == len(texts) or texts[i + 1][0] is not t2]
                if other:
                    following[other] = fingerprints([texts[i][1] for i in other])
                changed = fingerprints(edits)
                yield pa.RecordBatch.from_pydict(
                    {"key": pa.array(keys, pa.int64()), "n_chars": pa.array([len(t) for t, _ in texts], pa.int64()), "edited": pa.array(edits, pa.string()), "fingerprint": hexed(base), "edited_fingerprint": hexed(changed), "near_edited": likeness(base, changed), "near_next": likeness(base, following)}
                )

        for batch in batches:
            c = batch.to_pydict()
            rows = [(s, k, t or "", g) for s, k, t, g in zip(c["slot"], c["k"], c["t"], c["guest"])]
            rows = held + rows
            at = size = 0
            for i in range(1, len(rows)):
                size += len(rows[i][2])
                if size > 4 * vectext.GROUP:
                    yield from emit(rows[at : i + 1])
                    at, size = i, 0
            yield from emit(rows[at:])
            held = rows[-1:]

    schema = "key long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(stream, schema).withColumnRenamed("key", key)


def _blocks(prints: Column, blocks: int) -> list[Column]:
    """The hex digits of a fingerprint in ``blocks`` slices of nearly equal width."""
    digits = BITS // 4
    edges = [round(k * digits / blocks) for k in range(blocks + 1)]
    return [F.substring(prints, a + 1, b - a) for a, b in zip(edges, edges[1:])]


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints."""
    half = lambda x, k: F.conv(F.substring(x, 16 * k + 1, 16), 16, -10).cast("long")
    return F.bit_count(half(a, 0).bitwiseXOR(half(b, 0))) + F.bit_count(half(a, 1).bitwiseXOR(half(b, 1)))


def radius_of(jaccard: float) -> int:
    """Bits within which lie nearly all fingerprints (two standard deviations above the mean) of texts of one length whose sets of
    terms have so large a Jaccard likeness: 2 j / (1 + j) is their cosine, and bits differ by the share of the angle in pi."""
    share = np.arccos(min(1.0, 2 * jaccard / (1 + jaccard))) / np.pi
    return int(np.ceil(BITS * share + 2 * np.sqrt(BITS * share * (1 - share))))


def near_pairs(df: DataFrame, prints: str = "fingerprint", radius: int | None = None, extra: int = 2, jaccard: float = 0.8) -> DataFrame:
    """All pairs of different fingerprints of ``df`` within ``radius`` bits, by default those for a likeness of ``jaccard``: ``a`` < ``b``
    (string) and ``bits`` (int), each pair once. Null fingerprints pair with nothing; repeated ones count once; join ``a`` and
    ``b`` back to ``df`` for the rows. The wider the radius, the shorter the blocks and the more pairs are compared: at the default
    each key is 8 bits or a little more, so the work grows with the square of the table."""
    radius = radius_of(jaccard) if radius is None else radius
    distinct = df.where(F.col(prints).isNotNull()).select(F.col(prints).alias("f")).distinct()
    parts = _blocks(F.col("f"), radius + extra)
    tables = [F.concat_ws(":", F.lit(str(n)), *[parts[k] for k in chosen]) for n, chosen in enumerate(combinations(range(radius + extra), extra))]
    keyed = distinct.select("f", F.explode(F.array(*tables)).alias("block"))
    pairs = keyed.select(F.col("f").alias("a"), "block").join(keyed.select(F.col("f").alias("b"), "block"), "block")
    return pairs.where("a < b").withColumn("bits", distance(F.col("a"), F.col("b"))).where(F.col("bits") <= radius).select("a", "b", "bits").distinct()
