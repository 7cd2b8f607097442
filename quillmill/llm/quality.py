"""A quality classifier by compression.

Two zstandard dictionaries are built, one from text labelled good and one from text labelled bad. A text is compressed with
each, in pieces of PIECE bytes so that a long text does not become its own dictionary; the difference of the sizes, divided by
the text's bytes, says which dictionary knows it better. A text that repeats itself shrinks to nothing under either, so the
difference says little there; how far its compressed share lies below that of nearly all good texts is a second measure. A
logistic curve fitted on labelled texts that the dictionaries have not seen turns both into the probability of the label good.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import workspace

#: Bytes that are compressed at once, and bytes of a training sample.
PIECE, TRAIN_PIECE = 1024, 512
DICTIONARY = 1 << 16
LEVEL = 3
#: Labelled texts of each class that are used, each whole.
SAMPLE = 3000
#: The share of good texts that lie below the floor.
FLOOR = 0.01


@dataclass(frozen=True)
class Model:
    """The two dictionaries, the floor of the compressed share of good texts (logarithm), and the weights of the logistic curve: of
    the difference, of what the share lies below the floor, and the constant."""

    good: bytes
    bad: bytes
    floor: float
    weights: tuple[float, float, float]

    def score(self, measures: np.ndarray) -> np.ndarray:
        """Probabilities of rows of measures."""
        w = self.weights
        z = w[0] * measures[:, 0] + w[1] * np.maximum(0, self.floor - measures[:, 1]) + w[2]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@lru_cache(maxsize=2)
def _compressors(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    made = []
    for data in (good, bad):
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def measure(text: str | None, good: bytes, bad: bytes) -> tuple[float, float]:
    """Size with the bad dictionary less size with the good one, by byte of text; and the logarithm of the smaller size by byte.
    Both are 0 for an empty text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data or not good or not bad:
        return 0.0, 0.0
    a, b = _compressors(good, bad)
    pieces = [data[k : k + PIECE] for k in range(0, len(data), PIECE)]
    with_good, with_bad = sum(len(a.compress(p)) for p in pieces), sum(len(b.compress(p)) for p in pieces)
    return (with_bad - with_good) / len(data), float(np.log(min(with_good, with_bad) / len(data)))


def _dictionary(pieces: list[bytes]) -> bytes:
    """A dictionary from the pieces; of too few to train one, the pieces themselves."""
    order = sorted(pieces, key=lambda p: hashlib.md5(p).digest())
    try:
        return zstandard.train_dictionary(DICTIONARY, order).as_bytes()
    except zstandard.ZstdError:
        return b"".join(order)[-DICTIONARY:]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the columns of x and the constant, by Newton's method, with a little ridge and smoothed targets, so that separable
    classes stay finite."""
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = np.column_stack([x / scale, np.ones(len(x))])
    n1 = float(y.sum())
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w)), z.T @ (p - target) + 1e-2 * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from the texts of ``docs`` that ``labels`` marks 1 or 0.

    At most ``sample`` labelled keys of each class are used (a bound), those with the smallest hash of the key; half of them build
    the dictionaries, from all pieces of their texts, and half fit the curve. Null labels, keys and texts are left out. A key with both labels counts
    once in each class, and rows of ``docs`` that repeat a key count each. With no text of one class the score is the share of label 1 among the labels, or 0.5 without labels.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"), F.xxhash64(F.col(key)).alias("h")).where("k IS NOT NULL AND y IN (0, 1)").distinct()
    chosen = [r for y in (0, 1) for r in marked.where(F.col("y") == y).orderBy("h", "k").limit(sample).collect()]
    if not chosen:
        return Model(b"", b"", 0.0, (0.0, 0.0, 0.0))
    part = workspace.local_table(spark, {"k": pa.array([r["k"] for r in chosen], pa.int64()), "y": pa.array([r["y"] for r in chosen], pa.int32()), "fold": pa.array([i % 2 for i in range(len(chosen))], pa.int32())})
    # at most 2 * sample rows
    mine = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t IS NOT NULL AND k IS NOT NULL").join(F.broadcast(part), "k")

    @F.arrow_udf("array<binary>")
    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            data = t.encode("utf-8", "surrogatepass")
            out.append([data[k : k + TRAIN_PIECE] for k in range(0, len(data), TRAIN_PIECE)])
        return pa.array(out, pa.list_(pa.binary()))

    pieces: dict[int, list[bytes]] = {0: [], 1: []}
    for r in mine.where("fold = 0").select("y", cut("t").alias("p")).collect():
        pieces[r["y"]] += [bytes(p) for p in r["p"]]
    rate = sum(r["y"] for r in chosen) / len(chosen)
    flat = Model(b"", b"", 0.0, (0.0, 0.0, float(np.log((rate + 0.01) / (1.01 - rate)))))
    if not pieces[0] or not pieces[1]:
        return flat
    good, bad = _dictionary(pieces[1]), _dictionary(pieces[0])
    fitted = mine.where("fold = 1").select("y", _measures(spark, good, bad)("t").alias("m")).collect()
    if len({r["y"] for r in fitted}) < 2:
        return Model(good, bad, -99.0, (40.0, 0.0, 0.0))
    x, y = np.array([[r["m"]["difference"], r["m"]["share"]] for r in fitted]), np.array([r["y"] for r in fitted], float)
    floor = float(np.quantile(x[y > 0, 1], FLOOR))
    # the classes were taken in other shares than the labels have
    shares = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    w = _logistic(np.column_stack([x[:, 0], np.maximum(0, floor - x[:, 1])]), y)
    constant = w[2] + np.log(shares[1] / shares[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(good, bad, floor, (float(w[0]), float(w[1]), float(constant)))


def _measures(spark: SparkSession, good: bytes, bad: bytes):
    shipped = spark.sparkContext.broadcast((good, bad))

    @F.arrow_udf("struct<difference:double,share:double>")
    def run(texts: pa.Array) -> pa.Array:
        found = np.array([measure(t, *shipped.value) for t in texts.to_pylist()]).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["difference", "share"])

    return run


def with_score(df: DataFrame, model: Model, text: str = "text", out: str = "quality_score") -> DataFrame:
    """Add the probability (double, 0 to 1) that a text would be labelled good. Null and empty texts have the score of a text that
    both dictionaries compress alike. Equal texts score alike; other columns pass through, and a column named like the output
    is replaced. Row by row, without a shuffle."""
    workspace.bound_batches(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        model = shipped.value
        found = np.array([measure(t, model.good, model.bad) for t in texts.to_pylist()]).reshape(-1, 2)
        return pa.array(model.score(found), pa.float64())

    return df.withColumn(out, score(F.col(text)))
