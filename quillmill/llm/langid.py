"""Language identification of mixed-language text.

A text is cut into words: runs of letters and marks of one script. Three steps label them:

1. *Script ranges* narrow the candidates of a word to the languages that write that script in the training text.
2. *Per-word scores*: the mean log-probability ratio of the word's character n-grams (1 to 4, with its edges) under each
   candidate, times a bounded weight, from hashed counts; kept in a table, so a distinct word is scored once per worker.
3. *Viterbi* over the words with a penalty for every switch gives the best sequence of languages. All texts of a group step
   through their words together, as rows of one array.

Runs of words of one language are spans; the language with the most letters is the text's. How well its words fit that language
is measured apart, since some language is always the best: their mean log-probability by n-gram is set between that of the
training text (1) and that of n-grams never seen (0).
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm import vectext, workspace

#: The first and last code points of scripts' blocks, by Unicode's chart names. Other letters form one more script.
SCRIPTS = [
    ("Latin", [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)]),
    ("Greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("Cyrillic", [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)]),
    ("Armenian", [(0x530, 0x58F)]),
    ("Hebrew", [(0x590, 0x5FF)]),
    ("Arabic", [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)]),
    ("Devanagari", [(0x900, 0x97F)]),
    ("Bengali", [(0x980, 0x9FF)]),
    ("Tamil", [(0xB80, 0xBFF)]),
    ("Thai", [(0xE00, 0xE7F)]),
    ("Georgian", [(0x10A0, 0x10FF)]),
    ("Hangul", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)]),
    ("Kana", [(0x3040, 0x30FF)]),
    ("Han", [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)]),
]
NGRAMS = (1, 2, 3, 4)
BUCKET_BITS = 16
#: Cost, in log-probability, of a change of language between two words.
SWITCH = 12.0
#: The most that one word adds for a language over another.
WORD_CAP = 6.0
#: Distinct texts whose counts make the model, at most, for each language.
SAMPLE = 2000
#: Words of a group of texts that step together.
GROUP_WORDS = 1 << 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def script_table() -> np.ndarray:
    """0 for what is no letter, else 1 + the script's place in SCRIPTS (one more for other letters). Marks go with letters."""
    major = np.frombuffer("".join(map(unicodedata.category, map(chr, range(sys.maxunicode + 1)))).encode(), np.uint8)[::2]
    script = np.full(len(major), len(SCRIPTS) + 1, np.uint8)
    for k, (_, ranges) in enumerate(SCRIPTS):
        for a, b in ranges:
            script[a : b + 1] = k + 1
    return np.where((major == ord("L")) | (major == ord("M")), script, 0).astype(np.uint8)


@lru_cache(maxsize=1)
def has_letter() -> np.ndarray:
    """Which code points are letters (not marks)."""
    return np.frombuffer("".join(map(unicodedata.category, map(chr, range(sys.maxunicode + 1)))).encode(), np.uint8)[::2] == ord("L")


def words(parts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined lower-cased parts, their code points, and the starts, ends, parts and scripts of the words."""
    # lower() may change lengths, so parts are laid out after it
    joined, points, starts = vectext.flatten([p.lower() for p in parts])
    script = script_table()[points]
    n = len(script)
    change = np.ones(n, bool)
    change[1:] = script[1:] != script[:-1]
    change[starts[:-1][starts[:-1] < n]] = True
    edges = np.flatnonzero(change)
    ends = np.append(edges[1:], n)
    keep = script[edges] > 0
    begin, end = edges[keep], ends[keep]
    return joined, points, begin, end, np.searchsorted(starts, begin, "right") - 1, script[begin]


def ngram_buckets(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word between two edge marks, and the words that they belong to."""
    _, points, starts = vectext.flatten([f"\x02{t}\x03" for t in tokens])
    hasher = vectext.SliceHasher(points)
    owner = np.repeat(np.arange(len(tokens)), np.diff(starts))
    buckets, owners = [], []
    for n in NGRAMS:
        at = np.arange(max(len(points) - n + 1, 0))
        if not len(at):
            continue
        at = at[owner[at] == owner[at + n - 1]]
        buckets.append((hasher(at, at + n) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        owners.append(owner[at])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass(frozen=True)
class Model:
    """languages; table: (buckets, languages) log-probabilities; writes: (scripts, languages) booleans; levels: (3, languages), the
    log-probability of an n-gram never seen, and mean and standard deviation of those of the training text's n-grams."""

    languages: tuple[str, ...]
    table: np.ndarray
    writes: np.ndarray
    levels: np.ndarray

    def fit(self, language: int, log: float, grams: int, words: int) -> float:
        """How well words fit a language, from the sum of their n-grams' log-probabilities; few words have the benefit of the doubt,
        one standard error by words."""
        unseen, mean, deviation = self.levels[:, language].tolist()
        return float(np.clip((log / grams + deviation / np.sqrt(words) - unseen) / max(mean - unseen, 1e-9), 0, 1))

    def digest(self) -> str:
        return hashlib.sha256(repr(self.languages).encode() + self.table.tobytes() + self.writes.tobytes() + self.levels.tobytes()).hexdigest()


class Labeller:
    """Word scores and Viterbi of a model, with a cache of words that lasts as long as the worker."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.cache = vectext.SliceTable()
        self.scores = np.zeros((0, len(self.model.languages)), np.float32)
        self.logs, self.grams = np.zeros((0, len(self.model.languages)), np.float32), np.zeros(0, np.int32)

    def score_new(self, tokens: list[str], script: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of words: the best candidate has 0, the others less; what doesn't write the script has the cap. Also the sums of
        the log-probabilities of their n-grams, and the numbers of these."""
        bucket, owner = ngram_buckets(tokens)
        order = np.argsort(owner, kind="stable")
        bucket, owner = bucket[order], owner[order]
        first = np.searchsorted(owner, np.arange(len(tokens)))
        total = np.add.reduceat(self.model.table[bucket], first, axis=0)
        grams = np.diff(np.append(first, len(owner)))[:, None]
        score = total / np.sqrt(grams)  # n-grams overlap, so they count less the more there are
        writes = self.model.writes[script]
        writes = np.where(writes.any(axis=1, keepdims=True), writes, True)
        score = np.where(writes, score, -np.inf)
        score -= score.max(axis=1, keepdims=True)
        return np.maximum(score, -WORD_CAP).astype(np.float32), total, grams[:, 0].astype(np.int32)

    def rows(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cache rows, parts and lengths of the words."""
        joined, points, begin, end, part, script = words(parts)
        if not len(begin):
            return np.zeros(0, np.int32), part, end - begin
        hashes = vectext.SliceHasher(points)(begin, end)
        row = self.cache.find(hashes)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            new, where, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            where = miss[where]
            fresh, logs, grams = self.score_new([joined[a:b] for a, b in zip(begin[where].tolist(), end[where].tolist())], script[where])
            row[miss] = self.cache.add(new)[back]
            self.scores = np.concatenate([self.scores, fresh])
            self.logs, self.grams = np.concatenate([self.logs, logs]), np.concatenate([self.grams, grams])
        return row, part, end - begin

    def label(self, texts: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each text the language (index) and the letters of every word, in order, and the log-probability in that language and
        the number of its n-grams."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        held: list[list] = []
        size = 0

        def flush() -> None:
            rows = [np.concatenate(x[0]) if x[0] else np.zeros(0, np.int32) for x in held]
            sizes = [np.concatenate(x[1]) if x[1] else np.zeros(0, np.int64) for x in held]
            paths = viterbi(rows, self.scores)
            out.extend((path, size, self.logs[row, path], self.grams[row]) for path, size, row in zip(paths, sizes, rows))

        for parts, owner in vectext.segments(texts):
            if size > GROUP_WORDS and owner[0] >= len(out) + len(held):  # a new text begins
                flush()
                held, size = [], 0
                if self.cache.rows > (1 << 20):
                    self._reset()
            row, part, length = self.rows(parts)
            bounds = np.searchsorted(part, np.arange(len(parts) + 1))
            for k, a, b in zip(owner.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                while len(out) + len(held) <= k:
                    held.append([[], []])
                held[-1][0].append(row[a:b])
                held[-1][1].append(length[a:b])
            size += len(row)
        flush()
        return out


def viterbi(rows: list[np.ndarray], scores: np.ndarray) -> list[np.ndarray]:
    """The best sequence of languages for each sequence of score rows, where a change costs SWITCH. Ties go to staying and to
    the first language. All sequences step together, longest first, so those at work are always a head of the array."""
    n, states = len(rows), scores.shape[1]
    lengths = np.array([len(r) for r in rows], np.int64)
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    steps = int(lengths[0]) if n else 0
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * n
    if not steps:
        return out
    live = np.searchsorted(-lengths, -np.arange(steps), "left")  # sequences longer than t
    ends = np.cumsum(live)
    # the rows step by step: sequences next to one another
    packed = np.zeros(int(ends[-1]), np.int32)
    for k in range(n):
        length = int(lengths[k])
        if length:
            packed[ends[:length] - live[:length] + k] = rows[order[k]]
    stay = np.zeros((len(packed), states), bool)
    source = np.zeros(len(packed), np.int32)
    value = np.zeros((n, states), np.float32)
    value[:] = 0
    at = 0
    for m in live.tolist():
        v = value[:m]
        best = v.argmax(axis=1)
        top = v[np.arange(m), best][:, None] - SWITCH
        source[at : at + m] = best
        np.greater_equal(v, top, out=stay[at : at + m])
        np.maximum(v, top, out=v)
        v += scores[packed[at : at + m]]
        at += m
    state = value.argmax(axis=1)
    path = np.zeros(len(packed), np.int32)
    for m in live[::-1].tolist():
        at -= m
        s = state[:m]
        path[at : at + m] = s
        kept = stay[at : at + m][np.arange(m), s]
        state[:m] = np.where(kept, s, source[at : at + m])
    for k in range(n):
        length = int(lengths[k])
        out[order[k]] = path[ends[:length] - live[:length] + k]
    return out


_LABELLERS: dict[str, Labeller] = {}


def labeller(model: Model) -> Labeller:
    workspace.works_for("language", _LABELLERS.clear)
    key = model.digest()
    if key not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[key] = Labeller(model)
    return _LABELLERS[key]


def _last_hashes(rows: DataFrame, counts: dict[str, int], sample: int) -> dict[str, int]:
    """For each language the ``sample``-th smallest distinct hash, or the largest if there are fewer. ``counts``: the languages'
    distinct hashes, about."""
    share = {x: min(1.0, 2 * sample / max(n, 1)) for x, n in counts.items()}
    last: dict[str, int] = {}
    while share:
        bound = F.create_map(*[F.lit(y) for x, s in share.items() for y in (x, min((1 << 63) - 1, int(s * 2.0**64) - (1 << 63)))])
        found: dict[str, list[int]] = {x: [] for x in share}
        for r in rows.where(F.col("h") <= bound[F.col("l")]).select("l", "h").distinct().collect():
            found[r["l"]].append(r["h"])
        for x, hashes in found.items():
            if len(hashes) >= sample or share[x] == 1:
                last[x] = sorted(hashes)[: max(sample, 1)][-1]
        # a language that drew too few is drawn from more of its texts
        share = {x: min(1.0, 4 * s) for x, s in share.items() if x not in last}
    return last


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from rows with a text and a language. Of each language the ``sample`` distinct texts with the smallest hashes are used
    (a bound), or all if it has no more; copies of a text count once. Null languages and texts are left out.
    Without any row the model knows no language. What reaches the driver is about two hashes for each text of the sample, and one
    array of counts for each task and language."""
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(F.col(text)).alias("h")).where("t IS NOT NULL AND l IS NOT NULL")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()}
    languages = tuple(sorted(counts))
    index = {x: k for k, x in enumerate(languages)}
    buckets, scripts = 1 << BUCKET_BITS, len(SCRIPTS) + 2
    table = np.ones((len(languages), buckets), np.float64)
    letters = np.zeros((scripts, len(languages)), np.float64)
    if languages:
        last = _last_hashes(rows, counts, sample)
        picked = rows.where(F.col("h") <= F.create_map(*[F.lit(x) for pair in last.items() for x in pair])[F.col("l")])

        def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a text with very many copies is sent on once by each task; at most ``sample`` hashes a language are held
            seen: set[tuple[str, int]] = set()
            for batch in batches:
                new = []
                for k, key in enumerate(zip(batch.column("l").to_pylist(), batch.column("h").to_pylist())):
                    if key not in seen:
                        seen.add(key)
                        new.append(k)
                yield batch.take(pa.array(new, pa.int64()))

        picked = picked.mapInArrow(first_of_each, "t string, l string, h long").dropDuplicates(["l", "h"]).select("t", "l")

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: dict[str, list[np.ndarray]] = {}
            for batch in batches:
                of, texts = batch.column("l").to_pylist(), batch.column("t").to_pylist()
                for parts, owner in vectext.segments(texts):
                    joined, _, begin, end, part, script = words(parts)
                    tokens = [joined[a:b] for a, b in zip(begin.tolist(), end.tolist())]
                    if not tokens:
                        continue
                    bucket, word = ngram_buckets(tokens)
                    which = np.array([index[of[k]] for k in owner])
                    for k in np.unique(which):
                        mine = own.setdefault(languages[k], [np.zeros(buckets), np.zeros(scripts)])
                        mine[0] += np.bincount(bucket[which[part[word]] == k], minlength=buckets)
                        mine[1] += np.bincount(script[which[part] == k], minlength=scripts)
            yield pa.RecordBatch.from_pydict({"l": pa.array(list(own), pa.string()), "grams": pa.array([x[0].tobytes() for x in own.values()], pa.binary()), "scripts": pa.array([x[1].tobytes() for x in own.values()], pa.binary())})

        # the picked texts are few: eight tasks count them
        for r in picked.repartition(8).mapInArrow(tally, "l string, grams binary, scripts binary").toLocalIterator():
            table[index[r["l"]]] += np.frombuffer(bytes(r["grams"]), np.float64)
            letters[:, index[r["l"]]] += np.frombuffer(bytes(r["scripts"]), np.float64)
    total = table.sum(axis=1, keepdims=True)
    seen = (table - 1) / np.maximum(total - buckets, 1)
    log = np.log(table / total)
    mean = (seen * log).sum(axis=1)
    levels = np.stack([-np.log(total[:, 0]), mean, np.sqrt(np.maximum((seen * log**2).sum(axis=1) - mean**2, 0))])
    table = log.T.astype(np.float32)
    writes = letters >= np.maximum(1, 0.001 * letters.sum(axis=0, keepdims=True))
    return Model(languages, np.ascontiguousarray(table), writes, levels)


def with_spans(df: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """Add a struct: ``lang`` (string), ``score`` (double, the share of the text's letters in words of that language, 0 to 1), ``fit``
    (double, 0 to 1: how well those words fit the language) and ``spans`` (array of lang and letters: the runs of words of one
    language in order).

    ``lang`` is the language with the most letters, ties going to the first in order; ``und`` with score and fit 0 and no spans where the
    text is null or has no letter, or the model knows no language. Other columns pass through; a column named like the output
    is replaced. Row by row, without a shuffle."""
    workspace.bound_batches(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double,fit:double,spans:array<struct<lang:string,letters:long>>>")
    def label(texts: pa.Array) -> pa.Array:
        model = shipped.value
        rows = []
        given = texts.to_pylist()
        if not model.languages:
            return pa.array([{"lang": UNKNOWN, "score": 0.0, "fit": 0.0, "spans": []} for _ in given], pa.struct(_FIELDS))
        for text, (path, size, log, grams) in zip(given, labeller(model).label(given)):
            total = np.bincount(path, weights=size, minlength=len(model.languages))
            if not len(path) or not has_letter()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any():
                rows.append({"lang": UNKNOWN, "score": 0.0, "fit": 0.0, "spans": []})
                continue
            best = int(total.argmax())
            own = path == best
            edges = np.flatnonzero(np.diff(path)) + 1
            first = np.concatenate([[0], edges])
            spans = [{"lang": model.languages[k], "letters": int(n)} for k, n in zip(path[first].tolist(), np.add.reduceat(size, first).tolist())]
            rows.append({"lang": model.languages[best], "score": float(total[best] / total.sum()), "fit": model.fit(best, float(log[own].sum(dtype=float)), int(grams[own].sum()), int(own.sum())), "spans": spans})
        return pa.array(rows, pa.struct(_FIELDS))

    return df.withColumn(out, label(F.col(text)))


_FIELDS = [("lang", pa.string()), ("score", pa.float64()), ("fit", pa.float64()), ("spans", pa.list_(pa.struct([("lang", pa.string()), ("letters", pa.int64())])))]
