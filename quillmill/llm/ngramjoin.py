"""The n-gram Jaccard join: all links between texts whose sets of word shingles are alike enough, by T-occurrence search.

Two sets with J >= t have an overlap of at least t times either size. That drives four steps:

1. *Sets and classes.* Each text's set of 64-bit shingle hashes; equal sets are one class, whatever the number of copies.
2. *Candidates.* In the order of the hashes, the first n - T + l shingles of a set (T = ceil(t n), l = n // 10) hold at least l
   of those that it has in common with any partner. These prefixes are dealt by hash range as packed arrays; a set with too
   few prefix shingles in any other set's prefix has no partner and is done.
3. *Families.* Among the sets left, shingles are counted, and each set is ordered from rare to frequent. A set with fewer than
   T shingles that another has is done too; the others meet in the inverted lists of their n - T + 1 rarest shingles. Sets
   connected through such lists are a family: passages that many documents share are too frequent to connect anything.
4. *T-occurrence search* in each family, in pairs of bounded blocks, with DivideSkip: the lists of a query's most frequent
   shingles are set aside, the short ones are merged and counted, and only what comes within the number of long lists of the
   threshold is looked up in those by binary search. Sizes bound which members a query can reach.

No step bounds the number of partners or drops a list. What leaves a block is a spanning forest of its links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm import components, vectext, workspace

#: Words in a shingle, and the threshold in hundredths.
WORDS, PERCENT = 5, 80
#: Members of a block of a family.
BLOCK = 400
#: Packed prefix entries that a task holds before it sends them off.
HELD = 1 << 20
#: Most sets (2 MB) whose classes are broadcast to their rows.
HOT = 1 << 16
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def least_overlap(n, percent: int = PERCENT):
    """The overlap that a set of n shingles needs with any partner."""
    return (percent * n + 99) // 100


def _spare(n):
    return np.maximum(1, n // 10)


def shingle_sets(texts: list, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of runs of ``words`` words (A-Z lower-cased, split at U+0020 and U+0009 to
    U+000D), or of the whole sequence where there are fewer; none without words or text."""
    held: list[list[np.ndarray]] = [[] for _ in texts]
    for parts, owner in vectext.segments(texts):
        _, points, starts = vectext.flatten(parts)
        begin, end = vectext.words(points, starts)
        hashes = vectext.SliceHasher(points, lower_ascii=True)(begin, end)
        bounds = np.searchsorted(begin, starts)
        for k, a, b in zip(owner.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            held[k].append(hashes[a:b])
    out = []
    for pieces in held:
        word = pieces[0] if len(pieces) == 1 else np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
        if len(word) >= words:
            n = len(word) - words + 1
            acc = word[:n] * _ODD[0]
            for k in range(1, words):
                acc += word[k : k + n] * _ODD[k]
            out.append(np.unique(vectext.mix(acc)))
        elif len(word):
            out.append(vectext.mix(np.array([(word * _ODD[: len(word)]).sum(dtype=np.uint64) + np.uint64(len(word))], np.uint64)))
        else:
            out.append(word)
    return out


def _name(s: np.ndarray) -> int:
    """A set's 64-bit name."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    t = F.col(text).cast("string")
    return df.select(F.col(key).cast("long").alias("id"), t.alias("t"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("th"))


def _names(rows: DataFrame, words: int) -> DataFrame:
    """id, th, n and name (null where n is 0) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workspace.works_for("shingles")
        for b in batches:
            sets = shingle_sets(b.column("t").to_pylist(), words)
            names = [_name(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64())], ["id", "th", "n", "name"])

    return rows.mapInArrow(run, "id long, th long, n long, name long")


def _hit_counts(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """name and hits: how many prefix shingles of a set are in another set's prefix."""
    tasks = workspace.task_count(rows.sparkSession)
    parts = 4 * tasks

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, o = np.concatenate(hashes), np.concatenate(owners)
            # prefixes hold small hashes, so the low bits say where one goes
            return _packed(h.view(np.int64), o, (h % np.uint64(parts)).astype(np.int64), parts)

        for b in batches:
            for s in shingle_sets(b.column("t").to_pylist(), words):
                n = len(s)
                if not n:
                    continue
                name = _name(s)
                if name in seen:
                    continue
                seen.add(name)
                prefix = s[: n - least_overlap(n, percent) + int(_spare(n))]
                hashes.append(prefix)
                owners.append(np.full(len(prefix), name, np.int64))
                size += len(prefix)
            if size > HELD:
                yield from flush()
                hashes, owners, seen, size = [], [], set(), 0
        if size:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_unpacked(raw) for b in batches for raw in b.column("entries").to_pylist()]
        if not found:
            return
        h, o = np.concatenate([x for x, _ in found]).view(np.uint64), np.concatenate([y for _, y in found])
        del found
        order = np.lexsort((o, h))
        h, o = h[order], o[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])  # a set may come from several tasks
        h, o = h[new], o[new]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        length = np.diff(np.append(np.flatnonzero(first), len(h)))
        names, hits = np.unique(o[np.repeat(length > 1, length)], return_counts=True)
        yield from _packed(names.astype(np.int64), hits.astype(np.int64), (names % tasks).astype(np.int64), tasks)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_unpacked(raw) for b in batches for raw in b.column("entries").to_pylist()]
        if not found:
            return
        names, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
        hits = np.bincount(at, weights=np.concatenate([y for _, y in found])).astype(np.int64)
        step = 1 << 16
        for a in range(0, len(names), step):
            yield pa.RecordBatch.from_arrays([pa.array(names[a : a + step]), pa.array(hits[a : a + step])], ["name", "hits"])

    kind = "part int, entries binary"
    dealt = rows.mapInArrow(send, kind).repartition(tasks, "part").mapInArrow(meet, kind)
    return dealt.repartition(tasks, "part").mapInArrow(add, "name long, hits long")


def _packed(first: np.ndarray, second: np.ndarray, part: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Two columns of 64-bit numbers as one packed row for each part that has any: never more rows than entries."""
    order = np.argsort(part, kind="stable")
    first, second = first[order], second[order]
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    full = np.flatnonzero(np.diff(edges))
    packed = [first[edges[p] : edges[p + 1]].tobytes() + second[edges[p] : edges[p + 1]].tobytes() for p in full]
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(packed, pa.binary())], ["part", "entries"])


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(raw) // 2
    return np.frombuffer(raw, np.int64, half // 8), np.frombuffer(raw, np.int64, half // 8, half)


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """name, n and members (array of the hashes as longs) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column("t").to_pylist(), words)
            offsets = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["name", "n", "members"])

    return rows.mapInArrow(run, "name long, n long, members array<long>")


def search(query: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray], sizes: np.ndarray, percent: int = PERCENT, below: int | None = None) -> np.ndarray:
    """T-occurrence search: the members of an index (places in ``sizes``, which is in ascending order) that link with ``query``.

    lists: the index's distinct shingles, where each one's list begins (with the end), and the places in the lists. Only places
    below ``below`` are reached.
    """
    keys, bounds, places = lists
    n = len(query)
    need = int(least_overlap(n, percent))
    # J >= t needs t n <= size <= n / t
    lo = int(np.searchsorted(sizes, need, "left"))
    hi = int(np.searchsorted(sizes, 100 * n // percent, "right"))
    hi = hi if below is None else min(hi, below)
    if lo >= hi:
        return np.zeros(0, np.int64)
    at = np.searchsorted(keys, query)
    at = np.minimum(at, len(keys) - 1)
    at = at[keys[at] == query]
    length = bounds[at + 1] - bounds[at]
    if len(at) < need:
        return np.zeros(0, np.int64)
    # DivideSkip: how many of the longest lists are only probed
    longest = int(length.max())
    aside = min(int(need / (0.01 * np.log2(longest + 2) + 1)), need - 1, len(at) - 1)
    order = np.argsort(length, kind="stable")
    short, long = at[order[: len(at) - aside]], at[order[len(at) - aside :]]
    starts, counts = bounds[short], bounds[short + 1] - bounds[short]
    ends = np.cumsum(counts)
    merged = places[np.arange(int(ends[-1])) + np.repeat(starts - ends + counts, counts)]
    merged = merged[(merged >= lo) & (merged < hi)]
    seen = np.bincount(merged - lo, minlength=hi - lo)
    found = np.flatnonzero(seen >= max(need - len(long), 1)) + lo
    total = seen[found - lo]
    for left, k in zip(range(len(long) - 1, -1, -1), long.tolist()):
        if not len(found):
            break
        own = places[bounds[k] : bounds[k + 1]]
        spot = np.minimum(np.searchsorted(own, found), len(own) - 1)
        total = total + (own[spot] == found)
        on = total >= need - left
        found, total = found[on], total[on]
    return found[(100 + percent) * total >= percent * (n + sizes[found])]


def inverted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverted lists of sets: distinct shingles, bounds, and places in ascending order within each list."""
    flat = np.concatenate(sets)
    place = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, place = flat[order], place[order]
    first = np.ones(len(flat), bool)
    first[1:] = flat[1:] != flat[:-1]
    head = np.flatnonzero(first)
    return flat[head], np.append(head, len(flat)), place


def block_links(names: list[int], sets: list[np.ndarray], side: list[int], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between members of side 0 and of side 1, or among all where there is one side."""
    order = sorted(range(len(sets)), key=lambda k: (len(sets[k]), names[k]))
    names, sets, side = [names[k] for k in order], [sets[k] for k in order], [side[k] for k in order]
    root = list(range(len(sets)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    two = len(set(side)) == 2
    index = [k for k in range(len(sets)) if not two or side[k] == 0]
    lists, sizes = inverted([sets[k] for k in index]), np.array([len(sets[k]) for k in index], np.int64)
    for k in range(len(sets)):
        if two and side[k] == 0:
            continue
        for j in search(sets[k], lists, sizes, percent, None if two else k).tolist():
            a, b = top(k), top(index[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((names[k], names[index[j]]))
    return out


def _families(sets: DataFrame, percent: int) -> DataFrame:
    """node (a set's name) and root of the sets that meet in inverted lists of rare shingles."""
    entries = sets.select("name", "n", F.explode("members").alias("h"))
    counts = entries.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = entries.join(counts, "h").groupBy("name").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "h"))).alias("by"))
    need = F.floor((F.lit(percent) * F.col("n") + 99) / 100)
    # shingles that no other set has come first in the order, and reach nothing
    take = (F.size("by") - need + 1).cast("int")
    rare = ranked.where(take > 0).select("name", F.explode(F.slice("by", F.lit(1), take)).alias("e")).select("name", F.col("e.h").alias("h"))
    rare = workspace.stage(rare, "rare")
    heads = rare.groupBy("h").agg(F.min("name").alias("head"))
    edges = rare.join(heads, "h").where("name <> head").select(F.col("name").alias("a"), F.col("head").alias("b"))
    return components.connected(edges)


def _links(sets: DataFrame, families: DataFrame, percent: int) -> DataFrame:
    """a, b: a spanning forest of the links within each pair of blocks of a family."""
    blocks = families.groupBy("root").agg(F.count(F.lit(1)).alias("size")).select("root", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    member = families.join(blocks, "root").select(F.col("node").alias("name"), "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int").alias("block"))
    placed = sets.join(member, "name")
    # a member goes to every pair of blocks that has its own; the smaller block of a pair is side 0
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = F.transform(every, lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y"), (F.col("block") > o).cast("int").alias("side")))
    work = placed.select("name", "members", "root", F.explode(pairs).alias("p")).select("name", "members", "root", "p.x", "p.y", "p.side")
    work = work.repartition(workspace.task_count(sets.sparkSession), "root", "x", "y").sortWithinPartitions("root", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        names: list[int] = []
        sets: list[np.ndarray] = []
        side: list[int] = []
        out: list[tuple[int, int]] = []
        for b in batches:
            keys = list(zip(b.column("root").to_pylist(), b.column("x").to_pylist(), b.column("y").to_pylist()))
            members = b.column("members")
            flat, bounds = members.values.to_numpy(zero_copy_only=False).view(np.uint64), members.offsets.to_numpy()
            for k, (key, name, s) in enumerate(zip(keys, b.column("name").to_pylist(), b.column("side").to_pylist())):
                if key != now:
                    if len(names) > 1:
                        out += block_links(names, sets, side, percent)
                    now, names, sets, side = key, [], [], []
                names.append(name)
                sets.append(flat[bounds[k] : bounds[k + 1]].copy())
                side.append(s)
            if out:
                yield _edges(out)
                out = []
        if len(names) > 1:
            out += block_links(names, sets, side, percent)
        if out:
            yield _edges(out)

    return work.mapInArrow(run, "a long, b long")


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """For every row of ``df``: ``id`` (the value of ``key`` as long), ``n_shingles`` (long, the size of its set) and ``component_id`` (long, the
    smallest ``key`` that links reach from it, its own included).

    Rows link when 100 * intersection >= ``percent`` * union of their shingle sets. Null and empty texts and texts without words have
    the empty set, link with nothing and are their own component. Copies and repeated rows have equal sets and link. A null
    key is never a component's id unless all keys of the component are null. An empty table gives an empty result; other
    columns are not read.
    """
    if words > len(_ODD) or not 0 < percent <= 100:
        raise ValueError("words or percent out of range")
    return _components(df, key, text, words, percent).select("id", "n_shingles", "component_id")


def _components(df: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """What ``jaccard_components`` returns, with ``th`` (a hash of the text) and ``group`` (long: the same for the rows of a component, null without
    words)."""
    workspace.bound_batches(df.sparkSession)
    rows = _texts(df, key, text)
    named = workspace.stage(_names(rows, words), "names")
    classes = named.where("n > 0").groupBy("name").agg(F.first("n").alias("n"), F.min("id").alias("low"), F.min(F.struct("id", "th")).alias("rep"), F.count(F.lit(1)).alias("copies"))
    hits = _hit_counts(rows, words, percent)
    need = F.ceil(F.lit(percent) * F.col("n") / 100)
    enough = F.col("hits") >= F.greatest(F.lit(1), F.floor(need / 10))
    reached = workspace.stage(classes.join(hits, "name").where(enough).select(F.col("rep.id").alias("rid"), F.col("rep.th").alias("rth")), "reached")
    # one plan at every size: whether the reached sets happen to fit a broadcast does not decide what is shuffled
    met = rows.join(reached.hint("merge"), (F.col("th") == F.col("rth")) & F.col("id").eqNullSafe(F.col("rid"))).select("t")
    sets = workspace.stage(_sets(met, words).dropDuplicates(["name"]), "sets")
    forest = workspace.stage(_links(sets, _families(sets, percent), percent), "links")
    found = components.connected(forest)
    # the smallest key of a component, by class
    low = classes.select(F.col("name").alias("node"), "low").join(found, "node")
    roots = low.groupBy("root").agg(F.min("low").alias("component"))
    joined = found.join(roots, "root").select(F.col("node").alias("name"), "root", "component")
    by_class = classes.select("name", "low", "copies").join(joined, "name", "left").select(F.col("name").alias("c"), F.coalesce("component", "low").alias("component_id"), F.coalesce("root", "name").alias("group"), "copies")
    by_class = workspace.stage(by_class, "classes")
    every = by_class.agg(F.sum("copies")).head()[0] or 0
    # classes of one in HOT of all rows are HOT at most; their rows stay where they are, so no class is a task by itself
    often = by_class.where(F.col("copies") * HOT >= every)
    some = named.where("n > 0")
    hot = some.join(F.broadcast(often), F.col("name") == F.col("c"))
    rare = some.join(F.broadcast(often.select("c")), F.col("name") == F.col("c"), "left_anti").join(by_class.where(F.col("copies") * HOT < every), F.col("name") == F.col("c"))
    linked = hot.unionByName(rare).select("id", F.col("n").alias("n_shingles"), "component_id", "th", "group")
    return linked.union(named.where("n = 0").select("id", "n", "id", "th", F.lit(None).cast("long")))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df``, with all columns, of which one stays for each component of links: the one with the smallest ``key``. A null
    key stays only where the component has no other; rows that repeat that key and its text are reduced to one. Rows without
    words all stay."""
    names = df.columns
    mark = "__component"
    while any(n.startswith(mark) for n in names):
        mark = "_" + mark
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = workspace.stage(_components(df, key, text, words, percent).where("n_shingles > 0"), "components")
    first = found.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("first")).select("first.id", "first.th")
    many = found.groupBy("id", "th").agg((F.count(F.lit(1)) > 1).alias("many"))
    stay = first.join(many, first["id"].eqNullSafe(many["id"]) & (first["th"] == many["th"])).select(first["id"].alias(f"{mark}_id"), first["th"].alias(f"{mark}_th"), F.col("many").alias(f"{mark}_many"))
    some = whole.rlike("[^\\x20\\x09-\\x0D]")
    kept = df.where(some).withColumn(mark, F.xxhash64(whole)).join(stay, F.col(key).cast("long").eqNullSafe(F.col(f"{mark}_id")) & (F.col(mark) == F.col(f"{mark}_th")))
    repeated = kept.where(f"{mark}_many").dropDuplicates([key, mark])
    return kept.where(~F.col(f"{mark}_many")).select(*names).union(repeated.select(*names)).union(df.where(~some).select(*names))
