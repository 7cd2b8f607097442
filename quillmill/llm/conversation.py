"""Repair of the structure of conversations by fewest edits.

A conversation's rows, by turn, are edited until the initials of its roles read ``(s?(ua)+)?``: a row is kept (0), given the role user or assistant
(3) or deleted (4; the only choice for blank rows and for copies of earlier rows), and an empty turn of user or assistant may be inserted anywhere
(3); an undeleted row whose text has no end costs 3 more. Nodes are (rows used, state of the pattern), arcs are edits. Forward and backward least costs
tell which arcs are *tight*, that is on some cheapest way; a walk over them with a set of nodes as its front takes the least letter
(D, I, K, R) that any tight arc out of the front has. Both costs are kept as differences from their least, of which there are few, so each row is
one look-up in a table that fills as it is used.

Scale: no conversation needs to fit a task. Rows are counted by (conversation, turn, role, text digest), which folds copies before any shuffle; the first row
of each (conversation, role, text) brings its text; both are sorted in ranges of (conversation, turn, ...). A conversation inside a range is
repaired there. One that crosses ranges, or is long, leaves its range as packed pieces, which are read once backward (costs to the end) and
once forward (walk, audit, digest), a piece at a time. What a conversation adds up to in one task is its audit, one character a row, which is
one value of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Items of a piece, and bytes of their texts.
PIECE_ROWS, PIECE_BYTES = 1 << 13, 1 << 22
#: A row that must go has code 0; the others have 1 + 2 * (initial: s, u, a, other) + (whether the text has no end).
_INITIALS = "sua"
#: States: nothing yet, after s, after u, after a. The state after each initial, None where it may not stand.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ROLE = {"u": "user", "a": "assistant"}
_END = (0, 3)
#: More than any two states' costs to the end differ by: a node that is so far above the least cost is on no cheapest way.
_FAR = 64
_STATS = ("blank", "duplicate", "truncated", "illegal", "rows", "first_initial", "last_initial", "min_turn", "max_turn", "turns", "first_turn", "last_turn")


def _asked(state: int) -> str:
    """The initial of the one role of user and assistant that may come next."""
    return "a" if state == 2 else "u"


def _code(role: str, truncated: bool) -> int:
    at = _INITIALS.find(role[0]) if role else -1
    return 1 + 2 * (at if at >= 0 else 3) + truncated


def _arcs(state: int, code: int) -> list[tuple[str, int, int, str | None]]:
    """letter, cost, next state and new role of the edits that use up a row of this code."""
    found = [("D", DELETE, state, None)]
    if code:
        initial, extra = (*_INITIALS, "?")[(code - 1) // 2], TRUNCATED * ((code - 1) % 2)
        if initial in _NEXT[state]:
            found.append(("K", KEEP + extra, _NEXT[state][initial], None))
        asked = _asked(state)
        found.append(("R", REROLE + extra, _NEXT[state][asked], _ROLE[asked]))
    return found


class Costs:
    """Least costs by state, as differences from the least of them (numbered), and the walk over tight arcs."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self._back: dict[tuple[int, int], int] = {}
        self._walk: dict[tuple[int, int, int, tuple[int, ...]], tuple] = {}
        self.start = self._put(self._closed([0, _FAR, _FAR, _FAR]))[0]
        end = [0 if q in _END else INSERT if _NEXT[q][_asked(q)] in _END else 2 * INSERT for q in range(4)]
        self.end = self._put(end)[0]

    def _put(self, costs: list[int]) -> tuple[int, int]:
        """The number of the costs' differences, and the least cost."""
        least = min(costs)
        key = tuple(min(c - least, _FAR) for c in costs)
        if key not in self.number:
            self.number[key] = len(self.vectors)
            self.vectors.append(key)
        return self.number[key], least

    def _closed(self, costs: list[int]) -> list[int]:
        """Costs with insertions after them; two in a row reach every state that any number reaches."""
        costs = list(costs)
        for _ in range(2):
            for q in range(4):
                to = _NEXT[q][_asked(q)]
                costs[to] = min(costs[to], costs[q] + INSERT)
        return costs

    def _before(self, after: tuple[int, ...], code: int) -> list[int]:
        """Least costs to the end before a row, from those after it."""
        costs = [min(w + after[to] for _, w, to, _ in _arcs(q, code)) for q in range(4)]
        for _ in range(2):
            costs = [min(costs[q], costs[_NEXT[q][_asked(q)]] + INSERT) for q in range(4)]
        return costs

    def back(self, after: int, code: int) -> int:
        key = after, code
        if key not in self._back:
            self._back[key] = self._put(self._before(self.vectors[after], code))[0]
        return self._back[key]

    def walk(self, before: int, code: int, after: int, front: tuple[int, ...]) -> tuple[int, int, str, tuple, tuple[int, ...]]:
        """Past one row: costs from the start after it (number, what the least grew by), letters, (letter, new role) of each, and the front."""
        key = before, code, after, front
        if key not in self._walk:
            self._walk[key] = self._walked(*key)
        return self._walk[key]

    def _walked(self, before: int, code: int, after: int, front: tuple[int, ...]) -> tuple[int, int, str, tuple, tuple[int, ...]]:
        f, b_after = self.vectors[before], self.vectors[after]
        b = self._before(b_after, code)
        best = min(x + y for x, y in zip(f, b))
        steps: list[tuple[str, str | None]] = []
        while True:
            tight = []
            for q in front:
                to = _NEXT[q][_asked(q)]
                if f[q] + INSERT + b[to] == best:
                    tight.append(("I", to, _ROLE[_asked(q)], False))
                tight += [(letter, to, role, True) for letter, w, to, role in _arcs(q, code) if f[q] + w + b_after[to] == best]
            letter = min(t[0] for t in tight)
            chosen = [t for t in tight if t[0] == letter]
            front = tuple(sorted({t[1] for t in chosen}))
            steps.append((letter, chosen[0][2]))
            if chosen[0][3]:
                break
        reached = [_FAR] * 4
        for q in range(4):
            for _, w, to, _ in _arcs(q, code):
                reached[to] = min(reached[to], f[q] + w)
        number, grown = self._put(self._closed(reached))
        return number, grown, "".join(s[0] for s in steps), tuple(steps), front

    def finish(self, before: int, front: tuple[int, ...]) -> tuple[int, str, tuple]:
        """Cost beyond the least, letters and steps of what is inserted after the last row."""
        f, b = self.vectors[before], self.vectors[self.end]
        best = min(x + y for x, y in zip(f, b))
        steps = []
        while not any(q in _END and f[q] == best for q in front):
            tight = [(_NEXT[q][_asked(q)], _ROLE[_asked(q)]) for q in front if f[q] + INSERT + b[_NEXT[q][_asked(q)]] == best]
            front = tuple(sorted({t[0] for t in tight}))
            steps.append(("I", tight[0][1]))
        return best, "I" * len(steps), tuple(steps)


class Piece:
    """Consecutive rows of one conversation: items (code, how many rows, role, text) and counts that add up."""

    __slots__ = ("codes", "runs", "roles", "texts", "size", *_STATS)

    def __init__(self) -> None:
        self.codes, self.runs, self.roles, self.texts, self.size = bytearray(), [], [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.rows = self.turns = 0
        self.first_initial = self.last_initial = self.min_turn = self.max_turn = self.first_turn = self.last_turn = None

    def add(self, role: str, turn: int | None, n: int, blank: bool, truncated: bool, text: str | None) -> None:
        """n rows alike; with a text, the first of them is no copy."""
        eligible = text is not None
        if eligible:
            self.codes.append(_code(role, truncated))
            self.runs.append(1)
            self.roles.append(role)
            self.texts.append(text)
            self.size += len(text) + len(role)
            self.truncated += truncated
        if n > eligible:
            self.codes.append(0)
            self.runs.append(n - eligible)
            self.roles.append(None)
            self.texts.append(None)
        self.blank += n * blank
        self.duplicate += 0 if blank else n - eligible
        initial = role[:1]
        self.illegal += (n - 1) + self._clash(self.last_initial, initial)
        self.first_initial = initial if self.first_initial is None else self.first_initial
        self.last_initial = initial
        self.rows += n
        if turn is not None:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turns += turn != self.last_turn
            self.min_turn = turn if self.min_turn is None else self.min_turn
            self.last_turn = self.max_turn = turn

    @staticmethod
    def _clash(one: str | None, other: str | None) -> int:
        return int(one is not None and other is not None and one + other not in ("su", "ua", "au"))

    @property
    def full(self) -> bool:
        return len(self.codes) >= PIECE_ROWS or self.size >= PIECE_BYTES

    def stats(self) -> list:
        return [getattr(self, s) for s in _STATS]


def _joined(a: list | None, b: list) -> list:
    """The counts of two pieces, one after the other."""
    if a is None or not a[4]:
        return list(b)
    if not b[4]:
        return list(a)
    x, y = dict(zip(_STATS, a)), dict(zip(_STATS, b))
    out = {s: x[s] + y[s] for s in ("blank", "duplicate", "truncated", "illegal", "rows", "turns")}
    out["illegal"] += Piece._clash(x["last_initial"], y["first_initial"])
    out["turns"] -= x["last_turn"] is not None and x["last_turn"] == y["first_turn"]
    known = lambda s, t: y[s] if x[t] is None else x[t] if y[s] is None else None
    out["first_initial"], out["last_initial"] = x["first_initial"], y["last_initial"]
    out["first_turn"] = x["first_turn"] if x["first_turn"] is not None else y["first_turn"]
    out["last_turn"] = y["last_turn"] if y["last_turn"] is not None else x["last_turn"]
    out["min_turn"] = known("min_turn", "min_turn") if x["min_turn"] is None or y["min_turn"] is None else min(x["min_turn"], y["min_turn"])
    out["max_turn"] = known("max_turn", "max_turn") if x["max_turn"] is None or y["max_turn"] is None else max(x["max_turn"], y["max_turn"])
    return [out[s] for s in _STATS]


class Walk:
    """The forward walk through one conversation, piece by piece."""

    def __init__(self, costs: Costs, turns: bool) -> None:
        self.costs, self.turns = costs, turns
        self.f, self.cost, self.front, self.audit, self.stats = costs.start, 0, (0,), [], None
        self.digest, self.any, self.place = hashlib.sha256(), False, 0

    def piece(self, codes: bytes, runs: list, roles: list, texts: list, stats: list, b_end: int) -> list[tuple[int, str, str, str]]:
        """Walk a piece; the repaired turns (place, letter, role, text) if they are wanted."""
        costs, out = self.costs, []
        b, ahead = b_end, [b_end]
        for code in reversed(codes):
            b = costs.back(b, code)
            ahead.append(b)
        ahead.reverse()
        for k, code in enumerate(codes):
            self.f, grown, letters, steps, self.front = costs.walk(self.f, code, ahead[k + 1], self.front)
            if runs[k] > 1:  # copies, all deleted: the costs of the states all grow alike, so each row is like the first
                letters, steps = letters + "D" * (runs[k] - 1), ()
                grown *= runs[k]
            self.cost += grown
            self.audit.append(letters)
            if len(steps) != 1 or letters != "D":
                self._write(steps, roles[k], texts[k], out)
        self.stats = _joined(self.stats, stats)
        return out

    def _write(self, steps: tuple, role: str | None, text: str | None, out: list) -> None:
        for letter, new in steps:
            if letter == "D":
                continue
            turn = (role if letter == "K" else new, "" if letter == "I" else text)
            if self.turns:
                out.append((self.place, letter, *turn))
                self.place += 1
            else:
                self.digest.update(f"{chr(10) if self.any else ''}{turn[0]}:{turn[1]}".encode("utf-8", "surrogatepass"))
                self.any = True

    def finish(self) -> tuple[dict, list[tuple[int, str, str, str]]]:
        more, letters, steps = self.costs.finish(self.f, self.front)
        out: list = []
        self._write(steps, None, None, out)
        s = dict(zip(_STATS, self.stats or Piece().stats()))
        report = {
            "gaps": 0 if s["min_turn"] is None else s["max_turn"] - s["min_turn"] + 1 - s["turns"],
            **{c: s[c] for c in ("blank", "duplicate", "truncated", "illegal")},
            "cost": self.cost + more,
            "audit": "".join(self.audit) + letters,
            "repaired_sha256": self.digest.hexdigest(),
        }
        return report, out


def _sorted_rows(df: DataFrame, conv: str, turn: str, role: str, text: str, present: Column) -> DataFrame:
    """Rows in order, in ranges: for each (conversation, turn, role, text) how many there are, behind a row with the text where it is the first of
    its (conversation, role, text); a row without number for a conversation that may have no others."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(
        F.col(conv).alias("conv"),
        F.coalesce(present, F.lit(False)).alias("there"),
        F.col(turn).isNotNull().alias("known"),
        F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
        (~body.rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~body.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
        body.alias("text"),
    )
    here = rows.where("there")
    counted = here.groupBy("conv", "known", "turn", "role", "digest", "blank", "truncated").agg(F.count(F.lit(1)).alias("n"))
    texts = here.where("NOT blank").groupBy("conv", "role", "digest", "truncated").agg(F.min(F.struct("known", "turn")).alias("at"), F.first("text").alias("text"))
    names = rows.select("conv").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    columns = ["conv", "known", "turn", "role", "digest", "kind", "n", "blank", "truncated", "text"]
    every = (
        counted.withColumns({"kind": F.lit(2), "text": none("string")})
        .select(columns)
        .union(texts.select("conv", "at.known", "at.turn", "role", "digest", F.lit(1), F.lit(0).cast("long"), F.lit(False), "truncated", "text"))
        .union(names.select("conv", F.lit(False), F.lit(0).cast("long"), F.lit(""), none("binary"), F.lit(0), F.lit(0).cast("long"), F.lit(False), F.lit(False), none("string")))
    )
    return every.repartitionByRange("conv", "known", "turn", "role", "digest").sortWithinPartitions("conv", "known", "turn", "role", "digest", "kind")


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PIECE = "part int, piece int, codes binary, runs array<long>, roles array<string>, texts array<string>, counts array<long>, initials array<string>, ahead array<int>"
_COUNTS = tuple(s for s in _STATS if not s.endswith("_initial"))


def _batches(columns: dict[str, pa.DataType], rows: Iterator[dict], limit: int = 500, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size."""
    held, used = [], 0
    pack = lambda: pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in held], t) for c, t in columns.items()], list(columns))
    for r in rows:
        held.append(r)
        used += r.get("__size", 0)
        if len(held) >= limit or used >= size:
            yield pack()
            held, used = [], 0
    if held:
        yield pack()


def _repaired(df: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None, turns: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = _sorted_rows(df, conv, turn, role, text, F.lit(True) if present is None else present)
    spark, name = df.sparkSession, rows.schema["conv"].dataType.simpleString()
    done = f"conv {name}, seq long, edit string, role string, text string" if turns else f"conv {name}, {_REPORT}"
    middle = f"{done}, {_PIECE}"
    arrow = lambda ddl: {f.name: f.type for f in to_arrow_schema(spark.createDataFrame([], ddl).schema)}
    done_types, middle_types = arrow(done), arrow(middle)

    def packed(key, part: int, number: int, p: Piece) -> dict:
        stats = dict(zip(_STATS, p.stats()))
        return {
            "conv": key, "part": part, "piece": number, "codes": bytes(p.codes), "runs": p.runs, "roles": p.roles, "texts": p.texts,
            "counts": [stats[s] for s in _COUNTS], "initials": [stats["first_initial"], stats["last_initial"]], "__size": p.size,
        }

    def unpacked(r: dict) -> list:
        stats = dict(zip(_COUNTS, r["counts"])) | dict(zip(("first_initial", "last_initial"), r["initials"]))
        return [stats[s] for s in _STATS]

    def results(key, walk: Walk, written: list) -> Iterator[dict]:
        report, last = walk.finish()
        if turns:
            yield from written_rows(key, written + last)
        else:
            yield {"conv": key, **report, "__size": len(report["audit"])}

    def written_rows(key, written: list) -> Iterator[dict]:
        for place, letter, role_, text_ in written:
            yield {"conv": key, "seq": place, "edit": letter, "role": role_, "text": text_, "__size": len(text_)}

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Repairs the conversations that begin and end inside the range; pieces of the others."""
        part, costs = TaskContext.get().partitionId(), Costs()

        def run() -> Iterator[dict]:
            key, piece, number, first, some, text_ = None, Piece(), 0, True, False, None

            def close(last: bool) -> Iterator[dict]:
                # the range before may hold the start of the first, the one after it more of the last
                if first or last or number:
                    yield packed(key, part, number, piece)
                else:
                    walk = Walk(costs, turns)
                    yield from results(key, walk, walk.piece(piece.codes, piece.runs, piece.roles, piece.texts, piece.stats(), costs.end))

            for b in batches:
                columns = [b.column(c).to_pylist() for c in ("conv", "known", "turn", "role", "kind", "n", "blank", "truncated", "text")]
                for conv_, known, turn_, role_, kind, n, blank, truncated, body in zip(*columns):
                    if some and conv_ != key:
                        yield from close(False)
                        piece, number, first = Piece(), 0, False
                    key, some = conv_, True
                    if kind == 1:
                        text_ = body
                    elif kind == 2:
                        piece.add(role_, turn_ if known else None, n, blank, truncated, text_)
                        text_ = None
                        if piece.full:
                            yield packed(key, part, number, piece)
                            piece, number = Piece(), number + 1
            if some:
                yield from close(True)

        return _batches(middle_types, run())

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces, last to first: each gets the costs to the end after it."""
        costs = Costs()

        def run() -> Iterator[dict]:
            key, b, some = None, costs.end, False
            for batch in batches:
                for r in batch.to_pylist():
                    if r["codes"] is not None:
                        if not some or r["conv"] != key:
                            key, b, some = r["conv"], costs.end, True
                        r["ahead"] = list(costs.vectors[b])
                        for code in reversed(r["codes"]):
                            b = costs.back(b, code)
                    r["__size"] = sum(map(len, filter(None, r["texts"] or ()))) + len(r.get("audit") or "")
                    yield r

        return _batches(middle_types, run())

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces, first to last: the walk."""
        costs = Costs()

        def run() -> Iterator[dict]:
            key, walk = None, None
            for batch in batches:
                for r in batch.to_pylist():
                    if r["codes"] is None:
                        yield r
                        continue
                    if walk is None or r["conv"] != key:
                        if walk is not None:
                            yield from results(key, walk, [])
                        key, walk = r["conv"], Walk(costs, turns)
                    yield from written_rows(key, walk.piece(r["codes"], r["runs"], r["roles"], r["texts"], unpacked(r), costs._put(r["ahead"])[0]))
            if walk is not None:
                yield from results(key, walk, [])

        return _batches(done_types, run())

    ranged = rows.mapInArrow(by_range, middle)
    ordered = ranged.repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("piece"))
    met = ordered.mapInArrow(backward, middle).sortWithinPartitions("conv", "part", "piece")
    return met.mapInArrow(forward, done)


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """One row a conversation: ``conv``, gaps (turns missing between the least and the greatest), blank, duplicate and truncated rows (the first fault of each counts),
    illegal (neighbours whose initials are not su, ua or au), cost, audit (the letters of the cheapest edits; of several the least string) and
    repaired_sha256 (of the repaired ``role:text``, joined by newlines).

    Rows go by turn, null turns first, then by role and digest of the text; copies of a row are therefore neighbours. Blank: no character beyond
    ``[\\x20\\x09-\\x0D]``; duplicate: role and text seen earlier; truncated: the last such character is none of ``.!?``. Null roles and texts are
    empty, so such texts are blank; a role that is empty or begins with another letter must be changed or go. A null conversation is a
    conversation. ``present``: rows for which it does not hold only name their conversation; one without other rows has zeros and an empty
    audit. Other columns are not read, whatever their names. An empty table gives an empty one. Texts of any length that fits a row.
    """
    return _repaired(df, conv, turn, role, text, present, False).withColumnRenamed("conv", conv)


def repaired_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """The turns after the repair of ``repair``: ``conv``, seq (from 0), edit (K, R or I), role and text."""
    return _repaired(df, conv, turn, role, text, present, True).withColumnRenamed("conv", conv)
