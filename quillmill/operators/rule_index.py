"""Thousands of rules on a text: an automaton over all finds tells which rules may fire, so the others cost nothing.

A rule may fire on a text for one of two reasons. Its find is in the text as given: one pass of an Aho-Corasick automaton tells all such rules. Or a rule
before it has made it: what is new after a replacement overlaps the text put in, or (if that is empty) the seam. So rule i may make rule j > i fire only
if j's find and i's replacement overlap: one holds the other, or one ends as the other begins. That graph is found with a second automaton and the
borders of the replacements. A text then runs its rules in order from a heap, to which each rule that has changed it adds those it may have made.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.operators.rules import Rule


class RuleIndex:
    """Rules in order, those without a find or without an effect left out of what runs."""

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.rules = [(r.find or "", r.replace or "") for r in rules]
        self.live = [k for k, (f, r) in enumerate(self.rules) if f and f != r]
        self.singles: dict[str, int] = {}
        self.after: dict[str, list[int]] = defaultdict(list)
        words: dict[str, list[int]] = defaultdict(list)
        for k in self.live:
            words[self.rules[k][0]].append(k)
        self.by_find = dict(words)
        self.characters = {f for f in words if len(f) == 1}
        self.long = ahocorasick.Automaton()
        for f in words:
            if len(f) > 1:
                self.long.add_word(f, f)
        if len(self.long):
            self.long.make_automaton()
        self._made: dict[str, list[int]] = {}
        self._borders()

    def _borders(self) -> None:
        """Rules by the starts, the ends and the inner parts of their finds, as far as replacements ask for them."""
        self.starts, self.ends, self.inside = defaultdict(list), defaultdict(list), defaultdict(list)
        asked = {self.rules[k][1] for k in self.live}
        sizes = sorted({len(r) for r in asked if r})
        for f, own in self.by_find.items():
            for n in range(1, len(f)):
                self.starts[f[:n]] += own
                self.ends[f[len(f) - n :]] += own
            for n in sizes:
                if n > len(f):
                    break
                for r in {f[a : a + n] for a in range(len(f) - n + 1)} & asked:
                    self.inside[r] += own
        # what an empty replacement may join
        self.joined = sorted(k for f, own in self.by_find.items() if len(f) > 1 for k in own)

    def made_by(self, replacement: str) -> list[int]:
        """The rules, in order, whose find can come about where this has been put in."""
        if replacement not in self._made:
            if not replacement:
                found = set(self.joined)
            else:
                found = set(self.inside[replacement]) | set(self.found(replacement))
                for n in range(1, len(replacement) + 1):
                    # the replacement's end begins a find, or its start ends one
                    found.update(self.starts.get(replacement[-n:], ()))
                    found.update(self.ends.get(replacement[:n], ()))
            self._made[replacement] = sorted(found)
        return self._made[replacement]

    def found(self, text: str) -> list[int]:
        """The rules whose find is in the text, in order."""
        hits = {c for c in set(text) if c in self.characters} if self.characters else set()
        if len(self.long):
            hits.update(f for _, f in self.long.iter(text))
        return sorted(k for f in hits for k in self.by_find[f])

    def apply(self, text: str) -> str:
        """The text after all rules in order."""
        heap = self.found(text)
        waiting = set(heap)
        while heap:
            k = heapq.heappop(heap)
            find, replacement = self.rules[k]
            if find not in text:
                continue
            text = text.replace(find, replacement)
            for j in self.made_by(replacement):
                if j > k and j not in waiting:
                    waiting.add(j)
                    heapq.heappush(heap, j)
        return text


def apply_many(text: Column, rules: Iterable[Rule]) -> Column:
    """``text`` after all rules in order, as ``rules.apply_rules``, in time that grows with the rules that a text meets and not with all there are. The rules go
    to the tasks with the plan. Null texts stay null."""
    own = [Rule(r.find, r.replace) for r in rules]

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        index = _index(own)
        return pa.array([None if t is None else index.apply(t) for t in texts.to_pylist()], pa.string())

    return run(text)


def rules_in(text: Column, rules: Iterable[Rule]) -> Column:
    """The places in ``rules``, in order, of those whose find is in the text as given. Null for a null text."""
    own = [Rule(r.find, r.replace) for r in rules]

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        index = _index(own)
        return pa.array([None if t is None else index.found(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return run(text)


_INDEXES: dict[int, tuple[list[Rule], RuleIndex]] = {}


def _index(rules: list[Rule]) -> RuleIndex:
    """The index of a task's rules, made once."""
    held = _INDEXES.get(id(rules))
    if held is None or held[0] is not rules:
        _INDEXES.clear()
        held = _INDEXES[id(rules)] = rules, RuleIndex(rules)
    return held[1]
