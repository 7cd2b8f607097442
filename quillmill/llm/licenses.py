"""License scans with a positional index of rare words.

Templates are short statements and notices of licenses, and bare phrases. Their words are the vocabulary of the scan, each with its postings: in which
template it stands, and where.

1. The inverse document frequency of every word of the vocabulary is counted over all texts (a few numbers a task, added up).
2. A text's words of the vocabulary are kept with their places. For every template, its words with the highest inverse document frequency that the text
   has are looked up: a word at place p of the text and q of the template proposes that the template begins at p - q. Postings are intersected by that
   relative place. A phrase must stand whole, so its rarest word alone gives every place where it can be, and the intersection runs over all its words. Of a
   notice at least half of the words looked up, and two if it has two, must agree on the beginning.
3. A proposal for a notice is verified: the share of its words that stand where they should, and its mandatory key phrases, each of which must
   stand whole inside the notice's stretch of the text.

A text's own letters A-Z count as a-z; words are runs of digits, letters a-z and all characters beyond ASCII.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a template that are looked up in a text, the share of the words that must agree on a beginning, and the share of a notice that must stand.
LOOKED_UP, AGREE, COVERAGE = 8, 0.5, 0.75
#: Bytes of a text that are words at one time.
WINDOW = 1 << 20
_WORDS = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else 32 for c in range(256))
_FOUND = "struct<n_words:long,matches:array<struct<label:string,exact:boolean,start:long,length:int,coverage:double>>>"


@dataclass(frozen=True)
class Template:
    """A label's statement. ``key_phrases`` must stand in it; without any it is a bare phrase, which must stand whole."""

    label: str
    text: str
    key_phrases: tuple[str, ...] = ()


# Phrases and public wordings of license statements.
PHRASES = (
    Template("cc-by", "cc by"),
    Template("gpl", "general public license"),
    Template("reserved", "all rights reserved"),
)
NOTICES = (
    Template("mit", "released under the MIT License", ("mit license",)),
    Template("mit", "licensed under the MIT License", ("mit license",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        ("permission is hereby granted", "without restriction"),
    ),
    Template("apache-2.0", "licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use", "are permitted provided")),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        ("gnu general public license", "free software foundation"),
    ),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license", "v 2 0")),
    Template("cc-by-4.0", "licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc0-1.0", "dedicated to the public domain under CC0 1.0", ("cc0 1 0",)),
)


def words_of(text: bytes) -> list[bytes]:
    """The words of UTF-8 bytes; only A-Z are lower-cased."""
    return text.lower().translate(_WORDS).split()


class Index:
    """Templates as arrays of word numbers, from 1; 0 is any other word."""

    def __init__(self, templates: tuple[Template, ...]) -> None:
        own = [words_of(t.text.encode()) for t in templates]
        keys = [[words_of(k.encode()) for k in t.key_phrases] for t in templates]
        if not all(own) or any(not k for each in keys for k in each):
            raise ValueError("a template and its key phrases need words")
        self.templates = templates
        self.words = list(dict.fromkeys(w for ws in own + [k for each in keys for k in each] for w in ws))
        self.number = {w: k + 1 for k, w in enumerate(self.words)}
        to_array = lambda ws: np.array([self.number[w] for w in ws], np.int32)
        self.arrays = [to_array(ws) for ws in own]
        self.keys = [[to_array(k) for k in each] for each in keys]
        self.idf = np.ones(len(self.words) + 1)

    def with_counts(self, texts: int, counts: dict[int, int]) -> Index:
        """Inverse document frequencies from the number of texts and how many have each word."""
        self.idf = np.array([0.0] + [math.log((texts + 1) / (counts.get(k + 1, 0) + 1)) for k in range(len(self.words))])
        return self

    def read(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """How many words a text has, and places and numbers of those of the vocabulary."""
        count, places, numbers, a = 0, [], [], 0
        while a < len(text):
            b = min(a + WINDOW, len(text))
            if b < len(text):
                # back to the last byte that is in no word, or on to the next one if the window is all one word
                head = text[a:b].lower().translate(_WORDS)
                cut = head.rfind(b" ")
                if cut >= 0:
                    b = a + cut + 1
                else:
                    while b < len(text) and _WORDS[text[b] | 0x20 if 65 <= text[b] <= 90 else text[b]] != 32:
                        b += 1
            found = np.array(list(map(self.number.get, words_of(text[a:b]))), object)
            own = np.flatnonzero(found != None)  # noqa: E711
            places.append(own + count)
            numbers.append(found[own].astype(np.int32))
            count, a = count + len(found), b
        if not places:
            return 0, np.zeros(0, np.int64), np.zeros(0, np.int32)
        return count, np.concatenate(places), np.concatenate(numbers)

    def matches(self, places: np.ndarray, numbers: np.ndarray) -> list[tuple[str, bool, int, int, float]]:
        """label, exact, start, length and coverage of all that a text's words (as ``read`` gives them) hold."""
        if not len(places):
            return []
        order = np.argsort(numbers, kind="stable")
        kinds, first = np.unique(numbers[order], return_index=True)
        postings = dict(zip(kinds.tolist(), np.split(places[order], first[1:])))
        found = []
        for template, words, keys in zip(self.templates, self.arrays, self.keys):
            if template.key_phrases:
                found += self._notice(template.label, words, keys, postings, places, numbers)
            else:
                found += [(template.label, True, int(p), len(words), 1.0) for p in self._whole(words, postings)]
        return sorted(found, key=lambda m: (m[2], m[0], -m[3], -m[4]))

    def _whole(self, words: np.ndarray, postings: dict[int, np.ndarray]) -> np.ndarray:
        """Every place where the words stand one after the other: postings are intersected from the rarest word on."""
        if any(w not in postings for w in words.tolist()):
            return np.zeros(0, np.int64)
        rarest = sorted(range(len(words)), key=lambda q: -self.idf[words[q]])
        at = postings[int(words[rarest[0]])] - rarest[0]
        for q in rarest[1:]:
            if not len(at):
                break
            at = at[_member(at + q, postings[int(words[q])])]
        return at

    def _notice(self, label: str, words: np.ndarray, keys: list[np.ndarray], postings: dict[int, np.ndarray], places: np.ndarray, numbers: np.ndarray) -> list[tuple[str, bool, int, int, float]]:
        if any(w not in postings for key in keys for w in key.tolist()):
            return []
        present = sorted({w for w in words.tolist() if w in postings}, key=lambda w: (-self.idf[w], w))[:LOOKED_UP]
        starts = np.concatenate([postings[w] - q for w in present for q in np.flatnonzero(words == w).tolist()])
        starts, votes = np.unique(starts, return_counts=True)
        starts = starts[votes >= max(math.ceil(AGREE * len(present)), min(2, len(present)))]
        # whole key phrases inside the stretch
        for key in keys:
            if not len(starts):
                return []
            begins = self._whole(key, postings)
            at = np.searchsorted(begins, starts)
            starts = starts[(at < len(begins)) & (np.append(begins, -1)[np.minimum(at, len(begins))] + len(key) <= starts + len(words))]
        if not len(starts):
            return []
        hits = np.zeros(len(starts), np.int64)
        for q, w in enumerate(words.tolist()):
            if w in postings:
                hits += _member(starts + q, postings[w])
        share = hits / len(words)
        return [(label, False, int(max(p, 0)), len(words), float(s)) for p, s in zip(starts.tolist(), share.tolist()) if s >= COVERAGE]


def _member(wanted: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of ``wanted`` are in ``among`` (both in order)."""
    at = np.searchsorted(among, wanted)
    return (at < len(among)) & (among[np.minimum(at, len(among) - 1)] == wanted)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def fit(df: DataFrame, text: str = "text", templates: tuple[Template, ...] = PHRASES + NOTICES) -> Index:
    """The index of the templates with inverse document frequencies over every row of ``df``. What reaches the driver is one number for each
    word of the templates."""
    index = Index(templates)
    shared = df.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        counts = np.zeros(len(own.words) + 1, np.int64)
        for b in batches:
            for t in _texts(b.column(0)):
                counts[0] += 1
                counts[np.unique(own.read(t)[2])] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(counts)), pa.int32()), pa.array(counts)], ["word", "n"])

    sums = df.select(F.col(text).cast("binary").alias("t")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in sums.toLocalIterator()}
    return index.with_counts(found.get(0, 0), found)


def with_licenses(df: DataFrame, index: Index, text: str = "text", out: str = "licenses") -> DataFrame:
    """Add the struct ``out``: n_words and matches, an array of (label, exact, start, length, coverage) in order of start, in words from 0. An exact match
    is a phrase; the others are notices, ``coverage`` of whose words stand where they should.

    Null and empty texts have no words and no matches. Rows that repeat each get theirs; other columns pass through, whatever their names,
    except that one named like the output is replaced. An empty table gives an empty one. No shuffle; a text's words are read a megabyte
    at a time, and only the places of template words are held.
    """
    shared = df.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf(_FOUND)
    def run(texts: pa.Array) -> pa.Array:
        own, n, matches = shared.value, [], []
        for t in _texts(texts):
            count, places, numbers = own.read(t)
            n.append(count)
            matches.append([dict(zip(("label", "exact", "start", "length", "coverage"), m)) for m in own.matches(places, numbers)])
        kind = pa.list_(pa.struct([("label", pa.string()), ("exact", pa.bool_()), ("start", pa.int64()), ("length", pa.int32()), ("coverage", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(matches, kind)], ["n_words", "matches"])

    return df.withColumn(out, run(F.col(text).cast("binary")))
