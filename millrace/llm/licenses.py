"""License scans by a positional index of rare words.

Templates (notices and license texts) are kept as postings: word to (template, position). Of every file only the words that
some template has are looked at. Per template, the file's words of highest inverse document frequency vote for the place
where the template would start: a word at p in the file and q in the template says p - q. Places on which enough different
words agree, within a few inserted or missing words, are candidates. A candidate holds if all mandatory key phrases of the
template stand there word for word and enough of the template's words are in their places.

Document frequencies are counted over all rows. The index is as large as the templates, whatever the input; a text is read
in pieces, so memory beyond the text itself is what its license words take.
"""
from __future__ import annotations

import math
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from millrace.llm.batches import add_columns, extended, quoted, slices

RARE = 4
AGREE = 2
SLACK = 4
SHARE = 0.75
PIECE = 1 << 20
_FULL = range(RARE)
# A-Z become small, digits, small letters and all bytes of other characters are word bytes, the rest separates.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Template:
    """A license text or notice. ``phrases`` have to stand in it word for word; ``share`` of its words has to be in place."""

    label: str
    text: str
    phrases: tuple[str, ...]
    share: float = SHARE


@dataclass(frozen=True)
class Phrase:
    """Words that make a label by themselves, wherever they stand one after the other."""

    text: str
    label: str


# Public license notices and texts.
TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("you may not use this file except in compliance with the license", "without warranties or conditions of any kind"),
    ),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Licensed under the MIT License", ("mit license",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
        ("for any purpose with or without fee is hereby granted",),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        ("redistribution and use in source and binary forms", "with or without modification are permitted"),
    ),
    Template(
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission.",
        ("may be used to endorse or promote products derived from this software",),
    ),
    Template(
        "gpl",
        "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version",),
    ),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("gnu general public license as published by the free software foundation",),
    ),
    Template(
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        ("gnu lesser general public license",),
    ),
    Template(
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("gnu affero general public license",),
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ("mozilla public license v 2 0",),
    ),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
    Template(
        "cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",),
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
        "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by "
        "any means.",
        ("free and unencumbered software released into the public domain",),
    ),
)
PHRASES = (Phrase("cc by", "cc-by"), Phrase("general public license", "gpl"), Phrase("all rights reserved", "reserved"))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


class Index:
    """Postings of the templates; ``idf`` orders the words, the same for all until document frequencies are given."""

    def __init__(self, templates: Sequence[Template] = TEMPLATES, phrases: Sequence[Phrase] = PHRASES) -> None:
        self.templates, self.phrases = tuple(templates), tuple(phrases)
        self.words: dict[bytes, int] = {}
        code = lambda text: np.array([self.words.setdefault(w, len(self.words)) for w in words_of(text)], np.int32)
        self._texts = [code(t.text) for t in self.templates]
        self._keys = [[code(p) for p in t.phrases] for t in self.templates]
        self._needed = [{w for key in keys for w in key.tolist()} for keys in self._keys]
        self._base = [code(p.text) for p in self.phrases]
        self._postings: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, text in enumerate(self._texts):
            for w in np.unique(text).tolist():
                self._postings.setdefault(w, []).append((k, np.flatnonzero(text == w)))
        self.idf = np.zeros(len(self.words))

    def weigh(self, frequencies: dict[int, int], documents: int) -> Index:
        for word in range(len(self.words)):
            self.idf[word] = math.log((documents + 1) / (frequencies.get(word, 0) + 1))
        return self

    def hits(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of words of the text, and the places and codes of those that the index has."""
        data = text.encode("utf-8", "surrogatepass").translate(_PLAIN)
        places, codes, count, at = array("q"), array("i"), 0, 0
        known = self.words.get
        while at < len(data):
            end = data.find(b" ", at + PIECE) if len(data) - at > PIECE else -1
            words = data[at:end].split() if end >= 0 else data[at:].split()
            for k, code in enumerate(map(known, words), count):
                if code is not None:
                    places.append(k)
                    codes.append(code)
            count += len(words)
            at = end if end >= 0 else len(data)
        return count, np.frombuffer(places, np.int64), np.frombuffer(codes, np.int32)

    def base_places(self, places: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
        """Starts of each base phrase."""
        return [_runs(phrase, places, codes) for phrase in self._base]

    def candidates(self, places: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(template, starts): the starts that enough of the file's rarest license words agree on. A template of whose key
        phrases the file lacks a word cannot hold and gets no vote."""
        order = np.unique(codes)
        order = order[np.argsort(-self.idf[order], kind="stable")].tolist()
        shown = set(order)
        votes: dict[int, list[tuple[int, np.ndarray]]] = {k: [] for k, words in enumerate(self._needed) if words <= shown}
        for word in order:
            for template, own in self._postings.get(word, ()):
                if len(votes.get(template, _FULL)) < RARE:
                    votes[template].append((word, own))
        for template, rare in votes.items():
            least = min(AGREE, len(np.unique(self._texts[template])))
            if len(rare) >= max(1, least):
                yield template, _agreed([(places[codes == word][:, None] - own[None, :]).ravel() for word, own in rare], least)

    def with_phrases(self, template: int, starts: np.ndarray, places: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The starts near which every key phrase of the template stands."""
        reach = len(self._texts[template]) + SLACK
        for key in self._keys[template]:
            found = _runs(key, places, codes)
            at = np.searchsorted(found, starts - SLACK)
            nearest = found[np.minimum(at, len(found) - 1)] if len(found) else starts
            starts = starts[(at < len(found)) & (nearest + len(key) <= starts + reach)]
        return starts

    def share(self, template: int, start: int, places: np.ndarray, codes: np.ndarray) -> float:
        """Share of the template's words that stand in place, give or take ``SLACK`` words, at ``start``."""
        text = self._texts[template]
        first, last = np.searchsorted(places, [start - SLACK, start + len(text) + SLACK])
        window = np.full(len(text) + 2 * SLACK, -1, np.int32)
        window[places[first:last] - start + SLACK] = codes[first:last]
        there = np.zeros(len(text), bool)
        for shift in range(2 * SLACK + 1):
            there |= window[shift : shift + len(text)] == text
        return float(there.mean())

    def matches(self, places: np.ndarray, codes: np.ndarray) -> list[tuple[str, int, float]]:
        """(label, start, share) of every template that holds somewhere: its best place, the first of equals."""
        best: dict[int, tuple[float, int]] = {}
        for template, starts in self.candidates(places, codes):
            for start in self.with_phrases(template, starts, places, codes).tolist():
                share = self.share(template, start, places, codes)
                if share >= self.templates[template].share and share > best.get(template, (0.0, 0))[0]:
                    best[template] = (share, start)
        return sorted((self.templates[t].label, max(0, s), v) for t, (v, s) in best.items())


def _runs(phrase: np.ndarray, places: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places where the words of ``phrase`` stand one after the other."""
    n = len(codes) - len(phrase) + 1
    if n <= 0 or not len(phrase):
        return places[:0]
    fits = places[len(phrase) - 1 :] - places[:n] == len(phrase) - 1
    for k, code in enumerate(phrase):
        fits &= codes[k : k + n] == code
    return places[:n][fits]


def _agreed(starts: Sequence[np.ndarray], least: int) -> np.ndarray:
    """The smallest start of each cluster, at most ``SLACK`` wide, that ``least`` different words vote for."""
    flat = np.concatenate(starts)
    word = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
    order = np.argsort(flat, kind="stable")
    flat, word = flat[order], word[order]
    ends = np.searchsorted(flat, flat + SLACK, side="right")
    voters = np.zeros(len(flat), np.int64)
    for w in range(len(starts)):
        upto = np.concatenate([[0], np.cumsum(word == w)])
        voters += upto[ends] > upto[: len(flat)]
    return np.unique(flat[voters >= least])


def document_frequencies(docs: DataFrame, index: Index, text: str = "text") -> tuple[dict[int, int], int]:
    """Rows that hold each word of the index, over all rows, and the number of rows. As many numbers as the index has words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(len(index.words), np.int64), 0
        for _, texts in slices(batches, "text"):
            rows += len(texts)
            for t in texts:
                seen[np.unique(index.hits(t)[2])] += 1
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *held.tolist()], pa.int32()), pa.array([rows, *seen[held].tolist()], pa.int64())], ["word", "n"])

    counted = docs.select(F.col(quoted(text)).alias("text")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word: r.n for r in counted}
    return found, found.pop(-1, 0)


def scan(docs: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """Adds what each whole text says about licenses; columns of these names are replaced, all others stay.

    n_words; n_base, first_word and last_word (number of places of base phrases, smallest and largest start, null if none);
    base_labels and labels (sorted arrays, the second with the labels of templates too); matches (label, first_word and share
    of each template that holds); score (1 where a base phrase stands, else the largest share, 0 without any). Null and
    empty texts have no words and no labels; repeated rows are judged one by one.
    """
    def run(batches: Iterator[pa.RecordBatch], own: str) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches, own):
            out: list[list] = [[] for _ in range(8)]
            for t in texts:
                for column, value in zip(out, _judged(index, t)):
                    column.append(value)
            yield extended(piece, **{f.name: pa.array(column, kind) for f, column, kind in zip(_ADDED, out, _ARROW)})

    return add_columns(docs, text, _ADDED, run)


def _judged(index: Index, text: str) -> tuple:
    count, places, codes = index.hits(text)
    base = index.base_places(places, codes)
    starts = np.concatenate(base) if base else places[:0]
    own = {p.label for p, found in zip(index.phrases, base) if len(found)}
    matches = index.matches(places, codes) if len(codes) else []
    score = 1.0 if own else max((m[2] for m in matches), default=0.0)
    first, last = (int(starts.min()), int(starts.max())) if len(starts) else (None, None)
    named = [{"label": a, "first_word": b, "share": c} for a, b, c in matches]
    return count, len(starts), first, last, sorted(own), sorted(own | {m[0] for m in matches}), named, score


_ADDED = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.ArrayType(T.StringType())),
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("matches", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("share", T.DoubleType())]))),
    T.StructField("score", T.DoubleType()),
]
_ARROW = [
    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()),
    pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("share", pa.float64())])), pa.float64(),
]


def find_licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, phrases: Sequence[Phrase] = PHRASES, text: str = "text") -> DataFrame:
    """``scan`` with document frequencies of all rows."""
    index = Index(templates, phrases)
    return scan(docs, index.weigh(*document_frequencies(docs, index, text)), text)
