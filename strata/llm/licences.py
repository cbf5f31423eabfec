"""Licences: matching statistics against a suffix automaton of licence texts, chained into covered spans.

The tokens of all templates make one generalised suffix automaton. A text's tokens stream
through it and give, at each, the longest stretch ending there that stands in a template.
Matches that cannot be made longer and have SEED words at least are chained: in order both
in the text and in a template, with at most GAP words left out between two. A chain that
covers enough of a template (whole, if it is short) is a span of its label. A phrase is a
template of two words or more that is also reported wherever it stands: where the match is
as long as it and its state lies on the match's way of suffix links.

Only stretches whose pairs of neighbouring words stand in some template go through the
automaton one word at a time; elsewhere no match has two words, which is found for whole
columns at once. The automaton is built from the templates alone (WORDS words at most, or an
error: it is sent to each executor), whatever the size of the data.

Nulls: a null or empty text has no words and no spans. Very long texts are read a window of
bytes at a time and keep four bytes for each word. Of chains with equal cover the first one
counts. Repeated rows each get their row, an empty table gives an empty one, and columns
besides the id and the text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.bpe import portions
from strata.llm.words import letters_and_digits, words

#: Words of the shortest match that is chained, the most words between two of a chain, and of all templates.
SEED, GAP, WORDS = 3, 16, 200_000
#: A template of up to SHORT words has to be covered whole, a longer one by SHORT words and this share of it.
SHORT, SHARE = 12, 0.5

# Phrases with their labels, and texts and notices of licences.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
BSD_WARRANTY = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
ENDORSE = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
GNU = "this program is free software you can redistribute it and or modify it under the terms of the {} as published by the free software foundation {} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {} for more details"
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + WARRANTY),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd-2-clause", f"{BSD} {BSD_WARRANTY}"),
    ("bsd-3-clause", f"{BSD} {ENDORSE} {BSD_WARRANTY}"),
    ("bsd-3-clause", ENDORSE),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-2.0", GNU.format("gnu general public license", "either version 2", "gnu general public license")),
    ("gpl-3.0", GNU.format("gnu general public license", "either version 3", "gnu general public license")),
    ("lgpl-2.1", GNU.format("gnu lesser general public license", "either version 2 1", "gnu lesser general public license")),
    ("lgpl-3.0", GNU.format("gnu lesser general public license", "either version 3", "gnu lesser general public license")),
    ("agpl-3.0", GNU.format("gnu affero general public license", "either version 3", "gnu affero general public license")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed do what the fuck you want to public license"),
    *[(name, f"spdx license identifier {words}") for name, words in (
        ("mit", "mit"), ("isc", "isc"), ("apache-2.0", "apache 2 0"), ("gpl-2.0", "gpl 2 0"), ("gpl-3.0", "gpl 3 0"), ("lgpl-2.1", "lgpl 2 1"), ("lgpl-3.0", "lgpl 3 0"),
        ("agpl-3.0", "agpl 3 0"), ("mpl-2.0", "mpl 2 0"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"), ("bsl-1.0", "bsl 1 0"), ("cc0-1.0", "cc0 1 0"), ("unlicense", "unlicense"), ("zlib", "zlib"),
    )],
    ("mit", "under the mit license"),
    ("apache-2.0", "apache license version 2 0"),
    ("apache-2.0", "apache license 2 0"),
    *[(f"{short}-{version.replace(' ', '.')}", f"gnu {kind} license {said}{version.removesuffix(' 0')}") for short, kind, versions in (
        ("gpl", "general public", ("2 0", "3 0")), ("lgpl", "lesser general public", ("2 1", "3 0")), ("agpl", "affero general public", ("3 0",)),
    ) for version in versions for said in ("version ", "v")],
    ("mpl-2.0", "mozilla public license version 2 0"),
    ("bsd", "under the bsd license"),
    ("isc", "under the isc license"),
]


def tokens_of(text: str) -> list[str]:
    return [w.decode() for found, _ in words(pa.array([text], pa.string()), letters_and_digits) for w in found.to_pylist()]


class Automaton:
    """The generalised suffix automaton of phrases and templates."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        told = [tokens_of(t) for t in phrases] + [tokens_of(t) for _, t in templates]
        self.labels = [*phrases.values(), *(name for name, _ in templates)]
        self.phrases = len(phrases)
        if (total := sum(map(len, told))) > WORDS:
            raise ValueError(f"{total} words of templates; {WORDS} at most")
        self.vocabulary = sorted({w for t in told for w in t})
        number = {w: k for k, w in enumerate(self.vocabulary)}
        self.told, self.sizes = told, [len(t) for t in told]
        if self.phrases and min(self.sizes[: self.phrases]) < 2:
            raise ValueError("a phrase has two words at least")
        self.ids = [[number[w] for w in t] for t in told]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [[]]
        pairs = set()
        for k, ids in enumerate(self.ids):
            pairs |= set(zip(ids, ids[1:]))
            last = 0
            for place, x in enumerate(ids):
                last = self._extended(last, x)
                self.ends[last].append((k, place + 1))
        self.known = np.array(sorted(a * len(self.vocabulary) + b for a, b in pairs), np.int64)
        # Ends of a state are also those of the states its suffixes lead to.
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]].extend(self.ends[s])
        # Where else in templates a state's strings end as far as their last SEED words or more, with the words in common.
        self.above: list[list[tuple[int, int, int]]] = [[] for _ in self.next]
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.length[up := self.link[s]] >= SEED:
                own = set(self.ends[s])
                self.above[s] = [(k, place, self.length[up]) for k, place in self.ends[up] if (k, place) not in own and k >= self.phrases] + self.above[up]
        # Phrases that are suffixes of a state's strings, as (words, number): a match as long as the phrase ends with it.
        self.said: list[tuple] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = [(self.sizes[k], k) for k, end in self.ends[s] if k < self.phrases and end == self.sizes[k] and self.length[self.link[s]] < end <= self.length[s]]
            self.said[s] = (*self.said[self.link[s]], *own)

    def _extended(self, last: int, x: int) -> int:
        """The state of a template's part that is one word longer; states of other templates are shared."""
        if x in self.next[last]:
            q = self.next[last][x]
            return q if self.length[q] == self.length[last] + 1 else self._cloned(last, x, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._cloned(p, x, q)
        return new

    def _cloned(self, p: int, x: int, q: int) -> int:
        new = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = new
            p = self.link[p]
        return new

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def statistics(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: state and length of the longest stretch ending there that stands in a template."""
        s = size = 0
        following, link, length = self.next, self.link, self.length
        for x in ids:
            while x not in following[s]:
                if not s:
                    size = 0
                    break
                s = link[s]
                size = length[s]
            else:
                s = following[s][x]
                size += 1
            yield s, size

    def runs(self, ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where stretches of known pairs begin and end; ids: -1 for words that no template has."""
        pair = ids[:-1].astype(np.int64) * len(self.vocabulary) + ids[1:]
        place = np.minimum(np.searchsorted(self.known, pair), len(self.known) - 1)
        has = (self.known[place] == pair) & (ids[:-1] >= 0) & (ids[1:] >= 0) & (text[1:] == text[:-1])
        edge = np.diff(np.concatenate([[False], has, [False]]).astype(np.int8))
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1


class Chain:
    """Of a template's matches in a text, in order: the best chain that ends with each."""

    def __init__(self, size: int):
        self.size, self.done, self.recent = size, [], []

    def add(self, start: int, end: int, at: int, low: int) -> None:
        """A match of the text's words from start to end with the template's from at; no match to come starts before low."""
        size, first, cover = end - start, start, end - start
        self.recent = [x for x in self.recent if x[0] >= low - GAP]
        for to, there, begun, had in self.recent:
            shared = max(0, to - start, there - at)
            if shared < size and start - to <= GAP and at - there <= GAP and to < end and there < at + size and had + size - shared > cover:
                first, cover = begun, had + size - shared
        self.recent.append((end, at + size, first, cover))
        self.done.append((cover, first, end))

    def best(self) -> list[tuple[int, int, int]]:
        """(start, end, cover) of chains that cover enough and share no word, the fullest first."""
        enough = self.size if self.size <= SHORT else max(SHORT, SHARE * self.size)
        out: list[tuple[int, int, int]] = []
        reach: set[int] = set()
        for cover, start, end in sorted((x for x in self.done if x[0] >= enough), key=lambda x: (-x[0], x[1], x[2])):
            if reach.isdisjoint(range(start, end)):
                reach.update(range(start, end))
                out.append((start, end, cover))
        return sorted(out)


def spans_of(automaton: Automaton, first: np.ndarray, last: np.ndarray, ids: np.ndarray, offset: int) -> list[tuple[str, bool, int, int, int, int]]:
    """(label, of a phrase, start, end, covered words, words of the template) in one text, by start; offset: its first word's place."""
    out, chains = [], {}
    for a, b in zip(first.tolist(), last.tolist()):
        run = ids[a:b].tolist()
        for i, (s, size) in enumerate(automaton.statistics(run)):
            end = a + i + 1 - offset
            out += [(automaton.labels[k], True, end - n, end, n, n) for n, k in automaton.said[s] if n <= size]
            if size >= SEED:
                following = run[i + 1] if i + 1 < len(run) else -1
                for k, place, n in [*((k, place, size) for k, place in automaton.ends[s] if k >= automaton.phrases), *automaton.above[s]]:
                    if place == automaton.sizes[k] or automaton.ids[k][place] != following:  # else the match goes on
                        chains.setdefault(k, Chain(automaton.sizes[k])).add(end - n, end, place - n, end - size)
    for k, chain in chains.items():
        out += [(automaton.labels[k], False, a, b, cover, automaton.sizes[k]) for a, b, cover in chain.best()]
    return sorted(out, key=lambda x: (x[2], x[3], x[0]))


SPAN = pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("first", pa.int64()), ("end", pa.int64()), ("covered", pa.int64()), ("words", pa.int64())])
FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(SPAN))])


def licence_spans(text: str | Column, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> Column:
    """struct<n_words, spans>: of each span its label, whether it is a phrase, its words (first, end exclusive), and how many of the template's words it covers."""
    sent = SparkSession.getActiveSession().sparkContext.broadcast(Automaton(phrases, templates))

    def of(automaton: Automaton, texts: pa.Array, vocabulary: pa.Array) -> list[dict]:
        ids, text = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for found, places in words(texts, letters_and_digits):
            ids.append(pc.fill_null(pc.index_in(found, value_set=vocabulary), -1).to_numpy(zero_copy_only=False))
            text.append(places)
        ids, text = np.concatenate(ids), np.concatenate(text)
        at = np.searchsorted(text, np.arange(len(texts) + 1))
        first, last = automaton.runs(ids, text)
        of_run = np.searchsorted(at, first, "right") - 1
        where = np.searchsorted(of_run, np.arange(len(texts) + 1))
        names = SPAN.names
        return [
            {"n_words": int(at[k + 1] - at[k]), "spans": [dict(zip(names, s)) for s in spans_of(automaton, first[where[k] : where[k + 1]], last[where[k] : where[k + 1]], ids, int(at[k]))] if where[k] < where[k + 1] else []}
            for k in range(len(texts))
        ]

    @F.arrow_udf("struct<n_words:long,spans:array<struct<label:string,phrase:boolean,first:long,end:long,covered:long,words:long>>>")
    def find(column: pa.Array) -> pa.Array:
        vocabulary = pa.array([w.encode() for w in sent.value.vocabulary], pa.large_binary())
        return pa.array([x for _, part in portions(column, 4096) for x in of(sent.value, part, vocabulary)], FOUND)

    return find.asNondeterministic()(text)  # so that Spark runs it once


def query(spark, sf_dir: str) -> DataFrame:
    """op12: one row per row of documents; score is the largest covered share of a span's template, 0 without spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", licence_spans("text").alias("f"))
    docs = docs.select("doc_id", "f.n_words", F.col("f.spans").alias("s"), F.filter("f.spans", lambda x: x["phrase"]).alias("base"))
    named = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")
    starts = F.transform("base", lambda x: x["first"])
    share = F.coalesce(F.array_max(F.transform("s", lambda x: x["covered"] / x["words"])), F.lit(0.0))
    spans = F.concat_ws(",", F.transform("s", lambda x: F.concat_ws(":", x["label"], x["first"], x["end"], x["covered"], x["words"])))
    return docs.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        named(F.col("base")).alias("base_labels"), named(F.col("s")).alias("labels"), share.alias("score"), spans.alias("spans"),
    )
