"""License scans: fixed phrases, and templates compiled into token automata.

A template is a line of words.  ``[ ... ]`` is optional, ``( a | b )`` is a choice
and ``{m-n}`` stands for any m to n words, such as a name or a year; all else is
mandatory and must match word for word.  A template compiles to a Glushkov
automaton: each word or replaceable word is a position, followed by the positions
that may come next.  It is run from every word that can begin it, and accepts the
longest match.

Defined cases: a null text is empty and has no words, labels or places; repeated
rows are scanned each; texts of any length are scanned whole; matches of several
templates may overlap; an empty table gives an empty result; further columns of the
input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkdex.llm.arrow import per_row
from inkdex.llm.common import ship
from inkdex.llm.license_texts import TEXTS

#: Every place where these words stand one after another.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_AS_IS = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for "
    "any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the "
    "software or the use or other dealings in the software")
_REDISTRIBUTE = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
    "are met [ 1 ] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[ 2 ] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
    "the documentation and or other materials provided with the distribution")
_NO_WARRANTY = (
    "this software is provided by {1-8} as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall {1-10} be liable for any direct indirect incidental special "
    "exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business "
    "interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in "
    "any way out of the use of this software even if advised of the possibility of such damage")

TEMPLATES = {
    "gpl-3.0": "licensed under [ the terms of ] the gnu general public license [ as published by the free software foundation ] [ either ] version 3 [ of the license ] [ or at your option any later version ]",
    "gpl-2.0": "licensed under [ the terms of ] the gnu general public license [ as published by the free software foundation ] [ either ] version 2 [ of the license ] [ or at your option any later version ]",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu ( general | lesser general | affero general ) public license as published by the free software foundation either version {1-2} of the license or at your option any later version [ this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu ( general | lesser general | affero general ) public license for more details ]",
    "apache-2.0": "licensed under the apache license version 2 0 [ the license you may not use this {1-3} except in compliance with the license [ you may obtain a copy of the license at {1-8} [ unless required by applicable law or agreed to in writing ( software | files ) distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license ] ] ]",
    "cc-by-4.0": "licensed under [ a ] ( cc by | [ the ] creative commons attribution ) 4 0 [ international ] [ license ]",
    "cc-by-nc-4.0": "licensed under [ a ] ( cc by nc | [ the ] creative commons attribution noncommercial ) 4 0 [ international ] [ license ]",
    "cc-by-sa-4.0": "licensed under [ a ] ( cc by sa | [ the ] creative commons attribution sharealike ) 4 0 [ international ] [ license ]",
    "mit-notice": "( released | licensed | distributed | available ) under the [ terms of the ] mit license",
    "mit-text": f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [ including the next paragraph ] shall be included in all copies or substantial portions of the software {_AS_IS}",
    "bsd-2-clause": f"{_REDISTRIBUTE} {_NO_WARRANTY}",
    "bsd-3-clause": f"{_REDISTRIBUTE} [ 3 ] neither the name of {{1-8}} nor the names of [ its | the ] contributors may be used to endorse or promote products derived from this software without specific prior written permission {_NO_WARRANTY}",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {1-4} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {1-4} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at ( http | https ) [ www ] mozilla org mpl 2 0",
    "apache-2.0-title": "apache license version 2 0 january 2004",
    "gpl-3.0-title": "gnu general public license version 3 29 june 2007",
    "gpl-2.0-title": "gnu general public license version 2 june 1991",
    "lgpl-3.0-title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl-2.1-title": "gnu lesser general public license version 2 1 february 1999",
    "agpl-3.0-title": "gnu affero general public license version 3 19 november 2007",
    **{f"spdx-{i}": f"spdx license identifier {i.replace('-', ' ').replace('.', ' ')}{' [ only | or later ]' if 'gpl' in i else ''}" for i in (
        "apache-2.0", "mit", "isc", "zlib", "unlicense", "mpl-2.0", "bsd-2-clause", "bsd-3-clause", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0",
        "cc-by-4.0", "cc-by-sa-4.0", "cc-by-nc-4.0", "cc0-1.0", "bsl-1.0")},
    "copyright-notice": "copyright [ c ] {1-3} {0-6} all rights reserved",
    **TEXTS,
}

#: Lower case for A-Z; other ASCII but digits and letters parts words.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Automaton:
    """Positions of a template with the words they take (None: any) and the positions that may follow them."""

    def __init__(self, template: str):
        self.words: list[bytes | None] = []
        self.follow: list[set[int]] = []
        tokens = re.findall(r"[\[\]()|]|\{\d+-\d+\}|[^\s\[\](){}|]+", template)
        at, (first, last, empty) = self._choice(tokens, 0)
        if at != len(tokens) or empty:
            raise ValueError(f"a template must be well-formed and have mandatory wording: {template}")
        self.first, self.last = first, last
        self.starts = {self.words[p] for p in first}
        if None in self.starts:
            raise ValueError(f"a template can't begin with a replaceable region: {template}")

    def _position(self, word: bytes | None):
        self.words.append(word)
        self.follow.append(set())
        p = {len(self.words) - 1}
        return p, p, False

    def _then(self, a, b):
        for p in a[1]:
            self.follow[p] |= b[0]
        return a[0] | b[0] if a[2] else a[0], a[1] | b[1] if b[2] else b[1], a[2] and b[2]

    def _choice(self, tokens: list[str], at: int):
        parts = []
        while True:
            part = (set(), set(), True)
            while at < len(tokens) and tokens[at] not in ("]", ")", "|"):
                t = tokens[at]
                at += 1
                if t in ("[", "("):
                    at, inner = self._choice(tokens, at)
                    if at >= len(tokens) or tokens[at] != ("]" if t == "[" else ")"):
                        raise ValueError("unbalanced brackets")
                    at += 1
                    part = self._then(part, (inner[0], inner[1], inner[2] or t == "["))
                elif t[0] == "{":
                    low, high = map(int, t[1:-1].split("-"))
                    for k in range(high):
                        one = self._position(None)
                        part = self._then(part, (one[0], one[1], k >= low))
                else:
                    part = self._then(part, self._position(t.encode()))
            parts.append(part)
            if at < len(tokens) and tokens[at] == "|":
                at += 1
                continue
            return at, (set().union(*(p[0] for p in parts)), set().union(*(p[1] for p in parts)), any(p[2] for p in parts))

    def match(self, words: list[bytes], start: int) -> int | None:
        """End of the longest match that begins at this word."""
        live, end = self.first, None
        for at in range(start, len(words)):
            w = words[at]
            here = [p for p in live if self.words[p] is None or self.words[p] == w]
            if not here:
                break
            if not self.last.isdisjoint(here):
                end = at + 1
            live = set().union(*(self.follow[p] for p in here))
        return end


@cache
def automata() -> dict[str, Automaton]:
    return {label: Automaton(t) for label, t in TEMPLATES.items()}


@cache
def _plan() -> tuple[list[bytes], dict[bytes, list], dict[bytes, list]]:
    """Words of which a text must hold one to match anything; phrases and templates by the words that can begin them."""
    phrases: dict[bytes, list] = {}
    for phrase, label in PHRASES.items():
        w = phrase.encode().split()
        phrases.setdefault(w[0], []).append((w, label))
    starts: dict[bytes, list] = {}
    for label, a in automata().items():
        for w in a.starts:
            starts.setdefault(w, []).append((label, a))
    return sorted({*phrases, *starts}), phrases, starts


def scan(text: bytes) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int]]]:
    """(number of words, (label, first word) of phrases, (label, first word, end word) of templates)."""
    folded = text.translate(FOLD)
    words = folded.split()
    firsts, phrases, starts = _plan()
    places, matches = [], []
    for first in firsts:
        if first not in folded:
            continue
        at = -1
        for _ in range(words.count(first)):
            at = words.index(first, at + 1)
            for wording, label in phrases.get(first, ()):
                if words[at : at + len(wording)] == wording:
                    places.append((label, at))
            for label, automaton in starts.get(first, ()):
                end = automaton.match(words, at)
                if end is not None:
                    matches.append((label, at, end))
    return len(words), places, matches


def scan_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, places, matches) of every whole text."""
    ship(df.sparkSession)
    place = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())]))
    match = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([(key, pa.int64()), ("n_words", pa.int64()), ("places", place), ("matches", match)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each(rows, k, body: bytes) -> None:
            n, places, matches = scan(body)
            rows.add(k, n, [{"label": x, "first": a} for x, a in places], [{"label": x, "first": a, "end": b} for x, a, b in matches],
                     size=64 + 32 * (len(places) + len(matches)))

        yield from per_row(batches, schema, each)

    return df.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(
        run, f"`{key}` bigint, n_words bigint, places array<struct<label: string, first: bigint>>, matches array<struct<label: string, first: bigint, end: bigint>>")


def label_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: numbers of words and phrases, the phrases' places, labels, and the share of words in accepted wording."""
    found = scan_documents(df, key, text)
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base, own = F.transform("places", lambda p: p["label"]), F.transform("matches", lambda m: m["label"])
    starts = F.transform("places", lambda p: p["first"])
    # words covered by matches: sorted by start, each adds what lies beyond the ends before it
    covered = F.aggregate(
        F.array_sort(F.transform("matches", lambda m: F.struct(m["first"].alias("first"), m["end"].alias("end")))),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to")),
        lambda a, m: F.struct((a["n"] + F.greatest(F.lit(0).cast("bigint"), m["end"] - F.greatest(a["to"], m["first"]))).alias("n"), F.greatest(a["to"], m["end"]).alias("to")),
        lambda a: a["n"])
    return found.select(
        key, "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        join(base).alias("base_labels"), join(F.concat(base, own)).alias("labels"),
        F.when(F.col("n_words") > 0, covered / F.col("n_words")).otherwise(0.0).alias("score"), "matches")
