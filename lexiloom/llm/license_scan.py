"""License scans by template-markup matching.

A template is a license's wording with markup: ``[[words]]`` may be left out, ``{{n}}``
stands for up to n words of any kind, ``(a|b c)`` for one of its alternatives. It compiles
to an automaton over tokens, which accepts a place in a text only if the mandatory wording
stands there exactly. Tokens are runs of ASCII letters, digits and non-ASCII characters,
A-Z in lower case, so layout and punctuation don't matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import from_texts

#: Phrases whose every place counts, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public wordings of licenses, whole, with what may be left out or replaced marked up.
_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
and to permit persons to whom the software is furnished to do so subject to the following conditions
the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
in no event shall (the authors or copyright holders|{{8}}) be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software
or the use or other dealings in the software"""
_ISC = """permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
the software is provided as is and {{8}} (disclaims|disclaim) all warranties with regard to this software including all implied warranties of merchantability and fitness
in no event shall {{8}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"""
_BSD_HEAD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
[[1|a]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
[[2|b]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
_BSD_TAIL = """this software is provided by {{10}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
in no event shall {{10}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services
loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise
arising in any way out of the use of this software even if advised of the possibility of such damage"""
_BSD_ENDORSE = """[[3|c]] neither the name of {{10}} nor the names of {{3}} contributors may be used to endorse or promote products derived from this software without specific prior written permission"""
_BSD_ADVERT = """[[3|c]] all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by {{12}}"""
_APACHE = """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at (http|https) www apache org licenses license 2 0
unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
see the license for the specific language governing permissions and limitations under the license"""
_GPL = """(this program|this file|this library) is free software you can redistribute it and or modify it under the terms of the gnu WHICH general public license as published by the free software foundation
either version {{2}} of the license or at your option any later version
(this program|this file|this library) is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
see the gnu WHICH general public license for more details"""
_UNLICENSE = """this is free and unencumbered software released into the public domain
anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means
in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain
we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors
we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
_ZLIB = """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions
[[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required
[[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software
[[3]] this notice may not be removed or altered from any source distribution"""
_BOOST = """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software
to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following
the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part
and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"""

#: Whole wordings and the usual one-line notices, by label.
TEMPLATES = {
    "spdx:mit": [_MIT, "(released|licensed|distributed|available|published) under the [[terms of the]] mit license"],
    "spdx:isc": [_ISC],
    "spdx:bsd-2-clause": [f"{_BSD_HEAD} {_BSD_TAIL}"],
    "spdx:bsd-3-clause": [f"{_BSD_HEAD} {_BSD_ENDORSE} {_BSD_TAIL}"],
    "spdx:bsd-4-clause": [f"{_BSD_HEAD} {_BSD_ADVERT} {_BSD_ENDORSE.replace('[[3|c]]', '[[4|d]]')} {_BSD_TAIL}"],
    "spdx:apache-2.0": [_APACHE, "(released|licensed|distributed|available|published) under the [[terms of the]] apache license version 2 0"],
    "spdx:gpl": [
        "[[this {{2}} is]] (released|licensed|distributed) under the [[terms of the]] gnu general public license [[version (2|3) [[0]] [[or [[any]] later [[version]]]]]]",
        _GPL.replace("WHICH ", ""),
    ],
    "spdx:lgpl": [
        "(released|licensed|distributed) under the [[terms of the]] gnu lesser general public license",
        _GPL.replace("WHICH", "(lesser|library)"),
    ],
    "spdx:agpl": [_GPL.replace("WHICH", "affero")],
    "spdx:mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at (http|https) [[www]] mozilla org mpl 2 0"],
    "spdx:cc-by-nc-4.0": ["(released|licensed|available|published) under [[a|the]] (cc by nc|creative commons attribution noncommercial) 4 0"],
    "spdx:cc-by-4.0": ["(released|licensed|available|published) under [[a|the]] (cc by|creative commons attribution) 4 0"],
    "spdx:unlicense": [_UNLICENSE],
    "spdx:zlib": [_ZLIB],
    "spdx:bsl-1.0": [_BOOST],
    "all-rights-reserved": ["all rights reserved"],
}

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARK = re.compile(r"\[\[|\]\]|\{\{\d+\}\}|\(|\)|\||[^\s\[\](){}|]+")


@dataclass(frozen=True)
class Node:
    """kind: word (word), any (up to n words), seq, alt and opt (of parts)."""

    kind: str
    parts: tuple[Node, ...] = ()
    word: str = ""
    n: int = 0


def parse(template: str) -> Node:
    marks = _MARK.findall(template.lower())
    at = 0

    def alternatives(end: str) -> Node:
        nonlocal at
        seqs, parts = [], []
        while at < len(marks) and marks[at] != end:
            m = marks[at]
            at += 1
            if m in ("[[", "("):
                inner = alternatives("]]" if m == "[[" else ")")
                if at >= len(marks):
                    raise ValueError(f"{m} isn't closed: {template}")
                at += 1
                parts.append(Node("opt", (inner,)) if m == "[[" else inner)
            elif m == "|":
                seqs.append(Node("seq", tuple(parts)))
                parts = []
            elif m.startswith("{{"):
                parts.append(Node("any", n=int(m[2:-2])))
            elif m in ("]]", ")"):
                raise ValueError(f"{m} closes nothing: {template}")
            else:
                parts.append(Node("word", word=m))
        seqs.append(Node("seq", tuple(parts)))
        return seqs[0] if len(seqs) == 1 else Node("alt", tuple(seqs))

    return alternatives("")


class Automaton:
    """Nondeterministic token automaton. ``match(words, i)``: the end of the longest accepted run from word i, or -1."""

    def __init__(self, template: str):
        self.step: list[dict[bytes, list[int]]] = []
        self.wild: list[list[int]] = []
        self.free: list[list[int]] = []
        start, self.end = self._state(), -1
        self.end = self._build(parse(template), start)
        self.start = self._closure({start})
        if self.end in self.start:
            raise ValueError(f"accepts no words: {template}")
        if any(self.wild[s] for s in self.start):
            raise ValueError(f"begins with any words: {template}")
        self.first = {w for s in self.start for w in self.step[s]}

    def _state(self) -> int:
        self.step.append({}), self.wild.append([]), self.free.append([])
        return len(self.step) - 1

    def _build(self, node: Node, at: int) -> int:
        if node.kind == "word":
            to = self._state()
            self.step[at].setdefault(node.word.encode(), []).append(to)
            return to
        if node.kind == "seq":
            for p in node.parts:
                at = self._build(p, at)
            return at
        out = self._state()
        if node.kind == "any":
            for _ in range(node.n):
                self.free[at].append(out)
                to = self._state()
                self.wild[at].append(to)
                at = to
            self.free[at].append(out)
            return out
        for p in node.parts:
            self.free[self._build(p, at_new := self._state())].append(out)
            self.free[at].append(at_new)
        if node.kind == "opt":
            self.free[at].append(out)
        return out

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def match(self, words: list[bytes], i: int) -> int:
        now, end = self.start, -1
        while now and i < len(words):
            w = words[i]
            now = self._closure({t for s in now for t in (*self.step[s].get(w, ()), *self.wild[s])})
            i += 1
            if self.end in now:
                end = i
        return end


def regex(node: Node) -> str:
    """The same language as a regular expression over words that each end with a space, for SQL."""
    if node.kind == "word":
        return re.escape(node.word) + " "
    if node.kind == "any":
        return f"(?:[^ ]+ ){{0,{node.n}}}"
    inner = [regex(p) for p in node.parts]
    return "".join(inner) if node.kind == "seq" else f"(?:{'|'.join(inner)})" + ("?" if node.kind == "opt" else "")


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, base: dict[str, str] = BASE):
        self.base = [(p.encode().split(), label) for p, label in base.items()]
        self.starts: dict[bytes, list[tuple[str, Automaton]]] = {}
        for label, texts in templates.items():
            for a in map(Automaton, texts):
                for w in a.first:
                    self.starts.setdefault(w, []).append((label, a))
        firsts = {p[0] for p, _ in self.base} | set(self.starts)
        self.worth = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + b"|".join(sorted(map(re.escape, firsts))) + rb")(?![0-9a-z\x80-\xff])")

    def __call__(self, text: str | None) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, found), found being (label, word, words)."""
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        words = _WORD.findall(data)
        places, base, found = [], set(), []
        if self.worth.search(data):
            for phrase, label in self.base:
                here = [i for i, w in enumerate(words) if w == phrase[0] and words[i : i + len(phrase)] == phrase]
                places += here
                base |= {label} if here else set()
            for i, w in enumerate(words):
                for label, a in self.starts.get(w, ()):
                    if (end := a.match(words, i)) > 0:
                        found.append((label, i, end - i))
        labels = base | {f[0] for f in found}
        score = 1.0 if found else 0.5 if places else 0.0
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, found


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    score is 1 where a template accepts some place, 0.5 where only a base phrase stands,
    else 0. matches lists (label, word, words) of every accepted place. A null or empty
    text has no words and no labels; repeated rows are scanned alike; an empty table gives
    an empty result; other columns are ignored.
    """

    match = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64())]))
    made = dict.fromkeys(["n_words", "n_base", "first_word", "last_word"], pa.int64()) | {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "matches": match}

    def work():
        scanner = Scanner(templates)

        def row(text: str | None) -> tuple:
            *counts, found = scanner(text)
            return *counts, [{"label": x, "word": i, "words": n} for x, i, n in found]

        return row

    return from_texts(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"], made, work)


def oracle_sql(templates: dict[str, list[str]] = TEMPLATES) -> str:
    """DuckDB SQL for :func:`scan` without ``matches``: base places by list positions, templates by regular expressions."""
    place = lambda p: "list_filter(range(1, n_words + 1), lambda i: " + " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) + ")"
    base = "list_sort(list_distinct(list_filter([" + ", ".join(f"case when len({place(p)}) > 0 then '{label}' end" for p, label in BASE.items()) + "], lambda x: x is not null)))"
    method = ", ".join("case when " + " or ".join(f"regexp_matches(s, ' {regex(parse(t))}')" for t in texts) + f" then '{label}' end" for label, texts in templates.items())
    return f"""
with t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
u as (select doc_id, w, len(w)::bigint as n_words, ' ' || array_to_string(w, ' ') || ' ' as s from t),
p as (select *, list_concat({", ".join(place(p) for p in BASE)}) as places, {base} as base, list_filter([{method}], lambda x: x is not null) as method from u)
select doc_id, n_words, len(places)::bigint as n_base, (list_min(places) - 1)::bigint as first_word, (list_max(places) - 1)::bigint as last_word,
  array_to_string(base, ',') as base_labels, array_to_string(list_sort(list_distinct(list_concat(base, method))), ',') as labels,
  case when len(method) > 0 then 1.0::double when len(places) > 0 then 0.5::double else 0.0::double end as score
from p"""
