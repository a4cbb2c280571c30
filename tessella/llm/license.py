"""License scans: template markup compiled to token automata, and fixed phrases.

A template is wording with `<<beginOptional>>...<<endOptional>>` around what may be missing and `<<var;words=A-B>>`
for A to B words of any kind. Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased, so
punctuation and layout don't count. A template is found where all its mandatory wording stands exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, hash_word, steps, utf8, word_hashes, words

#: Phrases and the labels that the base columns report.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Wording of public licenses and notices by SPDX-like label.
TEMPLATES = {
    "apache-2.0": """<<beginOptional>>this work is<<endOptional>> licensed under the apache license version 2.0
        <<beginOptional>>(the "license"); you may not use this file except in compliance with the license. you may obtain a copy of
        the license at <<var;words=1-1>> www.apache.org/licenses/LICENSE-2.0 <<beginOptional>>unless required by applicable law or
        agreed to in writing, software distributed under the license is distributed on an "as is" basis, without warranties or
        conditions of any kind, either express or implied. see the license for the specific language governing permissions and
        limitations under the license<<endOptional>><<endOptional>>""",
    "cc-by-nc-4.0": """<<beginOptional>>this work is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> cc by-nc 4.0
        <<beginOptional>>international<<endOptional>> <<beginOptional>>license<<endOptional>>""",
    "gpl-3.0": """<<beginOptional>>this work is<<endOptional>> licensed under the gnu general public license
        <<beginOptional>>as published by the free software foundation<<endOptional>> version 3
        <<beginOptional>>or any later version<<endOptional>>""",
    "mit-notice": """released under the <<beginOptional>>terms of the<<endOptional>> mit license""",
    "rights-reserved": """<<beginOptional>>copyright <<beginOptional>>c<<endOptional>> <<var;words=1-8>><<endOptional>> all rights reserved""",
    "mit": """<<beginOptional>>copyright <<beginOptional>>c<<endOptional>> <<var;words=1-12>><<endOptional>>
        permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "software"), to deal in the software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the
        software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice
        <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of
        the software. the software is provided "as is", without warranty of any kind, express or implied, including but not limited
        to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall
        <<var;words=1-12>> be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise,
        arising from, out of or in connection with the software or the use or other dealings in the software""",
    "isc": """<<beginOptional>>copyright <<beginOptional>>c<<endOptional>> <<var;words=1-12>><<endOptional>>
        permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. the software is provided "as is"
        and <<var;words=1-8>> disclaims all warranties with regard to this software including all implied warranties of
        merchantability and fitness. in no event shall <<var;words=1-8>> be liable for any special, direct, indirect, or
        consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of
        contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software""",
    "bsd-2-clause": """<<beginOptional>>copyright <<beginOptional>>c<<endOptional>> <<var;words=1-12>><<endOptional>>
        redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. <<beginOptional>>2<<endOptional>> redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. this software is provided by <<var;words=1-12>> "as is" and any express or implied
        warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are
        disclaimed. in no event shall <<var;words=1-12>> be liable for any direct, indirect, incidental, special, exemplary, or
        consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or
        profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or
        tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the
        possibility of such damage""",
    "bsd-3-clause": """<<beginOptional>>copyright <<beginOptional>>c<<endOptional>> <<var;words=1-12>><<endOptional>>
        redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. <<beginOptional>>2<<endOptional>> redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. <<beginOptional>>3<<endOptional>> neither the name of <<var;words=1-12>> nor the
        names of its contributors may be used to endorse or promote products derived from this software without specific prior
        written permission. this software is provided by <<var;words=1-12>> "as is" and any express or implied warranties, including,
        but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no
        event shall <<var;words=1-12>> be liable for any direct, indirect, incidental, special, exemplary, or consequential damages
        (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business
        interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including
        negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such
        damage""",
    "apache-2.0-text": """apache license version 2.0, january 2004 <<var;words=4-5>> terms and conditions for use, reproduction, and
        distribution <<beginOptional>>1<<endOptional>> definitions "license" shall mean the terms and conditions for use,
        reproduction, and distribution as defined by sections 1 through 9 of this document""",
    "gpl-2.0-notice": """<<beginOptional>>this program<<endOptional>> is free software; you can redistribute it and/or modify it
        under the terms of the gnu general public license as published by the free software foundation; either version 2 of the
        license, or (at your option) any later version <<beginOptional>>this program is distributed in the hope that it will be
        useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose.
        see the gnu general public license for more details<<endOptional>>""",
    "gpl-3.0-notice": """<<beginOptional>>this program<<endOptional>> is free software: you can redistribute it and/or modify it
        under the terms of the gnu general public license as published by the free software foundation, either version 3 of the
        license, or (at your option) any later version <<beginOptional>>this program is distributed in the hope that it will be
        useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose.
        see the gnu general public license for more details<<endOptional>>""",
    "lgpl-2.1-notice": """<<beginOptional>>this library<<endOptional>> is free software; you can redistribute it and/or modify it
        under the terms of the gnu lesser general public license as published by the free software foundation; either version 2.1 of
        the license, or (at your option) any later version""",
    "lgpl-3.0-notice": """<<beginOptional>>this library<<endOptional>> is free software; you can redistribute it and/or modify it
        under the terms of the gnu lesser general public license as published by the free software foundation; either version 3 of
        the license, or (at your option) any later version""",
    "agpl-3.0-notice": """<<beginOptional>>this program<<endOptional>> is free software: you can redistribute it and/or modify it
        under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of
        the license, or (at your option) any later version""",
    "mpl-2.0-notice": """this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was
        not distributed with this file, you can obtain one at <<var;words=1-1>> mozilla.org/mpl/2.0""",
    "cc-by-4.0": """<<beginOptional>>this work is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>>
        <<beginOptional>>the<<endOptional>> creative commons attribution 4.0 <<beginOptional>>international<<endOptional>>
        <<beginOptional>>license<<endOptional>>""",
    "cc-by-sa-4.0": """<<beginOptional>>this work is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>>
        <<beginOptional>>the<<endOptional>> creative commons attribution-sharealike 4.0
        <<beginOptional>>international<<endOptional>> <<beginOptional>>license<<endOptional>>""",
    "cc0-1.0": """cc0 1.0 universal <<beginOptional>>cc0 1.0 public domain dedication<<endOptional>>""",
    "unlicense": """this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means""",
}


@dataclass
class Automaton:
    """States 0..n; `step[s]` leads by a word's hash to one state, `any[s]` by every word, `skip[s]` by none."""

    label: str
    step: list[dict[int, int]] = field(default_factory=list)
    any: list[int] = field(default_factory=list)
    skip: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.step.append({})
        self.any.append(-1)
        self.skip.append([])
        return len(self.step) - 1

    def closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def after(self, states: set[int], word: int) -> set[int]:
        return self.closed({t for s in states for t in (self.step[s].get(word, -1), self.any[s]) if t >= 0})

    @property
    def longest(self) -> int:
        """Words of the longest text that matches: every part lies on the way to the end."""
        return sum(map(len, self.step)) + sum(s >= 0 for s in self.any)

    def match(self, hashes: list[int]) -> int:
        """Words in the longest match at the start of the list; 0: none."""
        states, longest, end = self.closed({0}), 0, len(self.step) - 1
        for k, word in enumerate(hashes, 1):
            states = self.after(states, word)
            if end in states:
                longest = k
            if not states:
                break
        return longest


_MARK = re.compile(r"<<(beginOptional|endOptional|var;words=(\d+)-(\d+))>>")


def compile_template(label: str, template: str) -> Automaton:
    """The automaton of a template; regions may nest."""
    a = Automaton(label)
    at, open_ = a.state(), []

    def word(w):
        nonlocal at
        to = a.state()
        a.step[at][hash_word(w)] = to
        at = to

    def plain(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        for s, e in zip(*words(raw, np.array([0, len(raw)]), ALNUM), strict=True):
            word(text.encode()[s:e].decode())

    last = 0
    for m in _MARK.finditer(template):
        plain(template[last : m.start()])
        last = m.end()
        if m[1] == "beginOptional":
            to = a.state()
            a.skip[at].append(to)
            at = to
            open_.append(at)
        elif m[1] == "endOptional":
            if not open_:
                raise ValueError(f"{label}: endOptional without beginOptional")
            begin, to = open_.pop(), a.state()
            a.skip[at].append(to)
            a.skip[begin].append(to)
            at = to
        else:
            low, high = int(m[2]), int(m[3])
            stops = []
            for k in range(high + 1):
                if k >= low:
                    stops.append(at)
                if k < high:
                    to = a.state()
                    a.any[at] = to
                    at = to
            to = a.state()
            for s in stops:
                a.skip[s].append(to)
            at = to
    plain(template[last:])
    if open_:
        raise ValueError(f"{label}: beginOptional without endOptional")
    if len(a.closed({0}) & {len(a.step) - 1}):
        raise ValueError(f"{label}: no mandatory wording")
    if at != len(a.step) - 1:  # the last state accepts
        a.skip[at].append(a.state())
    return a


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.automata = [compile_template(k, t) for k, t in templates.items()]
        self.phrases = [(label, np.array([hash_word(w) for w in p.split()], np.uint64)) for p, label in phrases.items()]
        self.by_pair: dict[tuple[int, int], list[Automaton]] = {}
        self.by_first: dict[int, list[Automaton]] = {}
        self.anywhere: list[Automaton] = []  # those that may begin with any word
        for a in self.automata:
            begin = a.closed({0})
            if any(a.any[s] >= 0 for s in begin):
                self.anywhere.append(a)
                continue
            for w in {w for s in begin for w in a.step[s]}:
                states = a.after(begin, w)
                free = any(a.any[s] >= 0 for s in states) or len(a.step) - 1 in states
                if free:
                    self.by_first.setdefault(w, []).append(a)
                else:
                    for v in {v for s in states for v in a.step[s]}:
                        self.by_pair.setdefault((w, v), []).append(a)
        self.firsts = np.array(sorted(self.by_first), np.uint64)
        self.pairs = np.array(sorted({w for w, _ in self.by_pair}), np.uint64)
        self.seconds = np.array(sorted({v for _, v in self.by_pair}), np.uint64)

    def scan(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[list[tuple[str, str, int, int]]]]:
        """Each text's number of words, and what is found: kind, label, first word, word after the last."""
        s, e = words(raw, at, ALNUM)
        h = word_hashes(raw, s, e)
        limits = np.searchsorted(s, at)
        text = np.searchsorted(at, s, "right") - 1
        found: list[list[tuple[str, str, int, int]]] = [[] for _ in range(len(at) - 1)]
        for label, phrase in self.phrases:
            n = len(phrase)
            hit = np.flatnonzero(h[: max(0, len(h) - n + 1)] == phrase[0])
            for k in range(1, n):
                hit = hit[h[hit + k] == phrase[k]]
            for p in hit[text[hit] == text[hit + n - 1]]:
                found[text[p]].append(("phrase", label, int(p - limits[text[p]]), int(p - limits[text[p]] + n)))
        near = np.isin(h, self.firsts)
        near[:-1] |= np.isin(h[:-1], self.pairs) & np.isin(h[1:], self.seconds)
        if self.anywhere:
            near[:] = True
        for p in np.flatnonzero(near):
            first = int(h[p])
            t = text[p]
            tried = [*self.anywhere, *self.by_first.get(first, ()), *(self.by_pair.get((first, int(h[p + 1])), ()) if p + 1 < limits[t + 1] else ())]
            for a in tried:
                reach = min(int(limits[t + 1]), int(p) + len(a.step))
                if n := a.match([int(x) for x in h[p:reach]]):
                    found[t].append(("template", a.label, int(p - limits[t]), int(p - limits[t] + n)))
        return np.diff(limits), found


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(id, n_words, found): every place of a phrase or template in each whole text; a null text counts as empty."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_words long, found array<struct<kind:string,label:string,first_word:long,end_word:long>>"

    def run(batches):
        scanner = Scanner(templates, phrases)
        for batch in steps(batches, text_col):
            n, found = scanner.scan(*utf8(batch.column(text_col)))
            rows = pa.array([[dict(zip(("kind", "label", "first_word", "end_word"), f, strict=True)) for f in x] for x in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(n.astype(np.int64)), rows], [id_col, "n_words", "found"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The op7 contract. score: half with phrases alone; with templates half more by the share of a template's wording that stands in the text, the largest."""
    of = lambda kind: F.filter("found", lambda x: x["kind"] == kind)
    base, own = of("phrase"), of("template")
    most = F.create_map(*[F.lit(x) for label, t in TEMPLATES.items() for x in (label, compile_template(label, t).longest)])
    share = F.array_max(F.transform(own, lambda x: (x["end_word"] - x["first_word"]) / F.element_at(most, x["label"])))
    starts = F.transform(base, lambda x: x["first_word"])
    labels = lambda x: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(x, lambda y: y["label"]))))
    return scan(docs).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("found")).alias("labels"),
        F.when(F.size("found") == 0, 0.0).otherwise(0.5 + 0.5 * F.coalesce(share, F.lit(0.0))).alias("score"),
    )


def _sql_pattern(template: str) -> str:
    """A template as a regular expression over words that each end in a space."""
    out, last = ["(?:^| )"], 0
    for m in [*_MARK.finditer(template), None]:
        raw = np.frombuffer(template[last : m.start() if m else len(template)].encode(), np.uint8)
        at = zip(*words(raw, np.array([0, len(raw)]), ALNUM), strict=True)
        out += [raw[a:b].tobytes().decode().lower() + " " for a, b in at]
        if m:
            last = m.end()
            out.append({"beginOptional": "(?:", "endOptional": ")?"}.get(m[1]) or f"(?:[^ ]+ ){{{m[2]},{m[3]}}}")
    return "".join(out)


def _sql() -> str:
    found = lambda phrase: "list_filter(range(0, len(w)), lambda i: " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split(), 1)) + ")"
    bases = ", ".join(f"{found(p)} AS b{k}" for k, p in enumerate(PHRASES))
    base = [f"CASE WHEN len(b{k}) > 0 THEN '{label}' END" for k, label in enumerate(PHRASES.values())]
    more = [f"CASE WHEN len(m{k}) > 0 THEN '{label}' END" for k, label in enumerate(TEMPLATES)]
    most = {label: compile_template(label, t).longest for label, t in TEMPLATES.items()}
    shares = ", ".join(f"list_max(list_transform(m{k}, lambda x: len(string_split(trim(x), ' '))))::DOUBLE / {n}" for k, n in enumerate(most.values()))
    hits = ", ".join(f"regexp_extract_all(line, '{_sql_pattern(t)}') AS m{k}" for k, t in enumerate(TEMPLATES.values()))
    joined = lambda x: f"array_to_string(list_sort(list_filter([{', '.join(x)}], lambda y: y IS NOT NULL)), ',')"
    places = "list_concat(" * (len(PHRASES) - 1) + "b0" + "".join(f", b{k})" for k in range(1, len(PHRASES)))
    return f"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    f AS (SELECT doc_id, len(w) AS n_words, array_to_string(w, ' ') || ' ' AS line, {bases} FROM t),
    m AS (SELECT *, {hits} FROM f),
    g AS (SELECT doc_id, n_words, {places} AS places, {joined(base)} AS base_labels, {joined(base + more)} AS labels, list_max([{shares}]) AS share FROM m)
    SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, base_labels, labels,
    CASE WHEN labels <> '' THEN 0.5::DOUBLE + 0.5::DOUBLE * coalesce(share, 0) ELSE 0.0::DOUBLE END AS score FROM g"""


ORACLE = _sql()
