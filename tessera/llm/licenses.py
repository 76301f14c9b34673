"""License scan: template markup compiled into token automata.

A template is license wording with `<<optional>> ... <</optional>>` regions that may be absent and
`<<var:max>>` places that stand for up to max words of the text. It is compiled into an automaton
over word tokens: each mandatory word has one arc, an optional region also has an empty arc around
it, a replaceable place has a bounded run of any-word arcs. A place of a text is accepted when the
mandatory words match exactly, one after the other, from it.

Words: A-Z lower-cased, then maximal runs of ASCII letters, digits and all non-ASCII characters.
The whole text is scanned; an automaton runs only on texts that hold its longest run of mandatory
words, and starts only at words that can begin its template, so the cost follows the length of the text. Defined results: null and empty texts have no words and no
labels; repeated rows give repeated results; very long texts take memory in proportion to their
own length; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_rows, load, map_arrow

#: Phrases of the base labels.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
_BULLET = "<<optional>><<var:1>><</optional>>"
_BSD_GRANT = f"""redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
  {_BULLET} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
  {_BULLET} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
_BSD_NAMES = f"{_BULLET} neither the name of <<var:24>> nor the names of <<var:8>> may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_DISCLAIMER = """this software is provided by <<var:16>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
  in no event shall <<var:16>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption
  however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""


def _gnu(name: str) -> str:
    """The header that files under a licence of this family carry."""
    return f"""this <<var:6>> is free software you can redistribute it and or modify it under the terms of the gnu {name} <<optional>>version <<var:2>><</optional>> as published by the free software foundation
      <<optional>>either<</optional>> <<optional>>version <<var:2>> of the license<</optional>> <<optional>>or at your option any later version<</optional>>
      this <<var:6>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {name} for more details
      <<optional>>you should have received a copy of the gnu {name} along with this <<var:6>> if not<</optional>>"""


#: Templates of the method's labels: whole licences and the headers of the long ones, then shorter notices.
TEMPLATES = {
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the <<var:4>> to deal in the <<var:4>> without restriction including without limitation
      the rights to use copy modify merge publish distribute sublicense and or sell copies of the <<var:4>> and to permit persons to whom the <<var:4>> is furnished to do so subject to the following conditions
      the above copyright notice and this permission notice <<optional>>including the next paragraph<</optional>> shall be included in all copies or substantial portions of the <<var:4>>
      the <<var:4>> is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
      in no event shall <<var:16>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the <<var:4>> or the use or other dealings in the <<var:4>>""",
    "bsd-2-clause": f"{_BSD_GRANT} {_BSD_DISCLAIMER}",
    "bsd-3-clause": f"{_BSD_GRANT} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "isc": """permission to use copy modify and <<optional>>or<</optional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
      the software is provided as is and <<var:12>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
      in no event shall <<var:12>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
      whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software""",
    "apache-2.0-header": """licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<var:12>>
      unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
      see the license for the specific language governing permissions and limitations under the license""",
    "gpl-header": _gnu("general public license"),
    "lgpl-header": _gnu("lesser general public license"),
    "agpl-header": _gnu("affero general public license"),
    "mpl-2.0-header": "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "unlicense": """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means
      <<optional>>in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain
      we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law<</optional>>
      the software is provided as is without warranty of any kind""",
    "zlib": """this software is provided as is without any express or implied warranty in no event will <<var:12>> be held liable for any damages arising from the use of this software
      permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions
      <<optional>><<var:1>><</optional>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment <<optional>>see the following<</optional>> in the product documentation would be appreciated but is not required
      <<optional>><<var:1>><</optional>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software
      <<optional>><<var:1>><</optional>> this notice may not be removed or altered from any source distribution""",
    "bsl-1.0": """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software
      and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following
      the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software
      unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor
      the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement
      in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
    "apache-2.0-notice": "licensed under the apache license <<optional>>, version 2.0<</optional>>",
    "gpl-notice": "this <<var:2>> is licensed under the <<optional>>gnu<</optional>> general public license <<optional>>, version 3<</optional>>",
    "cc-by-nc-notice": "licensed under <<optional>>the<</optional>> <<optional>>creative commons<</optional>> cc by nc <<optional>>4.0<</optional>>",
    "mit-notice": "<<optional>>released<</optional>> <<optional>>licensed<</optional>> under the <<optional>>terms of the<</optional>> mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this <<var:12>> to deal in the <<var:2>> without restriction",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "spdx-tag": "spdx license identifier <<var:3>>",
    "copyright-line": "copyright <<optional>>c<</optional>> <<var:40>> all rights reserved",
}
_KEEP = bytes(i for i in range(256) if i >= 128 or chr(i).isalnum())
#: Lower-cases A-Z and blanks every byte that is in no word.
TABLE = bytes((ord(chr(i).lower()) if i < 128 else i) if i in _KEEP else 32 for i in range(256))
ANY = None


def words_of(utf8: bytes) -> list[bytes]:
    return utf8.translate(TABLE).split()


class Automaton:
    """States 0..n; arcs[s] lists (word or ANY, next state), empty[s] the states reached without a word."""

    def __init__(self, template: str):
        self.arcs: list[list[tuple[bytes | None, int]]] = [[]]
        self.empty: list[list[int]] = [[]]
        self.n_mandatory = 0
        here, opened, runs = 0, [], [[]]
        for part in re.findall(r"<<.*?>>|[^<]+", template):
            if part.startswith("<<"):
                runs.append([])
            if part == "<<optional>>":
                opened.append(here)
            elif part == "<</optional>>":
                self.empty[opened.pop()].append(here)
            elif part.startswith("<<var:"):
                start, reach = here, [here]
                for _ in range(int(part[6:-2])):
                    here = self._arc(here, ANY)
                    reach.append(here)
                for s in reach[1:-1] or []:
                    self.empty[s].append(here)
                assert start != here, "a replaceable place takes one word or more"
            else:
                for w in words_of(part.encode()):
                    if not opened:
                        self.n_mandatory += 1
                        runs[-1].append(w)
                    here = self._arc(here, w)
        assert not opened, "an optional region is left open"
        self.final = here
        #: The longest run of mandatory words; a text without it holds no match.
        self.pivot = b" " + b" ".join(max(runs, key=len)) + b" "
        self.closure = [self._close(s) for s in range(len(self.arcs))]
        self.starts = {w for s in self.closure[0] for w, _ in self.arcs[s]}

    def _arc(self, at: int, word: bytes | None) -> int:
        self.arcs.append([])
        self.empty.append([])
        self.arcs[at].append((word, len(self.arcs) - 1))
        return len(self.arcs) - 1

    def _close(self, s: int) -> frozenset[int]:
        seen, todo = {s}, [s]
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def match(self, words: list[bytes], at: int) -> int:
        """The end of the longest match that begins at this word, or -1."""
        states, end = self.closure[0], -1
        while states:
            if self.final in states:
                end = at
            if at >= len(words):
                break
            w = words[at]
            states = frozenset().union(*(self.closure[t] for s in states for a, t in self.arcs[s] if a is ANY or a == w))
            at += 1
        return end


@cache
def _compiled(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, Automaton]]:
    out = [(label, Automaton(text)) for label, text in templates]
    for label, a in out:
        assert ANY not in a.starts and len(a.pivot) > 2, f"{label} must begin with a word and have a mandatory one"
    return out


def scan(utf8: bytes, templates: dict[str, str] = TEMPLATES) -> dict:
    """Word count, base places (start, label) and template matches (start, end, label) of one text.

    An automaton runs only on texts that hold its longest run of mandatory words."""
    words = words_of(utf8)
    line = b" " + b" ".join(words) + b" "
    phrases = [(label, p.encode().split()) for label, p in BASE.items() if b" " + p.encode() + b" " in line]
    base, found, mandatory = [], [], 0
    by_start: dict[bytes, list[tuple[str, Automaton]]] = {}
    for label, a in _compiled(tuple(templates.items())):
        if a.pivot in line:
            for w in a.starts:
                by_start.setdefault(w, []).append((label, a))
    if phrases or by_start:
        starts = {*by_start, *(p[0] for _, p in phrases)}
        for i, w in enumerate(words):
            if w in starts:
                base += [(i, label) for label, p in phrases if words[i : i + len(p)] == p]
                for label, a in by_start.get(w, ()):
                    if (end := a.match(words, i)) >= 0:
                        found.append((i, end, label))
                        mandatory = max(mandatory, a.n_mandatory)
    return {"n_words": len(words), "base": base, "found": found, "mandatory": mandatory}


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_templates, spans for each row.

    score: 1 - 0.5 ** (mandatory words of the largest accepted template), at least 0.5 with a base
    phrase, else 0. spans: label:start:end of each accepted place, in words."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_templates", pa.int64()), ("spans", pa.string())])

    def row(doc_id: int, text: bytes) -> tuple:
        x = scan(text, templates)
        at = [i for i, _ in x["base"]]
        labels = {label for _, label in x["base"]}
        score = max(1 - 0.5 ** x["mandatory"] if x["found"] else 0.0, 0.5 if at else 0.0)
        return (doc_id, x["n_words"], len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {f[2] for f in x["found"]})), score, len(x["found"]), ",".join(f"{n}:{a}:{b}" for a, b, n in x["found"]))

    return map_arrow(docs.select("doc_id", "text"), arrow_rows(schema, row), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_templates long, spans string")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(load(spark, sf_dir, "documents")).drop("n_templates", "spans")


def _regex(template: str) -> str:
    """The template as a regular expression over words that each end in a space."""
    out = ""
    for part in re.findall(r"<<.*?>>|[^<]+", template):
        if part == "<<optional>>":
            out += "(?:"
        elif part == "<</optional>>":
            out += ")?"
        elif part.startswith("<<var:"):
            out += "(?:[^ ]+ ){1," + part[6:-2] + "}"
        else:
            out += "".join(w.decode() + " " for w in words_of(part.encode()))
    return out


def oracle() -> str:
    """The same result in DuckDB, for op10's columns."""
    places = " or ".join("(" + " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split(), 1)) + ")" for p in BASE.values())
    label = lambda name, test: f"case when {test} then '{name}' end"
    base = ", ".join(label(name, f"contains(s, ' {p} ')") for name, p in BASE.items())
    found = ", ".join(label(name, f"regexp_matches(s, ' {_regex(t)}')") for name, t in TEMPLATES.items())
    mandatory = ", ".join(f"case when regexp_matches(s, ' {_regex(t)}') then {Automaton(t).n_mandatory} else 0 end" for t in TEMPLATES.values())
    return f"""with a as (select doc_id, ' ' || trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')) || ' ' as s from documents),
    b as (select *, list_filter(string_split(s, ' '), lambda x: x <> '') as w, list_filter([{base}], lambda x: x is not null) as bl, list_filter([{found}], lambda x: x is not null) as fl, greatest({mandatory}) as m from a),
    c as (select *, list_filter(range(len(w)), lambda i: {places}) as places from b)
    select doc_id, len(w)::bigint as n_words, len(places)::bigint as n_base, list_min(places)::bigint as first_word, list_max(places)::bigint as last_word, array_to_string(list_sort(bl), ',') as base_labels, array_to_string(list_sort(list_concat(bl, fl)), ',') as labels,
      greatest(case when len(fl) > 0 then 1 - power(0.5, m) else 0 end, case when len(places) > 0 then 0.5 else 0 end)::double as score from c"""


ORACLE = oracle()
