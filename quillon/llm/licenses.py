"""License scans: templates with optional and replaceable regions as token automata."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, map_batches, utf8

#: Every byte that can't stand in a word becomes a blank, A-Z become a-z.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Words of a replaceable region that names no bounds.
REPLACEABLE = (0, 12)

#: Phrases of the base scan.
PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}

_THIS = "<<beginOptional>>this <<var;match=.{1,4}>> is <<endOptional>>"
_WARRANTY = (
    "this software is provided by <<var;match=.{2,14}>> as is and any express or implied warranties, including, but not limited to, the implied"
    " warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall <<var;match=.{2,14}>> be liable for any"
    " direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or"
    " services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict"
    " liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility"
    " of such damage"
)
_GRANT = (
    "permission is hereby granted, free of charge, to any person obtaining a copy of this <<var;match=.{1,6}>> (the software), to deal in the"
    " software without restriction"
)
#: Notices and license texts of the method's own, with the markup of Automaton.add().
TEMPLATES = {
    "gpl-notice": _THIS + "<<beginOptional>>free software <<endOptional>>"
    "licensed under the <<beginOptional>>terms of the <<endOptional>>GNU General Public License"
    "<<beginOptional>>, version <<var;match=.{1,3}>><<endOptional>>",
    "gpl-header": "<<var;match=this program|this file|this library>> is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or"
    " modify it under the terms of the GNU General Public License as published by the Free Software Foundation<<beginOptional>>,"
    " <<var;match=either version|version>> <<var;match=.{1,2}>> <<beginOptional>>of the license<<endOptional>><<beginOptional>>, or (at your option)"
    " any later version<<endOptional>><<endOptional>>",
    "gpl-header-text": "<<var;match=this program|this file|this library>> is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or"
    " modify it under the terms of the GNU General Public License as published by the Free Software Foundation, <<var;match=either version|version>>"
    " <<var;match=.{1,2}>> of the license<<beginOptional>>, or (at your option) any later version<<endOptional>>."
    " <<var;match=this program|this file|this library>> is distributed in the hope that it will be useful, but without any warranty; without even the"
    " implied warranty of merchantability or fitness for a particular purpose. see the GNU General Public License for more details",
    "apache-2.0-notice": "licensed under the Apache License, version 2.0<<beginOptional>> (the license); you may not use this"
    " <<var;match=.{1,3}>> except in compliance with the license<<endOptional>>",
    "apache-2.0-header": "licensed under the Apache License, version 2.0 (the license); you may not use <<var;match=.{1,4}>> except in compliance with"
    " the license. you may obtain a copy of the license at <<beginOptional>><<var;match=http|https>>://<<beginOptional>>www.<<endOptional>>apache.org"
    "/licenses/LICENSE-2.0<<beginOptional>>.txt<<endOptional>><<endOptional>> unless required by applicable law or agreed to in writing, software"
    " distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied. see the"
    " license for the specific language governing permissions and limitations under the license",
    "cc-by-notice": _THIS + "licensed under <<beginOptional>>a <<endOptional>>"
    "<<beginOptional>>creative commons <<endOptional>>CC BY<<beginOptional>>-NC<<endOptional>><<beginOptional>>-SA<<endOptional>>"
    "<<beginOptional>>-ND<<endOptional>> 4.0<<beginOptional>> international<<endOptional>>",
    "cc-by-deed": _THIS + "licensed under <<var;match=a|the>> creative commons attribution<<beginOptional>>-noncommercial<<endOptional>>"
    "<<beginOptional>>-sharealike<<endOptional>><<beginOptional>>-noderivatives<<endOptional>> <<var;match=1.0|2.0|2.5|3.0|4.0>>"
    " <<beginOptional>><<var;match=international|unported|generic>> <<endOptional>>license",
    "mit-notice": _THIS + "released under the MIT License",
    "mit-text": _GRANT,
    "mit-license": _GRANT + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"
    " of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice"
    " and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all copies or substantial portions"
    " of the software. the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of"
    " merchantability, fitness for a particular purpose and noninfringement. in no event shall <<var;match=.{2,12}>> be liable for any claim, damages or"
    " other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other"
    " dealings in the software",
    "bsd-license": "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions"
    " are met: <<beginOptional>>1. <<endOptional>>redistributions of source code must retain the above copyright notice, this list of conditions and the"
    " following disclaimer. <<beginOptional>>2. <<endOptional>>redistributions in binary form must reproduce the above copyright notice, this list of"
    " conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. <<beginOptional>>"
    "<<beginOptional>>3. <<endOptional>>neither the name of <<var;match=.{1,14}>> nor the names of <<var;match=its|their>> contributors may be used to"
    " endorse or promote products derived from this software without specific prior written permission. <<endOptional>>" + _WARRANTY,
    "isc-license": "permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is"
    " hereby granted, provided that the above copyright notice and this permission notice appear in all copies. the software is provided as is and"
    " <<var;match=.{2,8}>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. in no"
    " event shall <<var;match=.{2,8}>> be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from"
    " loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use"
    " or performance of this software",
    "mpl-2.0-notice": "this source code form is subject to the terms of the Mozilla Public License, v. 2.0<<beginOptional>>. if a copy of the MPL was not"
    " distributed with this file, <<var;match=you can obtain one at>> <<var;match=.{4,9}>><<endOptional>>",
    "copyright-notice": "copyright <<beginOptional>>(c) <<endOptional>><<var;match=.{1,10}>> all rights reserved",
}


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of letters and digits of ASCII and of all other characters."""
    return text.translate(_NORMAL).split()


_TAG = re.compile(r"<<(beginOptional|endOptional|var)(?:;(.*?))?>>")


@dataclass
class Automaton:
    """A token automaton: step[state] maps a word to the next states, any[state] holds
    those that any word leads to, skip[state] those reached without a word; final states carry labels."""

    step: list[dict[bytes, set[int]]]
    any: list[set[int]]
    skip: list[set[int]]
    final: dict[int, str]

    def __init__(self) -> None:
        self.step, self.any, self.skip, self.final = [{}], [set()], [set()], {}

    def _state(self) -> int:
        self.step.append({})
        self.any.append(set())
        self.skip.append(set())
        return len(self.step) - 1

    def add(self, label: str, template: str) -> None:
        """Compile a template: words between <<beginOptional>> and <<endOptional>> may be
        missing (regions may nest), <<var;match=.{m,n}>> stands for m to n words of any kind.

        match may also be .+ or .* (any number of words), or wordings between bars, one of
        which must stand there; without it a region has REPLACEABLE words. Other patterns
        are refused.
        """
        now = self._state()
        self.skip[0].add(now)
        opened: list[int] = []
        at = 0
        for m in [*_TAG.finditer(template), None]:
            for word in words_of(template[at : m.start() if m else len(template)].encode()):
                new = self._state()
                self.step[now].setdefault(word, set()).add(new)
                now = new
            if m is None:
                break
            at = m.end()
            if m[1] == "beginOptional":
                opened.append(now)
            elif m[1] == "endOptional":
                if not opened:
                    raise ValueError(f"{label}: a region ends that didn't begin")
                new = self._state()
                self.skip[now].add(new)
                self.skip[opened.pop()].add(new)
                now = new
            else:
                now = self._replaceable(label, now, m[2])
        if opened:
            raise ValueError(f"{label}: a region is not closed")
        self.final[now] = label

    def _replaceable(self, label: str, now: int, said: str | None) -> int:
        """States from `now` to the one returned, for a region with the attributes `said`."""
        found = re.search(r"(?:^|;)\s*match=(.*?)\s*(?:;|$)", said or "")
        pattern = found[1].strip('"') if found else ".{%d,%d}" % REPLACEABLE
        end = self._state()
        if pattern in (".+", ".*"):
            loop = self._state()
            self.any[now].add(loop)
            self.any[loop].add(loop)
            self.skip[loop].add(end)
            if pattern == ".*":
                self.skip[now].add(end)
        elif bounds := re.fullmatch(r"\.\{(\d+),(\d+)\}", pattern):
            least, most = int(bounds[1]), int(bounds[2])
            if least > most:
                raise ValueError(f"{label}: {pattern} has no words")
            for k in range(most + 1):
                if k >= least:
                    self.skip[now].add(end)
                if k < most:
                    new = self._state()
                    self.any[now].add(new)
                    now = new
        elif re.fullmatch(r"[\w .,'/-]+(?:\|[\w .,'/-]+)*", pattern):
            for wording in pattern.split("|"):
                at = now
                for word in words_of(wording.encode()):
                    new = self._state()
                    self.step[at].setdefault(word, set()).add(new)
                    at = new
                self.skip[at].add(end)
        else:
            raise ValueError(f"{label}: can't match {pattern}")
        return end

    def ready(self) -> Automaton:
        """Close over skips, so that matching meets words only."""
        self.closed = []
        for s in range(len(self.step)):
            seen, todo = {s}, [s]
            while todo:
                for t in self.skip[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            self.closed.append(frozenset(seen))
        start = self.closed[0]
        self.starts_anywhere = any(self.any[s] for s in start)
        self.first = frozenset(w for s in start for w in self.step[s])
        return self

    def matches(self, words: list[bytes], at: int) -> dict[str, int]:
        """For each label that matches from word `at` on, the end of its longest match."""
        found: dict[str, int] = {}
        now = self.closed[0]
        for i in range(at, len(words)):
            w = words[i]
            new: set[int] = set()
            for s in now:
                for t in self.step[s].get(w, ()):
                    new |= self.closed[t]
                for t in self.any[s]:
                    new |= self.closed[t]
            if not new:
                break
            for s in new:
                if s in self.final:
                    found[self.final[s]] = i + 1
            now = new
        return found

    def scan(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        """(label, start, end) of all matches; one start and label give the longest match."""
        if not self.starts_anywhere and self.first.isdisjoint(words):
            return []
        first, every = self.first, self.starts_anywhere
        return [(label, i, end) for i, w in enumerate(words) if every or w in first for label, end in self.matches(words, i).items()]


SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string,"
    " labels string, score double, n_notices bigint, spans array<struct<label:string,start:bigint,end:bigint>>"
)


def license_scan(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """License mentions of whole texts (SCHEMA), a row for each row of docs.

    Phrases (label to wording) and templates (label to marked-up wording) run in one
    automaton. n_base counts the phrases' places, first_word and last_word are their
    smallest and largest start. score: the share of the text's words inside a match.
    spans: all matches, by start. A null text is empty: no words, score 0.
    """
    base = set(phrases)
    if base & set(templates):
        raise ValueError("a template has a phrase's label")

    def batch(b: pa.RecordBatch) -> pa.Table:
        machine = _machine(tuple(phrases.items()), tuple(templates.items()))
        out = []
        for doc, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
            words = words_of(text)
            spans = machine.scan(words)
            starts = [i for label, i, _ in spans if label in base]
            covered, reach = 0, 0
            for _, i, j in sorted(spans, key=lambda x: x[1:]):
                covered += max(0, j - max(i, reach))
                reach = max(reach, j)
            names = sorted({x[0] for x in spans})
            out.append((
                doc, len(words), len(starts), min(starts, default=None), max(starts, default=None),
                ",".join(x for x in names if x in base), ",".join(names), covered / len(words) if words else 0.0,
                len(spans) - len(starts), [{"label": a, "start": i, "end": j} for a, i, j in spans],
            ))
        cols = list(zip(*out, strict=True)) or [[]] * 10
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.int64(), span]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)})

    return map_batches(documents(docs, id_col, text_col), batch, SCHEMA)


_MACHINES: dict[tuple, Automaton] = {}


def _machine(phrases: tuple, templates: tuple) -> Automaton:
    key = (phrases, templates)
    if key not in _MACHINES:
        made = Automaton()
        for label, wording in (*phrases, *templates):
            made.add(label, wording)
        _MACHINES[key] = made.ready()
    return _MACHINES[key]
