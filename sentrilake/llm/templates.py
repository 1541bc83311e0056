"""License scans by templates with optional and replaceable regions.

Template markup: words stand for themselves and are mandatory, ``[ ... ]`` is an optional
region (it nests), ``{name:a-b}`` is a replaceable region of a to b words. A template is compiled
into an automaton over words whose states are the bits of one integer. A text is accepted
if some stretch of it is accepted from the first to the last word of the template; all mandatory
words must be there, in order, with nothing between but the template's regions.

Defined results: a null text is empty, without words or labels; rows that repeat are judged
alike; an empty table gives no rows; other columns are not carried. ``score`` is the
largest share of mandatory words in an accepted stretch, 0 without one.
"""

from __future__ import annotations

import pkgutil
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases of the base rule and their labels. Fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label and template, one after the other. Short notices first, then those of the licences and license texts.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit-notice", "[{subject:1-4} is] released under the mit license"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0"),
    ("gpl-3.0-notice", "[this work is] licensed under the gnu general public license version 3 [or any later version]"),
    ("gpl-2.0-notice", "[this work is] licensed under the gnu general public license version 2 [or any later version]"),
    ("cc-by-nc-notice", "licensed under [the] [a] cc by nc {version:0-2} [license]"),
    ("cc-by-notice", "licensed under [the] [a] cc by {version:1-2} license"),
    ("all-rights-notice", "copyright {holder:1-12} all rights reserved"),
)

_GNU = "under the terms of the gnu {kind} general public license [version {v}] as published by the free software foundation"
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and"
    " associated documentation files [the software] to deal in the software without restriction including without"
    " limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
    " and to permit persons to whom the software is furnished to do so subject to the following conditions"
    " the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies"
    " or substantial portions of the software"
    " the software is provided as is without warranty of any kind express or implied including but not limited to the"
    " warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {party:1-12} be"
    " liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of"
    " or in connection with the software or the use or other dealings in the software"
)
_BSD_HEAD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided"
    " that the following conditions are met"
    " {mark:0-1} redistributions of source code must retain the above copyright notice this list of conditions and the"
    " following disclaimer"
    " {mark:0-1} redistributions in binary form must reproduce the above copyright notice this list of conditions and the"
    " following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_ADVERTISING = (
    " {mark:0-1} all advertising materials mentioning features or use of this software must display the following"
    " acknowledgement this product includes software developed by {holder:1-20}"
)
_BSD_NAMES = (
    " {mark:0-1} neither the name of {holder:1-12} nor the names of [its] contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission"
)
_BSD_DISCLAIMER = (
    " this software is provided by {holder:1-12} as is and any express or implied warranties including but not limited to"
    " the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall"
    " {holder:1-12} be liable for any direct indirect incidental special exemplary or consequential damages including but"
    " not limited to procurement of substitute goods or services loss of use data or profits or business interruption"
    " however caused and on any theory of liability whether in contract strict liability or tort including negligence or"
    " otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)

#: The notices that the licences give for files, and the whole wording of short licences.
TEMPLATES += tuple(
    (label, f"{_GNU.format(kind=kind, v=v)} [either] version {v} of the license [or [at your option] any later version]")
    for label, kind, v in (
        ("gpl-3.0-notice", "", "3"), ("gpl-2.0-notice", "", "2"), ("lgpl-3.0-notice", "lesser", "3"),
        ("lgpl-2.1-notice", "lesser", "2 1"), ("lgpl-2.0-notice", "library", "2"),
    )
) + (
    ("lgpl-3.0-notice", "[this work is] licensed under the gnu lesser general public license version 3 [or any later version]"),
    ("lgpl-2.1-notice", "[this work is] licensed under the gnu lesser general public license version 2 1 [or any later version]"),
    ("apache-2.0-header",
     "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the"
     " license you may obtain a copy of the license at {scheme:1-1} www apache org licenses license 2 0 unless required by"
     " applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"
     " without warranties or conditions of any kind either express or implied see the license for the specific language"
     " governing permissions and limitations under the license"),
    ("mpl-2.0-notice",
     "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not"
     " distributed with this file you can obtain one at {scheme:1-1} mozilla org mpl 2 0"),
    ("mpl-1.1-notice",
     "the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this"
     " file except in compliance with the license"),
    ("mit-text", _MIT),
    ("mit-text", _MIT.replace("noninfringement", "non infringement")),
    ("isc-text",
     "permission to use copy modify and [or] distribute this software for any purpose with or without fee"
     " is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
     " the software is provided as is and {author:1-12} disclaims all warranties with regard to this software including all"
     " implied warranties of merchantability and fitness in no event shall {author:1-12} be liable for any special direct"
     " indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an"
     " action of contract negligence or other tortious action arising out of or in connection with the use or performance"
     " of this software"),
    ("bsd-2-clause-text", _BSD_HEAD + _BSD_DISCLAIMER),
    ("bsd-3-clause-text", _BSD_HEAD + _BSD_NAMES + _BSD_DISCLAIMER),
    ("bsd-4-clause-text", _BSD_HEAD + _BSD_ADVERTISING + _BSD_NAMES + _BSD_DISCLAIMER),
)

#: Label, file of the whole text and its last words that are no appendix.
_FULL = (
    ("apache-2.0-text", "Apache-2.0", "end of terms and conditions"), ("gpl-2.0-text", "GPL-2", "end of terms and conditions"),
    ("gpl-3.0-text", "GPL-3", "end of terms and conditions"), ("lgpl-2.0-text", "LGPL-2", "end of terms and conditions"),
    ("lgpl-2.1-text", "LGPL-2.1", "end of terms and conditions"),
    ("lgpl-3.0-text", "LGPL-3", ""), ("mpl-1.1-text", "MPL-1.1", ""), ("mpl-2.0-text", "MPL-2.0", ""),
)

_MARK = re.compile(r"\[|\]|\{\w+:\d+-\d+\}|[^\s\[\]{}]+")
_NOT_WORD = bytes(
    c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower()
)


def words_of(data: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text: runs of ASCII letters, digits and everything above ASCII."""
    return data.translate(_NOT_WORD).split()


def full_template(name: str, end: str) -> str:
    """The whole text of a licence: its closing line and appendix are optional, the scheme of an address and the
    foundation's street are replaceable."""
    text = b" ".join(words_of(pkgutil.get_data("sentrilake.llm", f"licenses/{name}.txt"))).decode()
    text, *rest = text.split(f" {end} ", 1) if end else [text]
    text = re.sub(r"\bhttps?\b", "{scheme:1-1}", text)
    text = re.sub(r"(free software foundation inc) \d+ (?:franklin|temple) .*? usa\b", r"\1 {street:0-14}", text)
    return f"{text} [{end}]" if rest else text


TEMPLATES += tuple((label, full_template(name, end)) for label, name, end in _FULL)


@dataclass
class Automaton:
    """Non-deterministic automaton; state i is bit i, ``accept`` is the last bit."""

    label: str
    steps: dict[bytes, int] = field(default_factory=dict)  # word: states it is read in
    any_word: int = 0  # states that read whatever word
    skip: list[int] = field(default_factory=list)  # states reachable from state i without reading
    start: int = 0
    accept: int = 0
    mandatory: int = 0
    anchor: bytes = b""  # longest run of mandatory words, as it stands in a normal text

    def stretches(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(first word, end) of accepted stretches, the shortest for each end, that don't overlap."""
        found, begins, free = [], {}, 0
        for i, word in enumerate(words):
            # Each live state remembers the latest start that leads to it.
            live = dict(begins)
            for s in self._closure(self.start):
                live[s] = max(live.get(s, -1), i)
            reads = self.steps.get(word, 0) | self.any_word
            begins = {}
            for state, at in live.items():
                if at >= free and reads >> state & 1:
                    for s in self._closure(1 << (state + 1)):
                        begins[s] = max(begins.get(s, -1), at)
            end = self.accept.bit_length() - 1
            if end in begins:
                found.append((begins[end], i + 1))
                free, begins = i + 1, {}
        return found

    def _closure(self, states: int) -> list[int]:
        out = []
        while states:
            low = states & -states
            out += self.skip[low.bit_length() - 1]
            states ^= low
        return out


def compile_template(label: str, template: str) -> Automaton:
    """Compile the markup. A region of a to b free words is a row of b states, the last b - a
    of which may be skipped."""
    auto, edges, opened, n = Automaton(label), [], [], 0
    run, longest = [], []

    def close_run():
        nonlocal run, longest
        longest = max(longest, run, key=len)
        run = []

    for mark in _MARK.findall(template.lower()):
        if mark == "[":
            opened.append(n)
            close_run()
        elif mark == "]":
            edges.append((opened.pop(), n))
            close_run()
        elif mark[0] == "{":
            least, most = map(int, mark[1:-1].split(":")[1].split("-"))
            for k in range(most):
                if k >= least:
                    edges.append((n + k, n + most))
                auto.any_word |= 1 << (n + k)
            n += most
            close_run()
        else:
            word = mark.encode()
            auto.steps[word] = auto.steps.get(word, 0) | 1 << n
            n += 1
            if not opened:
                auto.mandatory += 1
                run.append(word)
    close_run()
    if opened or not longest:
        raise ValueError(f"template {label!r}: unclosed region or no mandatory word")
    auto.start, auto.accept, auto.anchor = 1, 1 << n, b" " + b" ".join(longest) + b" "
    reach = [{i} for i in range(n + 1)]
    for state in range(n, -1, -1):
        for a, b in edges:
            if a == state:
                reach[state] |= reach[b]
    auto.skip = [sorted(x) for x in reach]
    return auto


def places(normal: bytes, phrase: bytes) -> list[int]:
    """Offsets of a phrase in a text of words with a space before, between and after."""
    out, at = [], normal.find(phrase)
    while at >= 0:
        out.append(at)
        at = normal.find(phrase, at + 1)
    return out


def _scan(data: bytes, phrases: dict[bytes, str], automata: list[Automaton]) -> tuple:
    words = words_of(data)
    normal = b" " + b" ".join(words) + b" "
    n, first, last, base = 0, None, None, set()
    for phrase, label in phrases.items():
        if at := places(normal, phrase):
            n += len(at)
            base.add(label)
            a, b = normal.count(b" ", 0, at[0]), normal.count(b" ", 0, at[-1])
            first, last = a if first is None else min(a, first), b if last is None else max(b, last)
    labels, score = set(base), 0.0
    for auto in automata:
        if auto.anchor in normal:
            for a, b in auto.stretches(words):
                labels.add(auto.label)
                score = max(score, min(1.0, auto.mandatory / (b - a)))
    return len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def scan_licenses(
    docs: DataFrame,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
) -> DataFrame:
    """Labels of every row of ``docs`` (doc_id, text). One pass, no shuffle."""
    for label, template in templates:
        compile_template(label, template)  # reject faulty markup before any task runs

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [compile_template(*x) for x in templates]
        wanted = {b" " + b" ".join(words_of(p.encode())) + b" ": label for p, label in phrases.items()}
        for batch in batches:
            found = [_scan(x or b"", wanted, automata) for x in batch["text"].cast(pa.binary()).to_pylist()]
            columns = list(zip(*found)) or [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, t) for c, t in zip(columns, _TYPES))], ["doc_id", *_NAMES]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        scan,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string,"
        " labels string, score double",
    )
