"""License scans: templates with optional and replaceable regions, compiled into token automata.

A template is words with two kinds of markup: [[ ... ]] may be left out, {{n}} stands for up to n words of any kind.
Everything else is mandatory and must match word for word, but for spellings that EQUIVALENTS makes one. A template of
a license holds its whole wording, so a text that is altered anywhere isn't accepted; notices and headers that refer
to a license have templates of their own. compile_template turns one into an automaton whose states are places in the
template; accepts() follows all states at once over the words of a text. Short phrases ("under the mit license") are
the base, and a template that accepts adds its own label.

Edge cases: null texts count as empty and have no words; labels are '' if there are none and first_word, last_word are
null; non-ASCII characters are letters of words; other columns are ignored; repeated rows are scanned as often as
they occur; an empty table gives an empty result; null ids are passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

PHRASES: tuple[tuple[str, str], ...] = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Words that count as the same in license texts.
EQUIVALENTS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "acknowledgement": "acknowledgment", "organisation": "organization"}

#: Wording of public licenses, whole, and of the notices that refer to them.
_HOLDER = "[[copyright [[c]] {{24}}]] [[all rights reserved]]"
_BSD_OPEN = f"""{_HOLDER} redistribution and use in source and binary forms with or without modification are permitted provided that
    the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the
    following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following
    disclaimer in the documentation and or other materials provided with the distribution"""
_BSD_CLOSE = """this software is provided by the {{12}} as is and any express or implied warranties including but not limited to the implied
    warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the {{12}} be liable for any direct indirect
    incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use
    data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including
    negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit-notice", "released under the [[terms of the]] mit license"),
    (
        "mit-text",
        f"""[[[[the]] mit license [[mit]]]] {_HOLDER} permission is hereby granted free of charge to any person obtaining a copy of this
        software and associated documentation files [[the software]] to deal in the software without restriction including without limitation
        the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom
        the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
        [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is
        without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular
        purpose and noninfringement in no event shall the {{{{8}}}} be liable for any claim damages or other liability whether in an action of
        contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
    ),
    (
        "isc-text",
        f"""[[[[the]] isc license [[isc]]]] {_HOLDER} permission to use copy modify and or distribute this software for any purpose with or
        without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is
        provided as is and {{{{8}}}} disclaims all warranties with regard to this software including all implied warranties of merchantability and
        fitness in no event shall {{{{8}}}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting
        from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection
        with the use or performance of this software""",
    ),
    ("bsd-2-text", f"[[[[the]] bsd 2 clause license]] {_BSD_OPEN} {_BSD_CLOSE}"),
    (
        "bsd-3-text",
        f"""[[[[the]] bsd 3 clause license]] {_BSD_OPEN} [[3]] neither the name of {{{{12}}}} nor the names of its contributors may be used to endorse
        or promote products derived from this software without specific prior written permission {_BSD_CLOSE}""",
    ),
    (
        "bsd-4-text",
        f"""[[[[the]] bsd 4 clause license]] {_BSD_OPEN} [[3]] all advertising materials mentioning features or use of this software must display the
        following acknowledgment this product includes software developed by {{{{12}}}} [[4]] neither the name of {{{{12}}}} nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_CLOSE}""",
    ),
    (
        "zlib-text",
        f"""[[[[the]] zlib license]] {_HOLDER} this software is provided as is without any express or implied warranty in no event will the authors be
        held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose
        including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of
        this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product
        an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly
        marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any
        source distribution""",
    ),
    ("apache-2-notice", "licensed under the apache license version 2 0 [[the license]]"),
    (
        "apache-2-header",
        """licensed under the apache license version 2 0 the license you may not use this {{3}} except in compliance with the license you may obtain
        a copy of the license at {{12}} unless required by applicable law or agreed to in writing software distributed under the license is
        distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific
        language governing permissions and limitations under the license""",
    ),
    ("gpl-3-notice", "licensed under the gnu [[affero]] general public license [[as published by the free software foundation either]] version 3"),
    (
        "gpl-3-header",
        """this {{3}} is free software you can redistribute it and or modify it under the terms of the gnu [[affero]] general public license as published
        by the free software foundation either version 3 of the license or [[at your option]] any later version this {{3}} is distributed in the
        hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular
        purpose see the gnu [[affero]] general public license for more details""",
    ),
    ("cc-by-nc-notice", "licensed under [[a]] [[creative commons]] cc by nc [[sa]] [[nd]] 4 0"),
)


@dataclass(frozen=True)
class Automaton:
    """States 0..len(steps); steps[s] is (word or None for any word, next states after it), skips[s] epsilon moves."""

    words: tuple[bytes | None, ...]
    skips: tuple[tuple[int, ...], ...]
    first: frozenset[bytes]
    mandatory: int

    def closed(self, states: set[int]) -> set[int]:
        found, todo = set(states), list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return found

    def accepts(self, words: list[bytes], at: int) -> int | None:
        """End of the longest match that starts at words[at], else None."""
        end, last = None, len(self.words)
        states = self.closed({0})
        for k in range(at, len(words)):
            states = self.closed({s + 1 for s in states if s < last and (self.words[s] is None or self.words[s] == words[k])})
            if not states:
                break
            if last in states:
                end = k + 1
        return end


def compile_template(text: str) -> Automaton:
    """The automaton of a template; unbalanced markup raises ValueError."""
    words: list[bytes | None] = []
    skips: list[list[int]] = [[]]
    opened: list[int] = []
    mandatory = 0
    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", text):
        if token == "[[":
            opened.append(len(words))
        elif token == "]]":
            if not opened:
                raise ValueError(f"]] without [[ in {text!r}")
            skips[opened.pop()].append(len(words))
        elif token.startswith("{{"):
            for _ in range(int(token[2:-2])):
                skips[-1].append(len(words) + 1)
                words.append(None)
                skips.append([])
        else:
            word = token.lower()
            words.append(EQUIVALENTS.get(word, word).encode())
            skips.append([])
            mandatory += not opened
    if opened:
        raise ValueError(f"[[ without ]] in {text!r}")
    found = Automaton(tuple(words), tuple(map(tuple, skips)), frozenset(), mandatory)
    starts = {words[s] for s in found.closed({0}) if s < len(words)}
    if None in starts or not starts:
        raise ValueError(f"a template must start with a word: {text!r}")
    return Automaton(found.words, found.skips, frozenset(starts), mandatory)


class Scanner:
    def __init__(self, phrases: tuple[tuple[str, str], ...] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        gap, edge = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
        self.phrases = [(re.compile(b"(?=" + gap.join(map(re.escape, p.encode().split())) + b"(?!" + edge + b"))"), edge, label) for p, label in phrases]
        self.before = re.compile(edge)
        self.templates = [(label, compile_template(t)) for label, t in templates]
        self.equal = {a.encode(): b.encode() for a, b in EQUIVALENTS.items()}
        # a template is tried only on texts that hold its longest mandatory word in some spelling; few texts do
        self.hints = []
        for label, automaton in self.templates:
            rare = max((w for w, s in zip(automaton.words, range(len(automaton.words))) if w is not None and not self._optional(automaton, s)), key=len)
            self.hints.append(([rare, *(a for a, b in self.equal.items() if b == rare)], label, automaton))

    @staticmethod
    def _optional(automaton: Automaton, state: int) -> bool:
        return any(a <= state < b for a, row in enumerate(automaton.skips) for b in row)

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        low = (text or "").encode("utf-8", "surrogatepass").lower()
        places: list[int] = []
        base: set[str] = set()
        for pattern, _, label in self.phrases:
            for m in pattern.finditer(low):
                k = m.start()
                if k and self.before.match(low, k - 1):
                    continue
                places.append(k)
                base.add(label)
        near = [(label, automaton) for spellings, label, automaton in self.hints if any(x in low for x in spellings)]
        own: dict[str, int] = {}
        words = WORD.findall(low)
        same = [self.equal.get(w, w) for w in words] if near else words
        for label, automaton in near:
            for k, w in enumerate(same):
                if w in automaton.first and automaton.accepts(same, k) is not None:
                    own[label] = automaton.mandatory
                    break
        starts = sorted(len(WORD.findall(low, 0, k)) for k in (min(places), max(places))) if places else [None, None]
        score = max([0.5 * bool(base), *(1 - 0.5 / n for n in own.values())])
        return len(words), len(places), starts[0], starts[1], ",".join(sorted(base)), ",".join(sorted(base | own.keys())), score


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    phrases: tuple[tuple[str, str], ...] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES,
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            rows = [scanner.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types))], names)

    kinds = ("long",) * 4 + ("string",) * 2 + ("double",)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} {k}" for n, k in zip(names[1:], kinds)))
