"""License scan by template markup.

A template is license wording with two kinds of regions, written as SPDX
templates write them: ``<<beginOptional>> ... <<endOptional>>`` may be left
out, and ``<<var;match=M>>`` stands for replaceable words, as many as M says
(``one``, ``some``: 1 to 20, ``any``: 0 to 20).  Each template is compiled to
an automaton over word tokens; it accepts a run of words if all mandatory
wording stands there exactly, in order, with nothing else between but what the
regions allow.  Runs may begin anywhere in a text.  Notices are written with
the verb ``licensed``, which stands for any of ``VERBS``.

Wording that opens a license or header without the rest of its mandatory
wording is labelled as an opening, not as that license.

Of accepted runs within one another only the longest counts.

The automaton is simulated on sets of states from every place where one of its
possible first words stands, so the cost follows these places and not the
number of templates.  Beside the templates, fixed phrases give base labels.

Defined cases: a null or empty text has no words, no labels and score 0; a
text that is only part of a template gets no template label; repeated rows are
scanned each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchpost.llm.base import ship
from watchpost.llm.decontaminate import words

#: The phrases of the contract and their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

#: The verb of a template's notice, and those that may stand in its place.
_VERB = b"licensed"
VERBS = frozenset((
    _VERB, b"released", b"distributed", b"redistributed", b"published", b"provided", b"available", b"offered",
    b"issued", b"covered",
))

_TERMS = "<<beginOptional>>the<<endOptional>> <<beginOptional>>terms of the<<endOptional>>"
_VERSION = ("<<beginOptional>>version <<var;match=version>><<endOptional>> "
            "<<beginOptional>>v <<var;match=version>><<endOptional>>")
_CLAUSES = "<<beginOptional>><<var;match=one>> clause<<endOptional>>"
_MIT_OPENING = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files the software to deal in the software without restriction including "
    "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
    "of the software and to permit persons to whom the software is furnished to do so"
)
_BSD_OPENING = (
    "redistribution and use in source and binary forms with or without modification are permitted provided "
    "that the following conditions are met"
)

#: Templates by label.  Wording from the licenses' own texts and notices.
TEMPLATES = {
    "apache-2.0": f"licensed under {_TERMS} apache license <<beginOptional>>version<<endOptional>> "
                  "<<beginOptional>>v<<endOptional>> 2 0",
    "apache-notice": f"licensed under {_TERMS} apache license",
    "cc-by-notice": "<<beginOptional>>this work is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> "
                    "cc by <<beginOptional>><<var;match=version>><<endOptional>>",
    "cc-by-nc": "licensed under <<beginOptional>>a<<endOptional>> cc by nc "
                "<<beginOptional>><<var;match=version>><<endOptional>>",
    "cc-by-nc-nd": "licensed under <<beginOptional>>a<<endOptional>> cc by nc nd "
                   "<<beginOptional>><<var;match=version>><<endOptional>>",
    "cc-by-nc-sa": "licensed under <<beginOptional>>a<<endOptional>> cc by nc sa "
                   "<<beginOptional>><<var;match=version>><<endOptional>>",
    "cc-by-nd": "licensed under <<beginOptional>>a<<endOptional>> cc by nd "
                "<<beginOptional>><<var;match=version>><<endOptional>>",
    "cc-by-sa": "licensed under <<beginOptional>>a<<endOptional>> cc by sa "
                "<<beginOptional>><<var;match=version>><<endOptional>>",
    "cc0": "<<beginOptional>>licensed under<<endOptional>> cc0 <<beginOptional>>1 0<<endOptional>> "
           "<<beginOptional>>universal<<endOptional>>",
    "gpl-notice": f"licensed under {_TERMS} gnu <<beginOptional>>lesser<<endOptional>> "
                  "<<beginOptional>>affero<<endOptional>> general public license "
                  f"{_VERSION}",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the "
                  "gnu general public license as published by the free software foundation either version "
                  "<<var;match=version>> of the license or at your option any later version",
    "mit-notice": f"licensed under {_TERMS} mit <<beginOptional>>expat<<endOptional>> license",
    "mit": f"{_MIT_OPENING} subject to the following conditions the above copyright notice and this permission notice "
           "<<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or "
           "substantial portions of the software the software is provided as is without warranty of any kind express "
           "or implied including but not limited to the warranties of merchantability fitness for a particular "
           "purpose and noninfringement in no event shall <<var;match=some>> be liable for any claim damages or other "
           "liability whether in an action of contract tort or otherwise arising from out of or in connection with "
           "the software or the use or other dealings in the software",
    "mit-opening": f"{_MIT_OPENING} <<beginOptional>>subject to the following conditions<<endOptional>>",
    "bsd-notice": f"licensed under {_TERMS} {_CLAUSES} <<beginOptional>>new<<endOptional>> "
                  "<<beginOptional>>modified<<endOptional>> <<beginOptional>>revised<<endOptional>> "
                  f"<<beginOptional>>simplified<<endOptional>> bsd {_CLAUSES} license",
    "bsd": f"{_BSD_OPENING} <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above "
           "copyright notice this list of conditions and the following disclaimer <<beginOptional>>2<<endOptional>> "
           "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
           "following disclaimer in the documentation and or other materials provided with the distribution "
           "<<beginOptional>>3<<endOptional>> <<beginOptional>>neither the name of <<var;match=some>> nor the names of "
           "<<var;match=some>> may be used to endorse or promote products derived from "
           "this software without specific prior written permission<<endOptional>> this software is provided by "
           "<<var;match=some>> as is and any express or implied warranties including but not limited to the implied "
           "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall "
           "<<var;match=some>> be liable for any direct indirect incidental special exemplary or consequential damages "
           "including but not limited to procurement of substitute goods or services loss of use data or profits or "
           "business interruption however caused and on any theory of liability whether in contract strict liability "
           "or tort including negligence or otherwise arising in any way out of the use of this software even if "
           "advised of the possibility of such damage",
    "bsd-opening": _BSD_OPENING,
    "mpl-notice": f"licensed under {_TERMS} mozilla public license {_VERSION} "
                  "<<beginOptional>>2 0<<endOptional>>",
    "mpl-header": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the "
                  "mpl was not distributed with this file you can obtain one at <<beginOptional>>http<<endOptional>> "
                  "<<beginOptional>>https<<endOptional>> <<beginOptional>>www<<endOptional>> mozilla org mpl 2 0",
    "copyright-reserved": "copyright <<beginOptional>>c<<endOptional>> <<var;match=some>> all rights reserved",
}

#: Words that a replaceable region takes, at least and at most, and what each must look like.
_MATCH = {
    "one": (1, 1, None),
    "some": (1, 20, None),
    "any": (0, 20, None),
    "version": (1, 2, re.compile(rb"[0-9]+")),
}
_MARK = re.compile(r"<<(beginOptional|endOptional|var;match=(\w+))>>")


@dataclass
class Automaton:
    """States 0 to ``final``; from each, the words it reads and where that leads, and its free moves."""

    label: str
    reads: list[list[tuple[object, int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    final: int = 0
    mandatory: int = 0

    def state(self) -> int:
        self.reads.append([])
        self.free.append([])
        return len(self.reads) - 1

    def closure(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def first_words(self) -> set[bytes]:
        """The words a match can begin with; a template must not begin with a replaceable region."""
        out = set()
        for s in self.closure({0}):
            for what, _ in self.reads[s]:
                if not isinstance(what, frozenset):
                    raise ValueError(f"{self.label}: begins with a replaceable region")
                out |= what
        return out

    def match(self, text: list[bytes], at: int) -> int:
        """The end of the longest run of words from ``at`` on that is accepted, or -1."""
        states, end = self.closure({0}), -1
        while states:
            if self.final in states:
                end = at
            if at == len(text):
                break
            word = text[at]
            states = self.closure({
                to for s in states for what, to in self.reads[s]
                if what is None or (word in what if isinstance(what, frozenset) else what.fullmatch(word))
            })
            at += 1
        return end


def compile_template(label: str, template: str) -> Automaton:
    """The token automaton of a template; raises where regions are not closed."""
    auto = Automaton(label)
    now, opened, at = auto.state(), [], 0

    def wording(part: str) -> None:
        nonlocal now
        for w in words(part):
            nxt = auto.state()
            auto.reads[now].append((VERBS if w == _VERB else frozenset((w,)), nxt))
            now = nxt
            auto.mandatory += not opened

    for mark in _MARK.finditer(template):
        wording(template[at:mark.start()])
        at = mark.end()
        if mark[1] == "beginOptional":
            opened.append(now)
        elif mark[1] == "endOptional":
            nxt = auto.state()
            auto.free[now].append(nxt)
            auto.free[opened.pop()].append(nxt)
            now = nxt
        else:
            least, most, shape = _MATCH[mark[2]]
            end = auto.state()
            for i in range(most):
                if i >= least:
                    auto.free[now].append(end)
                nxt = auto.state()
                auto.reads[now].append((shape, nxt))
                now = nxt
            auto.free[now].append(end)
            now = end
    wording(template[at:])
    if opened:
        raise ValueError(f"{label}: an optional region is not closed")
    if not auto.mandatory:
        raise ValueError(f"{label}: no mandatory wording")
    auto.final = now
    return auto


class Scanner:
    """All phrases and templates, found by the words they begin with."""

    def __init__(self, templates: dict[str, str], phrases: tuple[tuple[str, str], ...] = PHRASES):
        self.phrases = [(words(p), label) for p, label in phrases]
        self.starts: dict[bytes, list[Automaton]] = {}
        for label, template in templates.items():
            auto = compile_template(label, template)
            for w in auto.first_words():
                self.starts.setdefault(w, []).append(auto)
        for p, _ in self.phrases:
            self.starts.setdefault(p[0], [])

    def scan(self, text: str | None) -> dict:
        seq = words(text)
        base: list[tuple[int, int, str]] = []
        found: list[tuple[int, int, str]] = []
        if not self.starts.keys().isdisjoint(seq):
            for at, word in enumerate(seq):
                autos = self.starts.get(word)
                if autos is None:
                    continue
                for p, label in self.phrases:
                    if seq[at:at + len(p)] == p:
                        base.append((at, at + len(p), label))
                for auto in autos:
                    end = auto.match(seq, at)
                    if end > at:
                        found.append((at, end, auto.label))
        # Wording that is part of longer accepted wording is that one's: a
        # notice that names a narrower license is not one of the wider.
        found = [
            f for f in found
            if not any(g[0] <= f[0] and f[1] <= g[1] and g[1] - g[0] > f[1] - f[0] for g in found)
        ]
        covered, reach = 0, 0
        for start, stop, _ in sorted(base + found):
            covered += max(0, stop - max(start, reach))
            reach = max(reach, stop)
        starts = [b[0] for b in base]
        labels = {b[2] for b in base}
        return {
            "n_words": len(seq), "n_base": len(base),
            "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": sorted(labels), "labels": sorted(labels | {f[2] for f in found}),
            "places": [{"label": n, "start": a, "stop": b} for a, b, n in sorted(found)],
            # Half is due to any accepted wording, half to its share of the words.
            "score": 0.5 + 0.5 * covered / len(seq) if covered else 0.0,
        }


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Per document its words, base phrases, labels, the places of accepted templates, and a score.

    ``score`` is 0 without any accepted wording, else from 0.5 on, growing with
    the share of the words that belong to license wording.
    """
    ship(docs.sparkSession)
    using = TEMPLATES if templates is None else templates
    kind = pa.struct([
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())),
        ("places", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))),
        ("score", pa.float64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(using)
        for batch in batches:
            rows = pa.array([scanner.scan(t) for t in batch.column(1).to_pylist()], kind)
            yield pa.record_batch([batch.column(0), *rows.flatten()], ["doc_id", *[f.name for f in kind]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
        "labels array<string>, places array<struct<label: string, start: long, stop: long>>, score double"
    )
