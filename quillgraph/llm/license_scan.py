"""License scans by ordered signature rules.

A text is lower-cased (A-Z) and becomes a row of words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with one blank
between. A keyword prefilter looks for a handful of substrings in the raw text first; only texts
that hold one are matched. Rules are regular expressions over the row of words, in order of
priority: passages from the licences themselves, and what a licence is called in the ways that texts refer to it.
Overlaps are resolved by priority, then length, then the rules' order: a detection that lies inside a kept one, or
overlaps it, goes. Three base phrases are counted wherever their words stand.

Defined results: a null or empty text has no words, no label and score 0. The score is 1 less the product of what
the kept detections leave open (1 - confidence), and 0.85 at least where a base phrase stands. Rows are judged one by
one.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillgraph.llm.common import arrow_rows, document_texts

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Everything that is not a word byte becomes a blank; A-Z are lower-cased before.
_BLANKS = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else 0x20 for b in range(256))

#: What a licence is called: label, then expressions over words ("v2 0" is "v2.0").
NAMES: list[tuple[str, list[str]]] = [
    ("mit", ["mit", "expat", "x11"]),
    ("mit-0", ["mit 0", "mit no attribution"]),
    ("apache-2.0", ["apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?", "asl 2(?: 0)?"]),
    ("apache-1.1", ["apache(?: software)?(?: license)?(?: version| v)? ?1 1"]),
    ("apache", ["apache(?: software)?"]),
    ("agpl-3.0", ["(?:gnu )?affero general public(?: license)?(?: version| v)? ?3(?: 0)?", "(?:gnu )?agpl ?v? ?3(?: 0)?"]),
    ("agpl", ["(?:gnu )?affero general public", "(?:gnu )?agpl"]),
    ("lgpl-2.1", ["(?:gnu )?(?:lesser|library) general public(?: license)?(?: version| v)? ?2 1", "(?:gnu )?lgpl ?v? ?2 1"]),
    ("lgpl-3.0", ["(?:gnu )?lesser general public(?: license)?(?: version| v)? ?3(?: 0)?", "(?:gnu )?lgpl ?v? ?3(?: 0)?"]),
    ("lgpl", ["(?:gnu )?(?:lesser|library) general public", "(?:gnu )?lgpl"]),
    ("gpl-2.0", ["(?:gnu )?general public(?: license)?(?: version| v)? ?2(?: 0)?", "(?:gnu )?gpl ?v? ?2(?: 0)?"]),
    ("gpl-3.0", ["(?:gnu )?general public(?: license)?(?: version| v)? ?3(?: 0)?", "(?:gnu )?gpl ?v? ?3(?: 0)?"]),
    ("gpl", ["(?:gnu )?general public", "gnu gpl", "gpl"]),
    ("gfdl", ["(?:gnu )?free documentation", "gnu fdl", "gfdl"]),
    ("bsd-2-clause", ["bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd"]),
    ("bsd-3-clause", ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd"]),
    ("bsd-4-clause", ["bsd 4 clause", "4 clause bsd", "original bsd"]),
    ("bsd", ["bsd", "bsd style"]),
    ("0bsd", ["0bsd", "zero clause bsd"]),
    ("isc", ["isc"]),
    ("mpl-2.0", ["mozilla public(?: license)?(?: version| v)? ?2(?: 0)?", "mpl ?v? ?2(?: 0)?"]),
    ("mpl-1.1", ["mozilla public(?: license)?(?: version| v)? ?1 1", "mpl ?v? ?1 1"]),
    ("mpl", ["mozilla public", "mpl"]),
    ("epl-2.0", ["eclipse public(?: license)?(?: version| v)? ?2(?: 0)?", "epl ?v? ?2(?: 0)?"]),
    ("epl-1.0", ["eclipse public(?: license)?(?: version| v)? ?1(?: 0)?", "epl ?v? ?1(?: 0)?"]),
    ("epl", ["eclipse public", "epl"]),
    ("cddl", ["common development and distribution", "cddl"]),
    ("cpl", ["common public"]),
    ("eupl", ["european union public", "eupl"]),
    ("bsl-1.0", ["boost software", "bsl ?1 0"]),
    ("busl", ["business source", "busl"]),
    ("sspl", ["server side public", "sspl"]),
    ("elastic", ["elastic"]),
    ("unlicense", ["unlicense"]),
    ("wtfpl", ["do what the fuck you want to public", "wtfpl"]),
    ("zlib", ["zlib", "zlib libpng"]),
    ("artistic-2.0", ["artistic(?: license)?(?: version| v)? ?2(?: 0)?"]),
    ("artistic", ["artistic"]),
    ("python", ["python software foundation", "psf", "python"]),
    ("php", ["php"]),
    ("ruby", ["ruby"]),
    ("ofl-1.1", ["sil open font", "ofl"]),
    ("cc0", ["cc0", "cc zero", "creative commons zero"]),
    ("cc-by-nc-nd", ["(?:cc|creative commons) by nc nd(?: \\d 0)?", "attribution non ?commercial no ?deriv\\w*(?: \\d 0)?"]),
    ("cc-by-nc-sa", ["(?:cc|creative commons) by nc sa(?: \\d 0)?", "attribution non ?commercial share ?alike(?: \\d 0)?"]),
    ("cc-by-nc", ["(?:cc|creative commons) by nc(?: \\d 0)?", "attribution non ?commercial(?: \\d 0)?"]),
    ("cc-by-nd", ["(?:cc|creative commons) by nd(?: \\d 0)?", "attribution no ?deriv\\w*(?: \\d 0)?"]),
    ("cc-by-sa", ["(?:cc|creative commons) by sa(?: \\d 0)?", "attribution share ?alike(?: \\d 0)?"]),
    ("cc-by", ["(?:cc|creative commons) by(?: \\d 0)?", "creative commons attribution(?: \\d 0)?"]),
    ("cc", ["creative commons"]),
    ("odbl", ["open database", "odbl"]),
    ("odc-by", ["open data commons attribution", "odc by"]),
    ("pddl", ["public domain dedication and license", "pddl"]),
    ("openrail", ["(?:big ?science )?open ?rail(?: m)?"]),
    ("llama", ["llama(?: \\d)* community"]),
    ("ms-pl", ["microsoft public", "ms pl"]),
    ("ms-rl", ["microsoft reciprocal", "ms rl"]),
    ("postgresql", ["postgresql"]),
    ("openssl", ["openssl"]),
    ("vim", ["vim"]),
    ("w3c", ["w3c software"]),
    ("ncsa", ["university of illinois ncsa open source", "ncsa"]),
    ("afl-3.0", ["academic free"]),
    ("osl-3.0", ["open software"]),
    ("cecill", ["cecill"]),
    ("mulan", ["mulan psl", "mulan permissive software"]),
    ("beerware", ["beer ?ware"]),
    ("lppl", ["latex project public", "lppl"]),
    ("qpl", ["q public", "qt public"]),
    ("ipl", ["ibm public"]),
    ("upl", ["universal permissive"]),
    ("json", ["json"]),
]

#: Names that are also words or programs: only with the word licence after them, or in an SPDX line.
COMMON = {"mit-0", "isc", "elastic", "artistic", "python", "php", "ruby", "postgresql", "openssl", "vim", "json", "zlib", "cc", "epl", "mpl", "bsd"}

#: How a text refers to a licence ({} is the name): priority, confidence, expression.
REFERENCES: list[tuple[int, float, str]] = [
    (90, 1.0, "spdx license identifier {}"),
    (80, 0.95, "(?:re)?licen[cs]ed (?:to you )?(?:under|with|by|according to)(?: the(?: terms of the)?)? {}(?: licen[cs]e)?(?: version \\d(?: \\d)?)?"),
    (80, 0.95, "(?:released|distributed|available|published|provided|offered|shared) (?:to you )?under(?: the(?: terms of the)?)? {}(?: licen[cs]e)?(?: version \\d(?: \\d)?)?"),
    (70, 0.9, "(?:under|subject to|per)(?: the)? (?:terms(?: and conditions)? of|conditions of) the {} licen[cs]e"),
    (60, 0.85, "{} licen[cs]e(?: agreement| version \\d(?: \\d)?| v\\d(?: \\d)?)?"),
    (50, 0.8, "licen[cs]e (?:is )?{}"),
]

#: Passages of the licences themselves and other marks: label, priority, confidence, expression.
PASSAGES: list[tuple[str, int, float, str]] = [
    ("mit", 85, 0.95, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 84, 0.9, "to deal in the software without restriction including without limitation the rights to use copy modify merge"),
    ("mit", 83, 0.8, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", 84, 0.9, "to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("isc", 85, 0.9, "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 83, 0.7, "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("bsd", 85, 0.9, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 84, 0.8, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 84, 0.8, "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", 86, 0.9, "neither the name of .{1,80}? may be used to endorse or promote products"),
    ("bsd-4-clause", 86, 0.9, "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
    ("0bsd", 86, 0.9, "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("apache-2.0", 86, 0.95, "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", 84, 0.85, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", 83, 0.8, "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", 83, 0.8, "terms and conditions for use reproduction and distribution"),
    ("apache-1.1", 86, 0.9, "this product includes software developed by the apache software foundation"),
    ("gpl", 85, 0.95, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0", 87, 0.95, "under the terms of the gnu general public license as published by the free software foundation(?: either)? version 2"),
    ("gpl-3.0", 87, 0.95, "under the terms of the gnu general public license as published by the free software foundation(?: either)? version 3"),
    ("gpl", 84, 0.8, "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", 83, 0.7, "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl", 40, 0.8, "gnu general public license"),
    ("lgpl", 87, 0.95, "under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation"),
    ("lgpl", 84, 0.85, "you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl", 87, 0.95, "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", 84, 0.85, "you should have received a copy of the gnu affero general public license"),
    ("agpl-3.0", 84, 0.8, "your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", 85, 0.95, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", 83, 0.7, "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", 86, 0.95, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", 86, 0.95, "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl", 85, 0.9, "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", 85, 0.9, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl", 85, 0.9, "made available under the terms of the common public license"),
    ("eupl", 85, 0.9, "licensed under the eupl"),
    ("zlib", 85, 0.9, "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", 84, 0.85, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", 84, 0.85, "the png reference library is supplied as is"),
    ("unlicense", 85, 0.95, "this is free and unencumbered software released into the public domain"),
    ("unlicense", 84, 0.85, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("bsl-1.0", 85, 0.9, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("busl", 84, 0.85, "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("sspl", 84, 0.85, "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("wtfpl", 85, 0.95, "you just do what the fuck you want to"),
    ("artistic", 85, 0.9, "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", 84, 0.85, "this license establishes the terms under which a given free software package may be copied modified distributed"),
    ("python", 84, 0.85, "this license agreement is between the python software foundation"),
    ("php", 85, 0.9, "this product includes php software freely available from"),
    ("openssl", 85, 0.9, "this product includes software developed by the openssl project"),
    ("ncsa", 84, 0.85, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers"),
    ("w3c", 84, 0.85, "by obtaining using and or copying this work you the licensee agree that you have read understood"),
    ("ofl-1.1", 85, 0.9, "this font software is licensed under the sil open font license"),
    ("ofl-1.1", 84, 0.8, "neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("cc0", 85, 0.9, "to the extent possible under law .{1,80}? waived all copyright and related or neighboring rights"),
    ("cc-by", 84, 0.85, "this work is licensed under a creative commons attribution(?: \\d 0)?(?: international)? license"),
    ("cc-by-sa", 85, 0.9, "this work is licensed under a creative commons attribution share ?alike"),
    ("cc-by-nc", 85, 0.9, "this work is licensed under a creative commons attribution non ?commercial"),
    ("cc", 60, 0.8, "some rights reserved"),
    ("pddl", 84, 0.85, "dedicate the work to the public domain for the benefit of the public"),
    ("odbl", 84, 0.85, "any rights in individual contents of the database are licensed under"),
    ("openrail", 84, 0.85, "you agree not to use the model or derivatives of the model"),
    ("llama", 84, 0.85, "you will not use .{1,80}? to improve any other large language model"),
    ("ms-pl", 84, 0.85, "if you use the software you accept this license if you do not accept the license do not use the software"),
    ("json", 84, 0.9, "the software shall be used for good not evil"),
    ("postgresql", 84, 0.85, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("curl", 84, 0.8, "except as contained in this notice the name of a copyright holder shall not be used in advertising"),
    ("vim", 84, 0.85, "there are no restrictions on distributing unmodified copies of vim"),
    ("beerware", 85, 0.9, "you can do whatever you want with this stuff if we meet some day"),
    ("hpnd", 83, 0.8, "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("ijg", 84, 0.85, "this software is based in part on the work of the independent jpeg group"),
    ("unicode", 84, 0.85, "to deal in the data files or software without restriction"),
    ("tcl", 84, 0.8, "the authors hereby grant permission to use copy modify distribute and license this software"),
    ("cecill", 84, 0.85, "ce logiciel est regi par la licence cecill"),
    ("mulan", 84, 0.85, "you can use this software according to the terms and conditions of the mulan"),
    ("lppl", 84, 0.85, "this work may be distributed and or modified under the conditions of the latex project public license"),
    ("public-domain", 60, 0.8, "(?:dedicated to|released (?:in)?to|placed in|in) the public domain"),
    ("proprietary", 60, 0.8, "(?:proprietary and confidential|unauthorized (?:copying|use|distribution|reproduction) of this (?:file|software|document|work))"),
    ("proprietary", 60, 0.7, "no part of this (?:publication|document|work|software) may be reproduced"),
    ("proprietary", 60, 0.7, "you may not (?:copy|redistribute|reverse engineer|decompile) (?:this|the) (?:software|program|work)"),
    ("non-commercial", 60, 0.7, "(?:for|licensed for) non ?commercial use only"),
    ("all-rights-reserved", 50, 0.6, "all rights reserved"),
    ("gpl", 30, 0.6, "copyleft"),
    ("unknown", 10, 0.5, "(?:(?:re)?licen[cs]ed under|licen[cs]e agreement|terms of (?:this|the) licen[cs]e|see (?:the )?licen[cs]e)"),
]

#: Parts of single words; every rule and base phrase has a word with one of them.
KEYWORDS = tuple(b"licens licenc under domain permi distribut warrant reserved copyleft proprietary unauthori neither software copi copy reproduc rights materials commercial invariant stuff misrepresented restriction modified derivatives improve fuck library acknowledg receive package agree waived interacting includes grant libre logiciel product".split())


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    pattern: re.Pattern
    order: int
    literal: str | None = None  # a row without it has no match


def required(body: str) -> str | None:
    """The longest run of letters and digits that every match of an expression has, if it has three or more."""
    before = None
    while before != body:
        before, body = body, re.sub(r"\((?:\?:)?[^()]*\)[?*+]?", " ", body)
    body = re.sub(r"\\\w[*+?]?|\.\{[^}]*\}\??|\[[^\]]*\][?*+]?|.\?", " ", body)
    found = max(re.findall("[a-z0-9]+", body), key=len, default="")
    return found if len(found) >= 3 else None


def build_rules() -> list[Rule]:
    """One rule for each name and reference, and the passages; over the row of words."""
    specs = []
    for label, names in NAMES:
        for name in names:
            for priority, sure, reference in REFERENCES:
                if label in COMMON and priority == 50:
                    continue
                body = reference.replace("(?: licen[cs]e)?", " licen[cs]e") if label in COMMON else reference
                specs.append((label, priority, sure, body.format(f"(?:{name})"), required(name)))
    specs += [(*x, required(x[3])) for x in PASSAGES]
    order = {label: i for i, (label, _) in enumerate(NAMES)}
    return [Rule(label, priority, sure, re.compile(rb"(?<![^ ])(?:" + body.encode() + rb")(?![^ ])"), order.get(label, len(order)) * 100_000 + i, literal) for i, (label, priority, sure, body, literal) in enumerate(specs)]


class Scanner:
    def __init__(self, rules: list[Rule] | None = None):
        self.rules = build_rules() if rules is None else rules
        self.base = [(re.compile(rb"(?<![^ ])" + p.encode() + rb"(?![^ ])"), label) for p, label in BASE.items()]
        self.keywords = self._automaton({k.decode() for k in KEYWORDS})
        self.literals = self._automaton({r.literal for r in self.rules if r.literal})

    @staticmethod
    def _automaton(words: set[str]) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for word in words or {"\0"}:
            out.add_word(word, word)
        out.make_automaton()
        return out

    def detections(self, row: bytes) -> list[tuple[int, int, Rule]]:
        """(start, end, rule) of every rule's matches in a row of words, before suppression."""
        present = {None, *(word for _, word in self.literals.iter(row.decode("latin-1")))}
        return [(m.start(), m.end(), rule) for rule in self.rules if rule.literal in present for m in rule.pattern.finditer(row)]

    @staticmethod
    def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
        """By priority, then length, then the rules' order: a detection that a kept one contains or
        overlaps goes."""
        starts: list[int] = []
        kept: list[tuple[int, int, Rule]] = []  # apart from each other, by start
        for start, end, rule in sorted(found, key=lambda x: (-x[2].priority, x[0] - x[1], x[2].order, x[0])):
            at = bisect.bisect_left(starts, start)
            if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or end <= kept[at][0]):
                starts.insert(at, start)
                kept.insert(at, (start, end, rule))
        return kept

    def scan(self, text: bytes, with_spans: bool = True) -> dict:
        low = text.lower()
        words = low.translate(_BLANKS).split()
        n_words = len(words)
        none = {"n_words": n_words, "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "spans": []}
        if next(self.keywords.iter(low.decode("latin-1")), None) is None:
            return none
        row = b" ".join(words)
        places = [(m.start(), label) for pattern, label in self.base for m in pattern.finditer(row)]
        kept = self.resolve(self.detections(row))
        if not places and not kept:
            return none
        base = {label for _, label in places}
        blanks = np.flatnonzero(np.frombuffer(row, np.uint8) == 32)
        word = lambda at: int(np.searchsorted(blanks, at))
        starts = [at for at, _ in places]
        miss = 1.0
        for _, _, rule in kept:
            miss *= 1 - min(rule.confidence, 0.999)
        score = max(1 - miss, 0.85 if places else 0.0)
        return {
            "n_words": n_words,
            "n_base": len(places),
            "first_word": word(min(starts)) if starts else None,
            "last_word": word(max(starts)) if starts else None,
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {rule.label for _, _, rule in kept})),
            "score": score,
            "spans": [(word(a), word(z - 1) + 1, rule.label) for a, z, rule in kept] if with_spans else [],
        }


_scanner: list[Scanner] = []


def _rows(with_spans: bool):
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanner:
            _scanner.append(Scanner())
        for batch in batches:
            found = [_scanner[0].scan(t.as_py() or b"", with_spans) for t in batch.column("text").cast(pa.binary())]
            columns = [batch.column("doc_id"), *(pa.array([x[c] for x in found], t) for c, t in zip(names[1:], types[1:], strict=True))]
            if with_spans:
                kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
                columns.append(pa.array([[{"first": a, "end": z, "label": x} for a, z, x in f["spans"]] for f in found], kind))
            yield pa.RecordBatch.from_arrays(columns, [*names, *["spans"] * with_spans])

    return rows


def scan_licenses(docs: DataFrame, with_spans: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and, if
    asked for, spans (first word, word after the last, label) of the kept detections."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double" + ", spans array<struct<first: long, end: long, label: string>>" * with_spans
    return document_texts(docs).mapInArrow(arrow_rows(_rows(with_spans)), schema)
