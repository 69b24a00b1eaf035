import random
import re

from quillgraph.llm.license_scan import BASE, KEYWORDS, PASSAGES, Rule, Scanner, build_rules, scan_licenses

TEXTS = [
    "Released under the MIT License.",
    "licensed under the Apache-License, version 2.0; see the GNU General Public\nLicense",
    "mit license mit license MIT  LICENSE",
    "MITlicense, permit license, mit licenses",
    "Licensed under CC BY-NC 4.0.",
    "nothing to see",
    "SPDX-License-Identifier: BSD-3-Clause",
    "général public license é mit license",
]


def test_hundreds_of_rules():
    assert len(build_rules()) > 300


def test_base_columns_by_brute_force(docs_of, odd):
    rows = [*odd, *((100 + i, t) for i, t in enumerate(TEXTS))]
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in scan_licenses(docs_of(rows)).collect()), key=str)
    want = []
    for doc_id, text in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in hits]
        want.append((doc_id, len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
    assert got == sorted(want, key=str)


def test_labels_and_suppression():
    scan = Scanner().scan
    label = lambda t: scan(t.encode())["labels"]
    assert label(TEXTS[0]) == "mit" and label(TEXTS[4]) == "cc-by-nc" and label(TEXTS[6]) == "bsd-3-clause"
    assert label(TEXTS[5]) == "" and scan(b"")["score"] == 0.0
    both = scan(TEXTS[1].encode())
    assert both["base_labels"] == "apache,gpl" and {"apache", "apache-2.0", "gpl"} <= set(both["labels"].split(",")) and 0 < both["score"] <= 1
    spans = scan(b"licensed under the gnu lesser general public license version 3")["spans"]
    assert len(spans) == 1 and spans[0][2].startswith("lgpl")


def test_each_rule_has_a_keyword():
    for _, _, _, body in PASSAGES:
        assert any(k in w.encode() for w in re.findall(r"[a-z]{4,}", body) for k in KEYWORDS), body
    assert all(any(k in w for k in KEYWORDS) for w in (b"licensed", b"under", b"license", b"licence"))


def test_suppression_by_brute_force():
    rng = random.Random(2)
    rules = [Rule(f"l{i}", rng.choice([10, 50, 80]), 0.5, re.compile(b"x"), i) for i in range(20)]
    for _ in range(200):
        found = [(a := rng.randrange(60), a + rng.randint(1, 20), rng.choice(rules)) for _ in range(rng.randint(0, 25))]
        kept = []
        for x in sorted(found, key=lambda x: (-x[2].priority, x[0] - x[1], x[2].order, x[0])):
            if all(x[1] <= a or x[0] >= z for a, z, _ in kept):
                kept.append(x)
        assert Scanner.resolve(found) == sorted(kept, key=lambda x: x[:2])


def test_labels_and_score_without_prefilter_or_heads():
    """Every rule tried on every text, suppression by comparing all pairs."""
    scanner = Scanner()
    texts = [*TEXTS, "provided under vim", "vim license; see license", "this software is licensed under the mit license. all rights reserved", "Permission is hereby\ngranted, free of charge, to any person obtaining a copy of this software", "json is under way", "public domain in the public domain"]
    texts += [" ".join(random.Random(i).choices("mit apache license version 2 0 under the licensed released gnu general public gpl cc by sa spdx identifier isc bsd 3 clause".split(), k=40)) for i in range(40)]
    for text in texts:
        row = b" ".join(re.findall(rb"[a-z0-9\x80-\xff]+", text.lower().encode()))
        found = [(m.start(), m.end(), r) for r in scanner.rules for m in r.pattern.finditer(row)]
        kept = []
        for x in sorted(found, key=lambda x: (-x[2].priority, x[0] - x[1], x[2].order, x[0])):
            if all(x[1] <= a or x[0] >= z for a, z, _ in kept):
                kept.append(x)
        got = scanner.scan(text.encode())
        base = set(filter(None, got["base_labels"].split(",")))
        left = 1.0
        for _, _, rule in sorted(kept, key=lambda x: x[:2]):
            left *= 1 - min(rule.confidence, 0.999)
        assert got["labels"] == ",".join(sorted(base | {r.label for _, _, r in kept})), text
        assert got["score"] == max(1 - left, 0.85 if base else 0.0)
        assert [(row[:a].count(b" "), row[: z - 1].count(b" ") + 1) for a, z, _ in sorted(kept, key=lambda x: x[:2])] == [x[:2] for x in got["spans"]]


def test_long_text_full_of_licences():
    found = Scanner().scan(b"This work is licensed under the Apache License, Version 2.0. " * 20_000)
    assert len(found["spans"]) == 20_000 and found["n_base"] == 20_000 and found["spans"][-1][2] == "apache-2.0"


def test_empty(docs_of):
    assert scan_licenses(docs_of([])).count() == 0
