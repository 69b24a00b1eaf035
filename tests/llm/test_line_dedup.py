import hashlib
from collections import defaultdict

import numpy as np

from quillgraph.llm.line_dedup import PerfectHash, Shard, dedup_lines


def brute(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(-1 if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            k = key(line)
            gone = len(k) >= min_chars and len(holders[k]) >= min_docs and max(holders[k]) != (-1 if doc_id is None else doc_id)
            if not gone:
                kept.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()), key=str)


def test_perfect_hash_is_minimal_and_round_trips():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000, np.uint64))
    index = PerfectHash.unpacked(PerfectHash.over(keys).packed())
    assert sorted(index(keys).tolist()) == list(range(len(keys)))
    shard = Shard.unpacked(Shard.over(keys.view(np.int64), keys[::-1].view(np.int64), np.full(len(keys), 7), np.arange(len(keys))).packed())
    assert len(shard.prints) == len(keys) and (shard.counts == 7).all()


def test_against_brute_force(docs_of, odd):
    hot = "This very line is held by every third document of them all."
    rows = list(odd)
    for i in range(10, 130):
        text = f"own line number {i} with enough letters to be long\n" + (f"  {hot.upper() if i % 2 else hot}\t" if i % 3 == 0 else "short")
        rows.append((i, text + ("\n" + hot if i % 9 == 0 else "")))
    rows += [(200, "ä" * 40), (201, "ä" * 40), (202, "ä" * 40), (203, "ä" * 40), (204, "ä" * 40), (205, "ä" * 39)]
    rows += [(300, "repeated row with a line of more than forty characters")] * 6
    shared = "a line that several rows with one number hold, long enough"
    rows += [(i, shared) for i in (400, 400, 400, 401, 402)] + [(i, shared.replace("one", "no")) for i in (None, None, 403, 404, 405, 406)]
    for options in ({}, {"shard_keys": 3, "replica_probes": 5}):
        assert got(dedup_lines(docs_of(rows), **options)) == brute(rows)


def test_empty(docs_of):
    assert dedup_lines(docs_of([])).count() == 0
