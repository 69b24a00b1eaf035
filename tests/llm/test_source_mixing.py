import math

import pytest
from pyspark.sql import functions as F

from quillgraph.llm.source_mixing import mix_sources, repeat_documents, round_cells, share_out


def test_share_out():
    assert share_out([100, 100, 100], [5, 2, 1], 3) == pytest.approx([187.5, 75, 37.5])
    capped = share_out([10, 100, 100], [5, 2, 1], 3)
    assert capped == pytest.approx([30, 120, 60]) and sum(capped) == pytest.approx(210)
    assert share_out([0, 0], [5, 2], 3) == [0, 0] and share_out([], [], 3) == []


def test_targets_and_copies(docs_of, odd):
    rows = [(i, t, "en", "odd") for i, t in odd]
    for i in range(100, 700):
        rows.append((i, "w " * (5 + i * 7 % 90), "en", (None, "a", "b", "c", "d")[i % 5] if i % 3 else "a"))
    got = mix_sources(docs_of(rows)).collect()
    assert len(got) == len(rows)
    sources = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"] and r.copies in (math.floor(r.rate), math.ceil(r.rate))
        s = sources.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r.taken
        s[1] += r["size"]
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    sizes = [sources[s][1] for s in names]
    assert [sources[s][3] for s in names] == sizes
    assert [sources[s][2] for s in names] == pytest.approx(share_out(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 3))
    for s in names:
        assert s == "odd" or abs(sources[s][0] - sources[s][2]) <= 0.02 * sources[s][2] + 2
    again = sorted((r.doc_id or 0, r["size"], r.taken) for r in mix_sources(docs_of(rows)).collect())
    assert again == sorted((r.doc_id or 0, r["size"], r.taken) for r in got)


def test_repeats_rows_with_all_columns(docs_of):
    docs = docs_of([(i, "one two three four " * (i % 7 + 1), "en", "ab"[i % 2]) for i in range(200)])
    taken = {r.doc_id: r.copies for r in mix_sources(docs).collect()}
    out = repeat_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(taken.values())
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {i: c for i, c in taken.items() if c}


def test_empty(docs_of):
    assert mix_sources(docs_of([])).count() == 0
    assert [r.taken for r in mix_sources(docs_of([(1, None, "en", None)])).collect()] == [0]


def test_rates_against_a_plain_solver(spark):
    """Each source's multiplier by halving: the words of min(cap, exp(t * size / mean)) * size grow with t."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mix_sources(docs).collect()
    sources = {}
    for r in rows:
        sources.setdefault(r.source, []).append(r)
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    total = {s: sum(r["size"] for r in sources[s]) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free = {}, set(names)
    while free:  # what is over goes to the others by weight
        unit = (sum(total.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > 3 * total[s]}
        target |= {s: 3.0 * total[s] for s in over} if over else {s: weight[s] * unit for s in free}
        free -= over or free
    for s in names:
        own, mean = sources[s], total[s] / len(sources[s])
        assert own[0].target == pytest.approx(target[s])
        words = lambda t: sum(r["size"] * min(3.0, math.exp(min(700, t * r["size"] / mean))) for r in own)  # noqa: B023, E731
        low, high = -1e3, 1e3
        for _ in range(200):
            low, high = ((low + high) / 2, high) if words((low + high) / 2) < target[s] else (low, (low + high) / 2)
        for r in own:
            assert r.rate == pytest.approx(min(3.0, math.exp(low * r["size"] / mean)), rel=2e-2), s
        assert abs(sum(r.taken for r in own) - target[s]) <= 0.02 * target[s]


def test_rounding_owes_little():
    cells = [("a", 500, 0.4, [(3, 1)]), ("a", 90, 1.5, [(1, 1), (9, 2)]), ("a", 10, 0.3, [(i, 1) for i in range(50)]), ("a", 1, 0.5, [(i, 2) for i in range(20)]), ("b", 7, 2.0, [(0, 3)]), ("b", 0, 1.0, [(0, 1)])]
    taken, wanted = {}, {}
    for (source, size, rate, bins), (_, _, _, whole, mark) in zip(cells, round_cells(iter(cells)), strict=True):
        taken[source] = taken.get(source, 0) + sum(k * size * (whole + (b < mark)) for b, k in bins)
        wanted[source] = wanted.get(source, 0) + sum(k for _, k in bins) * size * rate
    assert abs(taken["a"] - wanted["a"]) <= 1 and taken["b"] == wanted["b"]


def test_columns_with_odd_names(docs_of, odd):
    docs = docs_of([(i, t, "en", "ab"[k % 2]) for k, (i, t) in enumerate(odd)]).withColumns({n: F.lit(1) for n in ("a.b", "mark", "bin", "of_size", "whole")})
    assert repeat_documents(docs).columns == docs.columns
