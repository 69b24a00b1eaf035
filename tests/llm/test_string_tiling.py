import random

import numpy as np
import pytest

from quillgraph.llm.string_tiling import contaminated, decontaminate, tile


def plain_tiling(item, doc, least):
    """Greedy string tiling word by word, without hashes."""
    im, dm, total = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not im[i + n] and not dm[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return total
        for x in range(n):
            im[i + x] = dm[j + x] = True
        total += n


def test_tiles_like_the_plain_algorithm():
    rng = random.Random(3)
    for _ in range(60):
        item = [rng.randrange(6) for _ in range(rng.randint(4, 25))]
        doc = [rng.randrange(6) for _ in range(rng.randint(4, 60))]
        seeds = [(i, j) for i in range(len(item) - 2) for j in range(len(doc) - 2) if item[i : i + 3] == doc[j : j + 3]]
        tiles = tile(np.array(item), np.array(doc), seeds, 3)
        assert sum(t[2] for t in tiles) == plain_tiling(item, doc, 3)
        assert all(item[a : a + n] == doc[b : b + n] for a, b, n in tiles)


@pytest.fixture(scope="module")
def tables(spark, docs_of, odd):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, [word() for _ in range(30)]) for i in range(10)]
    rows = [*odd, *((100 + i, " ".join(word() for _ in range(100))) for i in range(30))]
    for i, w in items:
        other = [word() for _ in range(40)]
        rows.append((200 + i, " ".join([*other, *w, *other])))  # verbatim
        rows.append((300 + i, " ".join([*w[15:], *other, *w[:15]])))  # reordered
        rows.append((400 + i, " ".join([*w[:10], *other])))  # a third only
    rows.append((500, " ".join(items[0][1]).upper().replace(" ", ", ")))
    bench = spark.createDataFrame([*((i, " ".join(w)) for i, w in items), (50, None), (51, ""), (52, "three word item"), (0, " ".join(items[0][1]))], "item_id long, text string")
    return docs_of([*rows, (600, "this has the three word item in it")]), bench


@pytest.mark.parametrize("options", [{"least_words": 1}, {"least_words": 1, "block_bytes": 400}])
def test_finds_verbatim_and_reordered(tables, options):
    docs, bench = tables
    got = contaminated(docs, bench, **options).collect()
    assert {r.doc_id for r in got} == {*range(200, 210), *range(300, 310), 500, 600}
    assert all(r.n_tiles == 2 for r in got if 300 <= r.doc_id < 310)
    clean = decontaminate(docs, bench, **options)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 22


def test_short_items_take_nothing_unless_asked(tables):
    docs, bench = tables
    assert 600 not in {r.doc_id for r in contaminated(docs, bench).collect()}


def plain_tiles(item, doc, least):
    """The longest common run of unmarked words, first in the item, then in the document, again and again."""
    marked_i, marked_d, tiles = set(), set(), []
    while True:
        best = None
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and a + n not in marked_i and b + n not in marked_d:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = n, a, b
        if best is None:
            return tiles
        n, a, b = best
        marked_i.update(range(a, a + n))
        marked_d.update(range(b, b + n))
        tiles.append((a, b, n))


def test_result_columns_by_brute_force(spark, docs_of):
    rng = random.Random(11)
    word = lambda: rng.choice("abcdef") * rng.randint(1, 2)
    items = [(i, [word() for _ in range(rng.randint(5, 16))]) for i in range(12)]
    docs = [(i, [word() for _ in range(30)] + rng.choice(items)[1][: rng.randint(4, 16)] + [word() for _ in range(5)] + rng.choice(items)[1]) for i in range(25)]
    want = []
    for i, d in docs:
        for k, w in items:
            tiles = plain_tiles(w, d, 5)
            coverage = sum(t[2] for t in tiles) / len(w)
            if coverage >= 0.6:
                want.append((i, k, round(coverage, 9), len(w), len(tiles), min(t[1] for t in tiles)))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = [(r.doc_id, r.item_id, round(r.coverage, 9), r.item_words, r.n_tiles, r.first_word) for r in contaminated(docs_of([(i, " ".join(d)) for i, d in docs]), bench).collect()]
    assert sorted(got) == sorted(want) and want


def test_empty(tables, docs_of, spark):
    docs, bench = tables
    assert contaminated(docs_of([]), bench).count() == 0
    assert contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
