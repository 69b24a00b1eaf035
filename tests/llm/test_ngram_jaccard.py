import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quillgraph.llm.ngram_jaccard import JaccardJoin, first_of_groups, jaccard_components


def brute(rows, size, num, den):
    sets = []
    for _, text in rows:
        w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
        sets.append(grams)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b]:
            common = len(sets[a] & sets[b])
            if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    ids = [-1 if r[0] is None else r[0] for r in rows]
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    back = lambda x: None if x == -1 else x
    return sorted(((r[0], len(s), back(least[find(i)])) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)


@pytest.fixture(scope="module")
def rows(odd):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = [r for r in odd if r[0] != 7]
    passage = [word() for _ in range(50)]
    for i in range(20, 110):  # a passage in half of all, a group of near copies with more and less edits
        out.append((i, " ".join([*(passage if i % 2 else []), *(word() for _ in range(rng.randint(2, 80)))])))
    base = [word() for _ in range(150)]
    for i in range(200, 290):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = word()
        out.append((i, " ".join(copy[: rng.randint(130, 150)])))
    return out + [(400, "Exact copy of few words here"), (401, "exact COPY of few words here"), (402, "two words"), (403, "Two  words")]


@pytest.mark.parametrize("options", [{}, {"block": 6}, {"block": 2, "most_frequent": 10, "broadcast_rows": 3}])
def test_against_brute_force(docs_of, rows, options):
    got = sorted(((r.doc_id, r.n_ngrams, r.component_id) for r in jaccard_components(docs_of(rows), 4, 85, 100, **options).collect()), key=str)
    assert got == brute(rows, 4, 85, 100)


def test_one_of_each_group_stays(docs_of, rows):
    docs = docs_of(rows)
    kept = first_of_groups(docs)
    want = {c for _, _, c in brute(rows, 5, 80, 100)}
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and set(ids) == want and len(ids) == len(want)


def test_columns_with_odd_names_and_a_long_text(docs_of, odd):
    from pyspark.sql import functions as F

    docs = docs_of([*odd, (8, "long words " * 30_000 + "end")]).withColumns({n: F.lit(1) for n in ("a.b", "kept_id", "own_key", "key")})
    kept = first_of_groups(docs)
    # the two long texts have the same few n-grams but one or two; equal short rows are one
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "7", "8", "None"]


def test_copies_with_many_edits_are_not_all_compared(docs_of, monkeypatch):
    """Members of a large group that are too far from all others have few long columns in the second order."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base, rows = [word() for _ in range(200)], []
    for i in range(160):
        copy = list(base)
        for at in rng.sample(range(200), 1 if i % 2 else 5):
            copy[at] = word()
        rows.append((i, " ".join(copy)))
    compared, pairs = [], JaccardJoin._pairs

    def counted(self, left, right, condition, long=False):
        if long:
            met = left.alias("x").join(right.alias("y"), (F.col("x.col") == F.col("y.col")) & condition & (F.col("x.h") >= 14) & (F.col("y.h") >= 14))
            compared.append(met.count())
        return pairs(self, left, right, condition, long)

    monkeypatch.setattr(JaccardJoin, "_pairs", counted)
    got = sorted(((r.doc_id, r.n_ngrams, r.component_id) for r in jaccard_components(docs_of(rows), 4, 85, 100, block=8).collect()), key=str)
    assert got == brute(rows, 4, 85, 100)
    # 1,085 comparisons; in the order of hashes alone 172,495
    assert len({r[2] for r in got}) > 70 and len(compared) == 1 and compared[0] < 5_000


def test_empty(docs_of):
    assert jaccard_components(docs_of([])).count() == 0


def test_components_that_share_a_doc_id_all_stay(docs_of):
    said = lambda w: " ".join(f"{w}{i}" for i in range(30))
    near = said("near") + " end"
    rows = [(None, said("a")), (None, said("b")), (None, said("c")), (None, said("c")), (None, None), (None, "")]
    rows += [(7, said("d")), (7, said("e")), (7, said("e")), (7, " "), (7, " "), (8, said("e")), (8, said("f")), (9, said("near")), (9, near), (10, near), (11, said("f").upper())]
    got = sorted(((r.doc_id, r.text) for r in first_of_groups(docs_of(rows)).collect()), key=str)
    nears = [r for r in got if r[1] in (said("near"), near)]
    assert len(nears) == 1 and nears[0][0] == 9
    want = [(None, said("a")), (None, said("b")), (None, said("c")), (None, None), (None, ""), (7, said("d")), (7, said("e")), (7, " "), (7, " "), (8, said("f"))]
    assert [r for r in got if r not in nears] == sorted(want, key=str)


def test_frequent_columns_reach_the_driver_packed(spark, docs_of):
    import tracemalloc

    join = JaccardJoin(docs_of([(1, "a b c d e f")]), 5, 80, 100)
    counts = spark.range(200_000).select(F.xxhash64("id").alias("col"), F.lit(40).cast("long").alias("df"))
    tracemalloc.start()
    found = join._over(counts, 2_000_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(found.view("int64").tolist()) == sorted(r["col"] for r in counts.collect())
    assert peak < 40 * len(found)


def test_stored_tables_of_some_mb_are_not_broadcast(spark, docs_of):
    from quillgraph.llm.common import stored

    JaccardJoin(docs_of([(1, "a b c d e f")]), 5, 80, 100)
    small = stored(spark.range(500_000).select(F.xxhash64("id").alias("node")))  # 4 MB of files
    large = stored(spark.range(2_000_000).select(F.xxhash64("id").alias("node")))
    joined = large.join(small, "node")
    assert joined.count() == 500_000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan, (spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), plan)
