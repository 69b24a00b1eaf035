import hashlib
import random
import re

from quillgraph.llm import syncmers


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 9))) for _ in range(n))


def split(fingerprint):
    return [fingerprint[i : i + 8] for i in range(0, len(fingerprint), 8)]


def plain_likeness(a, b):
    a, b = split(a), split(b)
    x, y = [h for h in dict.fromkeys(a) if h in b], [h for h in dict.fromkeys(b) if h in a]
    kept = len(set(zip(x, x[1:], strict=False)) & set(zip(y, y[1:], strict=False))) + (len(x) > 0)
    return 2 * kept / (len(set(a)) + len(set(b)))


def test_contract_by_brute_force(docs_of, odd, spark):
    rng = random.Random(5)
    rows = [r for r in odd if r[0] != 4] + [(i, words(rng, i)) for i in range(20, 90)] + [(100, "same text " * 20), (101, "same text " * 20)]
    got = {r.doc_id: r for r in syncmers.fingerprint_edits(docs_of(rows)).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -1))
    for k, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(text) < 10_000:
            assert r.near_edited == plain_likeness(r.fingerprint, r.edited_fingerprint), doc_id
            assert r.near_next == plain_likeness(r.fingerprint, got[order[(k + 1) % len(order)][0]].fingerprint)
        assert re.fullmatch(r"([0-9a-f]{8})+", r.fingerprint) and re.fullmatch(r"([0-9a-f]{8})+", r.edited_fingerprint)
    assert got[100].fingerprint == got[101].fingerprint and got[101].near_next == 1.0
    own = {r.doc_id: r.fingerprint for r in syncmers.fingerprints(docs_of(rows)).collect()}
    assert all(own[i] == r.fingerprint for i, r in got.items())
    long = [r for i, r in got.items() if i and 60 <= i < 90]
    assert sum(r.near_edited for r in long) / len(long) > 0.4 and max(r.near_next for r in long) < 0.2


def test_choice_is_that_of_closed_syncmers(spark, docs_of):
    text = words(random.Random(6), 300)
    found = [(a.at, a.h) for a in syncmers.fingerprints(docs_of([(1, text)])).first().anchors]
    pieces = [p for p in re.findall(r"\S{1,8}", text)]
    df = spark.createDataFrame([(pieces,)], "u array<string>")
    k, s = syncmers.K, syncmers.S
    h = df.selectExpr("transform(u, x -> xxhash64(x)) as h").first().h
    inner = spark.createDataFrame([(i, h[i], h[i + 1]) for i in range(len(h) - 1)], "i int, a long, b long").selectExpr("i", "hash(a, b) as m").orderBy("i").collect()
    m = [r.m for r in inner]
    w = k - s + 1
    chosen = [i for i in range(len(h) - k + 1) if min(m[i : i + w]) in (m[i], m[i + w - 1])]
    assert [a for a, _ in found] == chosen


def test_buckets(docs_of):
    rows = [(i * 3, f"text of number {i} " * 5) for i in range(500)]
    df = docs_of(rows).select("doc_id", "text")
    order = sorted(rows, reverse=True)
    for options in ({}, {"measured": 3}):
        got = {r.doc_id: r.next_text for r in syncmers.with_next(df, ["text"], bucket_rows=40, **options).collect()}
        assert got == {r[0]: order[(k + 1) % len(order)][1] for k, r in enumerate(order)}


def test_empty(docs_of):
    assert syncmers.fingerprint_edits(docs_of([])).count() == 0
    one = syncmers.fingerprint_edits(docs_of([(1, "a b c d e f g h i j")])).first()
    assert one.near_next == 1.0


def test_short_texts_stay_like_their_edits(docs_of):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    rows = [(100 * n + i, " ".join(word() for _ in range(n))) for n in range(3, 61) for i in range(10)]
    text = dict(rows)
    for r in syncmers.fingerprint_edits(docs_of(rows)).collect():
        assert r.near_edited > (0.15 if r.doc_id < 4000 else 0), text[r.doc_id]
        assert r.near_next < 0.2
    c, d = ({x.h for x in r.anchors} for r in syncmers.fingerprints(docs_of([(3, "ab c"), (4, "c ab")])).collect())
    assert len(c) == len(d) == 3 and len(c & d) == 2


def test_repeated_rows_and_order(docs_of, odd):
    rows = [*odd, (9, "x"), (9, "y y"), (None, "z")]
    got = syncmers.fingerprint_edits(docs_of(rows)).collect()
    assert sorted((r.doc_id, r.n_chars) for r in got if r.doc_id is not None) == sorted((i, len(t or "")) for i, t in rows if i is not None)
    assert sum(r.doc_id is None for r in got) == 2 and len({r.fingerprint for r in got if r.doc_id == 4}) == 1
    rng = random.Random(8)
    parts = [words(rng, 60) for _ in range(6)]
    a, b, c = (r.fingerprint for r in syncmers.fingerprints(docs_of([(1, " ".join(parts)), (2, " ".join(parts[::-1])), (3, " ".join(parts[:5]))])).orderBy("doc_id").collect())
    common = 2 * len(set(split(a)) & set(split(b))) / (len(set(split(a))) + len(set(split(b))))
    assert 0 < plain_likeness(a, b) < common < 1 and plain_likeness(a, a) == 1.0 and plain_likeness(a, c) > plain_likeness(a, b)
