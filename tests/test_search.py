import pytest

from quillgraph.functions.chunks import chunked
from quillgraph.model import NOTES, SearchOptions
from quillgraph.operators import cluster, graph, search

ROWS = [
    ("en/go.md", "en", "Go Guide", "golang concurrency with channels and routines", ["lang", "Go"], ["en/py.md", "missing.md"], 100, None),
    ("en/py.md", "en", "Python", "python scripts and golang mentions", ["lang"], ["en/go.md", "en/go.md"], 200, 5),
    ("en/golang-notes.md", "en", "Notes", "golang golang notes", [], [], 300, None),
    ("fr/cuisine.md", "fr", "Cuisine", "recettes de cuisine", ["food"], ["en/go.md"], 400, None),
    ("fr/lonely.md", "fr", "Lonely", "nothing in here", None, None, 500, None),
]


@pytest.fixture(scope="module")
def vault(spark):
    notes = spark.createDataFrame([(p, ns, t, b, tags, links, "abc", "2026-01-01", at, mark) for p, ns, t, b, tags, links, at, mark in ROWS], NOTES).cache()
    chunks = chunked(notes.selectExpr("path", "namespace", "body as text")).cache()
    vectors = spark.createDataFrame([(f"{r[0]}#0", [float(i == 0), float(i == 1), 0.5]) for i, r in enumerate(ROWS)] + [("orphan#0", [1.0, 0.0, 0.5])], "chunk_id string, embedding array<float>")
    return notes, chunks, vectors


def paths(df):
    return [r.path for r in df.collect()]


def test_signals(vault):
    notes, chunks, _ = vault
    rows = search.search(notes, chunks, "golang").collect()
    assert {r.path for r in rows} == {"en/go.md", "en/py.md", "en/golang-notes.md"} and rows[0].path == "en/golang-notes.md"
    assert "filename:3" in rows[0].reason
    by = {r.path: r for r in rows}
    assert by["en/go.md"].graph == 1.0 and by["en/py.md"].graph == 0.5  # duplicates count
    assert by["en/go.md"].score == pytest.approx(0.5 * by["en/go.md"].bm25 + 0.1)


def test_tags_limits_and_blank(vault):
    notes, chunks, _ = vault
    assert paths(search.search(notes, chunks, "food")) == ["fr/cuisine.md"]
    assert paths(search.search(notes, chunks, "go"))[0] == "en/go.md"
    assert search.search(notes, chunks, "  ").count() == 0
    assert search.search(notes, chunks, "golang", SearchOptions(top=1)).count() == 1
    for bad in ('"unclosed', "AND OR", "(", "***", "field:value", '""'):
        search.search(notes, chunks, bad).collect()


def test_filters(vault):
    notes, chunks, _ = vault
    found = lambda **o: set(paths(search.search(notes, chunks, "golang", SearchOptions(**o))))
    assert found(prefix="EN/") == {"en/go.md", "en/py.md", "en/golang-notes.md"} and found(prefix="fr") == set()
    assert found(namespaces=("fr",)) == set()
    assert found(after=200) == {"en/py.md", "en/golang-notes.md"} and found(before=200) == {"en/go.md", "en/py.md"}
    assert found(skip_consolidated=True) == {"en/go.md", "en/golang-notes.md"}


def test_hybrid(vault):
    notes, chunks, vectors = vault
    rows = {r.path: r for r in search.search(notes, chunks, "golang", SearchOptions(top=9, query_vector=(1.0, 0.0, 0.5)), vectors).collect()}
    assert rows["en/go.md"].vector == pytest.approx(1.0) and "orphan" not in rows
    assert rows["en/go.md"].reason.startswith("vec:1.00")
    assert search.vector_candidates(vectors, chunks, notes, (1.0, 0.0), SearchOptions()).first().similarity == 0


def test_hops(vault):
    notes, chunks, _ = vault
    rows = {r.path: r for r in search.search(notes, chunks, "recettes", SearchOptions(top=9, hops=2)).collect()}
    assert rows["en/go.md"].bm25 == pytest.approx(0.5) and rows["en/py.md"].bm25 == pytest.approx(0.125)
    assert "missing.md" in rows and rows["missing.md"].title == ""
    assert set(paths(search.search(notes, chunks, "recettes", SearchOptions(hops=2, namespaces=("fr",))))) == {"fr/cuisine.md"}


def test_similar(vault):
    notes, chunks, _ = vault
    rows = search.similar(notes, chunks, "golang").collect()
    assert rows[0].similarity == 1.0 and rows[0].label == "MATCH"
    assert search.similar(notes, chunks, "zzz golang").count() == 3  # the longest word alone


def test_graph(vault):
    notes, _, _ = vault
    assert paths(graph.backlinks(notes, "en/go.md")) == ["en/py.md", "fr/cuisine.md"]
    assert paths(graph.backlinks(notes, "go.md", "substring")) == ["en/py.md", "fr/cuisine.md"]
    assert [r.dst for r in graph.out_links(notes, "en/py.md").collect()] == ["en/go.md", "en/go.md"]
    assert graph.graph_edges(notes).count() == 4 and graph.graph_edges(notes, "fr").count() == 0
    assert graph.neighbourhood(notes, "en/go.md").count() == 5
    status = {r.path: r for r in graph.lint(notes, 500 + 86400, 1).collect()}
    assert status["fr/lonely.md"].orphan and status["fr/cuisine.md"].no_backlink and status["en/go.md"].stale and not status["fr/lonely.md"].stale
    s = graph.lint_summary(graph.lint(notes, 500, 90)).first()
    assert (s.total, s.orphans, s.no_backlinks, s.stale, s.healthy) == (5, 2, 1, 0, 2)


def test_clusters(vault, spark):
    notes, chunks, vectors = vault
    tags = {r.path: r.label for r in cluster.tag_clusters(notes, 1).collect()}
    assert tags["en/go.md"] == tags["en/py.md"] == "lang" and tags["fr/lonely.md"] == "misc"
    content = {r.path: r.label for r in cluster.content_clusters(notes, 2).collect()}
    assert len(content) == 5 and content["fr/lonely.md"] == "misc"
    assert {r.label for r in cluster.vector_clusters(vectors, chunks, 2).collect()} <= {"cluster-1", "cluster-2"}
    with pytest.raises(ValueError):
        cluster.vector_clusters(vectors, chunks, 50)
    assert cluster.clusters(notes, 2, vectors, chunks).count() == 5


def test_topic_terms_like_a_plain_count(spark):
    import math
    from collections import Counter

    texts = {"a": "topic topic other word", "b": "Topic other thing", "c": "thing thing thing thing words", "d": "", "e": None, "f": "lone with this", "g": "other été été", "h": "été", "i": "words"}
    notes = spark.createDataFrame(list(texts.items()), "path string, body string")
    words = {p: [w for w in (t or "").lower().split() if len(w.encode()) >= 4 and w not in ("with", "this")] for p, t in texts.items()}
    df = Counter(w for ws in words.values() for w in set(ws))
    scores = {(p, w): n / len(ws) * (math.log(len(texts) / df[w]) + 1) for p, ws in words.items() for w, n in Counter(ws).items() if 2 <= df[w] <= 3}
    best = sorted({w: max(s for (_, x), s in scores.items() if x == w) for _, w in scores}.items(), key=lambda x: (-x[1], x[0]))
    terms = cluster.topic_terms(notes, 3)
    assert [(r.term, r.place) for r in terms.collect()] == [(w, i + 1) for i, (w, _) in enumerate(best[:3])]
    assert [r.score for r in terms.collect()] == pytest.approx([s for _, s in best[:3]])
    place = {w: i for i, (w, _) in enumerate(best[:3])}
    own = {p: min(((-s, place[w], w) for (q, w), s in scores.items() if q == p and w in place), default=(0, 0, "misc"))[2] for p in texts}
    found = cluster.content_clusters(notes, 3)
    assert {r.path: r.label for r in found.collect()} == own
    # terms are counted inside a row: no note's terms move, and nothing is kept
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan and "Join" not in plan
    # rows of one path are counted together
    twice = notes.unionByName(notes.filter("path = 'c'"))
    assert cluster.content_clusters(twice, 3).count() == 10 and {r.label for r in cluster.content_clusters(twice, 3).filter("path = 'c'").collect()} == {"thing"}
