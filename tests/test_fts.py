import random
import sqlite3

import pytest

from quillgraph.operators import fts

WORDS = ["alpha", "beta", "gamma", "delta", "café", "naïve", "Über", "x1", "snake_case"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 4))), " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(title, body)")
    db.executemany("insert into f(rowid, title, body) values (?, ?, ?)", rows)
    return spark.createDataFrame(rows, "id int, title string, body string").cache(), db


@pytest.mark.parametrize("text", ["alpha", "alpha beta", "alpha AND beta OR gamma", "alpha NOT beta", '"alpha beta"', "alph*", "title: alpha", "body : (alpha OR x1)", "NEAR(alpha beta, 2)", "(alpha OR beta) NOT gamma", "cafe", "alpha + beta", "{title body}: delta", "snake_case", "- title : alpha", "^alpha", "missing"])
def test_like_fts5(corpus, text):
    df, db = corpus
    want = {r[0]: -r[1] for r in db.execute("select rowid, bm25(f) from f where f match ?", (text,))}
    got = {r.id: r.bm25 for r in fts.match(df, text, {"title": "title", "body": "body"}).collect()}
    assert set(got) == set(want)
    for i, score in want.items():
        assert got[i] == pytest.approx(score, abs=1e-9)


@pytest.mark.parametrize("text", ['"unclosed', "AND", "(alpha", "*", "nosuch:alpha", "what is this?", "a-b", "alpha OR", "a,b", "", "title:"])
def test_bad_queries_become_phrases(corpus, text):
    df, db = corpus
    with pytest.raises(fts.MatchError):
        fts.parse(text, ("title", "body"))
    got = {r.id for r in fts.match(df, text, {"title": "title", "body": "body"}).collect()}
    want = {r[0] for r in db.execute("select rowid from f where f match ?", ('"' + text.replace('"', '""') + '"',))}
    assert got == want


def test_index_scores_alike(corpus):
    df, _ = corpus
    index, lengths = fts.postings(df, "id", "body"), fts.sizes(df, "id", "body")
    got = {r.id: r.bm25 for r in fts.score_postings(index, lengths, ["alpha", "beta"], "id").collect()}
    want = {r.id: r.bm25 for r in fts.match(df, "alpha beta", {"body": "body"}).collect()}
    assert got == pytest.approx(want)
    sums = lengths.agg({"size": "avg", "*": "count"}).first()
    stored = fts.TextIndex(index, "id", sums["count(1)"], sums["avg(size)"])
    for text in ("alpha", '"alpha beta" OR gam*', "alpha NOT beta", "NEAR(alpha beta, 2)", "alp* bet*", "nowhere", "...", '"unclosed alpha'):
        got = {r.id: r.bm25 for r in fts.match(df, text, {"body": "body"}, index=stored).collect()}
        assert got == pytest.approx({r.id: r.bm25 for r in fts.match(df, text, {"body": "body"}).collect()}), text


def test_filter_leaves_corpus_numbers(corpus):
    df, _ = corpus
    from pyspark.sql import functions as F

    all_rows = {r.id: r.bm25 for r in fts.match(df, "alpha", {"body": "body"}).collect()}
    some = {r.id: r.bm25 for r in fts.match(df, "alpha", {"body": "body"}, F.col("id") < 20).collect()}
    assert some == {i: s for i, s in all_rows.items() if i < 20}


def test_postings_of_rows_alone_move_nothing(corpus):
    df, _ = corpus
    more = df.select("id", "body").unionByName(df.sparkSession.createDataFrame([(100, None), (101, ""), (102, "b a b b ?! a")], "id int, body string"))
    got, want = fts.postings(more, "id", "body", alone=True), fts.postings(more, "id", "body")
    assert sorted(got.collect()) == sorted(want.collect()) and got.schema.simpleString() == want.schema.simpleString()
    assert {(r.term, r.tf) for r in got.filter("id = 102").collect()} == {("a", 2), ("b", 3)}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
