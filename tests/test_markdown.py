import pytest

from quillgraph.functions import markdown as md
from quillgraph.functions import text
from quillgraph.functions.chunks import chunk_texts, spans_of


@pytest.fixture(scope="module")
def apply(spark):
    from pyspark.sql import functions as F

    def run(f, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
        return [r[0] for r in df.orderBy("i").select(f(F.col("c"))).collect()]

    return run


def test_strip(apply):
    pairs = [
        ("# Title\n\ntext", "Title\n\ntext"),
        ("a **bold** and *soft* and __under__", "a bold and soft and under"),
        ("see [text](http://x.y) now", "see text now"),
        ("[[note]] and [[note|shown]]", "note and shown"),
        ("before\n```go\ncode\n```\nafter", "before\n\nafter"),
        ("a `code` b", "a  b"),
        ("<!-- gone -->kept", "kept"),
        ("> quoted\n\n---\n\nend", "quoted\n\nend"),
        ("![alt](img.png)", "!alt"),
        ("snake_case_name", "snakecasename"),
        ("a\n\n\n\nb", "a\n\nb"),
        ("", ""),
        (None, None),
    ]
    assert apply(md.strip_markdown, *(p[0] for p in pairs)) == [p[1] for p in pairs]


def test_front_matter(apply):
    docs = ["---\ntags: [a, b ,\"c\"]\n---\nbody", "---\ntags:\n  - x\n\n  - y\nother: z\n---\nb", "---\ntags: one\n---\n", "---\ntitle: t\n---\nq", "no front", "---\nnever closed", "---\ntags:\n---\nq"]
    assert apply(md.tags_of, *docs) == [["a", "b", '"c"'], ["x", "y"], ["one"], [], [], [], []]
    assert apply(md.body_of, *docs)[:5] == ["body", "b", "", "q", "no front"]
    assert apply(md.body_of, docs[5]) == [docs[5]]


def test_title_and_date(apply, spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("x/my-note_file.md", "# The Title  \ntext"), ("x/my-note_fILE.md", "no heading"), ("a.b.md", "## second")], "p string, c string")
    assert [r[0] for r in df.select(md.title_of(F.col("c"), F.col("p"))).collect()] == ["The Title", "My Note FILE", "A.b"]
    assert apply(md.last_verified, "<!-- last-verified: 2026-01-02 -->", "<!-- last-verified: 2026-01-02 | by x -->", "") == ["2026-01-02", "", ""]


def test_links(apply):
    doc = "[[one]] [[two|alias]] [[ one ]] [a](sub/x.md#part) [b](https://x.y/z) [c](/abs) [d](word) [e](../up.md)\n```\n[[code]]\n```\n`[[inline]]`"
    assert apply(md.links_of, doc, "") == [["one", "two", "sub/x.md", "../up.md"], []]


def test_paths(spark):
    from pyspark.sql import functions as F

    cases = [("a/b.md", "c.md", "a/c.md"), ("a/b.md", "../c.md", "c.md"), ("b.md", "../../c.md", "../../c.md"), ("a/b/c.md", "./d//e.md", "a/b/d/e.md"), ("a/b.md", "..", ".."), ("b.md", "./x/../y", "y")]
    df = spark.createDataFrame(cases, "p string, l string, w string")
    assert [r[0] for r in df.select(text.resolved_link(F.col("p"), F.col("l"))).collect()] == [c[2] for c in cases]
    ns = {"team": ["work"], "deep": ["work/deep"], "all": ["docs/"]}
    df = spark.createDataFrame([("work/a.md",), ("work/deep/b.md",), ("workshop/c.md",), ("docs/d.md",)], "p string")
    assert [r[0] for r in df.select(text.namespace_of(F.col("p"), ns, "none")).collect()] == ["team", "deep", "none", "all"]


def test_bytes(apply):
    long = "é" * 1500
    cut = apply(lambda c: text.first_bytes(c, 2000), long, "é" * 999 + "ab", "x" * 2001, "aé" + "é" * 1000, None)
    assert cut[0] == "é" * 1000 and cut[1] == "é" * 999 + "ab" and cut[2] == "x" * 2000 and cut[3] == "a" + "é" * 999 and cut[4] is None
    assert apply(text.token_estimate, "", "abcd", "abcde", "é") == [0, 1, 2, 1]
    assert apply(text.topic_tokens, "The WITH quick été né Straße x9yzz") == [["quick", "été", "straße"]]
    assert apply(text.search_tokens, "Café naïve_x ß 9") == [["cafe", "naive", "x", "ß", "9"]]


def test_chunks():
    assert spans_of([280] * 3) == [(0, 3), (2, 3)] and chunk_texts(" \n ") == [] and chunk_texts(None) == []
    units = [f"Sentence number {i} " + "word " * 30 + "." for i in range(60)]
    found = chunk_texts(" ".join(units))
    assert all(any(u.strip() in c for c in found) for u in units)
    assert all((len(c.encode()) + 3) // 4 <= 512 for c in found)
    assert len(chunk_texts("x" * 5000)) == 1  # a unit too long stays whole
    assert spans_of([800] * 10) == [(0, 2), *((i, i + 2) for i in range(1, 9)), (9, 10)]


def test_chunks_leave_a_worker_in_small_batches():
    import pyarrow as pa

    from quillgraph.functions import chunks

    texts = [" ".join(f"Sentence {i} of text {j}." for i in range(4000)) for j in range(60)] + [None, ""]
    batch = pa.record_batch({"path": [f"p{j}" for j in range(62)], "namespace": ["n"] * 62, "text": texts})
    out = list(chunks._rows(iter([batch])))
    got = [r for b in out for r in b.to_pylist()]
    assert [(r["path"], r["chunk_index"], r["content"]) for r in got] == [(f"p{j}", i, c) for j, t in enumerate(texts) for i, c in enumerate(chunk_texts(t))]
    assert max(b.nbytes for b in out) < 2 * 2**20
