import pytest

from quillgraph import cli, config, report
from quillgraph.sources.embedders import HashEmbedder, chosen
from quillgraph.sources.markdown import excluded, markdown_files, read_markdown
from quillgraph.sources.store import Store


@pytest.fixture
def vault(tmp_path):
    files = {"note1.md": "---\ntags: [a]\n---\n# One\ngolang [[sub/two.md]]", "note2.md": "text", "sub/sub-note.md": "see [x](../note1.md)", "_hidden/.x.md": "odd names count", "ignore.txt": "no", "drafts/draft.md": "draft"}
    for name, content in files.items():
        (tmp_path / "v" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "v" / name).write_text(content)
    return tmp_path / "v"


def test_listing(vault):
    assert markdown_files(str(vault), ["drafts/"]) == ["note1.md", "note2.md", "_hidden/.x.md", "sub/sub-note.md"] or set(markdown_files(str(vault), ["drafts/"])) == {"note1.md", "note2.md", "_hidden/.x.md", "sub/sub-note.md"}
    (vault / ".quillgraphignore").write_text("# comment\n\nsub\n")
    assert set(markdown_files(str(vault), ["drafts"])) == {"note1.md", "note2.md", "_hidden/.x.md"}
    assert excluded("a/b/c.pdf", ["*.pdf"]) and not excluded("a/b.md", ["a*d"]) and excluded("a/b.md", ["a/*"])


def test_incremental(spark, vault, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index")
    run = lambda now: store.index(*_swap(read_markdown(spark, str(vault), ["drafts"], {"s": ["sub"]}, "", now)))

    def _swap(x):
        return x[0], HashEmbedder(8), x[1]

    done = run(1)
    assert (done.updated, done.total, done.removed) == (4, 4, 0)
    rows = {r.path: r for r in store.read("notes").collect()}
    assert rows["note1.md"].title == "One" and rows["note1.md"].tags == ["a"] and rows["sub/sub-note.md"].links_out == ["note1.md"] and rows["sub/sub-note.md"].namespace == "s"
    assert store.mark(["note1.md", "nowhere.md"], 77) == 1
    assert run(2).updated == 0
    (vault / "note1.md").write_text("# Changed")
    (vault / "note2.md").unlink()
    done = run(3)
    assert (done.updated, done.total, done.removed) == (1, 3, 1)
    rows = {r.path: r for r in store.read("notes").collect()}
    assert set(rows) == {"note1.md", "sub/sub-note.md", "_hidden/.x.md"}
    assert rows["note1.md"].title == "Changed" and rows["note1.md"].consolidated_at == 77 and rows["note1.md"].last_indexed == 3 and rows["sub/sub-note.md"].last_indexed == 1
    ids = {r.chunk_id for r in store.read("chunks").collect()}
    assert ids == {r.chunk_id for r in store.read("vectors").collect()} and len(ids) == 3
    assert store.mark(["note1.md"], None) == 1 and store.read("notes").filter("consolidated_at is not null").count() == 0
    store.delete(["note1.md", "nowhere.md"])
    assert store.stats()["files"] == 2 and store.stats()["bytes"] > 0


def test_segments_hold_what_one_index_would(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillgraph.operators import search
    from quillgraph.sources import vault as columns

    first = columns.notes(spark, "/root/testdata/sf0.001").withColumn("full_body", F.col("body"))
    store, fresh = Store(spark, f"file://{tmp_path}/many", most_segments=3), Store(spark, f"file://{tmp_path}/one")
    store.index(first)
    before = store.manifest()
    for i in range(4):
        own = F.col("last_indexed") % 5 == i
        first = first.withColumns({c: F.when(own, F.concat(F.lit(f"edit {i} "), c)).otherwise(F.col(c)) for c in ("body", "full_body", "checksum")}).filter(f"last_indexed % 7 <> {i} or last_indexed % 3 > 0")
        store.index(first)
        if not i:
            with pytest.raises(RuntimeError):
                store._publish(before)
    assert len(store.manifest().segments) <= 3
    fresh.index(first)
    for name in ("notes", "chunks", "postings", "sizes"):
        drop = [c for c in ("last_indexed", "consolidated_at") if c in store.read(name).columns]
        got, want = (sorted(map(str, s.read(name).drop(*drop).collect())) for s in (store, fresh))
        assert got == want, name
    assert (store.manifest().chunks, store.manifest().tokens) == (fresh.manifest().chunks, fresh.manifest().tokens) == (fresh.read("sizes").count(), fresh.read("sizes").agg(F.sum("size")).first()[0])
    for text in ("license", '"mit license"', "licens* NOT mit", "edit 2"):
        plain = search.chunk_candidates(fresh.read("chunks"), fresh.read("notes"), text).collect()
        assert [r.chunk_id for r in search.chunk_candidates(store.read("chunks"), store.read("notes"), text, index=store.text_index()).collect()] == [r.chunk_id for r in plain], text
    store.vacuum()
    assert store.read("chunks").count() == fresh.read("chunks").count() and store.index(first).updated == 0


def test_stream(spark, vault, tmp_path):
    from quillgraph.streaming.ingest import markdown_stream, stream_into

    store = Store(spark, f"file://{tmp_path}/index")
    go = lambda: stream_into(markdown_stream(spark, f"file://{vault}"), store, f"file://{tmp_path}/check").awaitTermination(120)
    go()
    assert {"note1.md", "sub/sub-note.md"} <= {r.path for r in store.paths().collect()}
    (vault / "new.md").write_text("# New")
    go()
    assert "new.md" in {r.path for r in store.paths().collect()}


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "x"))
    with pytest.raises(config.ConfigError):
        config.find_root(str(tmp_path))
    config.scaffold(str(tmp_path / "w"))
    with pytest.raises(FileExistsError):
        config.scaffold(str(tmp_path / "w"))
    (tmp_path / "w/a/b").mkdir(parents=True)
    assert config.find_root(str(tmp_path / "w/a/b")) == str(tmp_path / "w")
    (tmp_path / "x/quillgraph").mkdir(parents=True)
    (tmp_path / "x/quillgraph/config.toml").write_text('top_n = 9\nexclude = ["tmp"]\n[contexts.home]\nroot = "h"\n')
    (tmp_path / "w/.quillgraph/config.toml").write_text('format = "json"\nexclude = ["tmp", "old"]\n[contexts.work]\nroot = "w/"\n[namespaces]\nteam = ["t"]\n')
    c = config.load(str(tmp_path / "w")).config
    assert (c.top_n, c.format, c.exclude[-2:], c.contexts, c.namespaces) == (9, "json", ("tmp", "old"), {"home": "h", "work": "w/"}, {"team": ["t"]})
    assert config.context_prefix(config.load(str(tmp_path / "w")), "work") == "w"
    (tmp_path / "w/.quillgraph/config.toml").write_text("not toml [")
    assert config.load_or_default(str(tmp_path / "w")).config == config.Config()
    assert cli.seconds_of("2026-01-02") == 1767312000 and cli.seconds_of("soon") is None


def test_reports():
    rows = [{"path": "p" * 60, "score": 1.5, "tags": ["a", "b"], "reason": "bm25:1.00", "title": "t", "last_verified": ""}]
    assert "..." + "p" * 47 in report.table(rows) and "1.5000" in report.table(rows)
    assert '"Path"' in report.results_json(rows) and report.paths(rows) == "p" * 60
    assert chosen("google", "") is None and chosen("google", "k").dimensions == 768 and chosen("", "k").dimensions == 1536
