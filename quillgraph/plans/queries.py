"""The registered queries, each over whole tables, by the names of the operators they show."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import markdown as md
from quillgraph.functions import scoring, text
from quillgraph.model import SearchOptions
from quillgraph.operators import cluster, fts, graph, search
from quillgraph.sources import store, vault

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: What the registered searches look for.
TEXT, PHRASE, BOOLEAN = "license", '"mit license"', 'licens* AND ("public license" OR apache) NOT mit'
TERMS = ["license", "src3", "good"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _rounded(c: str, digits: int = 6) -> F.Column:
    return F.round(F.col(c), digits).alias(c)


# ------------------------------------------------------------------ scans, filters, scalars


@query
def notes_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = vault.notes(spark, d, body=False)
    return rows.select("path", "namespace", "title", F.array_join("tags", ",").alias("tags"), "checksum", "last_indexed", "consolidated_at")


@query
def namespace_list(spark: SparkSession, d: str) -> DataFrame:
    return vault.table(spark, d, "documents").select(F.col("lang").alias("namespace")).distinct().orderBy("namespace")


@query
def stats_count(spark: SparkSession, d: str) -> DataFrame:
    return vault.table(spark, d, "documents").agg(F.count("*").alias("files"))


@query
def prefix_filter(spark: SparkSession, d: str) -> DataFrame:
    return vault.notes(spark, d, body=False).filter(search.prefix_filter(F.col("path"), "EN/src3/")).select("path")


@query
def ns_filter(spark: SparkSession, d: str) -> DataFrame:
    return vault.notes(spark, d, body=False).filter(search.note_filter(SearchOptions(namespaces=("de", "fr")))).select("path", "namespace")


@query
def temporal_filter(spark: SparkSession, d: str) -> DataFrame:
    options = SearchOptions(after=vault.FIRST_INDEXED + 360_000, before=vault.FIRST_INDEXED + 1_800_000, skip_consolidated=True)
    return vault.notes(spark, d, body=False).filter(search.note_filter(options)).select("path", "last_indexed")


@query
def checksum(spark: SparkSession, d: str) -> DataFrame:
    return vault.table(spark, d, "documents").select("doc_id", text.checksum(F.col("text")).alias("checksum"))


@query
def path_group(spark: SparkSession, d: str) -> DataFrame:
    rows = vault.notes(spark, d, body=False).select(text.path_group(F.col("path")).alias("grp"))
    return rows.groupBy("grp").agg(F.count("*").alias("notes"))


@query
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return vault.table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query
def strip_markdown(spark: SparkSession, d: str) -> DataFrame:
    return vault.table(spark, d, "documents").select("doc_id", F.md5(md.strip_markdown(F.col("text"))).alias("plain_md5"))


@query
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Link targets of whole pages, counted."""
    found = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))
    return vault.table(spark, d, "pages").select(F.explode(found).alias("target")).groupBy("target").agg(F.count("*").alias("links"))


@query
def extract_links(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of pages written as Markdown links, and extracted again."""
    as_md = F.regexp_replace("html", r'<a href="/?([^"]*)">([^<]*)</a>', "[$2]($1/index.md)")
    return vault.table(spark, d, "pages").select("page_id", F.array_join(md.links_of(as_md), "|").alias("links"))


@query
def chunk_tokens(spark: SparkSession, d: str) -> DataFrame:
    return vault.chunks(spark, d).select("path", "chunk_index", "token_count", F.md5("content").alias("content_md5"))


@query
def tokenize_df(spark: SparkSession, d: str) -> DataFrame:
    """Document and occurrence counts of every full-text term."""
    index = fts.postings(vault.table(spark, d, "documents"), "doc_id", "text")
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("uses"))


# ------------------------------------------------------------------ retrieval


def _bm25(spark: SparkSession, d: str, what: str) -> DataFrame:
    rows = vault.notes(spark, d)
    return fts.match(rows.select("path", "title", "body"), what, {"title": "title", "body": "body"}).select("path", _rounded("bm25"))


@query
def bm25_notes(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, TEXT)


@query
def bm25_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, PHRASE)


@query
def bm25_boolean(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, BOOLEAN)


@query
def bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    """The same score of one term from the inverted index of the texts."""
    docs = vault.table(spark, d, "documents")
    index, lengths = fts.postings(docs, "doc_id", "text"), fts.sizes(docs, "doc_id", "text")
    return fts.score_postings(index, lengths, [TEXT], "doc_id").select("doc_id", _rounded("bm25"))


@query
def bm25_notes_top(spark: SparkSession, d: str) -> DataFrame:
    return search.note_candidates(vault.notes(spark, d), TEXT, SearchOptions(namespaces=("en", "fr"))).select("path", _rounded("bm25"))


@query
def bm25_chunks_topk(spark: SparkSession, d: str) -> DataFrame:
    notes, chunks = vault.notes(spark, d), vault.chunks(spark, d)
    return search.chunk_candidates(chunks, notes, TEXT).select("chunk_id", "path", _rounded("bm25"))


@query
def bm25_rollup(spark: SparkSession, d: str) -> DataFrame:
    notes, chunks = vault.notes(spark, d), vault.chunks(spark, d)
    found = search.fused(chunks, search.chunk_candidates(chunks, notes, TEXT), None)
    return found.select("path", _rounded("bm25", 5))


@query
def filename_score(spark: SparkSession, d: str) -> DataFrame:
    return vault.notes(spark, d, body=False).select("path", scoring.filename_score(F.col("path"), TERMS).alias("score")).filter("score > 0")


@query
def tag_bonus(spark: SparkSession, d: str) -> DataFrame:
    return vault.notes(spark, d, body=False).select("path", scoring.tag_score(F.col("tags"), TERMS).alias("score")).filter("score > 0")


@query
def tag_only(spark: SparkSession, d: str) -> DataFrame:
    """Notes with the tag `toxic` that the text search for it doesn't find."""
    notes = vault.notes(spark, d)
    found = fts.match(notes.select("path", "body"), "stupid", {"body": "body"})
    return search.tag_only(notes, found, ["toxic"]).select("path")


@query
def cosine_all(spark: SparkSession, d: str) -> DataFrame:
    q = vault.query_vector(spark, d)
    return vault.table(spark, d, "embeddings").select("vec_id", F.round(scoring.cosine(F.col("embedding"), q), 6).alias("similarity"))


@query
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    notes, chunks, vectors = vault.notes(spark, d, body=False), vault.chunks(spark, d), vault.vectors(spark, d)
    return search.vector_candidates(vectors, chunks, notes, vault.query_vector(spark, d)).select("chunk_id", _rounded("similarity", 5))


def _signals(rows: DataFrame) -> DataFrame:
    return rows.select("path", "title", _rounded("score", 5), _rounded("bm25", 5), _rounded("vector", 5), "filename", "tag", "graph")


@query
def search_text(spark: SparkSession, d: str) -> DataFrame:
    return _signals(search.search(vault.notes(spark, d, links=True), vault.chunks(spark, d), TEXT, SearchOptions(top=10)))


@query
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    options = SearchOptions(top=15, query_vector=vault.query_vector(spark, d))
    return _signals(search.search(vault.notes(spark, d, links=True), vault.chunks(spark, d), TEXT, options, vault.vectors(spark, d)))


@query
def search_hops(spark: SparkSession, d: str) -> DataFrame:
    options = SearchOptions(top=25, hops=2, namespaces=("en",))
    return _signals(search.search(vault.notes(spark, d, links=True), vault.chunks(spark, d), TEXT, options))


@query
def similar_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = search.similar(vault.notes(spark, d, links=True), vault.chunks(spark, d), TEXT, SearchOptions(top=10))
    return rows.select("path", _rounded("similarity", 5), "label")


# ------------------------------------------------------------------ graph


@query
def edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(vault.notes(spark, d, links=True, body=False)).select("src", "pos", "dst")


def _hub(spark: SparkSession, d: str) -> str:
    """The note of document 8."""
    docs = vault.table(spark, d, "documents").filter("doc_id = 8")
    return docs.select(vault.path_of(F.col("doc_id"), F.col("lang"), F.col("source")).alias("p")).first()["p"]


@query
def out_links(spark: SparkSession, d: str) -> DataFrame:
    return graph.out_links(vault.notes(spark, d, links=True, body=False), _hub(spark, d))


@query
def backlinks_exact(spark: SparkSession, d: str) -> DataFrame:
    return graph.backlinks(vault.notes(spark, d, links=True, body=False), _hub(spark, d))


@query
def backlinks_substring(spark: SparkSession, d: str) -> DataFrame:
    return graph.backlinks(vault.notes(spark, d, links=True, body=False), "src8/doc-8", "substring")


@query
def degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(vault.notes(spark, d, links=True, body=False))


@query
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = graph.graph_nodes(vault.notes(spark, d, links=True, body=False))
    return rows.select("id", "title", F.array_join("tags", ",").alias("tags"), F.col("group").alias("grp"), "namespace", "links")


@query
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_edges(vault.notes(spark, d, links=True, body=False), "en")


def _bfs(spark: SparkSession, d: str, hops: int) -> DataFrame:
    notes = vault.notes(spark, d, links=True)
    found = fts.match(notes.select("path", "body"), PHRASE, {"body": "body"}).select("path", F.col("bm25").alias("base"))
    return graph.expand(notes, found, hops).select("path", _rounded("base"), "graph", "hop")


@query
def bfs_1hop(spark: SparkSession, d: str) -> DataFrame:
    return _bfs(spark, d, 1)


@query
def bfs_2hop(spark: SparkSession, d: str) -> DataFrame:
    return _bfs(spark, d, 2)


@query
def graph_boost(spark: SparkSession, d: str) -> DataFrame:
    """Boosts that the three best of all notes with the phrase give to notes."""
    notes = vault.notes(spark, d, links=True)
    scores = fts.match(notes.select("path", "body"), PHRASE, {"body": "body"}).select("path", "bm25")
    rows = notes.select("path", "links_out").join(scores, "path", "left").withColumn("pre", F.coalesce("bm25", F.lit(0.0)))
    return search.graph_boosts(rows)


@query
def lint_status(spark: SparkSession, d: str) -> DataFrame:
    return graph.lint(vault.notes(spark, d, links=True, body=False), vault.NOW, 345, exclude=("en/src1/",))


@query
def lint_summary(spark: SparkSession, d: str) -> DataFrame:
    return graph.lint_summary(graph.lint(vault.notes(spark, d, links=True, body=False), vault.NOW, 345))


# ------------------------------------------------------------------ changes


@query
def stale_anti(spark: SparkSession, d: str) -> DataFrame:
    """Notes of documents that have no label, as if only labelled ones were visited."""
    notes = vault.notes(spark, d, body=False)
    return store.stale_paths(notes, notes.filter(F.array_contains("tags", "good") | F.array_contains("tags", "bad")))


@query
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """All notes stored, then met by the labelled ones, of which the bad ones have changed."""
    old = vault.notes(spark, d, links=True)
    bad = F.array_contains("tags", "bad")
    new = old.filter(bad | F.array_contains("tags", "good"))
    new = new.withColumns({"checksum": F.when(bad, F.sha2(F.concat(F.lit("x"), "checksum"), 256)).otherwise(F.col("checksum")), "last_indexed": F.lit(vault.NOW).cast("long"), "consolidated_at": F.lit(None).cast("long")})
    return store.merged_notes(old, new).select("path", "checksum", "last_indexed", "consolidated_at")


@query
def mark_consolidated(spark: SparkSession, d: str) -> DataFrame:
    notes = vault.notes(spark, d, body=False)
    toxic = notes.filter(F.array_contains("tags", "toxic")).select("path")
    return store.marked(notes, toxic, vault.NOW).select("path", "consolidated_at")


@query
def unmark_consolidated(spark: SparkSession, d: str) -> DataFrame:
    notes = vault.notes(spark, d, body=False)
    return store.marked(notes, notes.filter(F.array_contains("tags", "good")).select("path"), None).select("path", "consolidated_at")


# ------------------------------------------------------------------ clusters


@query
def tfidf_terms(spark: SparkSession, d: str) -> DataFrame:
    return cluster.topic_terms(vault.notes(spark, d), 20).select("term", _rounded("score"), "place")


@query
def tfidf_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster.content_clusters(vault.notes(spark, d), 5)


@query
def tag_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster.tag_clusters(vault.notes(spark, d, body=False), 5)


@query
def kmeans_assign(spark: SparkSession, d: str) -> DataFrame:
    """Over the table `embeddings`, each vector a note of its own."""
    vectors = vault.table(spark, d, "embeddings").select(F.format_string("v%08d", "vec_id").alias("path"), "embedding")
    chunks = vectors.select("path", F.col("path").alias("chunk_id"), F.lit(0).alias("chunk_index"))
    return cluster.vector_clusters(vectors.select(F.col("path").alias("chunk_id"), "embedding"), chunks, 5)


# ------------------------------------------------------------------ Markdown, over notes written from columns


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, path, content): a Markdown note for each document, whose parts are known from its columns."""
    id_, lang, source = F.col("doc_id").cast("string"), F.col("lang"), F.col("source")
    tags = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("tags: ["), lang, F.lit(", "), source, F.lit("]"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("tags:\n  - "), source, F.lit("\n  - x"), id_)).otherwise(F.lit("other: y"))
    front = F.when(F.col("doc_id") % 4 == 3, F.lit("")).otherwise(F.concat(F.lit("---\n"), tags, F.lit("\n---\n")))
    verified = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<!-- last-verified: 2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit(" -->\n"))).otherwise(F.lit(""))
    heading = F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("# The **"), source, F.lit("** note "), id_, F.lit("\n\n")))
    links = F.concat(F.lit("See [[wiki-"), id_, F.lit("|shown]] and [text](../"), source, F.lit("/b-"), id_, F.lit(".md#part), `[[code]]`, [out](https://x.org/a.md), [[wiki-"), id_, F.lit("]].\n"))
    code = F.lit("```\n[[fenced]]\n```\n> quoted _word_\n\n\n\n![img](i.png)last")
    return vault.table(spark, d, "documents").select("doc_id", F.concat(lang, F.lit("/my-"), source, F.lit("_file"), id_, F.lit(".md")).alias("path"), F.concat(front, verified, heading, links, code).alias("content"))


@query
def markdown_parse(spark: SparkSession, d: str) -> DataFrame:
    """Tags, title (of the heading or the file's name) and mark of verification."""
    content = F.col("content")
    return _markdown(spark, d).select("doc_id", F.array_join(md.tags_of(content), ",").alias("tags"), md.title_of(content, F.col("path")).alias("title"), md.last_verified(content).alias("verified"))


@query
def markdown_links(spark: SparkSession, d: str) -> DataFrame:
    """Links outside code, and resolved from the file that holds them."""
    found = md.links_of(F.col("content"))
    resolved = F.transform(found, lambda x: text.resolved_link(F.col("path"), x))
    return _markdown(spark, d).select("doc_id", F.array_join(found, "|").alias("links"), F.array_join(resolved, "|").alias("resolved"))


@query
def markdown_plain(spark: SparkSession, d: str) -> DataFrame:
    """The body without front matter as plain text, and its first 40 bytes."""
    plain = md.strip_markdown(md.body_of(F.col("content")))
    return _markdown(spark, d).select("doc_id", plain.alias("plain"), text.first_bytes(plain, 40).alias("start"))


# ------------------------------------------------------------------ filtered, malformed and failing searches


@query
def match_malformed(spark: SparkSession, d: str) -> DataFrame:
    """Not a query of the grammar: the whole text is one phrase."""
    return _bm25(spark, d, '(mit "license AND')


@query
def match_columns(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, "title : doc AND body : licens* NOT {title body} : mit")


@query
def match_near(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, "NEAR(general license, 1)")


@query
def search_dated(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose notes were indexed in a time and are open."""
    options = SearchOptions(after=vault.FIRST_INDEXED + 36_000, before=vault.FIRST_INDEXED + 2_520_000, skip_consolidated=True)
    return search.chunk_candidates(vault.chunks(spark, d), vault.notes(spark, d, body=False), TEXT, options).select("chunk_id", "path", _rounded("bm25"))


@query
def vector_filtered(spark: SparkSession, d: str) -> DataFrame:
    options = SearchOptions(prefix="en", after=vault.FIRST_INDEXED + 36_000, skip_consolidated=True, strict_filters=True)
    rows = search.vector_candidates(vault.vectors(spark, d), vault.chunks(spark, d), vault.notes(spark, d, body=False), vault.query_vector(spark, d), options)
    return rows.select("chunk_id", _rounded("similarity", 5))


@query
def search_fallback(spark: SparkSession, d: str) -> DataFrame:
    """No chunk holds the words; titles do."""
    return _signals(search.search(vault.notes(spark, d, links=True), vault.chunks(spark, d), "doc 12", SearchOptions(top=10)))


@query
def similar_threshold(spark: SparkSession, d: str) -> DataFrame:
    rows = search.similar(vault.notes(spark, d, links=True), vault.chunks(spark, d), TEXT, SearchOptions(top=10), threshold=0.9)
    return rows.select("path", _rounded("similarity", 5), "label")


@query
def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbourhood(vault.notes(spark, d, links=True, body=False), _hub(spark, d))


@query
def cluster_chain(spark: SparkSession, d: str) -> DataFrame:
    """Below a directory, without vectors: the terms give clusters."""
    return cluster.clusters(vault.notes(spark, d), 5, prefix="en/")


@query
def namespaces_resolved(spark: SparkSession, d: str) -> DataFrame:
    rules = {"first": ["en/src1", "fr"], "second": ["en", "en/src1/doc-1.md"], "rest": ["."]}
    rows = vault.notes(spark, d, body=False)
    return rows.select("path", text.namespace_of(F.col("path"), rules).alias("ns"), text.title_from_filename(F.col("path")).alias("title"))


@query
def reasons(spark: SparkSession, d: str) -> DataFrame:
    """What a hit's signals are reported as."""
    one = lambda n: (F.col("doc_id") % n).cast("double")
    signals = [one(3) / 4, one(2) / 2, 3 * one(3), 2 * one(2), one(5) / 2]
    score = scoring.blend(*signals)
    return vault.table(spark, d, "documents").select("doc_id", F.round(score, 6).alias("score"), scoring.reason(*signals, score).alias("reason"))


@query
def first_chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = cluster.first_vectors(vault.vectors(spark, d), vault.chunks(spark, d))
    return rows.select("path", F.size("embedding").alias("dimensions"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query
def store_index(spark: SparkSession, d: str) -> DataFrame:
    """Stored, then indexed again: bad notes change, toxic ones are gone. Each note's chunks and its checksum."""
    index = _changed_store(spark, d)
    chunks = index.read("chunks").groupBy("path").agg(F.count("*").alias("chunks"), F.count(F.when(F.col("content").startswith("New. "), 1)).alias("new"))
    return index.read("notes").select("path", "checksum").join(chunks, "path", "left").select("path", "checksum", "chunks", "new")


@query
def store_search(spark: SparkSession, d: str) -> DataFrame:
    """The best chunks of the changed store, by its postings."""
    index = _changed_store(spark, d)
    rows = search.chunk_candidates(index.read("chunks"), index.read("notes"), "public licens*", index=index.text_index())
    return rows.select("chunk_id", "path", _rounded("bm25"))


def _changed_store(spark: SparkSession, d: str) -> store.Store:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    index = store.Store(spark, f"{(root or tempfile.gettempdir() + '/quillgraph-shared').rstrip('/')}/index-{uuid.uuid4().hex}")
    first = vault.notes(spark, d).withColumn("full_body", F.col("body"))
    index.index(first)
    bad, toxic = F.array_contains("tags", "bad"), F.array_contains("tags", "toxic")
    again = first.filter(~toxic).withColumns({c: F.when(bad, F.concat(F.lit("New. "), c)).otherwise(F.col(c)) for c in ("body", "full_body", "checksum")})
    index.index(again)
    return index
