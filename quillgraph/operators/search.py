"""Retrieval over notes, chunks and vectors: text, vector and hybrid candidates, signals, blend.

Only ids and scores move until candidates are cut to their limits; everything after is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph import model
from quillgraph.functions import scoring
from quillgraph.functions.text import query_terms
from quillgraph.model import SearchOptions
from quillgraph.operators import fts, graph


def prefix_filter(path: Column, prefix: str) -> Column:
    """Paths below a directory; ASCII case doesn't matter, trailing slashes neither."""
    folder = prefix.rstrip("/")
    return F.lower(path).startswith(folder.lower() + "/") if folder else F.lit(True)


def time_filter(last_indexed: Column, after: int | None, before: int | None) -> Column:
    out = F.lit(True)
    if after is not None:
        out = out & (last_indexed >= after)
    return out if before is None else out & (last_indexed <= before)


def place_filter(options: SearchOptions) -> Column:
    """On path and namespace."""
    out = prefix_filter(F.col("path"), options.prefix)
    return out & F.col("namespace").isin(list(options.namespaces)) if options.namespaces else out


def note_filter(options: SearchOptions) -> Column:
    out = place_filter(options) & time_filter(F.col("last_indexed"), options.after, options.before)
    return out & F.col("consolidated_at").isNull() if options.skip_consolidated else out


def _needs_notes(options: SearchOptions) -> bool:
    return options.after is not None or options.before is not None or options.skip_consolidated


def _dated(rows: DataFrame, notes: DataFrame, options: SearchOptions) -> DataFrame:
    """Rows whose note passes the time and consolidation filters; no join without such a filter."""
    if not _needs_notes(options):
        return rows
    open_notes = notes.filter(note_filter(SearchOptions(after=options.after, before=options.before, skip_consolidated=options.skip_consolidated)))
    return rows.join(open_notes.select("path"), "path", "left_semi")


def chunk_candidates(chunks: DataFrame, notes: DataFrame, text: str, options: SearchOptions = SearchOptions(), limit: int = model.CANDIDATES, index: fts.TextIndex | None = None) -> DataFrame:
    """(chunk_id, path, bm25) of the best chunks; corpus numbers are those of all chunks."""
    hits = fts.match(chunks.select("chunk_id", "path", "namespace", "content"), text, {"content": "content"}, place_filter(options), index)
    return _dated(hits, notes, options).select("chunk_id", "path", "bm25").orderBy(F.desc("bm25"), "chunk_id").limit(limit)


def note_candidates(notes: DataFrame, text: str, options: SearchOptions = SearchOptions(), limit: int = model.FALLBACK_CANDIDATES) -> DataFrame:
    """(path, bm25) of the best notes over title and body."""
    hits = fts.match(notes.select("path", "namespace", "title", "body", "last_indexed", "consolidated_at"), text, {"title": "title", "body": "body"}, note_filter(options))
    return hits.select("path", "bm25").orderBy(F.desc("bm25"), "path").limit(limit)


def vector_candidates(vectors: DataFrame, chunks: DataFrame, notes: DataFrame, query: tuple[float, ...], options: SearchOptions = SearchOptions(), limit: int = model.CANDIDATES) -> DataFrame:
    """(chunk_id, similarity) of the nearest chunk vectors; chunks are joined only if a filter needs them."""
    scored = vectors.select("chunk_id", scoring.cosine(F.col("embedding"), query).cast("float").alias("similarity"))
    if options.prefix or options.namespaces or options.strict_filters and _needs_notes(options):
        inside = chunks.filter(place_filter(options)).select("chunk_id", "path")
        scored = scored.join(_dated(inside, notes, options) if options.strict_filters else inside, "chunk_id")
    return scored.select("chunk_id", "similarity").orderBy(F.desc("similarity"), "chunk_id").limit(limit)


def fused(chunks: DataFrame, text_side: DataFrame, vector_side: DataFrame | None) -> DataFrame:
    """(path, bm25, vector): text scores over their maximum, both sides blended, weak ones dropped, the
    best of each kept for a path. Vectors without a chunk vanish."""
    # few rows: at most the limits of both sides
    top = Window.partitionBy(F.lit(1))
    text_side = text_side.withColumn("b", (F.col("bm25") / F.max("bm25").over(top)).cast("float"))
    if vector_side is None:
        kept = text_side.withColumn("s", F.lit(0.0).cast("float")).filter(F.col("b") >= F.lit(model.LEAST_SCORE).cast("float"))
        return kept.groupBy("path").agg(F.max("b").cast("double").alias("bm25"), F.max("s").cast("double").alias("vector"))
    both = text_side.select("chunk_id", "b").join(vector_side, "chunk_id", "full").select("chunk_id", F.coalesce("b", F.lit(0.0).cast("float")).alias("b"), F.coalesce("similarity", F.lit(0.0).cast("float")).alias("s"))
    total = F.lit(model.VECTOR_WEIGHT).cast("float") * F.col("s") + F.lit(model.TEXT_WEIGHT).cast("float") * F.col("b")
    kept = both.filter(total >= F.lit(model.LEAST_SCORE).cast("float"))
    placed = chunks.select("chunk_id", "path").join(F.broadcast(kept), "chunk_id")  # at most two candidate limits
    return placed.groupBy("path").agg(F.max("b").cast("double").alias("bm25"), F.max("s").cast("double").alias("vector"))


def kept(few: DataFrame) -> DataFrame:
    """A bounded number of rows (candidates), worked out once."""
    return few.sparkSession.createDataFrame(few.collect(), few.schema)


def tag_only(notes: DataFrame, found: DataFrame, terms: list[str], options: SearchOptions = SearchOptions()) -> DataFrame:
    """Paths with a tag that equals a term, not found before."""
    hit = F.exists("tags", lambda x: F.lower(x).isin(terms)) if terms else F.lit(False)
    keep = note_filter(options) if options.strict_filters else place_filter(options)
    return notes.filter(F.coalesce(hit, F.lit(False)) & keep).select("path").join(found.select("path"), "path", "left_anti")


def graph_boosts(scored: DataFrame, top: int = 3) -> DataFrame:
    """(path, graph): half a point for each link from the `top` rows by bm25 + filename + vector into the
    result (scored: path, links_out, pre)."""
    best = scored.orderBy(F.desc("pre"), "path").limit(top)
    targets = best.select(F.explode(F.coalesce("links_out", F.expr("cast(array() as array<string>)"))).alias("path"))
    counted = targets.groupBy("path").agg((F.count("*") * model.LINK_HIT).alias("graph"))
    return counted.join(scored.select("path"), "path", "left_semi")


def search(notes: DataFrame, chunks: DataFrame, text: str, options: SearchOptions = SearchOptions(), vectors: DataFrame | None = None, index: fts.TextIndex | None = None) -> DataFrame:
    """(path, title, score, tags, last_verified, reason), best first, with the signals that made the score."""
    terms = query_terms(text)
    if not terms:
        empty = "path string, title string, score double, tags array<string>, last_verified string, reason string, bm25 double, vector double, filename double, tag double, graph double"
        return notes.sparkSession.createDataFrame([], empty)
    text_side = kept(chunk_candidates(chunks, notes, text, options, index=index))
    vector_side = None
    if vectors is not None and options.query_vector:
        vector_side = vector_candidates(vectors, chunks, notes, options.query_vector, options)
    found = kept(fused(chunks, text_side, vector_side))
    if found.isEmpty():
        found = note_candidates(notes, text, options).withColumn("vector", F.lit(0.0))
    tagged = tag_only(notes, found, terms, options).select("path", F.lit(0.0).alias("bm25"), F.lit(0.0).alias("vector"))
    rows = found.select("path", "bm25", "vector").unionByName(tagged)
    about = notes.select("path", "title", "tags", "last_verified", "links_out")
    rows = rows.join(about, "path", "left").withColumns({"filename": scoring.filename_score(F.col("path"), terms), "tag": scoring.tag_score(F.col("tags"), terms)})
    rows = rows.withColumn("pre", F.col("bm25") + F.col("filename") + F.col("vector"))
    rows = rows.join(graph_boosts(rows), "path", "left").withColumn("graph", F.coalesce("graph", F.lit(0.0)))
    rows = rows.select("path", "title", "tags", "last_verified", "bm25", "vector", "filename", "tag", "graph")
    if options.hops > 0:
        more = graph.expand(notes, rows.select("path", (F.col("bm25") + F.col("vector")).alias("base")), options.hops, options.namespaces)
        more = more.join(about, "path", "left").select("path", "title", "tags", "last_verified", F.col("base").alias("bm25"), F.lit(0.0).alias("vector"), scoring.filename_score(F.col("path"), terms).alias("filename"), scoring.tag_score(F.col("tags"), terms).alias("tag"), "graph")
        rows = rows.unionByName(more)
    signals = [F.col(c) for c in ("bm25", "vector", "filename", "tag", "graph")]
    scored = rows.withColumn("score", scoring.blend(*signals))
    scored = scored.withColumn("reason", scoring.reason(*signals, F.col("score")))
    out = scored.select("path", F.coalesce("title", F.lit("")).alias("title"), "score", "tags", F.coalesce("last_verified", F.lit("")).alias("last_verified"), "reason", *("bm25", "vector", "filename", "tag", "graph"))
    return out.orderBy(F.desc("score"), "path").limit(options.limit)


def similar(notes: DataFrame, chunks: DataFrame, text: str, options: SearchOptions = SearchOptions(), threshold: float = 0.0, vectors: DataFrame | None = None, index: fts.TextIndex | None = None) -> DataFrame:
    """(path, title, similarity, label): scores over the best one. Without a hit the longest word (by bytes,
    the first of equals) is tried alone."""
    from dataclasses import replace

    wide = replace(options, top=3 * options.limit)
    rows = search(notes, chunks, text, wide, vectors, index)
    if rows.isEmpty() and text.split():
        rows = search(notes, chunks, max(text.split(), key=lambda w: len(w.encode())), wide, vectors, index)
    best = F.max("score").over(Window.partitionBy(F.lit(1)))
    rows = rows.withColumn("similarity", F.when(best > 0, F.col("score") / best).otherwise(F.lit(1.0)))
    rows = rows.filter(F.col("similarity") >= threshold)
    return rows.select("path", "title", "similarity", scoring.confidence(F.col("similarity")).alias("label")).orderBy(F.desc("similarity"), "path").limit(options.limit)
