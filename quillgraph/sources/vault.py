"""The table `documents` (with `labels` and `embeddings`) seen as notes, chunks, vectors and links.

path lang/source/doc-<id>.md; namespace lang; body the text; tags lang, source and the labels' marks;
links by a fixed rule on ids, one of them dangling now and then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.chunks import chunked

FIRST_INDEXED, NOW = 1_704_067_200, 1_735_689_600


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def path_of(doc_id: Column, lang: Column, source: Column) -> Column:
    return F.concat(F.coalesce(lang, F.lit("")), F.lit("/"), F.coalesce(source, F.lit("")), F.lit("/doc-"), doc_id.cast("string"), F.lit(".md"))


def notes(spark: SparkSession, folder: str, links: bool = False, body: bool = True) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    path = path_of(F.col("doc_id"), F.col("lang"), F.col("source"))
    marks = F.array(F.col("lang"), F.col("source"), F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad"), F.when(F.col("toxic") == 1, "toxic"))
    rows = docs.join(labels, "doc_id", "left")
    if links:
        rows = rows.join(link_lists(docs), "doc_id", "left")
    indexed = F.lit(FIRST_INDEXED) + 3600 * F.col("doc_id")
    none = F.expr("cast(array() as array<string>)")
    return rows.select(
        path.alias("path"),
        F.col("lang").alias("namespace"),
        F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"),
        *([F.col("text").alias("body")] if body else []),
        F.array_compact(marks).alias("tags"),
        (F.coalesce("links_out", none) if links else none).alias("links_out"),
        F.sha2("text", 256).alias("checksum"),
        F.lit("").alias("last_verified"),
        indexed.alias("last_indexed"),
        F.when(F.col("doc_id") % 5 == 0, indexed).alias("consolidated_at"),
    )


def link_lists(docs: DataFrame) -> DataFrame:
    """(doc_id, links_out) of the notes that have links."""
    n = docs.count()
    ids = docs.select("doc_id").filter("doc_id % 10 <> 0")
    to = F.array(F.struct(F.lit(0).alias("pos"), ((7 * F.col("doc_id") + 1) % n).alias("to")), F.struct(F.lit(1).alias("pos"), ((13 * F.col("doc_id") + 5) % n).alias("to")))
    wanted = ids.select("doc_id", F.explode(to).alias("l")).select("doc_id", "l.pos", "l.to")
    named = docs.select(F.col("doc_id").alias("to"), path_of(F.col("doc_id"), F.col("lang"), F.col("source")).alias("dst"))
    found = wanted.join(named, "to").select("doc_id", "pos", "dst")
    missing = ids.filter("doc_id % 11 = 0").select("doc_id", F.lit(2).alias("pos"), F.concat(F.lit("missing/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("dst"))
    lists = found.unionByName(missing).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("l"))
    return lists.select("doc_id", F.transform("l", lambda x: x["dst"]).alias("links_out"))


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return chunked(docs.select(path_of(F.col("doc_id"), F.col("lang"), F.col("source")).alias("path"), F.col("lang").alias("namespace"), "text"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """vec_id v is the vector of document v's first chunk; vectors without a document go."""
    docs = table(spark, folder, "documents").select("doc_id", path_of(F.col("doc_id"), F.col("lang"), F.col("source")).alias("path"))
    found = table(spark, folder, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id"))
    return found.select(F.concat("path", F.lit("#0")).alias("chunk_id"), "embedding")


def query_vector(spark: SparkSession, folder: str, vec_id: int = 0) -> tuple[float, ...]:
    row = table(spark, folder, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return tuple(float(x) for x in row["embedding"])
