"""Topic clusters: by TF-IDF terms, by tags, by k-means over first-chunk vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import counted, let, topic_tokens

MISC = "misc"


def document_band(n: int) -> tuple[int, int]:
    """Least and most documents of a useful term: 2, and two fifths of all."""
    return 2, max(2, int(0.4 * n))


def topic_terms(notes: DataFrame, k: int) -> DataFrame:
    """(term, score, place): the k terms with the highest TF-IDF in any note, within the document band."""
    rows, n, _ = _tokens(notes)
    return _best_terms(rows, n, k).drop("idf")


def _tokens(notes: DataFrame) -> tuple[DataFrame, int, bool]:
    """(path, tokens, size) of each path, the number of notes, and whether each has a path of its own. Where not, the rows
    of a path are put together."""
    row = notes.agg(F.count("*"), F.count_distinct("path")).first()
    rows, alone = notes.select("path", topic_tokens(F.col("body")).alias("tokens")), row[0] == row[1]
    if alone:
        return rows.select("path", "tokens", F.size("tokens").alias("size")), row[0], alone
    merged = rows.groupBy("path").agg(F.flatten(F.collect_list("tokens")).alias("tokens"), F.first(F.when(F.size("tokens") > 0, F.size("tokens")), ignorenulls=True).alias("size"))
    return merged, row[0], alone


def _best_terms(rows: DataFrame, n: int, k: int) -> DataFrame:
    """(term, score, idf, place). A term's weight is the same in all notes, so its largest share of a note makes its
    score: what moves is a row for each term and task."""
    low, high = document_band(n)
    each = rows.select("size", F.explode(counted(F.col("tokens"))).alias("t")).select("t.term", (F.col("t.n") / F.col("size")).alias("tf"))
    terms = each.groupBy("term").agg(F.count("*").alias("df"), F.max("tf").alias("tf")).filter(F.col("df").between(low, high))
    scored = terms.withColumn("idf", F.log(F.lit(n) / F.col("df")) + 1).select("term", (F.col("tf") * F.col("idf")).alias("score"), "idf")
    best = scored.orderBy(F.desc("score"), "term").limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "term")))  # k rows


def content_clusters(notes: DataFrame, k: int = 5) -> DataFrame:
    """(label, path): each note goes to the topic term with its highest TF-IDF, the rest to misc."""
    rows, n, alone = _tokens(notes)
    terms = _best_terms(rows, n, k).collect()  # k rows
    label = F.lit(None).cast("string")
    if terms:

        def scored(t: Row, few: Column, size: Column) -> Column:
            tf = F.try_divide(F.size(F.filter(few, lambda w: w == t["term"])), size)
            return F.struct((tf * F.lit(t["idf"])).alias("tfidf"), F.lit(-t["place"]).alias("place"), F.lit(t["term"]).alias("term"))

        def best(few: Column, size: Column) -> Column:
            return F.array_max(F.filter(F.array(*(scored(t, few, size) for t in terms)), lambda s: s["tfidf"] > 0))["term"]

        # the row's tokens are worked out once, and only the k terms among them looked at
        some = let(F.col("tokens"), lambda w: F.struct(F.filter(w, lambda x: x.isin([t["term"] for t in terms])).alias("few"), F.size(w).alias("size")))
        size = F.lit(None).cast("int") if alone else F.col("size")
        label = let(some, lambda x: best(x["few"], F.coalesce(size, x["size"])))
    placed = rows.select("path", F.when(F.col("path").isNotNull(), label).alias("label"))
    if not alone:
        placed = notes.select("path").join(placed, "path", "left")
    return placed.select(F.coalesce("label", F.lit(MISC)).alias("label"), "path")


def top_tags(notes: DataFrame, k: int) -> DataFrame:
    """(tag, uses, place): the k most used tags within the document band, or of all where none is."""
    n = notes.count()
    low, high = document_band(n)
    counted = notes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("uses"))
    band = counted.filter(F.col("uses").between(low, high))
    used = counted if band.isEmpty() else band
    best = used.orderBy(F.desc("uses"), "tag").limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("uses"), "tag")))  # k rows


def tag_clusters(notes: DataFrame, k: int = 5) -> DataFrame:
    """(label, path): each note goes to the most used of the top tags that it carries, the rest to misc."""
    each = notes.select("path", F.explode("tags").alias("tag")).join(F.broadcast(top_tags(notes, k)), "tag")
    best = each.groupBy("path").agg(F.min_by("tag", "place").alias("label"))
    return notes.select("path").join(best, "path", "left").select(F.coalesce("label", F.lit(MISC)).alias("label"), "path")


def first_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, embedding) of each note's first chunk."""
    first = chunks.filter("chunk_index = 0").select("chunk_id", "path")
    return vectors.join(first, "chunk_id").select("path", "embedding")


def _assigned(rows: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """(path, embedding, cluster): the centroid of highest cosine, the first of equals. Centroids are k literal
    rows, so a round is one scan."""
    from quillgraph.functions.scoring import cosine

    scores = F.array(*(cosine(F.col("embedding"), c).cast("float") for c in centroids))
    return rows.withColumn("scores", scores).withColumn("cluster", (F.array_position("scores", F.array_max("scores")) - 1).cast("int")).drop("scores")


def vector_clusters(vectors: DataFrame, chunks: DataFrame, k: int = 5, rounds: int = 10) -> DataFrame:
    """(label, path) by k-means on the cosine: the first k notes by path are the first centroids, ten rounds
    of assignment and mean. Raises ValueError with fewer than k notes."""
    rows = first_vectors(vectors, chunks).persist()  # read in every round
    start = rows.orderBy("path").limit(k).collect()  # k rows
    if len(start) < k:
        raise ValueError("fewer notes with vectors than clusters")
    centroids = [[float(x) for x in r["embedding"]] for r in start]
    size = len(centroids[0])
    for round_number in range(rounds):
        placed = _assigned(rows, centroids)
        if round_number == rounds - 1:
            return placed.select(F.concat(F.lit("cluster-"), (F.col("cluster") + 1).cast("string")).alias("label"), "path")
        sums = placed.groupBy("cluster").agg(*(F.avg(F.get("embedding", F.lit(i)).cast("double")).alias(f"c{i}") for i in range(size)))
        for r in sums.collect():  # k rows of means
            centroids[r["cluster"]] = [float(r[f"c{i}"]) for i in range(size)]
    raise AssertionError("rounds must be positive")


def clusters(notes: DataFrame, k: int = 5, vectors: DataFrame | None = None, chunks: DataFrame | None = None, prefix: str = "", namespaces: tuple[str, ...] = ()) -> DataFrame:
    """The first strategy that gives clusters: vectors (if there are any), content, tags."""
    rows = notes.filter(F.col("path").startswith(prefix)) if prefix else notes
    if namespaces:
        rows = rows.filter(F.col("namespace").isin(list(namespaces)))
    if vectors is not None and chunks is not None:
        try:
            return vector_clusters(vectors, chunks.join(rows.select("path"), "path", "left_semi"), k)
        except ValueError:
            pass
    found = content_clusters(rows, k)
    return tag_clusters(rows, k) if found.filter(F.col("label") != MISC).isEmpty() else found
