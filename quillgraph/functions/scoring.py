"""Score columns; query terms and weights are literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph import model


def cosine(vector: Column, query: list[float] | tuple[float, ...]) -> Column:
    """Over doubles; 0 for other lengths, empty vectors and zero norms."""
    other = F.array(*(F.lit(float(x)) for x in query)) if query else F.expr("cast(array() as array<double>)")
    own = vector.cast("array<double>")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
    dot = total(F.zip_with(own, other, lambda a, b: a * b))
    norms = F.sqrt(total(F.transform(own, lambda x: x * x))) * float(sum(x * x for x in query) ** 0.5)
    return F.when((F.size(own) == len(query)) & (norms > 0), dot / norms).otherwise(F.lit(0.0))


def filename_score(path: Column, terms: list[str]) -> Column:
    """For each term (repeats count) that the lower-cased path contains."""
    low = F.lower(path)
    return sum((F.when(low.contains(t), F.lit(model.FILENAME_HIT)).otherwise(0.0) for t in terms), F.lit(0.0))


def tag_score(tags: Column, terms: list[str]) -> Column:
    """For each term that equals a lower-cased tag."""
    low = F.transform(F.coalesce(tags, F.expr("cast(array() as array<string>)")), F.lower)
    return sum((F.when(F.array_contains(low, t), F.lit(model.TAG_HIT)).otherwise(0.0) for t in terms), F.lit(0.0))


def blend(bm25: Column, vector: Column, filename: Column, tag: Column, graph: Column) -> Column:
    text = model.FILENAME_WEIGHT * filename + model.BM25_WEIGHT * bm25 + model.GRAPH_WEIGHT * graph + tag
    return F.when(vector > 0, model.VECTOR_WEIGHT * vector + model.TEXT_WEIGHT * text).otherwise(text)


def reason(bm25: Column, vector: Column, filename: Column, tag: Column, graph: Column, score: Column) -> Column:
    parts = [("vec", "%.2f", vector), ("filename", "%.0f", filename), ("bm25", "%.2f", bm25), ("tag", "%.0f", tag), ("graph", "%.1f", graph)]
    said = F.concat_ws(" ", *(F.when(c > 0, F.format_string(f"{name}:{form}", c)) for name, form, c in parts))
    return F.when(said != "", said).otherwise(F.format_string("score:%.4f", score))


def confidence(similarity: Column) -> Column:
    return F.when(similarity >= 0.8, "MATCH").when(similarity >= 0.5, "SIMILAR").otherwise("RELATED")
