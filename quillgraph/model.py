"""Schemas and options of the note index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

NOTES = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("namespace", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("links_out", T.ArrayType(T.StringType())),
        T.StructField("checksum", T.StringType()),
        T.StructField("last_verified", T.StringType()),
        T.StructField("last_indexed", T.LongType()),
        T.StructField("consolidated_at", T.LongType()),
    ]
)
CHUNKS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("namespace", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("token_count", T.IntegerType()),
    ]
)
VECTORS = T.StructType([T.StructField("chunk_id", T.StringType(), False), T.StructField("embedding", T.ArrayType(T.FloatType()))])

#: Defaults and weights of ranking.
DEFAULT_TOP = 5
CANDIDATES, FALLBACK_CANDIDATES = 20, 50
VECTOR_WEIGHT, TEXT_WEIGHT, LEAST_SCORE = 0.6, 0.4, 0.1
FILENAME_WEIGHT, BM25_WEIGHT, GRAPH_WEIGHT = 0.4, 0.5, 0.1
FILENAME_HIT, TAG_HIT, LINK_HIT = 3.0, 2.0, 0.5


@dataclass(frozen=True)
class SearchOptions:
    """What `search` may be told. `strict_filters` applies every filter to every source; without
    it time and consolidation filters hold for text sources only."""

    top: int = 0
    prefix: str = ""
    namespaces: tuple[str, ...] = ()
    hops: int = 0
    after: int | None = None
    before: int | None = None
    skip_consolidated: bool = False
    query_vector: tuple[float, ...] | None = None
    strict_filters: bool = False

    @property
    def limit(self) -> int:
        return self.top if self.top > 0 else DEFAULT_TOP
