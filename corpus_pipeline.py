"""From documents to token files: language, near duplicates, benchmark passages, mix, ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import language_id, ngram_jaccard, source_mixing, string_tiling, wavelet_tokens
from quillgraph.llm.common import stored


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null and empty texts, texts without letters, and texts of whose
    n-grams no language explains a seventh. Each row is judged by itself; without labelled rows all go."""
    learn, _ = language_id.held_out_split(docs)
    return language_id.keep_languages(docs, language_id.fit_languages(learn))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8) stays: the smallest doc_id, null first. Of rows
    that agree in id and text one stays; texts without words stand for themselves."""
    return ngram_jaccard.first_of_groups(docs, size=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item go. Null and empty texts stay; items of fewer than five words, null or empty
    items take nothing; an empty benchmark leaves all rows."""
    return string_tiling.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, kept or left out so that sources reach their targets. Null is a source of its own; texts
    without words stay once; rows that agree in id and text get the same number of copies."""
    return source_mixing.repeat_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; a row of their index for every document: doc_id, start, n_tokens, ids_crc32. Null and empty texts are
    their end id alone; null ids come first, copies one after another."""
    return wavelet_tokens.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("token output", token_stage),
]

#: SQL can't express the learned, iterated and encoded stages. tests/llm/test_pipeline.py holds the near-duplicate
#: stage against a plain version and runs all stages on odd rows; what language, decontamination, mixing and tokens
#: decide is tested by operator against plain versions, not in the chain. A table with no rows stays one in every stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table documents to the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs)
    return docs
