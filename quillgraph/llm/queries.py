"""The queries opN_<name> and pipeline: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import language_id, license_scan, line_dedup, ngram_jaccard, quality_rules, source_mixing, string_tiling, syncmers, url_filter, wavelet_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), with_text=False)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learn, held = language_id.held_out_split(docs)
    model = language_id.fit_languages(learn)
    rows = language_id.identify_languages(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    learn, held = language_id.held_out_split(labels)
    model = quality_rules.fit_rules(docs, learn)
    return quality_rules.score_quality(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source_mixing.mix_sources(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_edits(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"), with_spans=False)


def op7_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet_tokens.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"), size=4, num=85, den=100)
    return rows.withColumnRenamed("n_ngrams", "n_shingles")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op10_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_language_id, op3_quality_rules, op4_source_mixing, op5_syncmers, op6_license_scan, op7_wavelet_tokens, op8_ngram_jaccard, op9_url_filter, op10_string_tiling)}

_KEYS = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n
  FROM documents),
keyed AS (SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
          GROUP BY key HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::int) >= 5),
marked AS (SELECT k.*, o.keeper IS NOT NULL AND o.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN often o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_JACCARD = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
cells AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM cells a JOIN cells b
          ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (na + nb - c)),
ends AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS root FROM sets UNION SELECT e.b, r.root FROM reach r JOIN ends e ON e.a = r.id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(root) FROM reach WHERE id = doc_id) AS component_id FROM sets
"""

ORACLE_SQL: dict[str, str] = {"op1_line_dedup": _KEYS, "op8_ngram_jaccard": _JACCARD}
