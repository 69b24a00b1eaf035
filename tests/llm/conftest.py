import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) or (doc_id, text, lang, source) rows, with columns that clash with
    names used inside."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("node", "score", "size", "hi", "n", "bucket", "row", "text_", "lost", "copies"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (4, "word"), (None, "a text without an id, of more than forty code points"), (5, "é" * 300), (6, "x" * 200_000), (7, "long words " * 30_000)]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
