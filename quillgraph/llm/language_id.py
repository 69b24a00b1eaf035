"""Language identification by language-bitmask n-gram filters.

Fitting: character n-grams of a bounded sample of labelled rows (`fit_rows` a language, taken by a
hash of the id) are counted by language on the executors, once, into the shared folder. An n-gram belongs to a
language if its rate there is at least `least_rate` and at least `share` of its highest rate in any language; rates
of a language add up to 1, so no more than 1 / `least_rate` n-grams (50,000) belong to it. Each
language has a Bloom filter over its n-grams; the filters are bit-sliced: one array of machine words, one a slot for
every 64 languages, in which bit l of a slot is language l's bit, so the AND of the slots that an n-gram hashes to is
the set of all languages that contain it.

Prediction: for every n-gram of the whole text one such mask; popcounts by language, less what
the language's false positive rate (measured on the finished filter) explains, decide. The score is
the share of the text's n-grams that the best language explains, whatever the number of languages.

Defined results: `und` with score 0 for a null text or one without a letter (\\p{L}); where no
n-gram is known, the language with most fitting rows and score 0; equal counts go to the first
language by code point. Without any labelled row every prediction is `und`. Rows are judged one
by one: repeated rows and ids, nulls and other columns don't matter; a column named like a result gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import arrow_rows, discard, small_batches, stored

LETTER = regex.compile(r"\p{L}")
NOT_LETTERS = regex.compile(r"[^\p{L}]+")
SIZES = (2, 3, 4)


def crc_fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, mod `folds`."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of the texts, runs of non-letters as one blank, with the text's
    number by position; a blank ends each text."""
    parts = [" " + NOT_LETTERS.sub(" ", t.lower()) + " " for t in texts]
    codes = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")
    return codes, np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def _grams(codes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size (hash, text's number) of the n-grams that stay inside a text and have a blank at an
    edge only; a blank is a mark of the word's edge."""
    blank = codes == 32
    with np.errstate(over="ignore"):
        for size in SIZES:
            n = len(codes) - size + 1
            if n <= 0:
                continue
            h = np.full(n, size, np.uint64)
            for i in range(size):
                h = (h ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(31)
            ok = owner[:n] == owner[size - 1 :]
            for i in range(1, size - 1):
                ok &= ~blank[i : i + n]
            ok &= ~(blank[:n] & blank[size - 1 :])
            yield h[ok], owner[:n][ok]


@dataclass
class LanguageFilter:
    """slots[i, w] bit l: slot i of the Bloom filter of language 64 * w + l."""

    languages: list[str]
    rows: list[int]
    slots: np.ndarray
    false_rates: np.ndarray

    HASHES = 4

    @staticmethod
    def _places(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            step = hashes * np.uint64(0xC2B2AE3D27D4EB4F) | np.uint64(1)
            for i in range(LanguageFilter.HASHES):
                x = hashes + np.uint64(i) * step
                yield (x ^ (x >> np.uint64(33))) & np.uint64(size - 1)

    @classmethod
    def over(cls, languages: list[str], rows: list[int], hashes: np.ndarray, masks: np.ndarray, bits_per_gram: int = 16) -> LanguageFilter:
        """masks[i, w] bit l: hashes[i] belongs to language 64 * w + l."""
        most = max([1, *(int(cls._bit(masks, i).sum()) for i in range(len(languages)))])
        size = 1 << max(10, int(bits_per_gram * most - 1).bit_length())
        slots = np.zeros((size, masks.shape[1]), np.uint64)
        for at in cls._places(hashes, size):
            np.bitwise_or.at(slots, at, masks)
        # probes that no n-gram hashes to (random 64-bit numbers) give each filter's rate
        probes = np.random.default_rng(7).integers(0, 2**63, 100_000, np.uint64)
        out = cls(languages, rows, slots, np.zeros(len(languages)))
        found = out.masks(probes)
        out.false_rates = np.array([float(cls._bit(found, i).mean()) for i in range(len(languages))])
        return out

    @staticmethod
    def _bit(masks: np.ndarray, language: int) -> np.ndarray:
        return masks[:, language // 64] >> np.uint64(language % 64) & np.uint64(1)

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full((len(hashes), self.slots.shape[1]), np.uint64(2**64 - 1))
        for at in self._places(hashes, len(self.slots)):
            out &= self.slots[at]
        return out

    def predict(self, texts: list[str | None], chunk_chars: int = 250_000) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        todo = [i for i, t in enumerate(texts) if t and self.languages and LETTER.search(t)]
        while todo:
            part, chars = [], 0
            while todo and (not part or chars + len(texts[todo[-1]]) <= chunk_chars):
                part.append(todo.pop())
                chars += len(texts[part[-1]])
            counts, totals = np.zeros((len(self.languages), len(part))), np.zeros(len(part))
            # a long text goes piece by piece, cut where a word ends
            pieces = [[texts[i] for i in part]] if chars <= chunk_chars else [[p] for p in _pieces(texts[part[0]], chunk_chars)]
            for piece in pieces:
                for hashes, owners in _grams(*_codes(piece)):
                    found = self.masks(hashes)
                    totals += np.bincount(owners, minlength=len(part))
                    for lang in range(len(self.languages)):
                        counts[lang] += np.bincount(owners, self._bit(found, lang), len(part))
            rate = self.false_rates[:, None]
            counts = np.maximum(0, (counts - totals * rate) / (1 - rate))
            best = counts.argmax(axis=0)
            for k, i in enumerate(part):
                known = counts[best[k], k]
                names[i] = self.languages[best[k] if known else int(np.argmax(self.rows))]
                scores[i] = min(1.0, known / totals[k]) if known else 0.0
        return names, scores


def _pieces(text: str, size: int) -> Iterator[str]:
    """A text in pieces of about `size` characters, each cut before a character that is no letter."""
    at = 0
    while at < len(text):
        m = NOT_LETTERS.search(text, at + size)
        to = m.start() if m and m.start() > at else len(text)
        yield text[at:to]
        at = to


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        texts = batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            for at in range(0, len(own), 100):
                found = [h for h, _ in _grams(*_codes(own[at : at + 100]))]
                hashes, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hashes)), pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def fit_languages(labelled: DataFrame, fit_rows: int = 2_000, least_rate: float = 2e-5, share: float = 0.2) -> LanguageFilter:
    """From labelled (doc_id, text, lang). The sample is bounded by `fit_rows` a language, the filter by
    1 / `least_rate` n-grams a language; the driver holds one mask of each n-gram."""
    small_batches(labelled.sparkSession)
    rows = labelled.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null and text != ''")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes, key=lambda x: x.encode("utf-8"))
    words = max(1, -(-len(languages) // 64))
    if not languages:
        return LanguageFilter([], [], np.zeros((1024, words), np.uint64), np.zeros(0))

    def by_language(values: dict[str, float | int]) -> Column:
        return F.element_at(F.create_map(*(F.lit(v) for pair in values.items() for v in pair)), F.col("lang"))

    # a hash of the id under a threshold: in expectation fit_rows of each language
    unit = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(2**32))
    limit = by_language({k: int(2**32 * min(1.0, fit_rows / n)) for k, n in sizes.items()})
    counted = rows.filter(unit < limit).select("text", "lang").mapInArrow(arrow_rows(_count_grams), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = stored(counted)
    totals = {r["lang"]: float(r["n"]) for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    rates = counted.select("gram", by_language({k: i for i, k in enumerate(languages)}).alias("number"), (F.col("n") / by_language(totals)).alias("rate")) if totals else counted.select("gram", F.lit(0).alias("number"), F.lit(0.0).alias("rate"))
    rates = rates.filter(F.col("rate") >= least_rate).groupBy("gram").agg(F.max("rate").alias("most"), F.collect_list(F.struct("number", "rate")).alias("own"))
    belongs = F.transform(F.filter("own", lambda x: x["rate"] >= share * F.col("most")), lambda x: x["number"])

    def word(w: int) -> Column:
        bits = F.filter(belongs, lambda x: F.floor(x / 64) == w)
        return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))))

    masks = F.array(*map(word, range(words)))
    found = rates.select("gram", masks.alias("masks")).orderBy("gram").toPandas()
    discard(counted)
    packed = np.array(found["masks"].tolist(), np.int64).reshape(len(found), words).view(np.uint64)
    return LanguageFilter.over(languages, [sizes[x] for x in languages], found["gram"].to_numpy(np.int64).view(np.uint64), packed)


def identify_languages(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """All columns of `docs` with lang_pred and score; only the text is looked at."""
    small_batches(docs.sparkSession)
    carried = docs.sparkSession.sparkContext.broadcast(model)  # bounded by languages and most_grams
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = carried.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], [*batch.schema.names, "lang_pred", "score"])

    fields = [f for f in docs.schema.fields if f.name in kept]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*kept).mapInArrow(arrow_rows(rows), schema)


def keep_languages(docs: DataFrame, model: LanguageFilter, least_score: float = 0.15) -> DataFrame:
    """The rows of `docs`, with all their columns, of whose n-grams a language explains `least_score` or more."""
    small_batches(docs.sparkSession)
    carried = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = carried.value.predict(batch.column("text").to_pylist())
            yield batch.filter(pa.array([n != "und" and bool(s >= least_score) for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(arrow_rows(rows), docs.schema)


def held_out_split(docs: DataFrame) -> tuple[DataFrame, Column]:
    """The rows a model may learn from, and the column that marks the others."""
    held = F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(False))
    return docs.filter(~held), held
