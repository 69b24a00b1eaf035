import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from quillgraph.llm.language_id import LanguageFilter, fit_languages, held_out_split, identify_languages, keep_languages

WORDS = {"en": "the quick brown fox jumps over lazy dogs while water runs", "de": "schnelle füchse springen über faule hunde während wasser fließt", "fr": "le rapide renard brun saute par dessus les chiens paresseux où l'eau coule"}


@pytest.fixture(scope="module")
def docs(docs_of, odd):
    rows = []
    for i in range(120):
        lang = list(WORDS)[i % 3]
        words = WORDS[lang].split()
        rows.append((i + 100, " ".join(words[(i * k) % len(words)] for k in range(1, 30)), lang))
    rows += [(300, "123 456 !?", "en"), (301, "unlabelled water runs", None)]
    return docs_of([*[(i, t, "en") for i, t in odd[:4]], *rows])


def test_held_out_accuracy_and_odd_texts(docs):
    learn, held = held_out_split(docs)
    assert 0 < learn.count() < docs.count()
    rows = identify_languages(docs, fit_languages(learn)).withColumn("held", held).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held and r.doc_id is not None and 100 <= r.doc_id < 300]
    assert tested and all(r.lang_pred == r.lang for r in tested)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].lang_pred == by_id[2].lang_pred == by_id[3].lang_pred == by_id[300].lang_pred == "und"
    assert by_id[301].lang_pred == "en"


def test_keep(docs):
    model = fit_languages(held_out_split(docs)[0])
    kept = keep_languages(docs, model)
    assert kept.columns == docs.columns and {1, 2, 3, 300}.isdisjoint(r.doc_id for r in kept.collect()) and kept.count() >= 120


def test_nothing_to_learn(docs_of):
    docs = docs_of([(1, "some words", None), (2, None, None)])
    model = fit_languages(docs)
    assert {r.lang_pred for r in identify_languages(docs, model).collect()} == {"und"}
    assert identify_languages(docs_of([]), model).count() == 0


def test_filters_hold_their_grams():
    grams = np.random.default_rng(2).integers(0, 2**63, 5_000, np.uint64)
    masks = np.random.default_rng(3).integers(1, 8, (5_000, 1)).astype(np.uint64)
    model = LanguageFilter.over(["a", "b", "c"], [1, 1, 1], grams, masks)
    assert ((model.masks(grams) & masks) == masks).all()  # no false negatives
    assert (model.false_rates < 0.05).all()
    assert model.predict([None, "", "1 2"])[0] == ["und"] * 3


def plain_grams(text):
    row = " " + regex.sub(r"[^\p{L}]+", " ", text.lower()) + " "
    found = [row[i : i + n] for n in (2, 3, 4) for i in range(len(row) - n + 1)]
    return [g for g in found if " " not in g[1:-1] and not (g[0] == " " and g[-1] == " ")]


def plain_model(rows, least_rate=2e-5, share=0.2):
    """language -> the n-grams that belong to it"""
    rates = {}
    for lang in {x for _, x in rows}:
        own = [g for t, x in rows if x == lang for g in plain_grams(t)]
        for g in set(own):
            if own.count(g) / len(own) >= least_rate:
                rates.setdefault(g, {})[lang] = own.count(g) / len(own)
    return {lang: {g for g, own in rates.items() if own.get(lang, 0) >= share * max(own.values()) and lang in own} for lang in {x for _, x in rows}}


def test_masks_and_scores_by_brute_force(docs_of):
    rng = random.Random(3)
    words = {x: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(30)] for x, letters in (("aa", "abcde"), ("bb", "cdefg"), ("cc", "xyzßé"))}
    texts = [(" ".join(rng.choice(words[x]) for _ in range(20)), x) for x in words for _ in range(8)]
    texts += [(texts[0][0] + " " + texts[20][0], "aa"), ("bb " * 3, "bb"), ("İstanbul 5x", "cc"), ("qqqq wwww", "cc")]
    docs = docs_of([(i, t, x) for i, (t, x) in enumerate(texts[:24] + [texts[0]] * 3)])
    model, own = fit_languages(docs, fit_rows=10**9), plain_model(texts[:24] + [texts[0]] * 3)
    assert model.languages == sorted(own)
    names, scores = model.predict([t for t, _ in texts])
    for (text, _), name, score in zip(texts, names, scores, strict=True):
        grams = plain_grams(text)
        share = {x: sum(g in own[x] for g in grams) / len(grams) for x in own}
        assert score == pytest.approx(share[name], abs=0.03) and share[name] >= max(share.values()) - 0.03
    long = " ".join(t for t, _ in texts[:8]) + " "
    whole, cut = model.predict([long * 40]), model.predict([long * 40], chunk_chars=500)
    assert whole[0] == cut[0] and whole[1][0] == pytest.approx(cut[1][0], abs=0.01)


def test_many_languages(docs_of):
    rng = random.Random(4)
    letters = [chr(0x4E00 + 40 * i + k) for i in range(70) for k in range(12)]
    text = lambda i: " ".join("".join(rng.choice(letters[12 * i : 12 * i + 12]) for _ in range(4)) for _ in range(20))
    rows = [(100 * i + k, text(i), f"l{i:02}") for i in range(70) for k in range(5)]
    model = fit_languages(docs_of(rows))
    assert model.slots.shape[1] == 2 and model.predict([text(i) for i in range(70)])[0] == [f"l{i:02}" for i in range(70)]


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learn, held = held_out_split(docs)
    rows = identify_languages(docs, fit_languages(learn)).filter(held & F.col("lang").isNotNull()).select("lang", "lang_pred").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
