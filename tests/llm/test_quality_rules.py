import random

import numpy as np
import pytest

from quillgraph.llm import quality_rules as q


@pytest.fixture(scope="module")
def table(spark, docs_of, odd):
    rng, rows, labels = random.Random(4), list(odd), []
    for i in range(100, 700):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(60)]
        good = rng.random() < 0.7
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good)))
    return docs_of(rows), spark.createDataFrame([*labels, (1, None), (None, 1), (99999, 1)], "doc_id long, label int"), dict(labels)


def test_learns_and_compiles(table):
    docs, labels, truth = table
    model = q.fit_rules(docs, labels.filter("doc_id % 5 <> 0 or doc_id is null"), trees=10)
    assert 0 < len(model.rules) < 200
    rows = q.score_quality(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.doc_id in truth and r.doc_id % 5 == 0]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    # the compiled column is the model
    stats = q.with_statistics(docs).toPandas()
    by_hand = model.predict(stats[model.names].to_numpy(float))
    assert np.allclose(sorted(by_hand), sorted(r.score for r in rows))


def test_without_labels(table, spark, docs_of):
    docs = table[0]
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in q.score_quality(docs, q.fit_rules(docs, none)).collect()} == {0.5}
    assert q.score_quality(docs_of([]), q.RuleEnsemble(list(q.STATISTICS), 0.0)).count() == 0


def test_lasso_is_sparse():
    rng = np.random.default_rng(0)
    z = (rng.random((500, 40)) < 0.5).astype(float)
    y = (z[:, 0] > 0.5).astype(float)
    _, weights = q.lasso_logistic(z, y, 0.02)
    assert np.argmax(np.abs(weights)) == 0 and (np.abs(weights) > 1e-6).sum() < 10
