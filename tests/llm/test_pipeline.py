import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "token output"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= (before if name != "mixing sources" else 3 * before)
    copies = docs.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert copies <= 3
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert rows.count() == docs.count()
    last = rows.orderBy(F.desc("start")).first()
    assert last.start + last.n_tokens == rows.agg(F.sum("n_tokens")).first()[0]


def plain_first_of_groups(rows, size=5, num=80, den=100):
    """(doc_id, text) of the least doc_id of each component of near duplicates, all pairs compared."""
    sets = []
    for _, text in rows:
        w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and den * common >= num * (len(sets[a]) + len(sets[b]) - common) and root[a] != root[b]:
                root = [root[b] if x == root[a] else x for x in root]
    least = {}
    for i, row in enumerate(rows):
        least[root[i]] = min(least.get(root[i], row), row)
    return sorted(least.values())


def test_near_duplicate_stage_in_the_chain(spark):
    docs = corpus_pipeline.language_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(rows[0][0], rows[1][1] + " and more of another"), (rows[0][0], "a text of its own under a number that another has")]
    more = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows[-2:]], docs.schema)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs.unionByName(more), SF)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == plain_first_of_groups(rows)


def test_stages_with_odd_rows(spark):
    """Nulls, empty and repeated texts, no rows at all: every stage runs and keeps the columns."""
    from quillgraph.llm.common import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", None, 0), (5, "the and of " * 20, None, "src1", 1), (5, "the and of " * 20, "en", "src1", 1), (None, "in the and of it " * 9, "en", None, 3)], docs.schema)
    more = docs.limit(40).unionByName(odd).selectExpr("*", "1 as score", "2 as copies", "3 as kept_id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        some, none = stage(spark, more, SF), stage(spark, more.limit(0), SF)
        assert some.columns == more.columns and none.columns == more.columns and none.count() == 0, name
        more = stored(some)
        assert more.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, more, SF).count() == more.count()
    assert corpus_pipeline.STAGES[-1][1](spark, more.limit(0), SF).count() == 0
