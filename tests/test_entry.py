import duckdb
import pytest

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def text_of(value):
    return repr(float(value)) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", sorted(n for n in driver.SQL))
def test_query_equals_sql(spark, db, name):
    df = driver.QUERIES[name](spark, SF)
    want = db.sql(driver.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    got = sorted(tuple(text_of(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(text_of(r[i]) for i in place) for r in want.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_kmeans_by_hand(spark):
    import numpy as np

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    centroids = x[:5].copy()
    for _ in range(10):
        s = (x @ centroids.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(centroids, axis=1)
        own = s.astype(np.float32).argmax(axis=1)
        centroids = np.array([x[own == k].mean(axis=0) if (own == k).any() else centroids[k] for k in range(5)])
    got = {r.path: r.label for r in driver.QUERIES["kmeans_assign"](spark, SF).collect()}
    assert got == {f"v{r.vec_id:08d}": f"cluster-{k + 1}" for r, k in zip(rows, own.tolist(), strict=True)}
