import math

import duckdb
import numpy as np
import pytest

import __spark_entry__
from lexdrift.operators import embedding, topics
from lexdrift.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, values):
    at = [columns.index(c) for c in sorted(columns)]
    plain = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else repr(x + 0.0) if isinstance(x, float) else repr(x)
    return sorted(tuple(plain(v[i]) for i in at) for v in values)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = registry.queries()[name](spark, SF)
    want = db.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_sketch_estimates_are_bounded(spark, db):
    exact = dict(db.sql("SELECT l_partkey::VARCHAR, count(*) FROM lineitem GROUP BY 1").fetchall())
    for name in ("sketch_estimate", "sketch_estimate_murmur3"):
        got = {r.key: r.estimate for r in registry.queries()[name](spark, SF).collect()}
        assert set(got) == set(exact) and all(got[k] >= exact[k] for k in got)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["slice", "i", "j", "w1", "w2", "n", "ppmi"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_embeddings_and_topics_are_whole(spark):
    sf = "/root/testdata/sf0.01"
    by_slice = {}
    for r in registry.queries()["embeddings_svd"](spark, sf).collect():
        by_slice.setdefault(r.slice, {})[r["rank"]] = r.vector
    cells = registry.ppmi_entries(spark, sf).collect()
    k = min(embedding.COMPONENTS, min(map(len, by_slice.values())) - 1)
    for name, rows in by_slice.items():
        m = np.zeros((len(rows), len(rows)))
        for r in cells:
            if r.slice == name:
                m[r.i, r.j] = r.ppmi
        got = np.array([rows[i] for i in range(len(rows))])
        assert got.shape[1] == k == 300
        assert (got**2).sum(0) == pytest.approx(np.linalg.svd(m, compute_uv=False)[:k], abs=1e-3)  # entries have 6 digits
    found = registry.queries()["topics_nmf"](spark, sf).select("slice", "topic_id").distinct().collect()
    assert {tuple(r) for r in found} == {(name, t) for name in by_slice for t in range(topics.TOPICS)}
