"""The registered queries on the smallest tables, the two with SQL against it; and the pipeline."""

import os

import duckdb
import pytest

import corpus_pipeline
from loomtext.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    got = Q.queries()[name](spark, SF)
    rows = got.collect()
    n = duckdb.sql(f"SELECT count(*) FROM '{SF}/documents.parquet'").fetchall()[0][0]
    assert len(rows) == n and len({r.doc_id for r in rows}) == n
    if name in Q.oracle_sql():
        db = duckdb.connect()
        for t in ("documents", "benchmark"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = db.sql(Q.oracle_sql()[name])
        at = [want.columns.index(c) for c in got.columns]
        assert sorted(map(tuple, rows)) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = out
    last = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in docs.collect()}
    assert last.where("NOT lossless").count() == 0


def test_a_long_text_with_one_passage_is_dropped(spark):
    """13 benchmark words at the end of 5,000 others: not `contaminated` by share, but gone from the pipeline."""
    from loomtext.llm import decontam

    item = " ".join(f"secret{i}" for i in range(13))
    docs = spark.createDataFrame([(1, " ".join(f"w{i % 700}" for i in range(5000)) + " " + item), (2, "a clean text " * 40), (3, None)], "doc_id LONG, text STRING")
    bench = spark.createDataFrame([("i1", item)], "item_id STRING, text STRING")
    got = {r.doc_id: (r.n_hit, r.contaminated) for r in decontam.report(docs, bench).collect()}
    assert got == {1: (13, False), 2: (0, False), 3: (0, False)}
    assert sorted(r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()) == [2, 3]
