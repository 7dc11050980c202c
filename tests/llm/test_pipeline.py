"""The queries against their SQL, and the stages one after the other."""
import pytest

import corpus_pipeline
from check_oracles import compare, connect
from evcat.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), name, QUERIES[name], SQL[name], sf_dir).startswith("ok")


def test_one_query_per_operator():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_stages_keep_the_columns(spark, awkward, sf_dir):
    docs, sizes = awkward, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == awkward.columns
        sizes.append(docs.count())
    assert sizes[0] < awkward.count() and sizes[1] < sizes[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and last.count() == docs.count()


def test_stages_on_an_empty_table(spark, empty, sf_dir):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).orderBy("start").collect()
    ends = [r["start"] + r["n_tokens"] for r in rows]
    assert rows and rows[0]["start"] == 0 and [r["start"] for r in rows[1:]] == ends[:-1]
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids)
