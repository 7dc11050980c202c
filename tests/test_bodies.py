import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evcat import schemas
from evcat.sources.bodies import BodyStore

NOW = datetime(2026, 5, 1)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def page_files(spark, folder, rows, files=3):
    """Rows as (source, url, body), read back from several files and a folder whose name needs escaping."""
    made = [dict(source_id=s, url=u, html_or_json=b, fetched_at=NOW + timedelta(minutes=k)) for k, (s, u, b) in enumerate(rows)]
    table = spark.createDataFrame([tuple(r.get(c) for c in ("source_id", "url", "html_or_json", "fetched_at")) for r in made], "source_id string, url string, html_or_json string, fetched_at timestamp")
    table.repartition(files).write.parquet(folder)
    return spark.read.schema(schemas.PAGES).parquet(folder)


@pytest.mark.parametrize("part_rows", [1, 3, 1000])
def test_every_content_once(spark, tmp_path, part_rows):
    """A hot content, empty and missing bodies, repeated pages; every bound on the owners gives the same store."""
    bodies = ["hot"] * 20 + [f"b{k}" for k in range(15)] + ["", None, "b1"]
    rows = [("s", f"u{k}", b) for k, b in enumerate(bodies)] + [("s", "u0", "hot")]
    store = BodyStore(spark, str(tmp_path / "st ore"), part_rows)
    store.add(page_files(spark, str(tmp_path / "pa ges"), rows), 0)
    assert sorted(tuple(r) for r in store.bodies().collect()) == sorted((sha(b), b) for b in {b for b in bodies if b is not None})
    assert store.keys().count() == len(rows)
    wanted = store.keys().select("source_id", "url_hash")
    got = {r.url_hash: r.body for r in store.get(wanted).collect()}
    assert got == {sha(f"u{k}"): b for k, b in enumerate(bodies)}


def test_later_batches_store_new_contents_only(spark, tmp_path):
    store = BodyStore(spark, str(tmp_path / "store"))
    first = page_files(spark, str(tmp_path / "a"), [("s", "u", "one"), ("s", "v", "two")])
    second = page_files(spark, str(tmp_path / "b"), [("s", "u", "two"), ("t", "u", "three")])
    store.add(first, 0)
    store.add(second.withColumn("fetched_at", F.col("fetched_at") + F.expr("INTERVAL 1 DAY")), 1)
    for again in (None, 1):  # a repeated batch replaces itself
        if again is not None:
            store.add(second.withColumn("fetched_at", F.col("fetched_at") + F.expr("INTERVAL 1 DAY")), again)
        assert sorted(r.body for r in store.bodies().collect()) == ["one", "three", "two"]
        assert store.keys().count() == 4
        now = {(r.source_id, r.url_hash): r.body for r in store.get(store.keys()).collect()}
        assert now == {("s", sha("u")): "two", ("s", sha("v")): "two", ("t", sha("u")): "three"}
    assert [r.body for r in store.lookup([sha("three"), sha("none")]).collect()] == ["three"]
    asked = spark.createDataFrame([("s", sha("u")), ("t", sha("v"))], "source_id string, url_hash string")
    assert [tuple(r) for r in store.missing(asked).collect()] == [("t", sha("v"))]
    assert store.get(asked, version="next").count() == 0


def test_empty_and_filtered_pages(spark, tmp_path):
    store = BodyStore(spark, str(tmp_path / "store"))
    assert store.keys().count() == store.bodies().count() == 0
    pages = page_files(spark, str(tmp_path / "a"), [("s", "u", "one"), ("t", "v", "two")])
    store.add(pages.filter("source_id = 'none'"), 0)
    assert store.keys().count() == store.bodies().count() == 0
    store.add(pages.filter("source_id = 't'"), 1)
    assert [r.body for r in store.bodies().collect()] == ["two"]


def test_bodies_are_not_shuffled(spark, tmp_path):
    """The copy is a scan, a broadcast join of a bounded table and a write."""
    pages = page_files(spark, str(tmp_path / "a"), [("s", f"u{k}", f"b{k}") for k in range(30)], files=3)
    store = BodyStore(spark, str(tmp_path / "store"), part_rows=8)
    store.add(pages, 0)
    owners = spark.read.parquet(str(tmp_path / "store/work/batch=0/owners"))
    names = sorted(r[0] for r in owners.select("_file").distinct().collect())
    stretches = list(store._stretches(owners))
    assert len(names) == 3 and len(stretches) >= 4
    placed = pages.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    for ends in stretches:
        inside = store._between(*ends)
        read = placed.filter(inside).select("_file", "_row", "html_or_json")
        assert owners.filter(inside).count() <= 8
        copied = read.join(F.broadcast(owners.filter(inside)), ["_file", "_row"])
        plan = copied._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert spark.read.parquet(str(tmp_path / "store/bodies")).groupBy("page_hash").count().filter("count > 1").count() == 0
