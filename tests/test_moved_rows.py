"""What change detection and routing move between tasks: keys and hashes, no bodies and no row twice."""
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evcat import schemas, session
from evcat.operators.ordered import add_previous
from evcat.plans import ingest as ing
from evcat.sources import pages as pg

AT = datetime(2026, 5, 1)
PAGES = "source_id string, url string, html_or_json string, fetched_at timestamp, status_code int"


def frame(spark, schema, rows):
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


@pytest.mark.parametrize("written", [False, True])
def test_previous_row_in_one_pass_over_sorted_slices(spark, written):
    rows = [(k, n, None if n % 5 == 0 else f"v{n}") for k in ("a", None, "b", "") for n in range(40)]
    df = spark.createDataFrame(rows, "k string, o int, v string").repartition(3)
    out = add_previous(df, ["k"], ["o"], "v", "prev", written=written)
    got = {(r.k, r.o): r.prev for r in out.collect()}
    assert got == {(k, o): None if o == 0 or (o - 1) % 5 == 0 else f"v{o - 1}" for k, o, _ in rows} and out.count() == len(rows)
    # The only window runs over one row per slice.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window") == 1
    assert add_previous(df.limit(0), ["k"], ["o"], "v", "prev").count() == 0


def test_pages_to_read_on_a_first_run_need_no_join_with_all_keys(spark, monkeypatch):
    one = dict(source_id="s", fetched_at=AT, status_code=200)
    rows = [
        {**one, "url": "new", "html_or_json": "1"}, {**one, "url": "old", "html_or_json": "2"}, {**one, "url": "lost", "html_or_json": "3", "status_code": 503},
        {**one, "url": "twin", "html_or_json": "4"}, {**one, "url": "twin", "html_or_json": "5", "status_code": 503}, {**one, "url": "gone"},
        {**one, "url": "old twin", "html_or_json": "2"}, {**one, "url": "old twin", "html_or_json": "2", "status_code": 500},
        {**one, "url": None, "html_or_json": "6"}, {**one, "source_id": None, "url": "x", "html_or_json": "7"},
        {**one, "url": "new", "html_or_json": "1", "fetched_at": AT + timedelta(hours=1)}, {**one, "url": "new", "html_or_json": "8", "fetched_at": AT + timedelta(hours=2)},
    ]
    pages, sources = frame(spark, PAGES, rows), frame(spark, schemas.SOURCES, [dict(id="s", platform="generic", config_json="{}")])
    fetched = pg.with_errors(pages, sources)
    known = pg.fingerprints(pages.filter("html_or_json = '2' AND status_code = 200")).withColumn("fetched_at", F.lit(AT - timedelta(days=1)))
    judged = pg.judged_prints(fetched.filter("fetch_error IS NULL"), pg.snapshot_rows(known), sources)
    lost = fetched.filter("fetch_error IS NOT NULL")
    chosen, keys = pg.changed_pages(pages, judged, lost)
    assert keys is None and chosen.columns == pages.columns
    got = sorted((r.url, r.html_or_json) for r in chosen.collect())
    assert got == [("new", "1"), ("new", "8"), ("twin", "4"), ("twin", "5")]
    monkeypatch.setattr(pg, "is_small", lambda df: False)
    same, keys = pg.changed_pages(pages, judged, lost)
    assert sorted((r.url, r.html_or_json) for r in same.join(keys, list(pg.PAGE_KEY), "left_semi").collect()) == got


def test_rows_are_written_without_hashes_that_can_be_made_again(spark):
    rows = spark.createDataFrame([("s", "u", 0, "x", AT, "t", None, 1), ("s", "u", 1, None, AT, "t", None, None)],
                                 "source_id string, page_url string, place int, external_id string, fetched_at timestamp, title string, canonical_url string, seq int")
    full = ing.named(rows.withColumn("start_at", F.col("fetched_at")))
    bare = ing.unnamed(full)
    assert not {"row_key", "id", "event_id"} & set(bare.columns)
    assert sorted(map(str, ing.named(bare).select(full.columns).collect())) == sorted(map(str, full.collect()))
    events = {r.place: r.event_id for r in full.collect()}
    assert events[1] is None and len(events[0]) == 64


def test_shuffled_files_of_a_cut_go_with_it(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    out = session.cut(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    assert out.count() == 7 and spark.conf.get(key) == before
    with pytest.raises(Exception):
        session.cut(spark.range(1).select(F.raise_error(F.lit("no")).cast("string").alias("x")))
    assert spark.conf.get(key) == before
