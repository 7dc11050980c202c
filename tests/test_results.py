"""Results of models laid over raw events: rows move once, before they are parsed."""
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evcat import schemas
from evcat.operators import tables
from evcat.plans import ingest as ing
from evcat.sources import pages as pg

NOW = datetime(2026, 5, 1)
PAGES = "source_id string, url string, html_or_json string, fetched_at timestamp"
CLASSES = "raw_event_id string, event_type string, topics array<string>, audience array<string>, is_student_friendly boolean"
DATES = "raw_event_id string, start_at timestamp_ntz, end_at timestamp_ntz"


def table(spark, schema, rows):
    names = [f.split()[0].strip("`") for f in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


@pytest.fixture(scope="module")
def given(spark):
    sources = table(spark, schemas.SOURCES, [dict(id="st", platform="static", base_url="static://x", trust_score=0.9), dict(id="web", platform="generic", base_url="https://site.org", trust_score=0.9)])
    text = "Join the workshop in Lucknow. Bring a laptop. " * 8
    items = [
        {"_id": "a", "title": "Undated evening", "is_free": None, "_cleaned_text": text},
        {"_id": "b", "title": "Dated evening", "start_at": "2026-06-01T11:00:00Z", "mode": "offline", "description": "x", "canonical_url": "https://site.org/b", "is_free": False},
        {"title": "No id", "_json_ld": "{}", "topics": ["a", 1]},
        {"_id": "d", "title": "Late evening", "mode": "offline", "description": "y", "canonical_url": "https://site.org/d", "city": "Lucknow"},
    ]
    pages = table(spark, PAGES, [
        dict(source_id="st", url="static://x", html_or_json=json.dumps({"events": items}), fetched_at=NOW),
        dict(source_id="web", url="https://site.org/p", html_or_json=f"<p>Rust workshop night</p><p>{text}</p>", fetched_at=NOW),
    ])
    return pages, sources


def results(spark, ids):
    models = [dict(raw_event_id=ids["a"], title="Second", confidence=0.7, not_an_event=False), dict(raw_event_id=ids["a"], title="First", confidence=0.9, not_an_event=False),
              dict(raw_event_id=ids["p"], title="Rust night", confidence=0.8, not_an_event=False), dict(raw_event_id="no hash", confidence=1.0), dict(raw_event_id=None, confidence=1.0)]
    classes = [dict(raw_event_id=ids["b"], event_type="talk", topics=["T"], audience=[], is_student_friendly=True), dict(raw_event_id=ids["b"], event_type="panel", topics=["A"], audience=[], is_student_friendly=False)]
    dates = [dict(raw_event_id=ids["d"], start_at=datetime(2026, 7, 2)), dict(raw_event_id=ids["d"], start_at=datetime(2026, 7, 1)), dict(raw_event_id=ids["d"])]
    return table(spark, schemas.EXTRACTIONS, models), table(spark, CLASSES, classes), table(spark, DATES, dates)


def test_rows_with_results_move_once(spark, given, monkeypatch):
    pages, sources = given
    raw = ing.identify(pg.raw_events_of(pages.join(sources.select(F.col("id").alias("source_id"), "platform"), "source_id")))
    ids = {r.external_id or r.page_url[-1]: r.id for r in raw.select("external_id", "page_url", "id").collect()}
    extractions, classes, dates = results(spark, ids)
    seen = []
    monkeypatch.setattr(ing, "cut", lambda df: seen.append(df) or df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ing.scored_rows(pages, sources, NOW, extractions=extractions, classifications=classes, date_lookups=dates)
        plan = seen[0]._jdf.queryExecution().executedPlan().toString()
        got = {r.external_id or r.page_url[-1]: r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 4  # the rows and three tables of results
    assert (got["a"].title, got["a"].confidence, got["p"].title) == ("First", 0.9, "Rust night")
    assert (got["b"].event_type, got["b"].topics, got["b"].is_student_friendly) == ("talk", ["T"], True)
    assert got["d"].start_at == datetime(2026, 7, 1) and not got["d"].date_tba
    assert len(got) == 5 and {k: got[k].id for k in ids} == ids


def test_rows_that_move_are_read_again_as_they_were(spark, given):
    pages, sources = given
    plain, moved = (
        ing.scored_rows(pages, sources, NOW, extractions=e).drop("row_no") for e in (None, spark.createDataFrame([], schemas.EXTRACTIONS))
    )
    assert sorted(map(str, plain.select(*sorted(plain.columns)).collect())) == sorted(map(str, moved.select(*sorted(plain.columns)).collect()))


def test_a_row_that_is_all_order_is_held_once(spark):
    df = spark.createDataFrame([("k", 1, "b", None), ("k", 2, "a", 1.5), ("k", 2, "a", None), ("l", None, None, None)], "k string, n int, s string, x double")
    last = tables.last_per_key(df, "k", ("n",))
    assert "max_by" not in last._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, last.collect())) == [("k", 2, "a", 1.5), ("l", None, None, None)]
