import json
from datetime import datetime, timedelta

from evcat import schemas
from evcat.operators import lifecycle
from evcat.plans import ingest as ing
from evcat.sources import pages as pg

NOW = datetime(2026, 5, 1)
AT = NOW - timedelta(hours=1)


def frame(spark, schema, rows):
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def test_a_failed_page_fails_the_run_but_not_the_other_pages(spark):
    sources = frame(
        spark, schemas.SOURCES,
        [
            dict(id="st", platform="static", base_url="static://x", trust_score=0.9, config_json="{}", consecutive_failures=1),
            dict(id="web", platform="generic", base_url="https://site.org", trust_score=0.9, config_json="{}"),
            dict(id="idle", platform="generic", base_url="https://idle.org", trust_score=0.9, config_json="{}", consecutive_failures=4),
        ],
    )
    event = {"_id": "e1", "title": "Python workshop", "start_at": "2026-06-01T11:00:00Z", "canonical_url": "https://site.org/e1"}
    good = json.dumps({"events": [event]})
    one = dict(source_id="st", fetched_at=AT, status_code=200, page_type="detail")
    web = {**one, "source_id": "web"}
    pages = [
        {**one, "url": "static://x/1", "html_or_json": good[:30]},
        {**one, "url": "static://x/2", "html_or_json": good},
        {**web, "url": "https://site.org/a", "html_or_json": "gone", "status_code": 404, "fetched_at": AT + timedelta(minutes=1)},
        {**web, "url": "https://site.org/b", "html_or_json": None},
        {**web, "url": "https://site.org/c", "html_or_json": "{ no json but a page }"},
    ]
    events, raw, snapshots = (spark.createDataFrame([], s) for s in (schemas.EVENTS, schemas.RAW_EVENTS, schemas.SNAPSHOTS))
    first = ing.ingest(frame(spark, schemas.PAGES, pages), sources, events, raw, snapshots, NOW)
    assert {(r.url, r.error) for r in first.failures.collect()} == {
        ("static://x/1", "page is no JSON"), ("https://site.org/a", "status 404"), ("https://site.org/b", "no body"),
    }
    runs = {r.source_id: r for r in first.runs.collect()}
    assert set(runs) == {"st", "web"}
    assert (runs["st"].status, runs["st"].error_summary, runs["st"].events_found) == ("failed", "page is no JSON", 0)
    assert (runs["web"].status, runs["web"].error_summary, runs["web"].pages_fetched) == ("failed", "no body", 1)
    assert [r.external_id for r in first.raw_events.filter("source_id = 'st'").collect()] == ["e1"]
    health = {r.id: r for r in first.sources.collect()}
    assert [health[i].consecutive_failures for i in ("st", "web", "idle")] == [2, 1, 4]
    assert health["st"].last_failure_at == NOW and health["st"].last_success_at is None and health["idle"].last_crawled_at is None
    # A page that could not be fetched leaves no snapshot; one that could not be read is skipped until it changes.
    assert {r.url_hash for r in first.snapshots.collect()} == {r.url_hash for r in pg.fingerprints(frame(spark, schemas.PAGES, [pages[0], pages[1], pages[4]])).collect()}
    found = pg.changed_prints(pg.with_errors(frame(spark, schemas.PAGES, pages), sources).filter("fetch_error IS NULL"), first.snapshots, sources)
    assert found.count() == 0


def test_errors_of_pages_with_an_error_column_and_without_status(spark):
    sources = frame(spark, schemas.SOURCES, [dict(id="st", platform="static")])
    rows = [("st", "u1", "[]", AT, "timed out"), ("st", "u2", "[]", AT, " "), ("new", "u3", "x", AT, None), (None, "u4", "x", AT, None)]
    pages = spark.createDataFrame(rows, "source_id string, url string, html_or_json string, fetched_at timestamp, error string")
    got = {r.url: (r.fetch_error, r.read_error) for r in pg.with_errors(pages, sources).collect()}
    assert got == {"u1": ("timed out", None), "u2": (None, None), "u3": (None, None), "u4": (None, None)}
    assert pg.with_errors(pages.limit(0), sources).count() == 0


def test_long_errors_are_cut_and_the_first_counts(spark):
    failures = spark.createDataFrame([("s", "b", AT, "x" * 900), ("s", "a", AT, "first"), ("t", "a", AT, "y" * 900)], "source_id string, url string, fetched_at timestamp, error string")
    routed = spark.createDataFrame([("s", "published"), ("u", "moderation")], "source_id string, route string")
    counts = spark.createDataFrame([("s", 3), ("u", 1)], "source_id string, pages_fetched int")
    runs = {r.source_id: r for r in ing.crawl_counters(routed, counts, NOW, failures).collect()}
    assert runs["s"].error_summary == "first" and len(runs["t"].error_summary) == 500 and runs["t"].pages_fetched == 0
    assert (runs["s"].events_published, runs["u"].status, runs["u"].events_queued) == (0, "success", 1)


def test_re_extraction_takes_the_last_classification(spark):
    events = frame(spark, schemas.EVENTS, [dict(id=str(n), title="Old title", event_type="meetup", topics=["Old"]) for n in range(4)])
    fresh = spark.createDataFrame(
        [(str(n), False, 0.9 if n < 3 else 0.1, "Python workshop", None, None, None, None, None, None, None) for n in range(4)],
        "id string, not_an_event boolean, confidence double, title string, description string, start_at string, end_at string, venue_name string, locality string, registration_url string, mode string",
    )
    given = spark.createDataFrame(
        [("0", "seminar", ["A"], 1), ("0", "panel", ["B"], 2), ("1", "", [], 1), ("3", "panel", ["B"], 1), ("9", "panel", ["B"], 1)],
        "id string, event_type string, topics array<string>, seq int",
    )
    out = lifecycle.rescrape(events, fresh.selectExpr("*", "1 AS seq"), NOW, order=("seq",), classifications=given)
    got = {r.id: (r.event_type, r.topics) for r in out.collect()}
    # Given and last; given but empty; by the word rules; not used at all.
    assert got["0"] == ("panel", ["B"]) and got["1"] == ("meetup", ["Old"]) and got["3"] == ("meetup", ["Old"])
    assert got["2"][0] == "workshop" and "Python" in got["2"][1]
