import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evcat import schemas
from evcat.plans import ingest as ing
from evcat.sources import files, pages as pg
from evcat.streaming import streams

NOW = datetime(2026, 5, 1)
DEMO = {
    "_id": "demo-1",
    "title": "Lucknow Cloud Day – Demo Meetup",
    "start_at": "2026-06-01T11:00:00+05:30",
    "end_at": "2026-06-01T13:00:00+05:30",
    "mode": "offline",
    "description": "Demo event for the whole flow.",
    "canonical_url": "https://example.com/demo",
    "registration_url": "https://example.com/demo#register",
    "city": "Lucknow",
    "locality": "Gomti Nagar",
    "venue_name": "Demo Venue, Lucknow",
    "community_name": "Lucknow Developers",
    "organizer_name": "Lucknow Developers",
    "is_free": True,
    "event_type": "meetup",
    "topics": ["community", "networking", 7],
}
LONG = "Join the workshop in Lucknow. Bring a laptop and a friend. " * 8


def table(spark, schema, rows):
    names = [f.split()[0].strip("`") for f in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


@pytest.fixture(scope="module")
def sources(spark):
    static = {"events": [DEMO, "junk", {**DEMO, "_id": "demo-2", "title": "{}", "canonical_url": "https://example.com/2"}]}
    rows = [
        dict(id="st", platform="static", base_url="static://x", trust_score=0.99, config_json=json.dumps(static)),
        dict(id="web", platform="generic", base_url="https://site.org", trust_score=0.9, config_json="{}"),
        dict(id="meet", platform="meetup", base_url="https://www.meetup.com", trust_score=0.72, config_json='{"always_refresh":true}'),
    ]
    return table(spark, schemas.SOURCES, rows)


def web_pages():
    at = NOW - timedelta(hours=1)
    one = dict(source_id="web", fetched_at=at, status_code=200, page_type="detail")
    return [
        {**one, "url": "https://site.org/a", "html_or_json": f"<p>Rust workshop night</p>\n<p>{LONG}</p>"},
        {**one, "url": "https://site.org/b", "html_or_json": f"<p>Rust workshop</p>\n{LONG}", "fetched_at": at + timedelta(minutes=1)},
        {**one, "url": "https://site.org/c", "html_or_json": f"<p>Undated talk about Go</p>\n{LONG}"},
        {**one, "url": "https://site.org/d", "html_or_json": "<p>tiny</p>"},
        {**one, "url": "https://site.org/e", "html_or_json": "<p>Some city far away</p>" + "A workshop in another town entirely. " * 12},
        {**one, "url": "https://www.meetup.com/find/", "source_id": "meet", "html_or_json": LONG},
    ]


@pytest.fixture(scope="module")
def batch(spark, sources):
    web = table(spark, schemas.PAGES, web_pages())
    return web.unionByName(files.config_pages(sources, "2026-04-30 00:00:00").select(web.columns))


def extractions(spark, batch, sources):
    """Model results for pages a and b: the same workshop, one hour apart."""
    raw = ing.identify(pg.raw_events_of(batch.join(sources.select(F.col("id").alias("source_id"), "platform"), "source_id")))
    keys = {r.page_url: r.id for r in raw.select("page_url", "id").collect()}
    base = dict(city="Lucknow", mode="offline", confidence=0.9, is_free=False, topics=["Rust"], audience=[], not_an_event=False)
    rows = [
        {**base, "raw_event_id": keys["https://site.org/a"], "title": "Rust workshop night", "start_at": "2026-05-20 18:00"},
        {**base, "raw_event_id": keys["https://site.org/b"], "title": "Rust Workshop", "start_at": "2026-05-20 19:00", "venue_name": "Hall 7"},
    ]
    return table(spark, schemas.EXTRACTIONS, rows)


def empty(spark):
    return [spark.createDataFrame([], s) for s in (schemas.EVENTS, schemas.RAW_EVENTS, schemas.SNAPSHOTS)]


@pytest.fixture(scope="module")
def result(spark, batch, sources):
    events, raw, snaps = empty(spark)
    return ing.ingest(batch, sources, events, raw, snaps, NOW, extractions=extractions(spark, batch, sources))


def test_routes(result):
    got = {(r.external_id or r.page_url): (r.route, r.reason) for r in result.routed.collect()}
    assert got == {
        "demo-1": ("published", None),
        "demo-2": ("rejected", "junk_title"),
        "https://site.org/a": ("published", None),
        "https://site.org/b": ("duplicate", None),
        "https://site.org/c": ("moderation", "missing_start_at"),
        "https://site.org/d": ("moderation", "url_noise"),
        "https://site.org/e": ("rejected", "low_relevance"),
        "https://www.meetup.com/find/": ("moderation", "url_listing"),
    }


def test_golden_event(result):
    e = result.events.filter("canonical_url = 'https://example.com/demo'").first()
    assert round(e.publish_score, 6) == 0.9575
    assert (e.slug, e.start_at, e.end_at, e.expires_at) == (
        "lucknow-cloud-day-demo-meetup", datetime(2026, 6, 1, 5, 30), datetime(2026, 6, 1, 7, 30), datetime(2026, 6, 3, 7, 30),
    )
    assert (e.relevance_score, e.city, e.is_free, e.topics, e.audience) == (1.0, "Lucknow", True, ["Cloud Computing"], ["developers"])
    assert e.short_description == "Demo event for the whole flow." and e.published_at == NOW and not e.date_tba


def test_duplicate_refreshes_its_event(result):
    e = result.events.filter("canonical_url = 'https://site.org/a'").first()
    assert (e.title, e.venue_name, e.start_at, e.is_free) == ("Rust workshop night", "Hall 7", datetime(2026, 5, 20, 12, 30), False)
    assert result.events.count() == 2 and result.event_updates.count() == 2


def test_logs(result):
    reasons = {r.reason: r.status for r in result.moderation.collect()}
    assert reasons == {"missing_start_at": "pending", "url_noise": "pending", "url_listing": "pending"}
    runs = {r.source_id: (r.pages_fetched, r.events_found, r.events_new, r.events_published, r.events_queued) for r in result.runs.collect()}
    assert runs == {"st": (1, 2, 1, 1, 0), "web": (5, 5, 3, 1, 2), "meet": (1, 1, 1, 0, 1)}
    methods = {(r.external_id, r.extraction_method) for r in result.raw_events.collect()}
    assert methods == {("demo-1", "hybrid"), ("demo-2", "hybrid"), (None, "ai"), (None, "deterministic")}


def test_second_run_reads_only_changed_and_forced_pages(spark, batch, sources, result):
    edited = batch.withColumn(
        "html_or_json", F.when(F.col("url") == "https://site.org/d", F.concat("html_or_json", F.lit("!"))).otherwise(F.col("html_or_json"))
    )
    again = ing.ingest(edited, sources, result.events, result.raw_events, result.snapshots, NOW + timedelta(days=1))
    assert {r.page_url for r in again.routed.collect()} == {"https://site.org/d", "https://www.meetup.com/find/"}
    assert again.events.count() == 2


def test_known_url_is_a_duplicate_and_undated_events_are_announced(spark, sources, result):
    events = [{**DEMO, "title": "Renamed", "end_at": "2026-06-01T14:00:00+05:30"}, {**DEMO, "_id": "tba", "title": "Soon in town", "start_at": None, "canonical_url": "https://example.com/t"}]
    page = table(spark, schemas.PAGES, [dict(source_id="st", url="static://x", html_or_json=json.dumps({"events": events}), fetched_at=NOW)])
    again = ing.ingest(page, sources, result.events, result.raw_events, result.snapshots, NOW)
    assert {r.external_id: r.route for r in again.routed.collect()} == {"demo-1": "duplicate", "tba": "published"}
    known = {r.canonical_url: r for r in again.events.collect()}
    assert known["https://example.com/demo"].end_at == datetime(2026, 6, 1, 8, 30)
    tba = known["https://example.com/t"]
    assert tba.date_tba and tba.start_at == datetime(2027, 5, 1) and tba.expires_at == datetime(2026, 5, 31)
    assert again.raw_events.filter("external_id = 'demo-1'").count() == 1


def test_every_row_has_one_route(result):
    total = result.routed.count()
    assert result.routed.filter(F.col("route").isin("published", "duplicate", "moderation", "rejected")).count() == total == 8


def test_change_detection_inside_a_batch(spark, sources):
    at = [NOW + timedelta(minutes=i) for i in range(5)]
    rows = [dict(source_id="web", url="u", html_or_json=body, fetched_at=t) for body, t in zip("AABAA", at)]
    prints = pg.fingerprints(table(spark, schemas.PAGES, rows))
    snaps = pg.snapshot_rows(prints.filter(F.col("fetched_at") == F.lit(at[0])))
    changed = pg.changed_prints(prints, snaps, sources)
    assert sorted(r.fetched_at for r in changed.collect()) == [at[2], at[3]]
    # Another parser version reads everything once.
    assert pg.changed_prints(prints, snaps, sources, version="next").count() == 3
    stored = pg.with_bodies(pg.snapshot_rows(changed), table(spark, schemas.PAGES, rows))
    assert sorted(r.body for r in stored.collect()) == ["A", "B"]


def test_stream_equals_batch_and_resumes(spark, sources, tmp_path):
    web = [p for p in web_pages()]
    folder = str(tmp_path / "in")
    table(spark, schemas.PAGES, web[:3]).coalesce(1).write.parquet(folder)
    store = streams.Store(spark, str(tmp_path / "store"))

    def run():
        arriving = spark.readStream.schema(schemas.PAGES).parquet(folder)
        streams.ingest_pages(arriving, sources, store, str(tmp_path / "checkpoint"), lambda n: NOW).awaitTermination()

    run()
    table(spark, schemas.PAGES, web[3:]).coalesce(1).write.mode("append").parquet(folder)
    run()
    run()  # nothing new
    events, raw, snaps = empty(spark)
    whole = ing.ingest(table(spark, schemas.PAGES, web), sources, events, raw, snaps, NOW)
    want = {(r.source_id, r.pipeline_status) for r in whole.raw_events.collect()}
    assert {(r.source_id, r.pipeline_status) for r in store.current("raw_events").collect()} == want
    assert store.current("raw_events").count() == len(web) and store.current("snapshots").count() == len(web)
    assert store.current("moderation").count() == whole.moderation.count()


def test_streamed_counts_and_repeats(spark, tmp_path):
    rows = [("a", "o", NOW + timedelta(hours=h), NOW) for h in (0, 1, 13)] + [("b", "o", NOW, NOW)]
    schema = "title string, organizer_name string, start_at timestamp, seen_at timestamp"
    folder = str(tmp_path / "in")
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(folder)

    def arriving():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    streams.daily_counts(arriving(), "start_at", F.col("title"), str(tmp_path / "c"), str(tmp_path / "cc")).awaitTermination()
    got = {(r.name, r["count"]) for r in streams.read_daily_counts(spark, str(tmp_path / "c")).collect()}
    assert got == {("a", 3), ("b", 1)}
    streams.drop_repeats(arriving(), str(tmp_path / "d"), str(tmp_path / "dc")).awaitTermination()
    assert sorted(r.title for r in spark.read.parquet(str(tmp_path / "d")).collect()) == ["a", "a", "b"]
