import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evcat import schemas
from evcat.operators import catalogue as cat, startmaps
from evcat.operators import discovery, facets, lifecycle, moderation, refresh, search, slugs, tables

NOW = datetime(2026, 5, 1)
DAY = timedelta(days=1)


def events(spark, rows):
    """Catalogue rows from partial dicts."""
    base = dict(
        id="1", slug="s", title="T", published_at=NOW - DAY, date_tba=False, is_free=True, is_featured=False, is_cancelled=False,
        is_student_friendly=False, topics=[], start_at=NOW + DAY, created_at=NOW - 9 * DAY, updated_at=NOW - 9 * DAY,
        canonical_url="https://e/1", search_tokens=[],
    )
    names = [f.split()[0] for f in schemas.EVENTS.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}.get(n) for n in names) for r in rows], schemas.EVENTS)


def ids(df):
    return [r.id for r in df.collect()]


def test_query_parameters():
    q = cat.CatalogueQuery.from_params({"q": "", "mode": "online", "is_free": "true", "is_student_friendly": "yes", "page": "0"})
    assert q == cat.CatalogueQuery(mode="online", is_free=True)
    assert cat.CatalogueQuery.from_params({"page": "3"}).page == 3
    with pytest.raises(ValueError):
        cat.CatalogueQuery(limit=201)


def test_search_filters(spark):
    df = events(
        spark,
        [
            dict(id="a", mode="online", locality="Chowk", community_name="GDG X", topics=["AI"], start_at=datetime(2026, 5, 3, 23, 59, 59, 999999)),
            dict(id="b", expires_at=NOW - DAY),
            dict(id="c", published_at=None),
            dict(id="d", expires_at=NOW + DAY, start_at=datetime(2026, 5, 4), is_free=False, short_description="Learn Rust", search_tokens=["meetup"]),
            dict(id="e", date_tba=True, start_at=NOW - 300 * DAY),
        ],
    )

    def found(**kw):
        return sorted(ids(cat.search(df, cat.CatalogueQuery(**kw), NOW)))

    assert found() == ["a", "d", "e"]
    assert found(start_date=date(2026, 5, 3), end_date=date(2026, 5, 3)) == ["a"]
    assert found(mode="online", locality="CHOWK", community="gdg", topic="AI", is_free=True) == ["a"]
    assert found(topic="A") == []
    assert found(q="meetups") == ["d"]
    assert found(q="rust") == ["d"]
    assert found(q="the") == []
    assert ids(cat.page(cat.search(df, cat.CatalogueQuery(), NOW), cat.CatalogueQuery())) == ["a", "d", "e"]


def test_keyset_paging_equals_offset_paging(spark):
    rng = random.Random(3)
    rows = [dict(id=f"{i:03d}", date_tba=rng.random() < 0.2, start_at=NOW + rng.randrange(9) * DAY) for i in range(60)]
    found = cat.search(events(spark, rows), cat.CatalogueQuery(), NOW)
    first = cat.page(found, cat.CatalogueQuery(limit=25)).collect()
    last = first[-1]
    second = cat.page(found, cat.CatalogueQuery(page=2, limit=25))
    assert ids(cat.next_page(found, (last.date_tba, last.start_at, last.id), 25)) == ids(second)
    assert tuple(cat.page_totals(found, 25).first()) == (60, 3)
    assert tuple(cat.page_totals(found.limit(0), 25).first()) == (0, 1)


def test_listings(spark):
    df = events(
        spark,
        [
            dict(id="w", start_at=NOW + 7 * DAY, is_featured=True, expires_at=NOW - DAY),
            dict(id="p", start_at=NOW - 30 * DAY),
            dict(id="q", start_at=NOW - 2 * DAY, is_student_friendly=True),
            dict(id="s", start_at=NOW + 20 * DAY, is_student_friendly=True),
            dict(id="t", start_at=NOW + 3 * DAY, date_tba=True),
            dict(id="j", start_at=datetime(2099, 1, 1), title="Junk%"),
        ],
    )
    assert ids(cat.featured(df)) == ["w"]
    assert ids(cat.this_week(df, NOW)) == ["t", "w"]
    assert ids(cat.student_friendly(df, NOW)) == ["s"]
    assert ids(cat.past(df, NOW)) == ["q", "p"]
    assert ids(cat.calendar(df, NOW, end=date(2026, 12, 31))) == ["s"]
    assert ids(cat.bad_dates(df)) == ["j"]
    assert ids(cat.admin_listing(df, "unk")) == ["j"]
    assert ids(cat.admin_listing(df))[0] == "j"
    assert cat.last_published(df).count() == 1
    assert cat.peek(df).count() == 6
    assert "venue" in cat.listing_view(df).columns and len(cat.listing_view(df).columns) == 37
    assert len(cat.admin_view(df).columns) == 22


def test_cards(spark):
    df = events(
        spark,
        [
            dict(id="a", mode="online", registration_url="", topics=list("wxyz")),
            dict(id="b", mode="offline", venue_name="V", locality="L", registration_url="r"),
            dict(id="c", date_tba=True),
        ],
    )
    got = [tuple(r)[2:] for r in cat.cards(df).orderBy("id").collect()]
    assert got == [
        ("https://e/1", "Online", "Online", ["w", "x", "y"], 1, False),
        ("r", "V, L", "In-Person", [], 0, False),
        ("https://e/1", "Location TBA", None, [], 0, True),
    ]


def test_facets(spark):
    df = events(
        spark,
        [
            dict(id="a", topics=["AI ", "AI", ""], community_name=" ", locality="L"),
            dict(id="b", topics=["web"], community_name="G", locality="L"),
            dict(id="c", topics=["old"], expires_at=NOW - DAY),
        ],
    )
    assert [tuple(r) for r in facets.topics(df, NOW).collect()] == [("AI", 2), ("web", 1)]
    assert [tuple(r) for r in facets.communities(df, NOW).collect()] == [("G", 1)]
    assert [tuple(r) for r in facets.localities(df, NOW).collect()] == [("L", 2)]
    shown = spark.createDataFrame([("g",)], "name string")
    assert facets.more_communities(facets.communities(df, NOW), shown).count() == 0


def test_calendar_days(spark):
    df = events(spark, [dict(id="a", start_at=datetime(2026, 5, 3, 20)), dict(id="b", start_at=datetime(2026, 5, 3, 1)), dict(id="c", start_at=datetime(2026, 5, 4))])
    got = [(r.day, r["count"], r.day_label) for r in facets.by_day(df).collect()]
    assert got == [("2026-05-03", 2, "Sun, May 03, 2026"), ("2026-05-04", 1, "Mon, May 04, 2026")]
    assert [r.id for r in facets.with_days(df).collect()] == ["b", "a", "c"]


def test_upsert_and_insert(spark):
    target = spark.createDataFrame([("s", "x", "1", "old"), ("s", None, "2", "old")], "source_id string, external_id string, id string, v string")
    updates = spark.createDataFrame(
        [("s", "x", "3", "b"), ("s", "x", "4", "c"), ("s", None, "5", "n"), ("s", "y", "6", "n")], target.schema
    )
    out = tables.upsert(target, updates, ["source_id", "external_id"], ["id"], keep=["id"])
    assert sorted((r.id, r.v) for r in out.collect()) == [("1", "c"), ("2", "old"), ("5", "n"), ("6", "n")]
    seeds = spark.createDataFrame([("s", "x", "9", "z"), ("n", "x", "8", "z")], target.schema)
    assert sorted(r.id for r in tables.insert_if_absent(target, seeds, "source_id").collect()) == ["1", "2", "8"]


def test_edits(spark):
    df = events(spark, [dict(id="a", venue_name="V"), dict(id="b")])
    patches = spark.createDataFrame([("a", "New", None, "other")], "id string, title string, venue_name string, slug string")
    got = {r.id: r for r in lifecycle.edit_events(df, patches, NOW).collect()}
    assert (got["a"].title, got["a"].venue_name, got["a"].slug, got["a"].updated_at) == ("New", "V", "s", NOW)
    assert got["b"].updated_at == NOW - 9 * DAY
    cancelled = lifecycle.cancel(df, patches, NOW).filter("is_cancelled")
    assert ids(cancelled) == ["a"]
    assert ids(tables.delete(df, patches)) == ["b"]


def test_expiry(spark):
    df = events(
        spark,
        [
            dict(id="A", end_at=NOW - 3 * DAY),
            dict(id="B", start_at=NOW - 8 * DAY),
            dict(id="C", start_at=datetime(2099, 1, 1), created_at=NOW - 2 * DAY),
            dict(id="D", start_at=NOW - 9 * DAY, expires_at=NOW + DAY),
            dict(id="E", start_at=datetime(2099, 1, 1), created_at=NOW),
        ],
    )
    assert tuple(lifecycle.expiry_tally(df, NOW).first()) == (1, 1, 1)
    once = lifecycle.expire(df, NOW)
    want = {"A": NOW, "B": NOW, "D": NOW + DAY, "E": None}
    assert {r.id: r.expires_at for r in once.collect()} == want
    assert {r.id: r.expires_at for r in lifecycle.expire(once, NOW).collect()} == want


def sources(spark, rows):
    base = dict(id="1", name="n", platform="generic", base_url="u", enabled=True, status="active", config_json="{}", crawl_interval_hours=6, trust_score=0.7, consecutive_failures=0, created_at=NOW)
    names = [f.split()[0] for f in schemas.SOURCES.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}.get(n) for n in names) for r in rows], schemas.SOURCES)


def test_sources(spark):
    hour = timedelta(hours=1)
    df = sources(
        spark,
        [
            dict(id="due", last_crawled_at=NOW - 6 * hour), dict(id="never"), dict(id="black", status="blacklisted"),
            dict(id="zero", crawl_interval_hours=0, last_crawled_at=NOW - hour), dict(id="fresh", last_crawled_at=NOW - 5 * hour),
            dict(id="off", enabled=False),
        ],
    )
    assert sorted(ids(lifecycle.due_sources(df, NOW))) == ["due", "never", "zero"]
    changes = spark.createDataFrame([("due", "whitelisted"), ("never", "blacklisted"), ("black", "active"), ("off", "nonsense")], "id string, status string")
    got = {r.id: (r.status, r.trust_score, r.enabled) for r in lifecycle.set_source_status(df, changes).collect()}
    assert got["due"] == ("whitelisted", 0.95, True) and got["never"] == ("blacklisted", 0.0, False)
    assert got["black"] == ("active", 0.7, True) and got["off"] == ("active", 0.7, False)
    runs = spark.createDataFrame(
        [("due", "failed", NOW), ("due", "success", NOW + hour), ("due", "failed", NOW + 2 * hour), ("never", "failed", NOW)],
        "source_id string, status string, finished_at timestamp",
    )
    health = {r.id: r for r in lifecycle.source_health(df, runs).collect()}
    assert (health["due"].consecutive_failures, health["due"].last_success_at, health["due"].last_crawled_at) == (1, NOW + hour, NOW + 2 * hour)
    assert (health["never"].consecutive_failures, health["never"].last_success_at) == (1, None)
    made = lifecycle.create_sources(spark.createDataFrame([("a", "b")], "name string, base_url string"), NOW).first()
    assert (made.enabled, made.trust_score, made.crawl_interval_hours, made.status) == (True, 0.7, 6, "active")


def test_watchlist(spark):
    cfg = '{"watchlist":true,"max_items":1,"always_refresh":true}'
    src = sources(
        spark,
        [
            dict(id="soon", base_url="u1", config_json=cfg), dict(id="over", base_url="u2", config_json=cfg),
            dict(id="plain", base_url="u3"), dict(id="late", base_url="u1", config_json=cfg, created_at=NOW + DAY),
        ],
    )
    evs = events(
        spark,
        [
            dict(id="1", canonical_url="u1", start_at=NOW - timedelta(hours=12)), dict(id="2", canonical_url="u2", start_at=NOW - 3 * DAY),
            dict(id="3", canonical_url="u3", start_at=NOW),
        ],
    )
    got = {r.id: (r.config_json, r.due) for r in lifecycle.refresh_watchlist(src, evs, NOW).collect()}
    assert got["late"][1] is True and got["soon"] == (cfg, False) and got["plain"] == ("{}", False)
    assert '"watchlist":false' in got["over"][0] and "always_refresh" not in got["over"][0] and '"max_items":1' in got["over"][0]


def test_rescrape(spark):
    evs = events(spark, [dict(id=i, title="Old title", start_at=datetime(2099, 1, 1), event_type="x", topics=["k"]) for i in "abcd"])
    cols = "id string, title string, description string, start_at string, end_at string, venue_name string, locality string, registration_url string, mode string, confidence double, not_an_event boolean"
    fresh = spark.createDataFrame(
        [
            ("a", "AI workshop", None, "2026-06-01T10:00:00+05:30", None, None, "", None, "online", 0.6, False),
            ("b", "Short", "d", "2099-06-01", None, None, None, None, None, 0.6, False),
            ("c", "Ignored title", None, "2026-06-01", None, None, None, None, None, 0.2, False),
        ],
        cols,
    )
    got = {r.id: r for r in lifecycle.repair_bad_dates(evs, fresh, NOW).collect()}
    assert {k: v.verdict for k, v in got.items()} == {"a": "fixed", "b": "deleted", "c": "skipped", "d": "skipped"}
    assert (got["a"].start_at, got["a"].title, got["a"].event_type, got["a"].topics, got["a"].mode) == (
        datetime(2026, 6, 1, 4, 30), "AI workshop", "workshop", ["AI/ML"], "online",
    )
    assert (got["b"].title, got["b"].description, got["b"].event_type) == ("Old title", "d", "meetup")


def test_moderation(spark):
    raw = spark.createDataFrame(
        [
            ("r1", '{"title": "p", "url": "u"}', '{"title": "<b>x</b>", "community_name": "c"}', "moderation", NOW),
            ("r2", '{"page_url": "pu"}', None, "pending", NOW + DAY), ("r3", "{}", None, "published", NOW),
        ],
        "id string, raw_payload_json string, ai_extracted_json string, pipeline_status string, seen_at timestamp",
    ).withColumns({"extraction_confidence": F.lit(0.5), "extraction_method": F.lit("ai")})
    items = spark.createDataFrame(
        [
            ("m1", "raw_event", "r1", "first", "low", "pending", None, None, None, NOW),
            ("m2", "raw_event", "r1", "last", "low", "pending", None, None, None, NOW + DAY),
            ("m3", "event", "r2", "other", "low", "pending", None, None, None, NOW),
            ("m4", "raw_event", "r2", "done", "low", "approved", None, None, None, NOW),
        ],
        schemas.MODERATION,
    )
    got = [(r.id, r.preview_title, r.preview_url, r.preview_community) for r in moderation.pending(items, raw).collect()]
    assert got == [("m1", "x", "u", "c"), ("m3", None, None, None), ("m2", "x", "u", "c")]
    queue = {r.id: (r.title, r.url, r.reason) for r in moderation.event_queue(raw, items).collect()}
    assert queue == {"r1": ("x", "u", "last"), "r2": ("(untitled)", "pu", None)}
    left, kept = moderation.remove_from_queue(raw, items, raw.filter("id = 'r1'"))
    assert sorted(ids(left)) == ["r2", "r3"] and sorted(ids(kept)) == ["m3", "m4"]
    done = moderation.resolve(items, spark.createDataFrame([("m1", "approved")], "id string, status string"), NOW).filter("id = 'm1'").first()
    assert (done.status, done.resolved_at) == ("approved", NOW)


def test_submissions(spark):
    forms = spark.createDataFrame([("C", "u")], "community_name string, community_url string")
    rows = moderation.community_submissions(forms, NOW).unionByName(
        moderation.event_submissions(spark.createDataFrame([("https://e/x",), ("ftp://x",), ("https://dead/x",)], "event_url string"), NOW)
    )
    assert moderation.list_communities(rows).count() == 1
    decisions = rows.select("id", F.lit("approved").alias("status"))
    assert moderation.resolve_communities(rows, decisions).filter("status = 'approved'").count() == 1
    answers = spark.createDataFrame([("https://dead/x", 404, "")], "event_url string, status_code int, page_text string")
    gated = discovery.gate(rows.filter("submission_type = 'event'"), answers)
    assert {r.event_url: (r.ok, r.reason) for r in gated.collect()} == {
        "https://e/x": (True, "unreachable_but_allowed"), "ftp://x": (False, "invalid_url"), "https://dead/x": (False, "http_404"),
    }
    made = discovery.submission_sources(gated.filter("ok"), NOW)
    none = spark.createDataFrame([], "source_id string, events_published int")
    row = discovery.settle_submissions(made, none).first()
    assert (row.enabled, row.outcome, row.trust_score, row.crawl_interval_hours) == (False, "no_events", 0.6, 24)
    one = made.select(F.col("id").alias("source_id"), F.lit(2).alias("events_published"))
    row = discovery.settle_submissions(made, one).first()
    assert (row.enabled, row.outcome, row.trust_score) == (True, "published", 0.7)


def test_discovery(spark):
    texts = spark.createDataFrame([(2, "https://lu.ma/b https://lu.ma/"), (1, "https://lu.ma/b, https://lu.ma/a.")], "n int, body string")
    found = discovery.urls_of(texts, "body", "n")
    known = spark.createDataFrame([("https://lu.ma/a",)], "event_url string")
    got = {r.url: (r.verdict, r.pos.text) for r in discovery.classify_urls(found, known).collect()}
    assert got == {"https://lu.ma/b": ("new", 1), "https://lu.ma": ("listing", 2), "https://lu.ma/a": ("duplicate", 1)}
    assert tuple(discovery.tally(discovery.classify_urls(found, known)).first()) == (2, 1, 1, 1)


def test_slug_numbers(spark):
    existing = spark.createDataFrame([("x",), ("x-2",), ("y-1",)], "slug string")
    new = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y"), (5, "y"), (6, "z-1"), (7, "z"), (8, "z")], "seq int, base_slug string")
    got = [r.slug for r in slugs.assign_slugs(new, existing).orderBy("seq").collect()]
    assert got == ["x-1", "x-3", "x-4", "y", "y-2", "z-1", "z", "z-2"]


def fold(start, published, offers):
    """The sequential rule for starts."""
    for new in offers:
        near = published is not None and abs((start - published).total_seconds()) < 120
        if new != start and (near or start.year >= 2090 or abs((start - new).total_seconds()) >= 6 * 3600):
            start = new
    return start


@pytest.mark.parametrize("slices", [None, 1, 5, 40])
def test_start_chain_equals_the_sequential_rule(spark, slices):
    rng = random.Random(7)
    evs, offers, want = [], [], {}
    for i in range(12):
        start = rng.choice([NOW, datetime(2099, 1, 1), NOW + DAY])
        published = rng.choice([None, start + timedelta(seconds=60)])
        news = [NOW + timedelta(hours=rng.randrange(0, 30)) for _ in range(rng.randrange(0, 8))]
        evs.append(dict(id=str(i), start_at=start, published_at=published))
        offers += [(str(i), n, k) for k, n in enumerate(news)]
        want[str(i)] = fold(start, published, news)
    df = events(spark, evs)
    dups = spark.createDataFrame(offers, "match string, start_at timestamp, seq long")
    moved = {r.id: r.start_at for r in refresh.settle_starts(df, dups, slices).collect()}
    assert {e["id"]: moved.get(e["id"], e["start_at"]) for e in evs} == want


HOUR_US = 3_600_000_000


def start_after(start, published, offers):
    for new in offers:
        near = published is not None and abs(start - published) < HOUR_US // 30
        if near or start >= startmaps._DEFAULTED_US or abs(start - new) >= 6 * HOUR_US:
            start = new
    return start


def test_start_maps_equal_the_sequential_rule_for_every_start():
    rng = random.Random(11)
    grid = HOUR_US // 60
    for _ in range(400):
        published = rng.choice([None, rng.randrange(-900, 900) * grid])
        offers = [rng.choice([rng.randrange(-1500, 1500) * grid, startmaps._DEFAULTED_US + rng.randrange(3)]) for _ in range(rng.randrange(0, 14))]
        made, split = startmaps.StartMap(published), rng.randrange(0, 15)
        first, second = startmaps.StartMap(published), startmaps.StartMap(published)
        for k, new in enumerate(offers):
            made.offer(new)
            (first if k < split else second).offer(new)
        probes = [n + d for n in [0, published or 0, startmaps._DEFAULTED_US, *offers] for d in (-6 * HOUR_US, -6 * HOUR_US + 1, -1, 0, 1, 6 * HOUR_US - 1, 6 * HOUR_US, 120_000_000, -119_999_999)]
        for start in probes:
            want = start_after(start, published, offers)
            assert made(start) == want and second(first(start)) == want, (start, published, offers)


def test_a_busy_event_over_many_slices(spark):
    rng = random.Random(3)
    rows = [("busy", k, rng.randrange(40) * HOUR_US) for k in range(6_000)] + [(f"e{k % 50}", k, rng.randrange(40) * HOUR_US) for k in range(500)]
    offers = spark.createDataFrame([(i, k, 0, None, n) for i, k, n in rows], "id string, seq bigint, start_us bigint, published_us bigint, new_us bigint")
    got = {r.id: r.moved_us for r in startmaps.chained(offers, 16).collect()}
    assert got == {i: start_after(0, None, [n for j, _, n in rows if j == i]) for i in {r[0] for r in rows}}


def test_refresh_fills_only_what_is_better(spark):
    df = events(spark, [dict(id="a", description="", venue_name="V", end_at=None, start_at=datetime(2026, 5, 3, 10)), dict(id="b")])
    t = datetime(2026, 5, 3, 13)
    dups = spark.createDataFrame(
        [("a", 1, t, None, None, "d1", "", "", "W", "L"), ("a", 2, None, t, "s", "d2", "p", "", None, "M"), ("a", 3, None, t + DAY, None, None, None, None, None, None)],
        "match string, seq long, start_at timestamp, end_at timestamp, short_description string, description string, poster_url string, address string, venue_name string, locality string",
    )
    got = {r.id: r for r in refresh.refresh_existing(df, dups, NOW).collect()}
    a = got["a"]
    assert (a.description, a.short_description, a.poster_url, a.venue_name, a.locality, a.end_at, a.start_at) == (
        "d1", "s", "p", "V", "L", t + DAY, datetime(2026, 5, 3, 10),
    )
    assert a.refreshed and a.updated_at == NOW and not got["b"].refreshed
    assert ids(refresh.refresh_touched(df, dups, NOW)) == ["a"]


def test_search_index(spark, tmp_path):
    df = events(spark, [dict(id="a", title="Rust meetups"), dict(id="b", title="Rust"), dict(id="c", organizer_name="Meetup Rust group")])
    indexed = search.build_index(search.with_search_tokens(df))
    search.write_index(indexed, str(tmp_path / "index"), 3)
    index = spark.read.parquet(str(tmp_path / "index"))
    assert sorted(r.doc for r in search.lookup(index, ["rust", "meetup"]).collect()) == ["a", "c"]
    assert search.lookup(index, []).count() == 0
