import json
from datetime import datetime

from evcat.config import Site
from evcat.operators import feeds
from tests.test_tables import NOW, events

START = datetime(2026, 5, 3, 10)


def one(spark, **kw):
    return events(spark, [dict(id="1", slug="s", title="T", start_at=START, **kw)])


def test_calendar_file(spark):
    df = one(
        spark, short_description="Läuft; a, b\\c " + "ü" * 60, registration_url="https://r/" + "x" * 80, venue_name="V", address="A",
        community_name="C", end_at=datetime(2026, 5, 3, 12),
    )
    lines = "\r\n".join(r.value for r in feeds.ics_feed(df, NOW).collect()).split("\r\n")
    assert lines[:3] == ["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//Event Catalogue//evcat//EN"] and lines[-1] == "END:VCALENDAR"
    assert max(len(line.encode()) for line in lines) <= 75
    whole = "\r\n".join(lines).replace("\r\n ", "")
    assert "DTSTART:20260503T100000Z\r\nDTEND:20260503T120000Z\r\nUID:s@event-catalogue" in whole
    assert r"DESCRIPTION:Läuft\; a\, b\\c " + "ü" * 60 + r"\n\nRegister: https://r/" + "x" * 80 in whole
    assert "LOCATION:V\\, A\r\nORGANIZER:C\r\nURL:https://e/1" in whole


def test_calendar_file_without_end_or_place(spark):
    value = feeds.ics_feed(one(spark), NOW).filter("part = 1").first().value
    assert "DTEND" not in value and "ORGANIZER" not in value and "LOCATION:Lucknow" in value
    assert "LOCATION:Online" in feeds.ics_feed(one(spark, mode="hybrid"), NOW).filter("part = 1").first().value


def test_json_feed_and_sitemap(spark):
    df = events(spark, [dict(id="b", slug="b", start_at=datetime(2026, 6, 1)), dict(id="a", slug="a", start_at=START), dict(id="c", published_at=None)])
    rows = feeds.json_feed(df, NOW).collect()
    assert [r.id for r in rows] == ["a", "b"] and json.loads(rows[0].value)["slug"] == "a"
    site = feeds.sitemap(df, NOW, Site(base_url="https://s/")).collect()
    assert len(site) == 7 and {r.url for r in site} >= {"https://s", "https://s/events", "https://s/events/a"}


def test_json_ld(spark):
    doc = json.loads(one(spark, mode="online", registration_url="r", community_name="C", poster_url="p").select(feeds.json_ld().alias("j")).first().j)
    assert doc["@type"] == "Event" and doc["endDate"] == doc["startDate"] == "2026-05-03T10:00:00Z"
    assert doc["location"] == {"@type": "VirtualLocation", "name": "Lucknow", "url": "r"} and doc["image"] == ["p"]
    assert doc["organizer"] == {"@type": "Organization", "name": "C"} and doc["description"] == "T"
    bare = json.loads(one(spark).select(feeds.json_ld().alias("j")).first().j)
    assert "image" not in bare and "organizer" not in bare and bare["location"] == {"@type": "Place", "name": "Lucknow"}


def test_calendar_link(spark):
    link = one(spark, short_description="A & B", venue_name="V", locality="L").select(feeds.calendar_link().alias("l")).first().l
    assert link == (
        "https://calendar.google.com/calendar/render?action=TEMPLATE&text=T&dates=20260503T100000Z%2F20260503T110000Z"
        "&details=A+%26+B%0A%0Ahttps%3A%2F%2Fe%2F1&location=V%2C+L"
    )


def test_meta_card(spark):
    df = events(spark, [dict(id="a", short_description=" s "), dict(id="b", description="<p>x</p>", poster_url="p"), dict(id="c", event_type="talk")])
    got = {r.id: (r.description, r.card) for r in feeds.meta_card(df).collect()}
    assert got == {"a": ("s", "summary"), "b": ("x", "summary_large_image"), "c": ("Tech event in Lucknow — talk.", "summary")}
