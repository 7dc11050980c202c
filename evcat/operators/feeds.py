"""Published forms of the catalogue: JSON, iCalendar, sitemap, schema.org, links, cards."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evcat import config as C
from evcat.functions import text as T
from evcat.functions.dates import compact_utc, iso_utc
from evcat.operators.catalogue import live
from evcat.session import instant

_SITE = C.Site()


def _event_url(site: C.Site) -> Column:
    return F.concat(F.lit(site.base_url.rstrip("/") + "/events/"), F.col("slug"))


def json_feed(events: DataFrame, now: datetime) -> DataFrame:
    """Live events by start, one JSON object per row; write with ``write.text``."""
    ordered = events.filter(live(now)).orderBy(F.col("start_at").asc_nulls_last(), "id")
    return ordered.select("id", F.to_json(F.struct(*events.columns), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"}).alias("value"))


# --- iCalendar ------------------------------------------------------------------------------
def _escape(c: Column) -> Column:
    """Text value: backslash, semicolon, comma and line break are escaped."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for char in (";", ","):
        out = F.replace(out, F.lit(char), F.lit("\\" + char))
    return F.replace(F.replace(out, F.lit("\r\n"), F.lit("\\n")), F.lit("\n"), F.lit("\\n"))


def _fold(line: Column) -> Column:
    """Lines of at most 75 octets. Text is viewed as one character per octet, so a break never
    falls inside a multi-byte character."""
    octets = F.decode(F.encode(line, "UTF-8"), "ISO-8859-1")
    parts = F.regexp_replace(octets, r"(?s)\G(?=.{75})(.{1,74})(?![\x80-\xBF])", "$1\r\n ")
    return F.when(F.octet_length(line) <= 74, line).otherwise(F.decode(F.encode(parts, "ISO-8859-1"), "UTF-8"))


def ics_event(site: C.Site = _SITE) -> Column:
    """One VEVENT block."""
    link = T.first_filled(F.col("registration_url"), F.col("canonical_url"))
    about = T.strip_ws(F.concat(F.coalesce("short_description", F.lit("")), F.lit("\n\nRegister: "), link))
    place = F.concat_ws(", ", T.blank_to_null(F.col("venue_name")), T.blank_to_null(F.col("address")))
    location = F.when(F.col("mode").isin("online", "hybrid"), "Online").otherwise(
        T.first_filled(place, F.lit(site.region.city))
    )
    organizer = T.first_filled(F.col("community_name"), F.col("organizer_name"))

    def prop(name: str, value: Column) -> Column:
        return T.let(F.concat(F.lit(name + ":"), value), _fold)  # null value, no line

    lines = F.array_compact(
        F.array(
            F.lit("BEGIN:VEVENT"),
            prop("SUMMARY", _escape(F.col("title"))),
            prop("DTSTART", compact_utc(F.col("start_at"))),
            prop("DTEND", compact_utc(F.col("end_at"))),
            prop("UID", F.concat("slug", F.lit("@" + site.uid_domain))),
            prop("DESCRIPTION", _escape(about)),
            prop("LOCATION", _escape(location)),
            prop("ORGANIZER", organizer),
            prop("URL", F.col("canonical_url")),
            F.lit("END:VEVENT"),
        )
    )
    return F.array_join(lines, "\r\n")


def ics_feed(events: DataFrame, now: datetime, site: C.Site = _SITE) -> DataFrame:
    """(part, start_at, id, value): header, live events by start, footer, in file order."""
    spark = events.sparkSession
    edge = spark.createDataFrame(
        [
            (0, f"BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:{site.prodid}"),
            (2, "END:VCALENDAR"),
        ],
        "part int, value string",
    )
    rows = events.filter(live(now)).withColumns({"part": F.lit(1), "value": F.lit(None).cast("string")})
    ordered = rows.unionByName(edge, allowMissingColumns=True).orderBy("part", F.col("start_at").asc_nulls_last(), "id")
    # The text is built after the sort, whose sampling would build it a second time.
    return ordered.select("part", "start_at", "id", F.coalesce("value", ics_event(site)).alias("value"))


# --- Sitemap --------------------------------------------------------------------------------
# Path, change frequency and priority of the static pages.
STATIC_PAGES = (
    ("", "hourly", 1.0), ("/events", "hourly", 0.9), ("/calendar", "daily", 0.8),
    ("/submit", "weekly", 0.5), ("/about", "monthly", 0.5),
)


def sitemap(events: DataFrame, now: datetime, site: C.Site = _SITE) -> DataFrame:
    """Static pages plus every live event; there is no cap on events."""
    kind = events.schema["start_at"].dataType
    pages = events.sparkSession.createDataFrame(
        [(site.base_url.rstrip("/") + path, freq, priority) for path, freq, priority in STATIC_PAGES],
        "url string, change_frequency string, priority double",
    ).withColumn("last_modified", instant(now).cast(kind))
    rows = events.filter(live(now)).select(
        _event_url(site).alias("url"),
        F.lit("daily").alias("change_frequency"),
        F.lit(0.8).alias("priority"),
        F.coalesce("updated_at", "start_at").cast(kind).alias("last_modified"),
    )
    return pages.unionByName(rows)


# --- Per-event documents --------------------------------------------------------------------
def json_ld(site: C.Site = _SITE) -> Column:
    """schema.org Event document; members without a value are left out."""
    mode = F.col("mode")
    base = "https://schema.org/"
    attendance = (
        F.when(mode == "online", base + "OnlineEventAttendanceMode")
        .when(mode == "hybrid", base + "MixedEventAttendanceMode")
        .otherwise(base + "OfflineEventAttendanceMode")
    )
    location = F.struct(
        F.when(mode == "online", "VirtualLocation").otherwise("Place").alias("@type"),
        T.first_filled(F.col("venue_name"), F.col("locality"), F.lit(site.region.city)).alias("name"),
        F.when(mode == "online", F.col("registration_url")).alias("url"),
    )
    community = T.blank_to_null(F.col("community_name"))
    poster = T.blank_to_null(F.col("poster_url"))
    return F.to_json(
        F.struct(
            F.lit("https://schema.org").alias("@context"),
            F.lit("Event").alias("@type"),
            F.col("title").alias("name"),
            iso_utc(F.col("start_at")).alias("startDate"),
            iso_utc(F.coalesce("end_at", "start_at")).alias("endDate"),
            attendance.alias("eventAttendanceMode"),
            F.lit(base + "EventScheduled").alias("eventStatus"),
            location.alias("location"),
            F.when(poster.isNotNull(), F.array(poster)).alias("image"),
            T.first_filled(F.col("short_description"), F.col("description"), F.col("title")).alias("description"),
            F.col("is_free").alias("isAccessibleForFree"),
            F.when(
                community.isNotNull(), F.struct(F.lit("Organization").alias("@type"), community.alias("name"))
            ).alias("organizer"),
            _event_url(site).alias("url"),
        )
    )


def calendar_link(site: C.Site = _SITE) -> Column:
    """Link that opens a prefilled calendar entry; without an end the event lasts an hour."""
    end = F.coalesce(F.col("end_at"), F.col("start_at") + F.expr("INTERVAL 1 HOUR"))
    place = F.concat_ws(", ", T.blank_to_null(F.col("venue_name")), T.blank_to_null(F.col("locality")))
    location = F.when(F.col("mode") == "online", "Online").otherwise(
        T.first_filled(place, F.lit(f"{site.region.city}, India"))
    )
    details = F.concat_ws("\n\n", T.blank_to_null(F.col("short_description")), T.blank_to_null(F.col("canonical_url")))
    dates = F.concat_ws("/", compact_utc(F.col("start_at")), compact_utc(end))

    def query(name: str, value: Column) -> Column:
        return F.concat(F.lit(name + "="), F.url_encode(value))

    return F.concat(
        F.lit("https://calendar.google.com/calendar/render?"),
        F.concat_ws(
            "&",
            query("action", F.lit("TEMPLATE")),
            query("text", F.col("title")),
            query("dates", dates),
            query("details", details),
            query("location", location),
        ),
    )


def meta_card(events: DataFrame, site: C.Site = _SITE) -> DataFrame:
    """Title, description and card kind of an event page."""
    plain = F.left(F.regexp_replace("description", "<[^>]+>", ""), F.lit(160))
    fallback = F.concat(
        F.lit(f"Tech event in {site.region.city} — "), T.first_filled(F.col("event_type"), F.lit("meetup")), F.lit(".")
    )
    return events.select(
        "id",
        F.concat("title", F.lit(f" | {site.name}")).alias("title"),
        T.first_filled(T.strip_ws(F.col("short_description")), plain, fallback).alias("description"),
        _event_url(site).alias("url"),
        T.blank_to_null(F.col("poster_url")).alias("image"),
        F.when(F.col("poster_url") != "", "summary_large_image").otherwise("summary").alias("card"),
    )
