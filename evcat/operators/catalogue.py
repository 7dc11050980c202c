"""Listing queries over the catalogue. Each is filters plus an order; Catalyst does the rest."""
from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evcat import config as C
from evcat.functions import text as T
from evcat.functions.stem import query_terms
from evcat.operators.search import matches_all
from evcat.operators.segments import SearchIndex
from evcat.session import instant

LISTING_COLUMNS = (
    "id", "slug", "title", "description", "short_description", "start_at", "end_at", "timezone",
    "city", "locality", "venue_name AS venue", "address", "lat", "lng", "mode", "event_type",
    "topics", "audience", "organizer_name", "community_name", "source_platform", "canonical_url",
    "registration_url", "poster_url", "banner_color", "price_type", "is_free", "is_featured",
    "is_cancelled", "is_student_friendly", "date_tba", "relevance_score", "publish_score",
    "published_at", "expires_at", "updated_at", "created_at",
)
ADMIN_COLUMNS = (
    "id", "slug", "title", "start_at", "end_at", "mode", "event_type", "city", "locality",
    "venue_name", "community_name", "canonical_url", "registration_url", "poster_url",
    "is_featured", "is_cancelled", "is_free", "topics", "published_at", "expires_at",
    "created_at", "updated_at",
)


@dataclass(frozen=True)
class CatalogueQuery:
    """Listing filters; None means no filter."""

    q: str | None = None
    start_date: date | None = None
    end_date: date | None = None
    mode: str | None = None
    event_type: str | None = None
    topic: str | None = None
    locality: str | None = None
    community: str | None = None
    is_free: bool | None = None
    is_student_friendly: bool | None = None
    page: int = 1
    limit: int = 20

    def __post_init__(self) -> None:
        if self.page < 1 or not 1 <= self.limit <= 200:
            raise ValueError("page starts at 1 and limit is 1..200")

    @classmethod
    def from_params(cls, params: Mapping[str, str]) -> "CatalogueQuery":
        """From query-string parameters: empty means absent, flags count only when ``true``."""
        given = {k: params[k] for k in ("q", "topic", "locality", "community", "mode") if params.get(k)}
        flags = {k: True for k in ("is_free", "is_student_friendly") if params.get(k) == "true"}
        number = params.get("page", "")
        page = {"page": int(number)} if number.isdecimal() and int(number) >= 1 else {}
        return cls(**given, **flags, **page)


def live(now: datetime) -> Column:
    """Published and not expired."""
    return F.col("published_at").isNotNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > instant(now)))


def _midnight(day: date) -> datetime:
    return datetime(day.year, day.month, day.day)


def date_range(start: date | None, end: date | None) -> list[Column]:
    """Whole days, both ends included."""
    wanted = []
    if start is not None:
        wanted.append(F.col("start_at") >= instant(_midnight(start)))
    if end is not None:
        wanted.append(F.col("start_at") < instant(_midnight(end) + timedelta(days=1)))
    return wanted


def keyword(q: str, stemmed: bool = True) -> Column:
    """Full-text match, or the phrase inside title, short description or community."""
    like = f"%{q}%"
    parts = [F.col(c).ilike(like) for c in ("title", "short_description", "community_name")]
    hit = matches_all(F.col("search_tokens"), query_terms(q, stemmed))
    for part in parts:
        hit = hit | F.coalesce(part, F.lit(False))
    return hit


def search(events: DataFrame, query: CatalogueQuery, now: datetime, stemmed: bool = True, index: SearchIndex | None = None) -> DataFrame:
    """Live events that satisfy the query, unordered; count it for the page total.

    With an ``index`` a keyword is looked up there, and only the events it names are checked.
    """
    wanted = [live(now), *date_range(query.start_date, query.end_date)]
    if query.mode:
        wanted.append(F.col("mode") == query.mode)
    if query.event_type:
        wanted.append(F.col("event_type") == query.event_type)
    if query.locality:
        wanted.append(F.lower("locality") == query.locality.lower())
    if query.community:
        wanted.append(F.col("community_name").ilike(f"%{query.community}%"))
    if query.is_free is not None:
        wanted.append(F.col("is_free") == query.is_free)
    if query.is_student_friendly is not None:
        wanted.append(F.col("is_student_friendly") == query.is_student_friendly)
    if query.topic:
        wanted.append(F.array_contains("topics", query.topic))
    if query.q:
        wanted.append(keyword(query.q, stemmed))
    out = events
    named = index.candidates(query.q, stemmed) if index and query.q else None
    if named is not None:
        out = out.join(named, "id", "left_semi")
    for condition in wanted:
        out = out.filter(condition)
    return out


def page(found: DataFrame, query: CatalogueQuery) -> DataFrame:
    """One page: dated events first, by start; undated ones last."""
    ordered = found.orderBy(F.col("date_tba").asc_nulls_last(), F.col("start_at").asc_nulls_last(), "id")
    return ordered.offset((query.page - 1) * query.limit).limit(query.limit)


def next_page(found: DataFrame, last: tuple[bool, datetime, str], limit: int) -> DataFrame:
    """The page after a known last row; needs no offset, so deep pages cost the same as the first.

    ``last`` is (date_tba, start_at, id) of the last row seen.
    """
    tba, start, id_ = last
    at = instant(start)
    after = (F.col("date_tba") > F.lit(tba)) | (
        (F.col("date_tba") == F.lit(tba))
        & ((F.col("start_at") > at) | ((F.col("start_at") == at) & (F.col("id") > F.lit(id_))))
    )
    return found.filter(after).orderBy("date_tba", "start_at", "id").limit(limit)


def page_totals(found: DataFrame, limit: int) -> DataFrame:
    """One row: total and number of pages (at least one)."""
    total = F.count(F.lit(1))
    pages = F.greatest(F.lit(1), F.ceil(total / limit)).cast("bigint")
    return found.agg(total.alias("total"), pages.alias("pages"))


def by_slug(events: DataFrame, slugs: DataFrame) -> DataFrame:
    """Bulk lookup with a frame of slugs."""
    return events.join(slugs.select("slug"), "slug", "left_semi")


def featured(events: DataFrame, limit: int = 5) -> DataFrame:
    """Ignores expiry."""
    return (
        events.filter(F.col("is_featured") & F.col("published_at").isNotNull())
        .orderBy(F.col("start_at").asc_nulls_last(), "id")
        .limit(limit)
    )


def this_week(events: DataFrame, now: datetime) -> DataFrame:
    """Ignores expiry."""
    return events.filter(
        F.col("published_at").isNotNull() & F.col("start_at").between(instant(now), instant(now + timedelta(days=7)))
    ).orderBy("start_at", "id")


def student_friendly(events: DataFrame, now: datetime) -> DataFrame:
    return events.filter(
        F.col("published_at").isNotNull()
        & F.col("start_at").between(instant(now), instant(now + timedelta(days=30)))
        & F.col("is_student_friendly")
        & F.col("is_free")
    ).orderBy("start_at", "id")


def past(events: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    if not 1 <= days <= 90:
        raise ValueError("days is 1..90")
    return events.filter(
        F.col("published_at").isNotNull()
        & ~F.col("date_tba")
        & (F.col("start_at") < instant(now))
        & (F.col("start_at") >= instant(now - timedelta(days=days)))
    ).orderBy(F.col("start_at").desc_nulls_first(), "id")


def calendar(events: DataFrame, now: datetime, start: date | None = None, end: date | None = None) -> DataFrame:
    out = events.filter(live(now) & ~F.col("date_tba") & (F.col("start_at") >= instant(now)))
    for condition in date_range(start, end):
        out = out.filter(condition)
    return out.orderBy("start_at", "id")


def upcoming_of_page(page_rows: DataFrame, now: datetime) -> DataFrame:
    """The calendar's other form: a listing page, cut down to upcoming events and re-sorted."""
    return page_rows.filter(F.col("start_at") >= instant(now)).orderBy("start_at", "id")


def admin_listing(events: DataFrame, q: str | None = None, page_no: int = 1, limit: int = 50) -> DataFrame:
    """All events, published or not, latest start first (no start counts as latest)."""
    found = events.filter(F.col("title").ilike(f"%{q}%")) if q else events
    return found.orderBy(F.col("start_at").desc_nulls_first(), "id").offset((page_no - 1) * limit).limit(limit)


def bad_dates(events: DataFrame) -> DataFrame:
    """Placeholder dates beyond 2050."""
    return events.filter(F.col("start_at") > instant(datetime(C.JUNK_YEAR, 1, 1)))


def last_published(events: DataFrame) -> DataFrame:
    columns = ("id", "title", "start_at", "mode", "community_name", "canonical_url", "poster_url", "published_at", "date_tba")
    return (
        events.filter(F.col("published_at").isNotNull())
        .orderBy(F.col("published_at").desc(), "id")
        .limit(1)
        .select(*columns)
    )


def peek(table: DataFrame, rows: int = 10) -> DataFrame:
    return table.limit(rows)


def listing_view(events: DataFrame) -> DataFrame:
    return events.selectExpr(*LISTING_COLUMNS)


def admin_view(events: DataFrame) -> DataFrame:
    return events.selectExpr(*ADMIN_COLUMNS)


def cards(events: DataFrame) -> DataFrame:
    """What a list card shows."""
    place = T.blank_to_null(F.concat_ws(", ", T.blank_to_null(F.col("venue_name")), T.blank_to_null(F.col("locality"))))
    mode = F.col("mode")
    return events.select(
        "id",
        "title",
        T.first_filled(F.col("registration_url"), F.col("canonical_url")).alias("link"),
        F.when(mode == "online", "Online").otherwise(F.coalesce(place, F.lit("Location TBA"))).alias("place"),
        F.when(mode == "offline", "In-Person")
        .when(mode == "online", "Online")
        .when(mode != "", "Hybrid")
        .alias("mode_label"),
        F.slice("topics", 1, 3).alias("first_topics"),
        F.greatest(F.size("topics") - 3, F.lit(0)).alias("more_topics"),
        F.coalesce("date_tba", F.lit(False)).alias("tba_badge"),
    )
