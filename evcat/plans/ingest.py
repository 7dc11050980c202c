"""The ingestion flow: changed pages to routed raw events, catalogue rows and logs.

Everything up to routing is one chain of column expressions (map-only after the change check).
Shuffles: the hash comparison, one source join, the duplicate check, slug numbering.
"""
from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evcat import config as C
from evcat.functions import dates as D
from evcat.functions import html as H
from evcat.functions import rules as R
from evcat.functions import text as T
from evcat.operators import dedup, moderation, refresh, search, slugs, tables
from evcat.operators.lifecycle import HEALTH_COLUMNS, source_health
from evcat.operators.ordered import add_row_number
from evcat.session import broadcast_if_small, cut, instant, is_small
from evcat.sources import pages as P

_TEXT_FIELDS = (
    "title", "description", "start_at", "end_at", "city", "locality", "venue_name", "mode",
    "event_type", "organizer_name", "community_name", "registration_url",
)


@dataclass(frozen=True)
class IngestResult:
    """New versions of the tables, and the rows to add where tables are kept as logs.

    ``raw_events`` and ``events`` are whole new versions; ``raw_updates`` and ``event_updates`` are
    the rows that differ from before (new events and refreshed ones). ``failures`` has one row per page that could not be fetched or read
    (source_id, url, fetched_at, error), ``sources`` the sources after the run.
    """

    routed: DataFrame
    raw_events: DataFrame
    raw_updates: DataFrame
    events: DataFrame
    event_updates: DataFrame
    moderation: DataFrame
    runs: DataFrame
    snapshots: DataFrame
    failures: DataFrame
    sources: DataFrame


def identify(raw: DataFrame) -> DataFrame:
    """Deterministic keys, so a rerun writes the same rows.

    ``row_key`` names one occurrence (pages are unique in source, URL and fetch time); ``id``, the
    raw event, is the same for all occurrences of an external id.
    """
    occurrence = F.sha2(F.concat_ws("|", "source_id", "page_url", F.col("fetched_at").cast("string"), "place"), 256)
    named = F.sha2(F.concat_ws("|", "source_id", "external_id"), 256)
    return raw.withColumn("row_key", occurrence).withColumn(
        "id", F.when(F.col("external_id").isNotNull(), named).otherwise(F.col("row_key"))
    )


def with_results(
    raw: DataFrame, extractions: DataFrame | None = None, classifications: DataFrame | None = None, date_lookups: DataFrame | None = None
) -> DataFrame:
    """Add the results of models per raw event (raw_event_id), null where there is none.

    ``_extraction`` is the most confident of ``extractions``, ``_given`` one of ``classifications`` (event_type, topics, audience,
    is_student_friendly), ``_found`` the earliest start of ``date_lookups`` (start_at, end_at). Rows meet their results before they are
    parsed, because raw rows are the narrowest, packed ones above all; all results and the rows are dealt by the same key, so rows move once.
    """
    results = []
    if extractions is not None:
        columns = [c for c in extractions.columns if c != "raw_event_id"]
        results.append((extractions, tables.last_row(columns, tables.by_values(extractions, columns, ("confidence",))), "_extraction"))
    if classifications is not None:
        columns = ["event_type", "topics", "audience", "is_student_friendly"]
        results.append((classifications.select("raw_event_id", *columns), tables.last_row(columns, tables.by_values(classifications, columns)), "_given"))
    if date_lookups is not None:
        results.append((date_lookups.filter("start_at IS NOT NULL"), F.min(F.struct("start_at", "end_at")), "_found"))
    out = identify(raw).withColumn("_key", _packed(F.col("id"))).drop("id", "row_key")
    for table, row, name in results:
        # Dealt first: an event has few results, so sorting them before they are dealt would save nothing.
        keyed = table.withColumn("_key", _packed(F.col("raw_event_id"))).drop("raw_event_id").filter("_key IS NOT NULL").repartition("_key")
        out = out.join(keyed.groupBy("_key").agg(row.alias(name)), "_key", "left")
    return out.drop("_key")


def _packed(key: Column) -> Column:
    """A key in half the bytes when it is a SHA-256 hash in hex; other keys are longer than a hash, so that none equals one."""
    return F.when(key.rlike("^[0-9a-f]{64}$"), F.unhex(key)).otherwise(F.concat(F.lit(bytes(33)), key.cast("binary")))


def parse(raw: DataFrame, region: C.Region = C.Region()) -> DataFrame:
    """Deterministic parse, then extraction or classification where the rules ask for it.

    ``raw`` has ``RAW_COLUMNS``, id, platform and base_url, and results of models where ``with_results`` was given some. Rows without an
    extraction use the heuristic reader, rows without a classification the word rules.
    """
    fields = R.parse_payload(F.col("payload"))
    out = raw.withColumns({f"p_{k}": v for k, v in fields.items()})
    first = R.parse_confidence(
        F.col("p_title"), F.col("p_canonical_url"), F.col("p_start_at"), F.col("p_mode"), F.col("p_description")
    )
    out = out.withColumns(
        {"kind": H.page_kind(F.col("page_url"), F.col("json_ld"), F.col("cleaned_text")), "first_confidence": first}
    )
    has_text = F.coalesce(F.col("cleaned_text") != "", F.lit(False))
    out = out.withColumn(
        "extraction_method",
        F.when(F.col("kind") != "detail", "deterministic").otherwise(
            R.extraction_method(F.col("first_confidence"), F.col("platform"), has_text)
        ),
    )
    # The text is only looked at where the rules ask for extraction.
    text = F.coalesce(T.blank_to_null(F.col("cleaned_text")), T.clean_text(F.col("raw_payload_json"), C.MAX_EXTRACTION_CHARS))
    out = out.withColumn("_text", F.when(F.col("extraction_method") == "ai", text))
    page = F.coalesce(F.col("p_canonical_url"), F.col("page_url"))
    heuristic = R.heuristic_extraction(F.col("_text"), page, region)
    out = out.withColumn("heuristic", F.when(F.col("_text").isNotNull(), heuristic))
    return merge_extraction(out, region)


def merge_extraction(parsed: DataFrame, region: C.Region) -> DataFrame:
    """Lay extraction results over the parsed fields.

    A result that is no event keeps the parsed fields with confidence 0. Otherwise each non-null
    result wins, and so do the result type's non-null defaults (free, not for students, no topics).
    """
    h = F.col("heuristic")
    if "_extraction" not in parsed.columns:
        model = {f: F.lit(None).cast("string") for f in (*_TEXT_FIELDS, "address", "price_type")}
        has_model, m_not, m_conf = F.lit(False), F.lit(None).cast("boolean"), F.lit(None).cast("double")
        m_topics = m_audience = F.lit(None).cast("array<string>")
        m_free = m_student = F.lit(None).cast("boolean")
    else:
        result = F.col("_extraction")
        model = {f: result[f] for f in (*_TEXT_FIELDS, "address", "price_type")}
        has_model = result.isNotNull()
        m_not, m_conf = F.coalesce(result["not_an_event"], F.lit(False)), F.coalesce(result["confidence"], F.lit(0.0))
        m_topics, m_audience = result["topics"], result["audience"]
        m_free, m_student = result["is_free"], result["is_student_friendly"]

    no_topics = F.array().cast("array<string>")
    asked = F.col("extraction_method") == "ai"
    # Heuristics stand in for a model; the text gate guards model results only.
    not_event = F.when(has_model, m_not | R.garbage_reason(F.col("_text")).isNotNull()).otherwise(h["not_an_event"])
    use = asked & ~not_event
    heuristic = {"title": h["title"], "description": h["description"], "city": h["city"], "registration_url": h["registration_url"]}

    def laid(name: str):
        result = F.when(has_model, model[name]).otherwise(heuristic.get(name, F.lit(None).cast("string")))
        return F.when(use, F.coalesce(result, F.col(f"p_{name}"))).otherwise(F.col(f"p_{name}"))

    merged = parsed.withColumns({f: laid(f) for f in _TEXT_FIELDS})
    conf = F.when(asked, F.when(not_event, 0.0).otherwise(F.when(has_model, m_conf).otherwise(h["confidence"])))
    merged = merged.withColumns(
        {
            "confidence": F.coalesce(conf, "first_confidence"),
            "address": F.when(use, model["address"]),
            "price_type": F.when(use, F.when(has_model, model["price_type"]).otherwise(h["price_type"])),
            "is_free": F.when(use, F.coalesce(m_free, F.lit(True))).otherwise(F.col("p_is_free")),
            "is_student_friendly": F.when(use, F.coalesce(m_student, F.lit(False))).otherwise(F.lit(False)),
            "topics": F.when(use, F.coalesce(m_topics, no_topics)).otherwise(F.col("p_topics")),
            "audience": F.when(use, F.coalesce(m_audience, no_topics)).otherwise(no_topics),
        }
    )
    hybrid = F.col("extraction_method") == "hybrid"
    verdict = R.classification(F.col("title"), F.col("description"), F.col("organizer_name"), F.col("community_name"), region)
    if "_given" not in parsed.columns:
        merged = merged.withColumn("_class", F.when(hybrid, verdict))
    else:
        own = F.struct(*[verdict[f].alias(f) for f in ("event_type", "topics", "audience", "is_student_friendly")])
        merged = merged.withColumn("_class", F.when(hybrid, F.coalesce("_given", own)))
        student = F.when(F.col("_given").isNotNull(), F.col("_class.is_student_friendly"))
        merged = merged.withColumn("is_student_friendly", F.coalesce(student, "is_student_friendly"))
    return merged.withColumns(
        {
            "event_type": F.coalesce(T.blank_to_null(F.col("_class.event_type")), "event_type"),
            "topics": F.when(F.size("_class.topics") > 0, F.col("_class.topics")).otherwise(F.col("topics")),
            "audience": F.when(F.size("_class.audience") > 0, F.col("_class.audience")).otherwise(F.col("audience")),
            "short_description": F.col("p_short_description"),
            "poster_url": F.col("p_poster_url"),
            "canonical_url": F.col("p_canonical_url"),
        }
    ).drop("_class", "_given")


def normalise(parsed: DataFrame, now: datetime, region: C.Region = C.Region()) -> DataFrame:
    """Places, dates, text and URLs in their catalogue form."""
    url = T.absolute_url(F.coalesce(T.blank_to_null(F.col("canonical_url")), "page_url"), F.col("base_url"))
    out = parsed.withColumns(
        {
            "city": T.normalize_city(F.col("city"), region),
            "locality": T.normalize_locality(F.col("locality")),
            "start_at": D.parse_datetime(F.col("start_at"), region.zone, now),
            "end_at": D.parse_datetime(F.col("end_at"), region.zone, now),
            "description": T.blank_to_null(T.clean_text(F.col("description"))),
            "canonical_url": url,
        }
    )
    register = F.coalesce(T.blank_to_null(F.col("registration_url")), "canonical_url", "page_url")
    return out.withColumn("registration_url", T.absolute_url(register, F.col("base_url")))


def with_found_dates(scored: DataFrame, asked: Column) -> DataFrame:
    """Dates found by a look-up (``_found``) for rows without one that passed the checks so far (``asked``).

    Rows below the look-up confidence take none; a found start lifts the confidence.
    """
    takes = asked & F.col("start_at").isNull() & (F.col("confidence") >= C.LOOKUP_MIN_CONFIDENCE) & F.col("_found").isNotNull()
    out = scored.withColumn("_takes", takes)
    kind = scored.schema["start_at"].dataType
    return out.withColumns(
        {
            "end_at": F.when(F.col("_takes"), F.coalesce(F.col("_found.end_at").cast(kind), "end_at")).otherwise(F.col("end_at")),
            "confidence": F.when(F.col("_takes"), F.greatest("confidence", F.lit(C.LOOKUP_CONFIDENCE))).otherwise(F.col("confidence")),
            "start_at": F.when(F.col("_takes"), F.col("_found.start_at").cast(kind)).otherwise(F.col("start_at")),
        }
    ).drop("_found", "_takes")


def score(normalised: DataFrame, now: datetime, region: C.Region = C.Region()) -> DataFrame:
    """Relevance, date-to-be-announced, completeness, publish score, and the route so far.

    ``route`` is null for rows that go on to the duplicate check. Checks are ordered: page kind,
    relevance (not for static sources), title, date. Scoring again after a second classification
    cannot change the score, because completeness does not look at what classification sets.
    """
    out = normalised.withColumn(
        "relevance",
        R.relevance(*[F.col(c) for c in ("mode", "city", "address", "venue_name", "organizer_name", "community_name")], region),
    )
    if "_found" in normalised.columns:
        turned_down = (F.col("kind") != "detail") | ~H.valid_title(F.col("title")) | (
            (F.col("relevance") < C.MIN_RELEVANCE) & (F.coalesce("platform", F.lit("")) != "static")
        )
        # Rows that are turned down anyway take no date.
        out = with_found_dates(out, ~turned_down)
    dateless = F.col("start_at").isNull()
    eligible = (F.col("confidence") >= C.TBA_MIN_CONFIDENCE) & (F.col("relevance") >= C.TBA_MIN_RELEVANCE)
    route = (
        F.when(F.col("kind") != "detail", "moderation")
        .when((F.col("relevance") < C.MIN_RELEVANCE) & (F.coalesce("platform", F.lit("")) != "static"), "rejected")
        .when(~H.valid_title(F.col("title")), "rejected")
        .when(dateless & ~eligible, "moderation")
    )
    reason = (
        F.when(F.col("kind") != "detail", F.concat(F.lit("url_"), "kind"))
        .when(F.col("route").isNull(), F.lit(None).cast("string"))
        .when((F.col("relevance") < C.MIN_RELEVANCE) & (F.coalesce("platform", F.lit("")) != "static"), "low_relevance")
        .when(F.col("route") == "rejected", "junk_title")
        .otherwise("missing_start_at")
    )
    out = out.withColumn("route", route).withColumn("reason", reason)
    out = out.withColumns(
        {
            "date_tba": F.col("route").isNull() & dateless,
            "start_at": F.when(F.col("route").isNull() & dateless, D.tba_start(now).cast("timestamp")).otherwise(F.col("start_at")),
        }
    )
    complete = R.completeness(
        *[F.col(c) for c in ("title", "start_at", "canonical_url", "short_description", "mode", "community_name", "organizer_name")]
    )
    trust = F.col("trust_score")
    out = out.withColumn("completeness", complete)
    weighted = R.publish_score(trust, F.col("confidence"), F.col("relevance"), F.col("completeness"), F.col("relevance"))
    out = out.withColumn("publish_score", F.when(F.col("route").isNull(), weighted))
    return out.withColumn("publishable", F.coalesce(F.col("publish_score") >= R.publish_threshold(trust), F.lit(False)))


def _event_id() -> Column:
    return F.sha2(F.concat_ws("|", "id", "canonical_url", "title", F.col("start_at").cast("string")), 256)


def unnamed(rows: DataFrame) -> DataFrame:
    """Rows without the hashes that ``named`` makes again, for writing and moving; those without the columns for it keep theirs."""
    return rows.drop("row_key", "id", "event_id") if {"source_id", "page_url", "fetched_at", "place", "external_id"} <= set(rows.columns) else rows


def named(rows: DataFrame) -> DataFrame:
    """``unnamed`` rows with their keys, and the id of the event for those that were checked for duplicates (``seq``)."""
    rows = rows if "row_key" in rows.columns else identify(rows)
    return rows.withColumn("event_id", F.when(F.col("seq").isNotNull(), _event_id())) if "seq" in rows.columns else rows


def route(scored: DataFrame, events: DataFrame) -> DataFrame:
    """Final route of every row; duplicates carry ``match``, the id of the event they belong to.

    The check runs on a few narrow columns, with half of the row's hash as its key; the wide rows are joined once, at the end, and only those that were checked.
    Events of the run go by their number until then.
    """
    ready = scored.filter("route IS NULL")
    key = _packed(F.col("row_key"))
    key = F.when(F.length(key) == 32, F.substring(key, 1, 16)).otherwise(key).alias("_key")
    narrow = ready.select(
        key,
        "publishable",
        "fetched_at",
        T.norm(F.col("title")).alias("title"),
        dedup.micros(F.col("start_at")).alias("us"),
        F.coalesce("canonical_url", F.lit("")).alias("url"),
    )
    narrow = add_row_number(narrow, [], ["fetched_at", "_key"], "seq", written=True).drop("fetched_at")
    matched = cut(dedup.match_catalogue(narrow, events))
    fresh = cut(dedup.batch_duplicates(matched.filter("match IS NULL")))
    inside = fresh.select("_key", "seq", F.lit(None).cast("string").alias("match"), F.col("dup_of").alias("_twin"))
    # The URL comes first over catalogue and batch: a title match in the catalogue yields to a row kept before with the same URL.
    kept = fresh.filter("dup_of IS NULL AND publishable AND url <> ''").groupBy("url").agg(F.min("seq").alias("_kept"))
    outside = matched.filter("match IS NOT NULL").join(kept, "url", "left")
    same_url = ~F.col("by_url") & F.coalesce(F.col("_kept") < F.col("seq"), F.lit(False))
    outside = outside.select("_key", "seq", F.when(~same_url, F.col("match")).alias("match"), F.when(same_url, F.col("_kept")).alias("_twin"))
    firsts = fresh.filter("dup_of IS NULL").select("_key", F.col("seq").alias("_twin"))
    owners = ready.select(key, F.unhex(_event_id()).alias("_owner")).join(firsts, "_key").groupBy("_twin").agg(F.min("_owner").alias("_owner"))
    verdicts = outside.unionByName(inside).join(owners, "_twin", "left").drop("_twin")
    joined = unnamed(ready.withColumn("_key", key)).join(verdicts, "_key").withColumn("match", F.coalesce("match", F.lower(F.hex("_owner")))).drop("_key", "_owner")
    low = F.col("match").isNull() & ~F.col("publishable")
    final = F.when(F.col("match").isNotNull(), "duplicate").when(F.col("publishable"), "published").otherwise("moderation")
    joined = joined.withColumns({"reason": F.when(low, "low_confidence").otherwise(F.col("reason")), "route": final})
    settled = unnamed(scored.filter("route IS NOT NULL")).withColumns({c: F.lit(None).cast(joined.schema[c].dataType) for c in ("seq", "match")})
    return named(joined.unionByName(settled))


def new_events(routed: DataFrame, events: DataFrame, now: datetime, region: C.Region = C.Region()) -> DataFrame:
    """Catalogue rows for published raw events."""
    at = instant(now).cast("timestamp")
    rows = routed.filter("route = 'published'").withColumn("base_slug", T.slug_or_id(F.col("title"), F.col("id")))
    narrow = slugs.assign_slugs(rows.select("seq", "base_slug"), events.select("slug")).select("seq", "slug")
    built = rows.join(narrow, "seq").select(
        F.col("event_id").alias("id"),
        "slug",
        "title",
        "description",
        T.first_filled(F.col("short_description"), F.left("description", F.lit(500))).alias("short_description"),
        "start_at",
        "end_at",
        F.lit(region.zone).alias("timezone"),
        F.coalesce(T.blank_to_null(F.col("city")), F.lit(region.city)).alias("city"),
        "locality",
        "venue_name",
        "address",
        F.lit(None).cast("double").alias("lat"),
        F.lit(None).cast("double").alias("lng"),
        "mode",
        "event_type",
        "topics",
        "audience",
        "organizer_name",
        "community_name",
        F.col("platform").alias("source_platform"),
        "canonical_url",
        F.coalesce(T.blank_to_null(F.col("registration_url")), "canonical_url").alias("registration_url"),
        "poster_url",
        F.lit(None).cast("string").alias("banner_color"),
        "price_type",
        "is_free",
        F.lit(False).alias("is_featured"),
        F.lit(False).alias("is_cancelled"),
        "is_student_friendly",
        "date_tba",
        F.col("relevance").alias("relevance_score"),
        "publish_score",
        F.col("id").alias("raw_event_id"),
        at.alias("published_at"),
        D.expiry(F.col("date_tba"), F.col("end_at"), now).cast("timestamp").alias("expires_at"),
        at.alias("updated_at"),
        at.alias("created_at"),
    )
    return search.with_search_tokens(built)


OCCURRENCE = ("fetched_at", "place", "row_key")


def raw_event_rows(routed: DataFrame, now: datetime) -> DataFrame:
    """Raw-event rows; of several occurrences of one external id in the run the last one fetched."""
    extracted = F.to_json(F.struct(*_TEXT_FIELDS[:2], *_TEXT_FIELDS[4:], "canonical_url", "topics", "start_at", "end_at"))
    rows = routed.select(
        "id",
        "source_id",
        "external_id",
        "raw_payload_json",
        F.when(F.col("extraction_method") == "ai", extracted).alias("ai_extracted_json"),
        "extraction_method",
        F.col("confidence").alias("extraction_confidence"),
        F.array().cast("array<string>").alias("ai_flags"),
        instant(now).cast("timestamp").alias("seen_at"),
        F.lit(False).alias("processed"),
        F.col("route").alias("pipeline_status"),
        *OCCURRENCE,
    )
    return tables.latest_per_key(rows, ["id"], OCCURRENCE).drop(*OCCURRENCE)


def crawl_counters(routed: DataFrame, page_counts: DataFrame, now: datetime, failures: DataFrame | None = None) -> DataFrame:
    """One crawl-run row per source: pages, found, new, published, queued.

    A source with ``failures`` (source_id, url, fetched_at, error) has a failed run: its counters stay 0 and the first error, by fetch time and
    URL, is its summary. What its other pages gave is kept.
    """
    seen = F.col("route").isin("published", "moderation")
    at = instant(now).cast("timestamp")
    counts = routed.groupBy("source_id").agg(
        F.count(F.lit(1)).cast("int").alias("events_found"),
        F.count_if(seen).cast("int").alias("events_new"),
        F.count_if(F.col("route") == "published").cast("int").alias("events_published"),
        F.count_if(F.col("route") == "moderation").cast("int").alias("events_queued"),
    )
    joined = page_counts.join(counts, "source_id", "left")
    if failures is None:
        joined = joined.withColumn("_error", F.lit(None).cast("string"))
    else:
        first = failures.groupBy("source_id").agg(F.min(F.struct("fetched_at", "url", "error")).getField("error").alias("_error"))
        joined = joined.join(first, "source_id", "full").withColumn("pages_fetched", F.coalesce("pages_fetched", F.lit(0)))
    bad = F.col("_error").isNotNull()
    numbers = ["events_found", "events_new", "events_published", "events_queued"]
    return joined.select(
        F.sha2(F.concat_ws("|", "source_id", at.cast("string")), 256).alias("id"),
        "source_id",
        F.lit(None).cast("string").alias("celery_task_id"),
        at.alias("started_at"),
        at.alias("finished_at"),
        F.when(bad, "failed").otherwise("success").alias("status"),
        "pages_fetched",
        *[F.when(bad, 0).otherwise(F.coalesce(n, F.lit(0))).alias(n) for n in numbers],
        F.left("_error", F.lit(500)).alias("error_summary"),
        at.alias("created_at"),
    )


def routed_rows(
    pages: DataFrame,
    sources: DataFrame,
    events: DataFrame,
    now: datetime,
    region: C.Region = C.Region(),
    extractions: DataFrame | None = None,
    only: DataFrame | None = None,
    classifications: DataFrame | None = None,
    date_lookups: DataFrame | None = None,
) -> DataFrame:
    """Pages to routed raw events, without change detection."""
    return route(scored_rows(pages, sources, now, region, extractions, only, classifications, date_lookups), events)


def scored_rows(
    pages: DataFrame,
    sources: DataFrame,
    now: datetime,
    region: C.Region = C.Region(),
    extractions: DataFrame | None = None,
    only: DataFrame | None = None,
    classifications: DataFrame | None = None,
    date_lookups: DataFrame | None = None,
) -> DataFrame:
    """Pages to scored raw events; ``only`` restricts them to (source_id, url, fetched_at) keys.

    Page bodies are not shuffled for a join when it can be helped: sources and keys are broadcast
    if their checked size allows. Otherwise keys are applied after extraction, whose rows are
    a fraction of the bodies.
    """
    about = broadcast_if_small(sources.select(F.col("id").alias("source_id"), "platform", "base_url", "trust_score"))
    late = only is not None and not is_small(only)
    if only is not None and not late:
        pages = pages.join(F.broadcast(only), ["source_id", "url", "fetched_at"], "left_semi")
    packed = any(r is not None for r in (extractions, classifications, date_lookups))
    raw = P.raw_events_of(pages.join(about, "source_id"), P.adapters_in_use(sources), packed)
    if late:
        raw = raw.join(only.withColumnRenamed("url", "page_url"), ["source_id", "page_url", "fetched_at"], "left_semi")
    if packed:
        raw = P.unpacked(with_results(raw, extractions, classifications, date_lookups))
    raw = identify(raw).join(about, "source_id")
    scored = score(normalise(parse(raw, region), now, region), now, region)
    used_up = [c for c in scored.columns if c.startswith(("p_", "m_", "_"))]
    return named(cut(unnamed(scored.drop("payload", "heuristic", "cleaned_text", "json_ld", *used_up))))


def ingest(
    pages: DataFrame,
    sources: DataFrame,
    events: DataFrame,
    raw_events: DataFrame,
    snapshots: DataFrame,
    now: datetime,
    region: C.Region = C.Region(),
    extractions: DataFrame | None = None,
    classifications: DataFrame | None = None,
    date_lookups: DataFrame | None = None,
) -> IngestResult:
    """One ingestion run. Inputs are tables, outputs the rows to append and the new versions.

    Model results come as optional tables: extractions, classifications and date look-ups per raw event. A page that fails does not
    stop the others; one that could not be fetched leaves no snapshot, so it counts as new next time.
    """
    # Bodies are read once for their hashes and errors; everything after works on the written hashes. The hash of a URL is made again from it.
    url_hash = T.content_hash(F.col("url"))
    fetched = cut(P.with_errors(pages, sources).drop("url_hash")).withColumn("url_hash", url_hash)
    judged = P.judged_prints(fetched.filter("fetch_error IS NULL"), snapshots, sources, written=True)
    judged = cut(judged.drop("fetch_error", "url_hash")).withColumn("url_hash", url_hash)
    lost = fetched.filter("fetch_error IS NOT NULL").withColumn("error", F.col("fetch_error"))
    unread = judged.filter("changed AND read_error IS NOT NULL").withColumn("error", F.col("read_error"))
    columns = [*P.PAGE_KEY, "error"]
    failures = lost.select(*columns).unionByName(unread.select(*columns))
    prints = judged.filter("changed").drop("changed", "read_error")
    chosen, keys = P.changed_pages(pages, judged, lost)
    scored = routed_rows(chosen, sources, events, now, region, extractions, keys, classifications, date_lookups)
    routed = named(cut(unnamed(scored)))
    fresh = cut(new_events(routed, events, now, region))
    dups = routed.filter("route = 'duplicate'").select(
        "match", "seq", "start_at", "end_at", *refresh.FILL_FIELDS
    )
    columns = [c for c in events.columns if c in fresh.columns]
    both = events.select(*columns).unionByName(fresh.select(*columns))
    refreshed = refresh.refresh_touched(both, dups, now).filter("refreshed").drop("refreshed")
    changes = cut(refreshed.unionByName(tables.delete(fresh.select(*columns), refreshed)))
    page_counts = prints.groupBy("source_id").agg(F.count(F.lit(1)).cast("int").alias("pages_fetched"))
    queued = routed.filter("route = 'moderation'")
    updates = raw_event_rows(routed, now)
    runs = crawl_counters(routed, page_counts, now, failures)
    return IngestResult(
        routed=routed,
        raw_events=tables.upsert(raw_events, updates, ["source_id", "external_id"], ["seen_at", "id"], keep=["id"]),
        raw_updates=updates,
        events=tables.delete(events.select(*columns), changes).unionByName(changes),
        event_updates=changes,
        moderation=moderation.queue_rows(queued, F.col("reason"), now),
        runs=runs,
        snapshots=P.snapshot_rows(prints),
        failures=failures,
        sources=source_health(sources, runs) if set(HEALTH_COLUMNS) <= set(sources.columns) else sources,
    )
