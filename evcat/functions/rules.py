"""Extraction, classification and scoring rules as column expressions."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from evcat import config as C
from evcat.functions import text as T

PAYLOAD_FIELDS = tuple(
    dict.fromkeys(
        [k for keys in C.PAYLOAD_KEYS.values() for k in keys]
        + ["is_free", "_id", "id", "page_url", "_cleaned_text", "_meta_description", "_json_ld"]
    )
)
PAYLOAD_SCHEMA = ", ".join(f"`{f}` STRING" for f in PAYLOAD_FIELDS)
# JSON texts that count as "no value".
_EMPTY_JSON = ("", "false", "0", "0.0", "[]", "{}")


# --- Text gate ------------------------------------------------------------------------------
def garbage_reason(text: Column) -> Column:
    """``too_short``, ``error_page``, ``js_soup``, ``no_event_signal`` or null for usable text."""

    def judge(view: Column) -> Column:
        t, low, top = view["t"], view["low"], view["top"]
        noise = F.lit(0)
        for marker in C.NOISE_MARKERS:
            noise = noise + F.contains(t, F.lit(marker)).cast("int")
        letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
        vocabulary = F.array(*[F.lit(w) for w in C.EVENT_WORDS])
        has_word = F.arrays_overlap(F.split(low, f"[{T.WS}]+"), vocabulary)
        return (
            F.when(F.length(t) < 200, "too_short")
            .when(T.any_contains(top, C.ERROR_SIGNALS), "error_page")
            .when((noise >= 4) & (letters < 300), "js_soup")
            .when((F.length(t) < 600) & ~has_word, "no_event_signal")
        )

    def lowered(t: Column) -> Column:
        return T.let(F.lower(t), lambda low: F.struct(t.alias("t"), low.alias("low"), F.left(low, F.lit(500)).alias("top")))

    return T.let(T.let(T.strip_ws(text), lowered), judge)


def needs_external_lookup(text: Column) -> Column:
    """Long script-heavy text without any date word. The word "am" sits in almost any text, so
    this is rarely true; the rule is kept as defined."""
    soup = (F.length(text) > 2000) & T.any_contains(text, C.SOUP_MARKERS)
    return soup & T.let(F.lower(text), lambda low: ~T.any_contains(low, C.DATE_WORDS))


# --- Deterministic parse --------------------------------------------------------------------
def string_items(json_list: Column) -> Column:
    """String members of a JSON list; anything else in the list is dropped."""
    items = F.from_json(json_list, "array<variant>")
    strings = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.transform(strings, lambda v: F.variant_get(v, "$", "string"))


def parse_payload(payload: Column) -> dict[str, Column]:
    """Catalogue fields from a parsed payload struct (``PAYLOAD_SCHEMA``), by key preference."""
    found: dict[str, Column] = {}
    for name, keys in C.PAYLOAD_KEYS.items():
        found[name] = F.coalesce(*[F.when(~payload[k].isin(*_EMPTY_JSON), payload[k]) for k in keys])
    found["topics"] = F.coalesce(string_items(found["topics"]), F.array().cast("array<string>"))
    given = payload["is_free"]
    found["is_free"] = F.when(given.isNull(), True).otherwise(~given.isin("null", *_EMPTY_JSON))
    return found


def parse_confidence(title: Column, canonical_url: Column, start_at: Column, mode: Column, description: Column) -> Column:
    """Share of the five weighted fields that are present. Tops out at 4/5, so classification is
    always asked for; the rule is kept as defined."""
    given = {"title": title, "canonical_url": canonical_url, "start_at": start_at, "mode": mode, "description": description}
    points = F.lit(0.0)
    for name, value in given.items():
        points = points + F.when(value.isNotNull(), C.CONFIDENCE_POINTS[name]).otherwise(0.0)
    return F.least(F.lit(1.0), points / 5)


def extraction_method(confidence: Column, platform: Column, has_text: Column) -> Column:
    ask = (confidence < C.EXTRACT_BELOW) | (F.coalesce(platform, F.lit("")).isin(*C.EXTRACT_PLATFORMS) & has_text)
    return F.when(ask, "ai").when(confidence < C.CLASSIFY_BELOW, "hybrid").otherwise("deterministic")


# --- Heuristic extraction -------------------------------------------------------------------
def heuristic_title(text: Column) -> Column:
    """A line labelled event or title, else the first line of six or more characters."""
    labelled = F.regexp_extract(text, rf"(?i)(?:^|\n)[{T.WS}]*(?:event|title)[{T.WS}]*[:\-][{T.WS}]*([^\n]+)", 1)
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), T.strip_ws)
    first = F.get(F.filter(lines, lambda s: F.length(s) >= 6), F.lit(0))
    found = T.let(F.left(T.strip_ws(labelled), F.lit(200)), lambda t: F.when(t != "", t))
    return F.coalesce(found, F.left(first, F.lit(200)))


def heuristic_registration(text: Column, page_url: Column) -> Column:
    """First URL that mentions a registration word, else the first URL, else the page itself."""

    def choose(urls: Column) -> Column:
        hinted = F.filter(urls, lambda u: T.let(F.lower(u), lambda low: T.any_contains(low, C.REGISTER_WORDS)))
        return F.regexp_replace(F.coalesce(F.get(hinted, F.lit(0)), F.get(urls, F.lit(0))), r"[).,\]]+$", "")

    urls = F.regexp_extract_all(text, F.lit(f"(https?://[^{T.WS}]+)"), F.lit(1))
    chosen = F.when(F.contains(text, F.lit("http")), T.let(urls, choose))
    return T.let(chosen, lambda u: F.when(F.coalesce(u, F.lit("")) != "", u).otherwise(page_url))


def heuristic_extraction(text: Column, page_url: Column, region: C.Region = C.Region()) -> Column:
    """Struct with what can be read from plain text without a model."""

    def read(t: Column) -> Column:
        return T.let(heuristic_title(t), lambda title: fill(t, title))

    def fill(t: Column, title: Column) -> Column:
        is_event = F.coalesce(F.length(title) >= 6, F.lit(False))
        return F.struct(
            title.alias("title"),
            T.blank_to_null(F.left(t, F.lit(800))).alias("description"),
            F.when(is_mentioned(t, C.Words(whole=(region.key,))), F.lit(region.city)).alias("city"),
            heuristic_registration(t, page_url).alias("registration_url"),
            F.lit("unknown").alias("price_type"),
            F.lit(True).alias("is_free"),
            F.lit(False).alias("is_student_friendly"),
            F.when(is_event, 0.35).otherwise(0.0).alias("confidence"),
            (~is_event).alias("not_an_event"),
        )

    return T.let(text, read)


def rubric_confidence(title: Column, start_at: Column, has_time: Column, place: Column, not_an_event: Column) -> Column:
    """Confidence by field presence."""
    return (
        F.when(not_an_event | title.isNull(), 0.0)
        .when(start_at.isNull(), 0.30)
        .when(place.isNull(), 0.50)
        .when(has_time, 0.90)
        .otherwise(0.70)
    )


# --- Heuristic classification ---------------------------------------------------------------
def _is_known_community(community: Column, organizer: Column, region: C.Region) -> Column:
    names = F.lower(F.concat(F.coalesce(community, F.lit("")), F.lit("\n"), F.coalesce(organizer, F.lit(""))))
    return T.let(names, lambda low: T.any_contains(low, region.classifier_communities))


def _mentions(low: Column, words: Column, kind: C.Words) -> Column:
    """``low`` is lower-cased text, ``words`` its ``spaced_words``."""
    markers = [f" {w} " for w in kind.whole] + [f"{w} " for w in kind.ending]
    found = T.any_contains(words, markers) | T.any_contains(low, kind.within)
    if kind.pattern:
        # Looked for only where its first letters occur.
        start = re.match(r"(?:\\b)?(\w+)", kind.pattern).group(1)
        found = found | (F.contains(low, F.lit(start)) & low.rlike(f"(?U){kind.pattern}"))
    return found


def is_mentioned(text: Column, kind: C.Words) -> Column:
    return T.let(F.lower(text), lambda low: T.let(T.spaced_words(low), lambda words: _mentions(low, words, kind)))


def topics_of(low: Column, words: Column) -> Column:
    return F.array_compact(F.array(*[F.when(_mentions(low, words, k), F.lit(name)) for name, k in C.TOPIC_WORDS.items()]))


def event_type_of(low: Column, words: Column) -> Column:
    kinds = [F.when(_mentions(low, words, k), F.lit(name)) for name, k in C.EVENT_TYPE_WORDS.items()]
    return F.coalesce(*kinds, F.lit(C.DEFAULT_EVENT_TYPE))


def classification(
    title: Column, description: Column, organizer: Column, community: Column, region: C.Region = C.Region()
) -> Column:
    """Struct of event type, topics, audience, student flag, local relevance and confidence."""
    developers = F.array(F.lit("developers"))

    def judge(low: Column, words: Column) -> Column:
        students = F.contains(low, F.lit("student"))
        return F.struct(
            event_type_of(low, words).alias("event_type"),
            topics_of(low, words).alias("topics"),
            F.when(students, F.array(F.lit("developers"), F.lit("students"))).otherwise(developers).alias("audience"),
            F.lit(False).alias("is_student_friendly"),
            F.when(_mentions(low, words, C.Words(whole=(region.key,))), 0.95)
            .when(_is_known_community(community, organizer, region), 0.85)
            .otherwise(0.4)
            .alias("local_relevance"),
            F.lit(0.4).alias("confidence"),
        )

    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(description, F.lit(""))))
    return T.let(text, lambda low: T.let(T.spaced_words(low), lambda words: judge(low, words)))


# --- Scores ---------------------------------------------------------------------------------
def relevance(
    mode: Column,
    city: Column,
    address: Column,
    venue: Column,
    organizer: Column,
    community: Column,
    region: C.Region = C.Region(),
) -> Column:
    m = F.lower(F.coalesce(mode, F.lit("")))
    where = F.lower(F.concat_ws(" ", T.blank_to_null(city), T.blank_to_null(address), T.blank_to_null(venue)))
    who = F.lower(F.concat_ws(" ", T.blank_to_null(organizer), T.blank_to_null(community)))

    def on_site(place: Column) -> Column:
        if region.word_boundary:
            institution = T.any_contains(T.spaced_words(place), [f" {i} " for i in region.institutions])
        else:
            institution = T.any_contains(place, region.institutions)
        return (
            F.when(F.contains(place, F.lit(region.key)), 1.0)
            .when(T.any_contains(place, region.localities), 0.95)
            .when(institution, 0.90)
            .otherwise(0.1)
        )

    def remote(host: Column) -> Column:
        return (
            F.when(T.any_contains(host, region.communities), 0.90)
            .when(F.contains(host, F.lit(region.key)), 0.85)
            .otherwise(0.50)
        )

    return F.when(m.isin("offline", ""), T.let(where, on_site)).when(m.isin("online", "hybrid"), T.let(who, remote)).otherwise(0.3)


def completeness(
    title: Column,
    start_at: Column,
    canonical_url: Column,
    short_description: Column,
    mode: Column,
    community: Column,
    organizer: Column,
) -> Column:
    def present(c: Column) -> Column:
        return F.coalesce(c.cast("string") != "", F.lit(False))

    required = sum((present(c).cast("int") for c in (title, start_at, canonical_url)), F.lit(0)) / 3
    bonus = F.lit(0.0)
    for c in (short_description, mode, community, organizer):
        bonus = bonus + F.when(present(c), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), required + bonus)


def publish_score(trust: Column, confidence: Column, location: Column, complete: Column, relevant: Column) -> Column:
    """Weighted sum; uniqueness certainty is 1 because duplicates were routed away before."""
    return (
        trust * C.WEIGHT_TRUST
        + confidence * C.WEIGHT_CONFIDENCE
        + location * C.WEIGHT_LOCATION
        + complete * C.WEIGHT_COMPLETENESS
        + relevant * C.WEIGHT_RELEVANCE
        + F.lit(1.0) * C.WEIGHT_DEDUP
    )


def publish_threshold(trust: Column) -> Column:
    """The more trusted the source, the lower the bar; no trust or zero counts as the default."""
    t = F.when((trust != 0.0), trust).otherwise(F.lit(C.DEFAULT_TRUST))
    (high, high_bar), (mid, mid_bar) = C.TRUST_THRESHOLDS
    return F.when(t >= high, high_bar).when(t >= mid, mid_bar).otherwise(C.LOWEST_TRUST_THRESHOLD)


# --- Submissions ----------------------------------------------------------------------------
def dead_page(status: Column, text: Column) -> Column:
    """Reason to turn a submitted URL down from its HTTP answer, else null."""
    return F.when(status.isin(*C.DEAD_STATUS), F.concat(F.lit("http_"), status.cast("string"))).when(
        T.any_contains(F.lower(text), C.DEAD_TEXT), F.lit("not_found_or_expired")
    )


def event_gate(is_tech_event: Column, confidence: Column) -> Column:
    """True unless a verdict exists that says otherwise."""
    return F.when(is_tech_event.isNull(), True).otherwise(is_tech_event & (F.coalesce(confidence, F.lit(0.0)) >= 0.5))


def triage(spam: Column, tech: Column) -> Column:
    return (
        F.when((spam < 0.2) & (tech > 0.7), "approve")
        .when((spam > 0.7) | (tech < 0.2), "reject")
        .otherwise("human_review")
    )
