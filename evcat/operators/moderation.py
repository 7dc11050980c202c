"""Moderation queue, pipeline queue and submissions."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evcat import config as C
from evcat.functions import text as T
from evcat.operators import tables
from evcat.session import cut, instant

_EXTRACTED = "title STRING, canonical_url STRING, registration_url STRING, community_name STRING, organizer_name STRING"
_PAYLOAD = "title STRING, page_url STRING, url STRING"


def queue_rows(raw_ids: DataFrame, reason: Column, now: datetime) -> DataFrame:
    """New pending moderation rows for raw events (column ``id``); ids follow from the entity."""
    return raw_ids.select(
        F.sha2(F.concat_ws("|", F.lit("raw_event"), "id", reason), 256).alias("id"),
        F.lit("raw_event").alias("entity_type"),
        F.col("id").alias("entity_id"),
        reason.alias("reason"),
        F.lit("low").alias("severity"),
        F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("ai_verdict"),
        F.lit(None).cast("string").alias("notes"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        instant(now).cast("timestamp").alias("created_at"),
    )


def _parsed(raw_events: DataFrame) -> DataFrame:
    return raw_events.withColumns(
        {
            "_x": F.from_json("ai_extracted_json", _EXTRACTED),
            "_p": F.from_json("raw_payload_json", _PAYLOAD),
        }
    )


def _preview_title() -> Column:
    return T.plain_title(F.coalesce(T.first_filled(F.col("_x.title"), F.col("_p.title")), F.lit("(untitled)")))


def pending(items: DataFrame, raw_events: DataFrame) -> DataFrame:
    """Pending items, oldest first, with a preview of the raw event they point to: one left join."""
    preview = _parsed(raw_events).select(
        F.col("id").alias("_raw_id"),
        _preview_title().alias("preview_title"),
        T.first_filled(
            F.col("_x.canonical_url"), F.col("_x.registration_url"), F.col("_p.page_url"), F.col("_p.url")
        ).alias("preview_url"),
        T.first_filled(F.col("_x.community_name"), F.col("_x.organizer_name")).alias("preview_community"),
        F.col("extraction_confidence").alias("preview_confidence"),
    )
    waiting = items.filter("status = 'pending'")
    on = (waiting["entity_id"] == preview["_raw_id"]) & (waiting["entity_type"] == "raw_event")
    columns = ["id", "entity_type", "entity_id", "reason", "severity", "status", "ai_verdict", "notes", "created_at"]
    return (
        waiting.join(preview, on, "left")
        .select(*columns, "preview_title", "preview_url", "preview_community", "preview_confidence")
        .orderBy("created_at", "id")
    )


def event_queue(raw_events: DataFrame, items: DataFrame, limit: int = 50) -> DataFrame:
    """Raw events still in the flow, newest first, with the reason of those in moderation.

    Only the top rows are parsed, and only their moderation rows are read. Among several
    moderation rows of one raw event the last by created_at, id counts.
    """
    top = cut(
        raw_events.filter(F.col("pipeline_status").isin(*C.QUEUE_STATUSES))
        .orderBy(F.col("seen_at").desc_nulls_first(), "id")
        .limit(limit)
    )
    rows = _parsed(top)
    ids = top.select(F.col("id").alias("entity_id"))
    reasons = (
        items.filter("entity_type = 'raw_event'")
        .join(F.broadcast(ids), "entity_id", "left_semi")  # at most ``limit`` rows
        .groupBy(F.col("entity_id").alias("id"))
        .agg(F.max_by("reason", F.struct("created_at", F.col("id"))).alias("_reason"))
    )
    return rows.join(reasons, "id", "left").select(
        "id",
        "pipeline_status",
        "extraction_method",
        "extraction_confidence",
        _preview_title().alias("title"),
        T.first_filled(F.col("_x.canonical_url"), F.col("_p.page_url"), F.col("_p.url")).alias("url"),
        T.first_filled(F.col("_x.community_name"), F.col("_x.organizer_name")).alias("community"),
        F.when(F.col("pipeline_status") == "moderation", F.col("_reason")).alias("reason"),
        "seen_at",
    )


def resolve(items: DataFrame, decisions: DataFrame, now: datetime) -> DataFrame:
    """Apply (id, status) decisions and stamp them."""
    return tables.patch(items, decisions, ["status"], stamp={"resolved_at": instant(now)})


def remove_from_queue(raw_events: DataFrame, items: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop raw events and their moderation rows: (raw_events, items)."""
    gone = raw_events.select("id").join(ids.select("id"), "id", "left_semi")
    kept_items = items.join(
        gone.select(F.col("id").alias("entity_id"), F.lit("raw_event").alias("entity_type")),
        ["entity_id", "entity_type"],
        "left_anti",
    ).select(*items.columns)
    return tables.delete(raw_events, ids), kept_items


# --- Submissions ----------------------------------------------------------------------------
def event_submissions(urls: DataFrame, now: datetime, submitter: str | None = None, email: str | None = None, notes: str | None = None) -> DataFrame:
    """Queued submission rows for a frame of ``event_url``; the id follows from URL and time."""
    stamp = instant(now)
    return urls.select(
        F.sha2(F.concat_ws("|", "event_url", stamp.cast("string")), 256).alias("id"),
        F.lit("event").alias("submission_type"),
        F.lit(submitter).cast("string").alias("submitter_name"),
        F.lit(email).cast("string").alias("submitter_email"),
        "event_url",
        F.lit(None).cast("string").alias("poster_key"),
        F.lit(None).cast("string").alias("community_name"),
        F.lit(None).cast("string").alias("community_url"),
        F.lit(None).cast("string").alias("community_description"),
        F.lit(notes).cast("string").alias("notes"),
        F.lit("queued").alias("status"),
        stamp.cast("timestamp").alias("created_at"),
    )


def community_submissions(forms: DataFrame, now: datetime) -> DataFrame:
    """Pending community rows from form data (community_name, community_url, ...)."""
    fields = ("submitter_name", "submitter_email", "community_name", "community_url", "community_description", "notes")

    def given(name: str) -> Column:
        return (F.col(name) if name in forms.columns else F.lit(None).cast("string")).alias(name)

    stamp = instant(now)
    return forms.select(
        F.sha2(F.concat_ws("|", "community_name", given("community_url"), stamp.cast("string")), 256).alias("id"),
        F.lit("community").alias("submission_type"),
        *[given(f) for f in fields],
        F.lit(None).cast("string").alias("event_url"),
        F.lit(None).cast("string").alias("poster_key"),
        F.lit("pending").alias("status"),
        stamp.cast("timestamp").alias("created_at"),
    )


def list_communities(submissions: DataFrame, status: str = "pending") -> DataFrame:
    columns = (
        "id", "community_name", "community_url", "community_description", "submitter_name",
        "submitter_email", "notes", "status", "created_at",
    )
    return (
        submissions.filter((F.col("submission_type") == "community") & (F.col("status") == status))
        .select(*columns)
        .orderBy("created_at", "id")
    )


def resolve_communities(submissions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply (id, status) decisions, to community submissions only."""
    return tables.patch(submissions, decisions, ["status"], guard=F.col("submission_type") == "community")
