"""From search answers (free text) to queued submissions, and from submissions to sources."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evcat import config as C
from evcat.functions import rules as R
from evcat.functions import text as T
from evcat.operators import tables


def urls_of(texts: DataFrame, text: str, order: str) -> DataFrame:
    """(url, pos): every distinct http URL with its first place in the whole input.

    ``order`` is a column that orders the texts; ``pos`` is (order, place in text).
    """
    found = texts.select(F.col(order).alias("_order"), F.posexplode(T.urls_in_text(F.col(text))).alias("_at", "url"))
    return (
        found.filter(F.col("url").startswith("http"))
        .groupBy("url")
        .agg(F.min(F.struct(F.col("_order").alias("text"), F.col("_at").alias("at"))).alias("pos"))
    )


def classify_urls(urls: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Add ``verdict``: listing, duplicate (already in ``known.event_url``) or new."""
    out = urls.withColumn("_listing", T.is_listing_url(F.col("url")))
    if known is None:
        out = out.withColumn("_known", F.lit(False))
    else:
        seen = known.select(F.col("event_url").alias("url"), F.lit(True).alias("_known")).distinct()
        out = out.join(seen, "url", "left")
    verdict = F.when(F.col("_listing"), "listing").when(F.coalesce("_known", F.lit(False)), "duplicate").otherwise("new")
    return out.withColumn("verdict", verdict).drop("_listing", "_known")


def tally(classified: DataFrame) -> DataFrame:
    return classified.agg(
        F.count_if(F.col("verdict") != "listing").alias("total_found"),
        F.count_if(F.col("verdict") == "new").alias("new"),
        F.count_if(F.col("verdict") == "duplicate").alias("duplicate"),
        F.count_if(F.col("verdict") == "listing").alias("listing_dropped"),
    )


def gate(submissions: DataFrame, answers: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Add ``ok`` and ``reason`` to event submissions.

    ``answers`` has (event_url, status_code, page_text): what a light fetch returned, status 0 when
    it failed. ``verdicts`` has (event_url, is_tech_event, confidence), of which the most confident per URL
    counts. No verdict lets the submission pass.
    """
    # Page texts are judged where they are; only the findings are joined. Of several answers for one URL the last counts.
    text = F.coalesce("page_text", F.lit(""))
    seen = answers.select(
        "event_url", "status_code", R.dead_page(F.col("status_code"), F.col("page_text")).alias("_dead"), (text == "").alias("_blank")
    )
    out = submissions.join(tables.last_per_key(seen, "event_url"), "event_url", "left")
    if verdicts is None:
        out = out.withColumns({"is_tech_event": F.lit(None).cast("boolean"), "confidence": F.lit(None).cast("double")})
    else:
        judged = tables.last_per_key(verdicts.select("event_url", "is_tech_event", "confidence"), "event_url", ("confidence",))
        out = out.join(judged, "event_url", "left")
    valid = T.is_event_url(F.col("event_url"))
    dead = F.col("_dead")
    unreachable = (F.coalesce("status_code", F.lit(0)) == 0) & F.coalesce("_blank", F.lit(True))
    passes = R.event_gate(F.col("is_tech_event"), F.col("confidence"))
    reason = (
        F.when(~valid, "invalid_url")
        .when(dead.isNotNull(), dead)
        .when(unreachable, "unreachable_but_allowed")
        .when(F.col("is_tech_event").isNull(), "no_verdict_allowed")
        .when(passes, "tech_event")
        .otherwise("not_a_tech_event")
    )
    ok = valid & dead.isNull() & (unreachable | passes)
    return out.withColumns({"ok": ok, "reason": reason}).select(*submissions.columns, "ok", "reason")


def submission_sources(accepted: DataFrame, now: datetime) -> DataFrame:
    """A watchlist source per accepted submission, with starting trust."""
    from evcat.operators.lifecycle import create_sources

    config = F.to_json(
        F.struct(
            F.col("id").alias("submission_id"),
            F.coalesce("submitter_name", F.lit("anonymous")).alias("submitter_name"),
            F.lit(1).alias("max_items"),
            F.lit(True).alias("watchlist"),
        )
    )
    rows = accepted.select(
        F.concat(F.lit("Submission: "), F.left("event_url", F.lit(100))).alias("name"),
        F.lit("generic").alias("platform"),
        F.col("event_url").alias("base_url"),
        F.lit("generic").alias("crawl_strategy"),
        config.alias("config_json"),
        F.lit(24).alias("crawl_interval_hours"),
        F.lit(0.60).alias("trust_score"),
    )
    return create_sources(rows, now)


def settle_submissions(sources: DataFrame, published: DataFrame) -> DataFrame:
    """After the run: sources that published (``source_id``, ``events_published``) earn trust 0.70,
    the others are disabled. Adds ``outcome``."""
    counts = published.groupBy(F.col("source_id").alias("id")).agg(F.sum("events_published").alias("_n"))
    joined = sources.join(counts, "id", "left")
    good = F.coalesce("_n", F.lit(0)) >= 1
    return joined.withColumns(
        {
            "trust_score": F.when(good, C.DEFAULT_TRUST).otherwise(F.col("trust_score")),
            "enabled": good,
            "outcome": F.when(good, "published").otherwise("no_events"),
        }
    ).select(*sources.columns, "outcome")
