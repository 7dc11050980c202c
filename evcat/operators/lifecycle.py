"""Recurring jobs on events and sources: expiry, watchlist, re-extraction, health, edits."""
from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evcat import config as C
from evcat.functions import rules as R
from evcat.functions import text as T
from evcat.functions.dates import parse_datetime
from evcat.operators import tables
from evcat.operators.catalogue import live
from evcat.session import instant

_JUNK = datetime(C.JUNK_YEAR, 1, 1)


# --- Expiry ---------------------------------------------------------------------------------
def expiry_pass(now: datetime) -> Column:
    """``A`` ended over 48 h ago, ``B`` no end and started over 7 days ago; null otherwise."""
    open_ended = F.col("expires_at").isNull()
    return F.when(
        open_ended & F.col("end_at").isNotNull() & (F.col("end_at") < instant(now - timedelta(hours=48))), "A"
    ).when(open_ended & F.col("end_at").isNull() & (F.col("start_at") < instant(now - timedelta(days=7))), "B")


def junk_pass(now: datetime) -> Column:
    """Placeholder start, created over a day ago; checked on all rows, also those A or B touched."""
    return F.coalesce(
        (F.col("start_at") > instant(_JUNK)) & (F.col("created_at") < instant(now - timedelta(hours=24))), F.lit(False)
    )


def expire(events: DataFrame, now: datetime) -> DataFrame:
    """Events after the three passes: A and B expire now, C is gone."""
    kind = events.schema["expires_at"].dataType
    expired = F.when(expiry_pass(now).isNotNull(), instant(now)).otherwise(F.col("expires_at")).cast(kind)
    return events.filter(~junk_pass(now)).withColumn("expires_at", expired)


def expiry_tally(events: DataFrame, now: datetime) -> DataFrame:
    step = expiry_pass(now)
    return events.agg(
        F.count_if(step == "A").alias("pass_a"),
        F.count_if(step == "B").alias("pass_b"),
        F.count_if(junk_pass(now)).alias("pass_c_deleted"),
    )


# --- Sources --------------------------------------------------------------------------------
def due_sources(sources: DataFrame, now: datetime) -> DataFrame:
    """Enabled, not blacklisted, never crawled or interval over; interval 0 or null counts as 1."""
    hours = F.coalesce(F.when(F.col("crawl_interval_hours") != 0, F.col("crawl_interval_hours")), F.lit(1))
    next_at = F.col("last_crawled_at") + F.make_interval(hours=hours)
    return sources.filter(
        F.col("enabled") & (F.col("status") != "blacklisted") & (F.col("last_crawled_at").isNull() | (next_at <= instant(now)))
    )


def set_source_status(sources: DataFrame, changes: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """Apply (id, status) changes; unknown statuses are rejected by leaving the source unchanged.

    Of several known statuses for one source the last by ``order`` (columns of ``changes``) counts.
    """
    known = changes.filter(F.col("status").isin(*C.SOURCE_STATUSES)).select("id", "status", *order)
    news = tables.last_per_key(known, "id", order).select("id", F.col("status").alias("_new"))
    new, trust = F.col("_new"), F.col("trust_score")
    trusted = (
        F.when(new == "whitelisted", 0.95)
        .when(new == "blacklisted", 0.0)
        .when((new == "active") & (trust == 0.0), 0.70)
        .otherwise(trust)
    )
    enabled = F.when(new == "blacklisted", False).when(new.isNotNull(), True).otherwise(F.col("enabled"))
    return (
        sources.join(news, "id", "left")
        .withColumns({"trust_score": trusted, "enabled": enabled, "status": F.coalesce(new, "status")})
        .select(*sources.columns)
    )


def create_sources(rows: DataFrame, now: datetime) -> DataFrame:
    """Source rows with defaults for what is not given."""
    defaults = {
        "id": F.sha2(F.concat_ws("|", "name", "base_url"), 256),
        "platform": F.lit(None).cast("string"),
        "enabled": F.lit(True),
        "status": F.lit("active"),
        "crawl_strategy": F.lit(None).cast("string"),
        "config_json": F.lit("{}"),
        "crawl_interval_hours": F.lit(6),
        "trust_score": F.lit(C.DEFAULT_TRUST),
        "last_crawled_at": F.lit(None).cast("timestamp"),
        "last_success_at": F.lit(None).cast("timestamp"),
        "last_failure_at": F.lit(None).cast("timestamp"),
        "consecutive_failures": F.lit(0),
        "created_at": instant(now).cast("timestamp"),
    }
    value = {c: F.coalesce(F.col(c), d) if c in rows.columns else d for c, d in defaults.items()}
    order = ("id", "name", "platform", "base_url", *[c for c in defaults if c not in ("id", "platform")])
    return rows.select(*[value.get(c, F.col(c)).alias(c) for c in order])


def patch_sources(sources: DataFrame, patches: DataFrame) -> DataFrame:
    return tables.patch(sources, patches, C.SOURCE_PATCH_FIELDS)


def seed_sources(sources: DataFrame, seeds: DataFrame) -> DataFrame:
    return tables.insert_if_absent(sources, seeds, "name")


def list_sources(sources: DataFrame) -> DataFrame:
    columns = (
        "id", "name", "platform", "base_url", "enabled", "status", "crawl_strategy", "trust_score",
        "crawl_interval_hours", "last_crawled_at", "last_success_at", "consecutive_failures", "created_at",
    )
    return sources.select(*columns).orderBy(F.col("created_at").desc_nulls_first(), "id")


def recent_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    columns = (
        "id", "source_id", "started_at", "finished_at", "status", "events_found", "events_new",
        "events_published", "error_summary", "created_at",
    )
    return runs.select(*columns).orderBy(F.col("started_at").desc_nulls_first(), "id").limit(limit)


HEALTH_COLUMNS = ("last_crawled_at", "last_success_at", "last_failure_at", "consecutive_failures")


def source_health(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources after their runs: success resets failures, each failure since then adds one.

    Several runs of a source shrink to one row in the aggregate; failures count from the last
    success on.
    """
    at = F.col("finished_at")
    ok = runs.filter("status = 'success'").groupBy("source_id").agg(F.max("finished_at").alias("_ok_at"))
    joined = runs.join(ok, "source_id", "left")
    failed = F.col("status") == "failed"
    since = failed & (F.col("_ok_at").isNull() | (at > F.col("_ok_at")))
    summary = joined.groupBy(F.col("source_id").alias("id")).agg(
        F.max("finished_at").alias("_last"),
        F.max("_ok_at").alias("_ok"),
        F.max(F.when(failed, at)).alias("_bad"),
        F.count_if(F.coalesce(since, F.lit(False))).cast("int").alias("_fails"),
    )
    out = sources.join(summary, "id", "left")
    kind = {c: sources.schema[c].dataType for c in ("last_crawled_at", "last_success_at", "last_failure_at")}
    before = F.when(F.col("_ok").isNotNull(), 0).otherwise(F.coalesce("consecutive_failures", F.lit(0)))
    return out.withColumns(
        {
            "last_crawled_at": F.coalesce("_last", "last_crawled_at").cast(kind["last_crawled_at"]),
            "last_success_at": F.coalesce("_ok", "last_success_at").cast(kind["last_success_at"]),
            "last_failure_at": F.coalesce("_bad", "last_failure_at").cast(kind["last_failure_at"]),
            "consecutive_failures": (before + F.coalesce("_fails", F.lit(0))).cast("int"),
        }
    ).select(*sources.columns)


# --- Watchlist ------------------------------------------------------------------------------
def watchlist(sources: DataFrame, events: DataFrame, now: datetime) -> DataFrame:
    """Watchlist sources with live events: (source_id, disable, refresh).

    Among sources with one URL the last by created_at, id is meant. Events of a source act in start
    order and the last one wins each flag: an event over for 48 h turns the watch off, one that
    starts no earlier than 12 h ago asks for a refresh.
    """
    watched = sources.filter((F.get_json_object("config_json", "$.watchlist") == "true") & (F.col("base_url") != ""))
    by_url = watched.groupBy(F.col("base_url").alias("canonical_url")).agg(
        F.max_by("id", F.struct("created_at", "id")).alias("source_id")
    )
    over = F.coalesce("end_at", "start_at") < instant(now - timedelta(hours=48))
    soon = F.col("start_at") >= instant(now - timedelta(hours=12))
    acts = (
        events.filter(live(now))
        .select("canonical_url", "start_at", "id", F.when(over, "disable").when(soon, "refresh").alias("act"))
        .filter("act IS NOT NULL")
        .join(by_url, "canonical_url")
    )
    order = F.struct("start_at", "id")
    return acts.groupBy("source_id").agg(
        F.count_if(F.col("act") == "disable").alias("n_disable"),
        F.count_if(F.col("act") == "refresh").alias("n_refresh"),
        F.max_by("act", order).alias("last_act"),
    ).select(
        "source_id",
        (F.col("n_disable") > 0).alias("disable"),
        (F.col("n_refresh") > 0).alias("refresh"),
        # An end after a refresh request withdraws it; a refresh after an end does not re-watch.
        (F.col("last_act") == "refresh").alias("always_refresh"),
    )


def refresh_watchlist(sources: DataFrame, events: DataFrame, now: datetime) -> DataFrame:
    """Sources with their flags edited; ``due`` marks those to crawl now. Flags always persist."""
    marks = watchlist(sources, events, now).withColumnRenamed("source_id", "id")
    joined = sources.join(marks, "id", "left")
    config = set_json_flags(
        F.col("config_json"),
        {
            "watchlist": F.when(F.col("disable"), F.lit("false")),
            "always_refresh": F.when(F.col("always_refresh"), F.lit("true")).when(F.col("disable"), F.lit("")),
        },
    )
    touched = F.coalesce(F.col("disable") | F.col("refresh"), F.lit(False))
    return joined.withColumn("config_json", F.when(touched, config).otherwise(F.col("config_json"))).select(
        *sources.columns, F.coalesce("refresh", F.lit(False)).alias("due")
    )


def _without(members: Column, name: str) -> Column:
    return F.map_filter(members, lambda k, _: k != name)


def set_json_flags(config: Column, flags: dict[str, Column]) -> Column:
    """Set, remove or leave top-level flags of a JSON object.

    A flag value is JSON text to set, an empty string to remove the member, or null to leave it.
    Other members keep their own JSON form.
    """
    members = F.coalesce(F.from_json(config, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    for name, value in flags.items():
        without = _without(members, name)
        added = F.map_concat(without, F.create_map(F.lit(name), F.parse_json(F.coalesce(T.blank_to_null(value), F.lit("null")))))
        members = F.when(value.isNull(), members).when(value == "", without).otherwise(added)
    return F.to_json(members)


# --- Re-extraction --------------------------------------------------------------------------
def rescrape(
    events: DataFrame,
    extractions: DataFrame,
    now: datetime,
    region: C.Region = C.Region(),
    order: tuple[str, ...] = (),
    classifications: DataFrame | None = None,
) -> DataFrame:
    """Merge fresh extraction results (``id`` + extraction fields) into events; adds ``rescraped``.

    Of several results for one event the last by ``order`` (columns of ``extractions``) counts. Dates are read as in ingestion.

    Results that are no event or below 0.3 confidence change nothing. A found start counts only
    before 2050, a title only when longer than five characters; the event is classified anew, by its row in ``classifications`` (id, event_type,
    topics; of several the last by ``order`` where it has these columns) or else by the word rules. An empty type or topic list changes nothing.
    """
    fields = ("title", "description", "start_at", "end_at", "venue_name", "locality", "registration_url", "mode")
    fresh = tables.last_per_key(extractions, "id", order).select(
        "id",
        (~F.coalesce("not_an_event", F.lit(False)) & (F.coalesce("confidence", F.lit(0.0)) >= 0.3)).alias("_use"),
        *[F.col(f).alias(f"_{f}") for f in fields],
    )
    joined = events.join(fresh, "id", "left")
    use = F.coalesce("_use", F.lit(False))

    def typed(c: str) -> Column:
        return parse_datetime(F.col(f"_{c}"), region.zone, now).cast(events.schema[c].dataType)

    new = {f: T.blank_to_null(F.col(f"_{f}")) for f in ("description", "venue_name", "locality", "registration_url", "mode")}
    new["title"] = F.when(F.length("_title") > 5, F.col("_title"))
    new["start_at"] = F.when(F.year(typed("start_at")) < C.JUNK_YEAR, typed("start_at"))
    new["end_at"] = typed("end_at")
    found = F.lit(False)
    for name in ("start_at", "end_at", "title", "description", "venue_name"):
        found = found | new[name].isNotNull()
    merged = joined.withColumns({"rescraped": use, "fields_found": use & found}).withColumns(
        {f: F.when(F.col("rescraped") & v.isNotNull(), v).otherwise(F.col(f)) for f, v in new.items()}
    )
    again = R.classification(F.col("title"), F.col("description"), F.col("organizer_name"), F.col("community_name"), region)
    if classifications is not None:
        given = tables.last_per_key(classifications, "id", tuple(c for c in order if c in classifications.columns))
        given = given.select("id", F.struct("event_type", "topics").alias("_given"))
        merged = merged.join(given, "id", "left")
        again = F.coalesce("_given", F.struct(again["event_type"].alias("event_type"), again["topics"].alias("topics")))
    merged = merged.withColumn("_class", F.when(F.col("rescraped"), again))
    merged = merged.withColumns(
        {
            "event_type": F.coalesce(T.blank_to_null(F.col("_class.event_type")), "event_type"),
            "topics": F.when(F.size("_class.topics") > 0, F.col("_class.topics")).otherwise(F.col("topics")),
            "updated_at": F.when(F.col("rescraped"), instant(now)).otherwise(F.col("updated_at")).cast(events.schema["updated_at"].dataType),
        }
    )
    return merged.select(*events.columns, "rescraped", "fields_found")


def repair_bad_dates(
    events: DataFrame,
    extractions: DataFrame,
    now: datetime,
    region: C.Region = C.Region(),
    order: tuple[str, ...] = (),
    classifications: DataFrame | None = None,
) -> DataFrame:
    """Events with placeholder dates after re-extraction, each with its ``verdict``.

    ``fixed`` has a real date now, ``deleted`` was updated but still has none, ``skipped`` had
    nothing usable. Drop the deleted ones from the catalogue with ``tables.delete``.
    """
    bad = events.filter(F.col("start_at") > instant(_JUNK))
    done = rescrape(bad, extractions, now, region, order, classifications)
    verdict = (
        F.when(~F.col("fields_found"), "skipped").when(F.year("start_at") < C.JUNK_YEAR, "fixed").otherwise("deleted")
    )
    return done.withColumn("verdict", verdict).drop("rescraped", "fields_found")


def repair_tally(repaired: DataFrame) -> DataFrame:
    return repaired.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("verdict") == "fixed").alias("fixed"),
        F.count_if(F.col("verdict") == "deleted").alias("deleted"),
        F.count_if(F.col("verdict") == "skipped").alias("skipped"),
    )


# --- Edits ----------------------------------------------------------------------------------
def edit_events(events: DataFrame, patches: DataFrame, now: datetime) -> DataFrame:
    """Batch edit with an allow-list; null means unchanged."""
    return tables.patch(events, patches, C.EVENT_PATCH_FIELDS, stamp={"updated_at": instant(now)})


def feature(events: DataFrame, flags: DataFrame, now: datetime) -> DataFrame:
    """Apply (id, is_featured)."""
    return tables.patch(events, flags, ["is_featured"], stamp={"updated_at": instant(now)})


def cancel(events: DataFrame, ids: DataFrame, now: datetime) -> DataFrame:
    return tables.patch(
        events, ids.select("id", F.lit(True).alias("is_cancelled")), ["is_cancelled"], stamp={"updated_at": instant(now)}
    )
