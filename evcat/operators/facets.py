"""Counts over the catalogue: facets, calendar days, dashboard."""
from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evcat import config as C
from evcat.functions import text as T
from evcat.functions.dates import display_day_label
from evcat.operators.catalogue import live
from evcat.session import instant


def topics(events: DataFrame, now: datetime, limit: int = 200) -> DataFrame:
    """(name, count), every occurrence counted, most frequent first."""
    names = events.filter(live(now)).select(F.explode("topics").alias("name"))
    return (
        names.select(T.strip_ws(F.col("name")).alias("name"))
        .filter("name <> ''")
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.lower("name"), "name")
        .limit(limit)
    )


def _names(events: DataFrame, column: str, now: datetime, limit: int) -> DataFrame:
    return (
        events.filter(live(now))
        .filter(F.trim(F.col(column)) != "")
        .groupBy(F.col(column).alias("name"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), "name")
        .limit(limit)
    )


def communities(events: DataFrame, now: datetime, limit: int = 200) -> DataFrame:
    return _names(events, "community_name", now, limit)


def localities(events: DataFrame, now: datetime, limit: int = 200) -> DataFrame:
    return _names(events, "locality", now, limit)


def more_communities(found: DataFrame, shown: DataFrame) -> DataFrame:
    """A community facet without the names already shown, ignoring case."""
    names = shown.select(F.lower("name").alias("_low")).distinct()
    return found.join(names, F.lower(found["name"]) == names["_low"], "left_anti")


def day_key(start: Column) -> Column:
    return F.date_format(start, "yyyy-MM-dd")


def with_days(events: DataFrame, zone: str = C.DISPLAY_ZONE) -> DataFrame:
    """Calendar rows with their day key (UTC) and label (display zone).

    Rows stay rows: a day is a sort key, not a collected list, so a busy day is no larger a record.
    """
    return events.select("*", day_key(F.col("start_at")).alias("day"), display_day_label(F.col("start_at"), zone).alias("day_label")).orderBy("day", "start_at", "id")


def by_day(events: DataFrame, zone: str = C.DISPLAY_ZONE) -> DataFrame:
    """(day, label, count, first start, last start); the label is that of the day's first event."""
    first = F.min("start_at")
    return (
        events.groupBy(day_key(F.col("start_at")).alias("day"))
        .agg(F.count(F.lit(1)).alias("count"), first.alias("first_start"), F.max("start_at").alias("last_start"))
        .withColumn("day_label", display_day_label(F.col("first_start"), zone))
        .orderBy("day")
    )


def dashboard(events: DataFrame, moderation: DataFrame, sources: DataFrame, now: datetime) -> DataFrame:
    """One row of counts, one pass per table; the partial rows are added, not cross-joined."""
    published = F.col("published_at").isNotNull()
    week = F.col("start_at").between(instant(now), instant(now + timedelta(days=7)))
    parts = [
        events.agg(
            F.count_if(published).alias("events_total"),
            F.count_if(F.coalesce(published & week, F.lit(False))).alias("events_this_week"),
        ),
        moderation.agg(F.count_if(F.col("status") == "pending").alias("pending_moderation")),
        sources.agg(
            F.count_if("enabled").alias("sources_active"),
            F.count_if(F.col("status") == "blacklisted").alias("sources_blacklisted"),
        ),
    ]
    names = [name for part in parts for name in part.columns]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
