"""Refresh existing events from their duplicates, only where the new data is better."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evcat.operators.startmaps import chained
from evcat.session import instant

FILL_FIELDS = ("description", "short_description", "poster_url", "venue_name", "locality")


def settle_starts(events: DataFrame, dups: DataFrame, slices: int | None = None) -> DataFrame:
    """(id, start_at) for events whose start is replaced, applying duplicates in arrival order.

    The rule is a chain: each accepted start decides what the next one is compared with. Offers compose to maps of the start
    (``startmaps``), so an event with many offers is spread over slices like any other; nothing depends on its size.
    """
    offers = dups.filter("start_at IS NOT NULL").select(
        F.col("match").alias("id"), F.unix_micros(F.col("start_at").cast("timestamp")).alias("new_us"), "seq"
    )
    known = events.select(
        "id",
        F.unix_micros(F.col("start_at").cast("timestamp")).alias("start_us"),
        F.unix_micros(F.col("published_at").cast("timestamp")).alias("published_us"),
    )
    moved = chained(offers.join(known.filter("start_us IS NOT NULL"), "id"), slices).filter("moved_us <> start_us")
    kind = events.schema["start_at"].dataType
    return moved.select("id", F.timestamp_micros("moved_us").cast(kind).alias("start_at"))


def refresh_touched(events: DataFrame, dups: DataFrame, now: datetime) -> DataFrame:
    """Only the events that have duplicates, refreshed: what a log of changes needs."""
    touched = dups.select(F.col("match").alias("id")).distinct()
    return refresh_existing(events.join(touched, "id", "left_semi"), dups, now)


def refresh_existing(events: DataFrame, dups: DataFrame, now: datetime) -> DataFrame:
    """All events, those with better duplicate data updated; adds ``refreshed``.

    ``dups`` has ``match`` (event id), ``seq`` (arrival), start_at, end_at and the fill fields. An
    empty field takes the first non-empty offer, ``end_at`` the last offer, ``start_at`` follows
    ``settle_starts``. A moved start counts for later batches, not for matching inside this one.
    """
    offers = [
        F.min_by(f, F.when(F.col(f) != "", F.col("seq"))).alias(f"_{f}") for f in FILL_FIELDS
    ] + [F.max_by("end_at", F.when(F.col("end_at").isNotNull(), F.col("seq"))).alias("_end")]
    news = dups.groupBy(F.col("match").alias("id")).agg(*offers)
    starts = settle_starts(events, dups).withColumnRenamed("start_at", "_start")
    joined = events.join(news, "id", "left").join(starts, "id", "left")
    value = {f: F.coalesce(F.when(F.col(f) != "", F.col(f)), F.col(f"_{f}"), F.col(f)) for f in FILL_FIELDS}
    value["start_at"] = F.coalesce("_start", "start_at")
    value["end_at"] = F.coalesce("_end", "end_at")
    same = F.lit(True)
    for name, new in value.items():
        same = same & new.eqNullSafe(F.col(name))
    out = joined.withColumn("refreshed", ~same)
    value["updated_at"] = F.when(F.col("refreshed"), instant(now)).otherwise(F.col("updated_at"))
    columns = [value[c].cast(events.schema[c].dataType).alias(c) if c in value else F.col(c) for c in events.columns]
    return out.select(*columns, "refreshed")
