"""Duplicate detection against the catalogue and inside a batch.

A new event duplicates an existing one when the URLs are equal or, failing that, when its title is
contained in the existing title and the starts are at most twelve hours apart. Inside a batch the
rule is sequential: a row is compared with the rows *kept* before it, in arrival order.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evcat.functions.text import norm
from evcat.operators.ordered import first_within, micros
from evcat.operators.titles import titles_in_reach
from evcat.session import cut, run_folder

REACH_SECONDS = 12 * 3600
_REACH = REACH_SECONDS * 1_000_000
# Half days of a title that one task streams over: bounded by the calendar, whatever the title's history.
BLOCK_HALVES = 16


def _half_days(us: str) -> str:
    return f"({us} - pmod({us}, {_REACH})) div {_REACH}"


# --- Against the catalogue ------------------------------------------------------------------
def match_by_url(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(url, match): the first catalogue row, by created_at and id, with the same URL."""
    wanted = new.select("url").filter("url <> ''").distinct()
    known = existing.select(F.col("canonical_url").alias("url"), "created_at", "id").join(wanted, "url", "left_semi")
    return known.groupBy("url").agg(F.min(F.struct("created_at", "id")).alias("match")).select("url", F.col("match.id").alias("match"))


def match_by_title(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(title, us, match): the first catalogue row whose title contains ``title`` within reach.

    ``new`` has the compared form of the title and the start in microseconds. Catalogue rows in
    half days no new row can reach are dropped before titles are compared.
    """
    half = F.expr(_half_days("us"))
    probes = new.select("title", "us").filter("title <> '' AND us IS NOT NULL").distinct()
    days = probes.select(half.alias("half")).distinct().select(F.explode(F.expr("sequence(half - 1, half + 1)")).alias("half")).distinct()
    old = (
        existing.select(F.lower("title").alias("title"), micros(F.col("start_at")).alias("us"), "created_at", "id")
        .withColumn("half", half)
        .join(days, "half", "left_semi")
        .groupBy("title", "us", "half")
        .agg(F.min(F.struct("created_at", "id")).alias("value"))
    )
    old = cut(old)  # read for its titles, their half days and the rows under each title
    pairs = titles_in_reach(probes.select("title", half.alias("half")), old)
    found = first_within(_under_inner(old, pairs), probes.withColumnRenamed("title", "key"), REACH_SECONDS)
    return found.select(F.col("key").alias("title"), "us", F.col("value.id").alias("match"))


def _under_inner(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (title, us, half, value) under every title they contain, where their half day is in its reach."""
    pairs = pairs.withColumnsRenamed({"half": "_half"})
    met = rows.join(pairs, (rows["title"] == pairs["outer"]) & (rows["half"] == pairs["_half"]))
    return met.select(F.col("inner").alias("key"), "us", "value")


def match_whole_title(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(title, match) for rows without a start: equal titles, ignoring case."""
    known = existing.select(F.lower("title").alias("title"), "created_at", "id").join(new.select("title").distinct(), "title", "left_semi")
    return known.groupBy("title").agg(F.min(F.struct("created_at", "id")).alias("match")).select("title", F.col("match.id").alias("match"))


def match_catalogue(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Add ``match``, id of the catalogue event a row duplicates, URL before title, and ``by_url``."""
    by_url = match_by_url(new, existing).withColumnRenamed("match", "_by_url")
    by_title = match_by_title(new, existing).withColumnRenamed("match", "_by_title")
    dateless = new.filter("us IS NULL")
    by_whole = match_whole_title(dateless, existing).select("title", F.lit(True).alias("_no_start"), F.col("match").alias("_by_whole"))
    out = (
        new.withColumn("_no_start", F.col("us").isNull())
        .join(by_url, "url", "left")
        .join(by_title, ["title", "us"], "left")
        .join(by_whole, ["title", "_no_start"], "left")
    )
    out = out.withColumns({"match": F.coalesce("_by_url", "_by_title", "_by_whole"), "by_url": F.col("_by_url").isNotNull()})
    return out.drop(
        "_by_url", "_by_title", "_by_whole", "_no_start"
    )


# --- Inside a batch -------------------------------------------------------------------------
_KEEP, _DROP, _WAIT = 1, 0, -1


def _settle_in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Settle the blocks of half days of each title in arrival order.

    Rows come sorted by title, block and arrival, so only the state of the current block is held: its kept and its open
    starts per half day. Two starts in one half day always reach each other, so a half day holds at most one kept row.
    Rows that wait for another title or URL stay open, and so do rows that could follow them. Rows of the half days beside
    the block are settled in their own block; here they only keep rows open that could follow them.
    """
    current, kept, open_low, open_high = None, {}, {}, {}
    for batch in batches:
        verdicts = []
        for title, block, us, blocked, beside in zip(batch["title"], batch["block"], batch["us"], batch["blocked"], batch["beside"]):
            if (title, block) != current:
                current, kept, open_low, open_high = (title, block), {}, {}, {}
            half = us // _REACH
            taken = any(h in kept and abs(kept[h] - us) <= _REACH for h in (half - 1, half, half + 1))
            unsure = (
                blocked
                or beside
                or half in open_low
                or open_high.get(half - 1, us - _REACH - 1) >= us - _REACH
                or open_low.get(half + 1, us + _REACH + 1) <= us + _REACH
            )
            verdicts.append(_DROP if taken else _WAIT if unsure else _KEEP)
            if verdicts[-1] == _WAIT:
                open_low[half] = min(us, open_low.get(half, us))
                open_high[half] = max(us, open_high.get(half, us))
            elif verdicts[-1] == _KEEP:
                kept[half] = us
        out = batch[["title", "us", "url", "seq"]].assign(verdict=verdicts)
        yield out[~batch["beside"]]


def _in_blocks(fronts: DataFrame, halves: int) -> DataFrame:
    """Fronts under their block of half days, and those of a block's first and last half day under the block beside it as well."""
    half = F.expr(_half_days("us"))
    here = F.pmod(half, F.lit(halves))
    block = ((half - here) / halves).cast("bigint")
    beside = [F.when(here == 0, block - 1), F.when(here == halves - 1, block + 1)]
    places = F.array_append(
        F.transform(F.array_compact(F.array(*beside)), lambda b: F.struct(b.alias("block"), F.lit(True).alias("beside"))),
        F.struct(block.alias("block"), F.lit(False).alias("beside")),
    )
    return fronts.withColumn("place", F.explode(places)).select("*", "place.*").drop("place")


def _reach_of(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows repeated under every title they can suppress, as points for ``first_within``."""
    grouped = rows.groupBy("title", "us").agg(F.min("seq").alias("value"))
    return _under_inner(grouped.withColumn("half", F.expr(_half_days("us"))), pairs)


def _earliest(rows: DataFrame, pairs: DataFrame, probes: DataFrame, name: str) -> DataFrame:
    found = first_within(_reach_of(rows, pairs), probes.withColumnRenamed("title", "key"), REACH_SECONDS)
    return found.select(F.col("key").alias("title"), "us", F.col("value").alias(name))


def greedy_keep(rows: DataFrame, pairs: DataFrame, halves: int = BLOCK_HALVES) -> DataFrame:
    """Rows (title, us, url, seq) that survive the sequential duplicate rule among themselves.

    ``pairs`` lists every title containment (inner, outer, half) within reach, equal titles included. Each round looks
    only at *fronts*, the first open row of a (title, start). A front is blocked while an earlier
    open row has its URL or a longer title within reach. Every block of ``halves`` half days of a title is settled in
    one pass; where it touches a block with open rows, the rows that depend on those wait for the next round. If fronts had to
    wait, everything the kept rows suppress is dropped and the next round starts. The first open front never waits, and
    rounds are as many as one row's verdict waits for another across blocks, titles or URLs.
    """
    longer = pairs.filter("inner <> outer")
    nested = not longer.isEmpty()
    open_rows = cut(rows.select("title", "us", "url", "seq"))
    shared_urls = not open_rows.filter("url <> ''").groupBy("url").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    folder, schema, turn, waiting = run_folder(rows.sparkSession, "kept"), open_rows.schema, 0, True
    while waiting:
        fronts = open_rows.groupBy("title", "us").agg(F.min_by("url", "seq").alias("url"), F.min("seq").alias("seq"))
        blocked = F.lit(False)
        if shared_urls:
            first = open_rows.filter("url <> ''").groupBy("url").agg(F.min("seq").alias("_url_first"))
            fronts = fronts.join(first, "url", "left")
            blocked = blocked | F.coalesce(F.col("_url_first") < F.col("seq"), F.lit(False))
        if nested:
            fronts = fronts.join(_earliest(open_rows, longer, fronts, "_title_first"), ["title", "us"], "left")
            blocked = blocked | F.coalesce(F.col("_title_first") < F.col("seq"), F.lit(False))
        blocks = _in_blocks(fronts.withColumn("blocked", blocked).select("title", "us", "url", "seq", "blocked"), halves)
        settled = cut(
            blocks.repartition("title", "block")
            .sortWithinPartitions("title", "block", "seq")
            .mapInPandas(_settle_in_order, "title string, us bigint, url string, seq bigint, verdict int")
        )
        newly = settled.filter(F.col("verdict") == _KEEP).drop("verdict")
        newly.write.mode("overwrite").parquet(f"{folder}/turn={turn}")
        turn += 1
        # Rows behind a settled front share its title and start, hence its fate.
        waiting = not settled.filter(F.col("verdict") == _WAIT).isEmpty()
        if waiting:
            open_rows = cut(drop_followers(open_rows, newly, pairs))
    return rows.sparkSession.read.schema(schema).parquet(*[f"{folder}/turn={n}" for n in range(turn)])


def followers(rows: DataFrame, kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add ``dup_of``: seq of the kept row that makes a row a duplicate, URL before title."""
    by_url = kept.filter("url <> ''").groupBy("url").agg(F.min("seq").alias("_url_seq"))
    by_title = _earliest(kept, pairs, rows.select("title", "us"), "_title_seq")
    joined = rows.join(by_url, "url", "left").join(by_title, ["title", "us"], "left")
    earlier = [F.when(F.col(c) < F.col("seq"), F.col(c)) for c in ("_url_seq", "_title_seq")]
    return joined.withColumn("dup_of", F.coalesce(*earlier)).drop("_url_seq", "_title_seq")


def drop_followers(open_rows: DataFrame, newly: DataFrame, pairs: DataFrame) -> DataFrame:
    done = newly.select("seq")
    marked = followers(open_rows, newly, pairs).filter("dup_of IS NULL").drop("dup_of")
    return marked.join(done, "seq", "left_anti")


def batch_duplicates(rows: DataFrame, halves: int = BLOCK_HALVES) -> DataFrame:
    """Add ``dup_of`` to a batch with (title, us, url, seq, publishable); title and us are given.

    Only publishable rows can be kept and so suppress others; any row can be a duplicate. A row
    that is neither becomes a candidate for moderation.
    """
    titles = rows.select("title", F.expr(_half_days("us")).alias("half")).distinct()
    pairs = cut(titles_in_reach(titles, titles))
    kept = greedy_keep(rows.filter("publishable"), pairs, halves)
    return followers(rows, kept, pairs)


def candidates(df: DataFrame, title: str = "title", start: str = "start_at", url: str = "canonical_url") -> DataFrame:
    """Add the compared forms used by this module: title (lower, stripped), us and url."""
    return df.select(
        "*",
        norm(F.col(title)).alias("_title"),
        micros(F.col(start)).alias("us"),
        F.coalesce(F.col(url), F.lit("")).alias("url"),
    )


