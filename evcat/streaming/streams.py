"""The same work as Structured Streaming queries.

Every stream runs with ``availableNow`` by default: one run takes what has arrived and stops, which
is one scheduled run. State and outputs live in folders the caller names; a batch writes only
folders with its own batch number, so a batch that is repeated after a failure replaces itself.
"""
from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evcat import config as C
from evcat import schemas
from evcat.functions.dates import dedupe_key
from evcat.functions.text import content_hash
from evcat.operators import lifecycle
from evcat.plans.ingest import ingest
from evcat.session import cut


def _start(df: DataFrame, checkpoint: str, mode: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(each)
        .start()
    )


# --- Live counts ----------------------------------------------------------------------------
def daily_counts(stream: DataFrame, at: str, key: Column, out: str, checkpoint: str, late: str = "40 days") -> StreamingQuery:
    """Counts per day and key as one partial count per batch; late rows are told apart, none is dropped.

    A row is late when it lies more than ``late`` before the newest time of the batches before its own. Its counts go to the side table ``out/late``, those
    of the others to ``out/counts``; a batch that is repeated replaces both. Null times count under a null day and are never late.
    """

    def one(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], "high TIMESTAMP").write.mode("ignore").parquet(f"{out}/marks/batch=-1")
        marks = spark.read.schema("high TIMESTAMP, batch BIGINT").parquet(f"{out}/marks").filter(F.col("batch") < n)
        edge = marks.agg((F.max("high") - F.expr(f"INTERVAL {late}")).alias("edge"))  # one row
        rows = batch.select(F.col(at).cast("timestamp").alias("_at"), key.alias("name")).join(F.broadcast(edge))
        behind = F.coalesce(F.col("_at") < F.col("edge"), F.lit(False))
        counted = cut(
            rows.groupBy(F.date_trunc("day", "_at").alias("day"), "name", behind.alias("behind"))
            .agg(F.count(F.lit(1)).alias("count"), F.max("_at").alias("high"))
        )
        for name, part in (("counts", ~F.col("behind")), ("late", F.col("behind"))):
            counted.filter(part).select("day", "name", "count").write.mode("overwrite").parquet(f"{out}/{name}/batch={n}")
        counted.agg(F.max("high").alias("high")).write.mode("overwrite").parquet(f"{out}/marks/batch={n}")

    return _start(stream, checkpoint, "append", one)


def read_daily_counts(spark: SparkSession, out: str, merged: bool = True) -> DataFrame:
    """Count per day and key over all batches; ``merged`` adds what came late."""
    schema = "day TIMESTAMP, name STRING, count BIGINT, batch BIGINT"
    rows = spark.read.schema(schema).parquet(f"{out}/counts")
    if merged:
        rows = rows.unionByName(late_counts(spark, out))
    return rows.groupBy("day", "name").agg(F.sum("count").alias("count"))


def late_counts(spark: SparkSession, out: str) -> DataFrame:
    """The side table: counts of late rows per batch, day and key."""
    return spark.read.schema("day TIMESTAMP, name STRING, count BIGINT, batch BIGINT").parquet(f"{out}/late")


# --- Duplicate suppression on arrival -------------------------------------------------------
def drop_repeats(stream: DataFrame, out: str, checkpoint: str, hold: str = "30 days") -> StreamingQuery:
    """First arrival per title, half day and organizer; a key is held for ``hold`` after its first arrival.

    The watermark follows the clock of the batch a row arrives in, not a time written in the row, so no row comes too late and none is
    dropped but repeats. Key equality only; containment is the batch path's work.
    """
    keyed = stream.withColumn("_arrived", F.current_timestamp()).withColumn(
        "dedupe_key", dedupe_key(F.col("title"), F.col("start_at"), F.col("organizer_name"))
    )
    first = keyed.withWatermark("_arrived", hold).dropDuplicatesWithinWatermark(["dedupe_key"]).drop("_arrived")
    return (
        first.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", out)
        .trigger(availableNow=True)
        .start()
    )


# --- Ingestion ------------------------------------------------------------------------------
TABLES = {
    "events": schemas.EVENTS,
    "raw_events": schemas.RAW_EVENTS,
    "moderation": schemas.MODERATION,
    "snapshots": schemas.SNAPSHOTS,
    "runs": schemas.CRAWL_RUNS,
}


class Store:
    """Catalogue tables as runs of batches: the last row per key is current, unless it says ``deleted``.

    A batch is a run of its own; the keys of a run are distinct. Whenever ``fan`` runs of one length are complete, ``add`` merges them into one, so a table is read from a few runs and a row
    is rewritten once per level. A run that begins with the first batch drops deleted rows for good. Rows lie in ``buckets`` folders by a hash of their key,
    and ``current(..., keys=...)`` opens only the buckets of those keys. A run counts from the moment its row stands in the list of runs; a
    repeated batch replaces its run and the merged runs that end with it. Batches are numbered from 0 and may be left out.
    """

    KEYS = {
        "events": ["id"],
        "raw_events": ["id"],
        "moderation": ["id"],
        "snapshots": ["source_id", "url_hash", "schema_version", "page_hash", "stored_at"],
        "runs": ["id"],
    }
    BUCKET_BY = {"snapshots": ["source_id", "url_hash"]}

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str] = TABLES, fan: int = 4, buckets: int = 16):
        self.spark, self.root, self.schemas, self.fan, self.buckets = spark, root, schemas, fan, buckets
        for name in schemas:
            # An empty first entry, so a table can be read before its first batch.
            spark.createDataFrame([], "first BIGINT, last BIGINT").write.mode("ignore").parquet(f"{self.path(name)}/listed/none")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*self.BUCKET_BY.get(name, self.KEYS[name])), F.lit(self.buckets)).cast("int")

    def runs(self, name: str, first: int, stop: int) -> list[tuple[int, int]]:
        """The fewest listed runs that cover the batches from ``first`` up to ``stop``."""
        listed = self.spark.read.schema("first BIGINT, last BIGINT").option("recursiveFileLookup", "true").parquet(f"{self.path(name)}/listed")
        inside = listed.filter((F.col("first") >= first) & (F.col("last") < stop)).groupBy("first").agg(F.max("last").alias("last"))
        cover: list[tuple[int, int]] = []
        for a, b in sorted(tuple(r) for r in inside.collect()):  # one row per run, not per key
            if not cover or a > cover[-1][1]:
                cover.append((a, b))
        return cover

    def _rows(self, name: str, runs: list[tuple[int, int]]) -> DataFrame:
        schema = self.schemas[name] + ", deleted BOOLEAN, batch BIGINT, bucket INT"
        if not runs:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema).option("basePath", self.path(name))
        return read.parquet(*[f"{self.path(name)}/run={a}-{b}" for a, b in runs]).drop("run")

    def _put(self, name: str, rows: DataFrame, first: int, last: int, forget: bool = False) -> None:
        """Write a run: the last row of every key, without deleted ones if ``forget``. One exchange deals the rows by parts of buckets, so that neither the
        choice of the last rows nor the files of a bucket need another, and a bucket is spread over several tasks."""
        parts = max(1, 2 * int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        part = F.pmod(F.hash(*self.KEYS[name]), F.lit(parts))
        kept = self._latest(name, rows.withColumn("_part", part).repartition("bucket", "_part"), "bucket", "_part").drop("_part")
        kept = kept.filter("NOT deleted") if forget else kept
        kept.write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path(name)}/run={first}-{last}")
        entry = self.spark.range(1).select(F.lit(first).cast("bigint").alias("first"), F.lit(last).cast("bigint").alias("last"))
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.path(name)}/listed/{first}-{last}")

    def add(self, name: str, rows: DataFrame, batch: int, gone: DataFrame | None = None) -> None:
        """Add the rows of a batch; ``gone`` has the keys of rows to delete."""
        logged = rows.withColumn("deleted", F.lit(False))
        if gone is not None:
            keys = gone.select(*self.KEYS[name]).withColumn("deleted", F.lit(True))
            logged = logged.unionByName(keys, allowMissingColumns=True)
        self._put(name, logged.withColumns({"batch": F.lit(batch).cast("bigint"), "bucket": self._bucket(name)}), batch, batch)
        span = self.fan
        while (batch + 1) % span == 0:
            first = batch + 1 - span
            # Only runs shorter than the one to be written, so that a repeated batch reads none of its own merges.
            parts = [r for k in range(self.fan) for r in self.runs(name, first + k * span // self.fan, first + (k + 1) * span // self.fan)]
            self._put(name, self._rows(name, parts), first, batch, forget=first == 0)
            span *= self.fan

    def _latest(self, name: str, rows: DataFrame, *dealt: str) -> DataFrame:
        """The last row per key; a window, so columns that nobody asks for are not read. A key has a row per run at most, but in a batch being written."""
        newest = Window.partitionBy(*dealt, *self.KEYS[name]).orderBy(F.desc("batch"), F.desc("deleted"))
        return rows.withColumn("_place", F.row_number().over(newest)).filter("_place = 1").drop("_place")

    def current(self, name: str, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """Current rows, as of the batches before ``before``; with ``keys`` (the columns that choose the bucket) only rows of these keys."""
        runs = self.runs(name, 0, before if before is not None else 1 << 62)
        rows = self._rows(name, runs)
        if keys is not None:
            by = self.BUCKET_BY.get(name, self.KEYS[name])
            touched = [r[0] for r in keys.select(self._bucket(name).alias("bucket")).distinct().collect()]  # at most one row per bucket
            rows = rows.filter(F.col("bucket").isin(touched)).join(keys.select(*by).distinct(), by, "left_semi")
        # The keys of one run are distinct already.
        return (self._latest(name, rows) if len(runs) > 1 else rows).filter("NOT deleted").drop("batch", "deleted", "bucket")


def ingest_pages(
    pages: DataFrame,
    sources: DataFrame,
    store: Store,
    checkpoint: str,
    now: Callable[[int], datetime],
    region: C.Region = C.Region(),
) -> StreamingQuery:
    """Ingest arriving pages batch by batch; a batch sees the catalogue of the batches before it.

    Unchanged pages are skipped by the snapshot table. ``now`` gives the clock of a batch.
    """

    def one(batch: DataFrame, n: int) -> None:
        pages_of_batch = batch.select("source_id", content_hash(F.col("url")).alias("url_hash"))
        snapshots = store.current("snapshots", n, pages_of_batch)
        result = ingest(batch, sources, store.current("events", n), store.current("raw_events", n), snapshots, now(n), region)
        store.add("events", result.event_updates, n)
        store.add("raw_events", result.raw_updates, n)
        store.add("moderation", result.moderation, n)
        store.add("runs", result.runs, n)
        # Last, so that a batch that failed half-way reads its pages again.
        store.add("snapshots", result.snapshots, n)

    return _start(pages, checkpoint, "append", one)


def expire_events(store: Store, batch: int, now: datetime) -> None:
    """The recurring expiry job on the store: expired events as new rows, events with placeholder dates as deletes."""
    events = store.current("events", before=batch)
    junk = lifecycle.junk_pass(now)
    hit = lifecycle.expiry_pass(now).isNotNull()
    store.add("events", lifecycle.expire(events.filter(hit & ~junk), now), batch, gone=events.filter(junk))


def watched_pages(pages: DataFrame, sources: DataFrame, events: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """The watchlist job: sources with their flags edited, and the pages of the sources it wants read now."""
    refreshed = lifecycle.refresh_watchlist(sources, events, now)
    due = refreshed.filter("due").select(F.col("id").alias("source_id"))
    return refreshed.drop("due"), pages.join(due, "source_id", "left_semi")
