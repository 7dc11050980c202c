"""Change detection on a stream: the last hash of every page lives in the state of the query."""
from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from evcat import config as C
from evcat.session import broadcast_if_small
from evcat.sources import pages as P

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PRINT = "source_id string, url_hash string, url string, fetched_at timestamp, page_hash string"
LAST = "page_hash string, fetched_at timestamp"


class LastHash(StatefulProcessor):
    """Per page: emits a fetch whose hash differs from the fetch before it, and keeps the last hash.

    Fetches of one batch go by (fetched_at, page_hash), nulls first. Batches go by arrival: a fetch older than the state is compared with the
    state like any other.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", LAST, self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # Equal fetches are one; what is held is a time and a hash per fetch of one page in one batch.
        urls: dict[tuple, str | None] = {}
        always = False
        for row in rows:
            at = (row.fetched_at is not None, row.fetched_at, row.page_hash)
            urls[at] = row.url
            always = always or row.always
        before = self.last.get()
        known = before[0] if before is not None else None
        seen = before is not None
        for at in sorted(urls, key=lambda a: (a[0], a[1].timestamp() if a[0] else 0.0, a[2] or "")):
            if not seen or at[2] != known or always:
                yield Row(source_id=key[0], url_hash=key[1], url=urls[at], fetched_at=at[1], page_hash=at[2])
            known, seen = at[2], True
        self.last.update((known, at[1]))

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self.last.update((initialState.page_hash, initialState.fetched_at))

    def close(self) -> None:
        pass


def unchanged_skipped(
    pages: DataFrame,
    snapshots: DataFrame,
    sources: DataFrame,
    out: str,
    checkpoint: str,
    version: str = C.SNAPSHOT_VERSION,
    ttl_ms: int | None = None,
) -> StreamingQuery:
    """Fingerprints of arriving pages whose content differs from the fetch before, as Parquet in ``out``.

    The first run takes the stored snapshots of ``version`` as the state to start from; later runs go on from the checkpoint. Only hashes enter the
    state, page bodies stay where they are. A page not seen for ``ttl_ms`` of processing time counts as new. Sources with ``always_refresh``
    pass in any case. Null sources and URLs are keys of their own. A task holds a time and a hash per fetch of one page in one batch, so the size of a
    batch (``maxFilesPerTrigger``) bounds it.
    """
    spark = pages.sparkSession
    flags = sources.groupBy(F.col("id").alias("source_id")).agg(
        F.max(F.coalesce(F.get_json_object("config_json", "$.always_refresh") == "true", F.lit(False))).alias("always")
    )
    stored = snapshots.filter(F.col("schema_version") == version).groupBy("source_id", "url_hash").agg(
        F.max_by(F.struct("page_hash", F.col("stored_at").cast("timestamp").alias("fetched_at")), "stored_at").alias("s")
    )
    initial = stored.select("source_id", "url_hash", "s.*").groupBy("source_id", "url_hash")
    prints = P.fingerprints(pages).select("source_id", "url_hash", "url", F.col("fetched_at").cast("timestamp").alias("fetched_at"), "page_hash")
    prints = prints.join(broadcast_if_small(flags), "source_id", "left").withColumn("always", F.coalesce("always", F.lit(False)))
    changed = prints.groupBy("source_id", "url_hash").transformWithState(
        statefulProcessor=LastHash(ttl_ms),
        outputStructType=PRINT,
        outputMode="append",
        timeMode="processingTime" if ttl_ms else "none",
        initialState=initial,
    )
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # this kind of state needs it; the checkpoint remembers it
    try:
        return (
            changed.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).option("path", out)
            .trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
