"""Page bodies under the hash of their content: each content is stored once, and bodies are never shuffled to store them."""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evcat import config as C
from evcat.session import BROADCAST_ROWS, broadcast_if_small
from evcat.sources.pages import print_columns

KEYS = "source_id STRING, url_hash STRING, schema_version STRING, stored_at TIMESTAMP, page_hash STRING, batch BIGINT"
BODIES = "page_hash STRING, body STRING, batch BIGINT, part INT"
Block = tuple[str, int]


class BodyStore:
    """Two tables below ``folder``: ``keys`` has a row per stored page with the hash of its body, ``bodies`` a row per distinct body.

    ``add`` reads a page table twice and moves only narrow rows: the first pass hashes every body and notes its place (file and row) in the page table;
    the first place of every hash that no earlier batch holds is its owner. The second pass copies the owners' bodies, file by file, with the owners of
    a stretch of files as a broadcast table. A stretch is cut where it would pass ``part_rows`` owners, a long file into blocks of ``part_rows`` rows, so the
    broadcast table is bounded whatever the size of the batch. The driver holds the ends of the stretch at hand.

    Batches are numbered from 0. Keys are written last, so a batch counts once all its bodies are there; a repeated batch replaces itself. A page
    without a body has a key with a null hash and reads as null. Repeated pages keep a key each; an empty table adds an empty batch.
    """

    def __init__(self, spark: SparkSession, folder: str, part_rows: int = BROADCAST_ROWS):
        self.spark, self.folder, self.part_rows = spark, folder.rstrip("/"), part_rows
        # Empty first entries, so both tables can be read before the first batch.
        spark.createDataFrame([], KEYS).drop("batch").write.mode("ignore").parquet(f"{self.folder}/keys/batch=-1")
        spark.createDataFrame([], BODIES).drop("batch", "part").write.mode("ignore").parquet(f"{self.folder}/bodies/batch=-1/part=0")

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def keys(self) -> DataFrame:
        """One row per stored page; several with one (source_id, url_hash, schema_version) are its history."""
        return self._table("keys", KEYS)

    def bodies(self) -> DataFrame:
        """(page_hash, body): one row per distinct body. Bodies of a batch that has no keys yet are among them."""
        return self._table("bodies", BODIES).select("page_hash", "body")

    # --- Writing ----------------------------------------------------------------------------
    def add(self, pages: DataFrame, batch: int, version: str = C.SNAPSHOT_VERSION) -> None:
        """Store a frame of pages: a table read from Parquet files, with projections and filters on it only, so that every row has a place in a file."""
        work = f"{self.folder}/work/batch={batch}"
        placed = pages.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
        prints = placed.select(*print_columns(), "_file", "_row")
        prints.write.mode("overwrite").parquet(f"{work}/prints")
        written = self.spark.read.schema(prints.schema).parquet(f"{work}/prints")
        known = self._table("bodies", BODIES).filter(F.col("batch") < batch).select("page_hash")
        first = written.filter("page_hash IS NOT NULL").groupBy("page_hash").agg(F.min(F.struct("_file", "_row")).alias("_first"))
        chosen = first.join(known, "page_hash", "left_anti").select("page_hash", "_first.*")
        chosen.repartitionByRange("_file", "_row").write.mode("overwrite").parquet(f"{work}/owners")
        owners = self.spark.read.schema(chosen.schema).parquet(f"{work}/owners")
        source = placed.select("_file", "_row", F.col("html_or_json").alias("body"))
        for part, ends in enumerate(self._stretches(owners)):
            inside = self._between(*ends)
            copied = source.filter(inside).join(F.broadcast(owners.filter(inside)), ["_file", "_row"]).select("page_hash", "body")
            # Sorted within a task, and with a filter on the hash, so that a look-up skips row groups.
            ordered = copied.sortWithinPartitions("page_hash").write.option("parquet.bloom.filter.enabled#page_hash", "true")
            ordered.mode("overwrite").parquet(f"{self.folder}/bodies/batch={batch}/part={part}")
        rows = written.select("source_id", "url_hash", F.lit(version).alias("schema_version"), F.col("fetched_at").alias("stored_at"), "page_hash")
        rows.write.mode("overwrite").parquet(f"{self.folder}/keys/batch={batch}")

    def _between(self, low: Block, high: Block) -> Column:
        """Rows from block ``low`` to block ``high``; the comparison of names prunes files."""
        file, row = F.col("_file"), F.col("_row")
        first, last = low[1] * self.part_rows, (high[1] + 1) * self.part_rows
        inside = (file >= low[0]) & (file <= high[0])
        return inside & ((file > low[0]) | (row >= first)) & ((file < high[0]) | (row < last))

    def _stretches(self, owners: DataFrame) -> Iterator[tuple[Block, Block]]:
        """Ends of stretches of blocks with at most ``part_rows`` owners, in order of file and row. One row per file passes the driver, one at a time."""
        block = F.floor(F.col("_row") / self.part_rows).cast("int").alias("block")
        counted = owners.groupBy("_file", block).agg(F.count(F.lit(1)).alias("owners")).orderBy("_file", "block")
        low = high = None
        held = 0
        for file, number, count in counted.toLocalIterator():
            if low is not None and held + count > self.part_rows:
                yield low, high
                low, held = None, 0
            low, high, held = low or (file, number), (file, number), held + count
        if low is not None:
            yield low, high

    # --- Reading ----------------------------------------------------------------------------
    def current(self) -> DataFrame:
        """The last stored hash per source, page and version; equal times go by the larger hash."""
        last = F.max(F.struct("stored_at", "page_hash")).alias("_last")
        return self.keys().groupBy("source_id", "url_hash", "schema_version").agg(last).select("source_id", "url_hash", "schema_version", "_last.*")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Those of ``wanted`` (source_id, url_hash) that have no stored page."""
        return wanted.join(self.keys().select("source_id", "url_hash"), ["source_id", "url_hash"], "left_anti")

    def get(self, wanted: DataFrame, version: str = C.SNAPSHOT_VERSION) -> DataFrame:
        """Bodies of pages given by (source_id, url_hash): one row per page that is stored, read by key.

        Bodies are scanned where they lie while the distinct hashes asked for can be broadcast; beyond that bound they are joined by shuffle.
        """
        found = self.current().filter(F.col("schema_version") == version).join(wanted.select("source_id", "url_hash").distinct(), ["source_id", "url_hash"], "left_semi")
        hashes = broadcast_if_small(found.select("page_hash").distinct())
        return found.join(self.bodies().join(hashes, "page_hash"), "page_hash", "left").select("source_id", "url_hash", "stored_at", "page_hash", "body")

    def lookup(self, hashes: list[str]) -> DataFrame:
        """(page_hash, body) of a few contents; the filter reaches the files' Bloom filters."""
        return self.bodies().filter(F.col("page_hash").isin(*hashes))

