"""Pages by number over a sorted table: row counts lead to the rows of a page, nothing is skipped row by row."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

Keep = Callable[[DataFrame], DataFrame]
SLICE_ROWS = 1_000_000
BLOCK_ROWS = 8_192
_PLACE_BITS = (1 << 33) - 1  # a row's number within its task, as monotonically_increasing_id counts it


def listing_order() -> list[Column]:
    """Dated events first, by start; undated ones last."""
    return [F.col("date_tba").asc_nulls_last(), F.col("start_at").asc_nulls_last(), F.col("id").asc()]


def admin_order() -> list[Column]:
    """Latest start first, no start counts as latest."""
    return [F.col("start_at").desc_nulls_first(), F.col("id").asc()]


class SortedTable:
    """A table in one order as slices of about ``slice_rows`` rows; every row knows its ``_place`` in its slice.

    ``order`` must end with a unique column. A page is found in three steps: rows per slice (from the written counts, or counted for
    a filter), rows per block of the slice the page begins in, and the rows from that block on. So whatever the number of the page, at most
    ``block_rows`` rows before it and the slices it lies in are read for its rows. The driver holds one count per slice.
    """

    def __init__(self, spark: SparkSession, folder: str, order: Sequence[Column], block_rows: int = BLOCK_ROWS):
        self.spark, self.folder, self.order, self.block_rows = spark, folder, list(order), block_rows
        self.schema = StructType([*spark.read.parquet(f"{folder}/none").schema.fields, StructField("_slice", IntegerType())])

    @classmethod
    def write(cls, rows: DataFrame, folder: str, order: Sequence[Column], slice_rows: int = SLICE_ROWS, block_rows: int = BLOCK_ROWS) -> SortedTable:
        """Sort and write ``rows`` to a new folder. Rows with equal order values stay in one slice; an empty table has no slice."""
        number = max(1, -(-rows.count() // slice_rows))
        ranged = rows.repartitionByRange(number, *order).withColumn("_slice", F.spark_partition_id())
        placed = ranged.sortWithinPartitions("_slice", *order).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE_BITS)))
        spark = rows.sparkSession
        spark.createDataFrame([], placed.drop("_slice").schema).write.parquet(f"{folder}/none")
        placed.write.partitionBy("_slice").parquet(f"{folder}/rows")
        table = cls(spark, folder, order, block_rows)
        table.rows().groupBy("_slice").agg(F.count(F.lit(1)).alias("rows")).coalesce(1).write.parquet(f"{folder}/counts")
        return table

    def rows(self, slices: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some slices, whose folders alone are listed."""
        read = self.spark.read.schema(self.schema)
        if slices is None:
            return read.parquet(f"{self.folder}/rows")
        if not slices:
            return self.spark.createDataFrame([], self.schema)
        return read.option("basePath", f"{self.folder}/rows").parquet(*[f"{self.folder}/rows/_slice={n}" for n in slices])

    def counts(self, keep: Keep | None = None) -> list[tuple[int, int]]:
        """(slice, rows) of the slices with rows that ``keep`` leaves, in order."""
        if keep is None:
            counted = self.spark.read.schema("_slice int, rows bigint").parquet(f"{self.folder}/counts")
        else:
            counted = keep(self.rows()).groupBy("_slice").agg(F.count(F.lit(1)).alias("rows"))
        return sorted((r[0], r[1]) for r in counted.collect())

    def total(self, keep: Keep | None = None) -> int:
        return sum(rows for _, rows in self.counts(keep))

    def page(self, number: int, limit: int, keep: Keep | None = None) -> DataFrame:
        """Page ``number`` (from 1) of the rows that ``keep`` (filters only) leaves, in order; empty behind the last page."""
        if number < 1 or limit < 1:
            raise ValueError("page and limit start at 1")
        skip, wanted, begun = (number - 1) * limit, [], 0
        first = skip
        for n, rows in self.counts(keep):
            if begun + rows > first and begun < first + limit:
                if not wanted:
                    skip = first - begun
                wanted.append(n)
            begun += rows
        found = self.rows(wanted)
        if keep is not None:
            found = keep(found)
        if wanted:
            found, skip = self._from_block(found, wanted[0], skip, keep is None)
        columns = [c for c in found.columns if c not in ("_slice", "_place")]
        return found.orderBy(*self.order).offset(skip if wanted else 0).limit(limit).select(*columns)

    def _from_block(self, found: DataFrame, first: int, skip: int, whole: bool) -> tuple[DataFrame, int]:
        """Rows from the block in which the page begins, and how many of them to skip."""
        here = F.col("_slice") == first
        if whole:
            return found.filter(~here | (F.col("_place") >= skip)), 0
        block = F.expr(f"_place div {self.block_rows}")
        start = 0
        for n, rows in sorted(tuple(r) for r in found.filter(here).groupBy(block.alias("block")).count().collect()):  # one row per block of one slice
            start = n * self.block_rows
            if rows > skip:
                break
            skip -= rows
        return found.filter(~here | (F.col("_place") >= start)), skip
