"""Ordered computations per key that survive hot keys.

A window over a key sends the whole key to one task. Here the rows are range-partitioned on
(key, order) first, so a hot key spreads over many slices; each slice is computed on its own and
corrected by a small per-slice summary. At most one key continues into a slice from the slice
before, so the correction table has at most one row per slice.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from evcat.session import cut


ROWS_PER_SLICE = 1_000_000


def _ranged(df: DataFrame, columns: list[str], written: bool) -> DataFrame:
    # Written down first: ranging samples its input, which would otherwise be computed twice.
    rows = df if written else cut(df)
    slices = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_SLICE))
    return rows.repartitionByRange(slices, *columns)


def _sliced(df: DataFrame, keys: list[str], order: list[str], written: bool = False) -> DataFrame:
    ranged = _ranged(df, [*keys, *order], written)
    if keys:
        # The slice number is only stable once written down.
        return cut(ranged.withColumn("_slice", F.spark_partition_id()))
    # The number of a row counts the rows of its slice from 0, above the number of the slice.
    placed = ranged.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return cut(placed).withColumns({"_slice": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")


def _join_carry(df: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    same = [df[k].eqNullSafe(carry[k]) for k in keys] + [df["_slice"] == carry["_slice"]]
    joined = df.join(F.broadcast(carry), same, "left")  # at most one row per slice
    return joined.select(df["*"], carry["_carry"])


def add_row_number(df: DataFrame, keys: list[str], order: list[str], name: str, written: bool = False) -> DataFrame:
    """1-based position of each row among the rows with the same keys (all rows when no keys).

    ``written`` says that the rows come from files with projections and filters only, so that they need not be written down first.
    """
    if not keys:
        return _numbered(df, order, name, written)
    rows = _sliced(df, keys, order, written)
    local = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order)))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_carry", F.sum("_n").over(before))
        .filter(F.col("_carry") > 0)
        .drop("_n")
    )
    out = _join_carry(local, carry, keys)
    return out.withColumn(name, F.col(name) + F.coalesce(F.col("_carry"), F.lit(0))).drop("_slice", "_carry")


def _numbered(df: DataFrame, order: list[str], name: str, written: bool = False) -> DataFrame:
    """Position among all rows: the place in the sorted slice plus the sizes of the slices before; no exchange after the ranging."""
    rows = _sliced(df, [], order, written)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    carry = rows.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n")).withColumn("_carry", F.sum("_n").over(before)).drop("_n")
    return _join_carry(rows, carry, []).withColumn(name, F.col("_at") + F.coalesce(F.col("_carry"), F.lit(0)) + 1).drop("_slice", "_at", "_carry")


def _behind(keys: list[str], value: str, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows with the value of the row before of the same keys, and whether a row is the first of its keys here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: dict[str, pa.Array] = {}
        for batch in batches:
            if not len(batch):
                continue
            columns = {c: batch.column(c) for c in (*keys, value)}
            shifted = {c: pa.concat_arrays([before.get(c, pa.nulls(1, a.type)), a.slice(0, len(a) - 1)]) for c, a in columns.items()}
            same = pa.array([bool(before), *[True] * (len(batch) - 1)])
            for k in keys:
                equal = pc.fill_null(pc.equal(columns[k], shifted[k]), False)
                same = pc.and_(same, pc.or_(equal, pc.and_(columns[k].is_null(), shifted[k].is_null())))
            before = {c: a.slice(len(a) - 1) for c, a in columns.items()}
            found = pc.if_else(same, shifted[value], pa.scalar(None, columns[value].type))
            yield pa.RecordBatch.from_arrays([*batch.columns, found, pc.invert(same)], [*batch.schema.names, name, "_first"])

    return run


def add_previous(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, written: bool = False) -> DataFrame:
    """Value of the row before, among the rows with the same keys; null on the first row. ``written`` as for ``add_row_number``."""
    ranged = _ranged(df, [*keys, *order], written).sortWithinPartitions(*keys, *order)
    placed = ranged.withColumn("_slice", F.spark_partition_id())
    schema = StructType([*placed.schema.fields, StructField(name, placed.schema[value].dataType), StructField("_first", BooleanType())])
    rows = cut(placed.mapInArrow(_behind(keys, value, name), schema))
    # The first keys of a slice may go on from the last row of the slice before: one row per slice.
    last = F.max_by(F.struct(*keys, F.col(value).alias("_value")), F.struct(*keys, *order))
    ends = rows.groupBy("_slice").agg(last.alias("_last"))
    carry = ends.select("_slice", F.lag("_last").over(Window.orderBy("_slice")).alias("_carry"))
    joined = rows.join(F.broadcast(carry), "_slice", "left")
    goes_on = F.col("_first") & F.col("_carry").isNotNull()
    for k in keys:
        goes_on = goes_on & F.col(k).eqNullSafe(F.col("_carry")[k])
    return joined.withColumn(name, F.when(goes_on, F.col("_carry._value")).otherwise(F.col(name))).drop("_slice", "_carry", "_first")


def add_running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the rows up to and with this one, among the rows with the same keys; order values are distinct."""
    rows = _sliced(df, keys, order)
    upto = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn(name, F.sum(value).over(upto))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys, "_slice")
        .agg(F.sum(value).alias("_n"))
        .withColumn("_carry", F.sum("_n").over(before))
        .filter("_carry IS NOT NULL")
        .drop("_n")
    )
    out = _join_carry(local, carry, keys)
    return out.withColumn(name, F.col(name) + F.coalesce(F.col("_carry"), F.lit(0))).drop("_slice", "_carry")


def add_last_given(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Last non-null ``value`` at or before each row, among the rows with the same keys; order values are distinct."""
    rows = _sliced(df, keys, order)
    upto = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn(name, F.last(value, ignorenulls=True).over(upto))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    given = F.when(F.col(value).isNotNull(), F.struct(*order))
    carry = (
        rows.groupBy(*keys, "_slice")
        .agg(F.max_by(value, given).alias("_last"))
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(before))
        .filter("_carry IS NOT NULL")
        .drop("_last")
    )
    out = _join_carry(local, carry, keys)
    return out.withColumn(name, F.coalesce(F.col(name), F.col("_carry"))).drop("_slice", "_carry")


_SECOND = 1_000_000


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


# Rows of one block of time of a key that one task may sort; a block with more is split by seconds.
CROWDED_ROWS = 100_000


def first_within(points: DataFrame, probes: DataFrame, radius_seconds: int, crowded_rows: int = CROWDED_ROWS) -> DataFrame:
    """Smallest point value within +-radius of each probe, per key.

    ``points`` has (key, us, value), ``probes`` has (key, us), times in microseconds. Returns
    (key, us, value) for the distinct probes that have a point in reach.

    No pairs are formed. Time is cut into blocks two radii wide, so the reach of a probe is the end of one block, from
    us - radius on, and the start of the next, up to us + radius. Those are running minima. A block of a key with more than
    ``crowded_rows`` rows takes them in two levels, over the seconds of a block and inside one second, so a window never holds
    more than that, one block's seconds or one second's distinct times, however many rows share the key.
    """
    radius = radius_seconds * _SECOND
    width = 2 * radius
    block = F.expr(f"(at - pmod(at, {width})) div {width}").alias("b")
    off = F.pmod("at", F.lit(width)).alias("off")
    pts = (
        points.filter("key IS NOT NULL AND us IS NOT NULL")
        .groupBy("key", F.col("us").alias("at"))
        .agg(F.min("value").alias("value"))
        .select("key", block, off, "value", F.lit(None).cast("bigint").alias("probe"), F.lit(False).alias("onward"))
    )
    ends = F.array(
        F.struct((F.col("us") - radius).alias("at"), F.lit(True).alias("onward")), F.struct((F.col("us") + radius).alias("at"), F.lit(False).alias("onward"))
    )
    probe = probes.filter("key IS NOT NULL AND us IS NOT NULL").select("key", "us").distinct()
    ended = probe.select("key", F.col("us").alias("probe"), F.explode(ends).alias("end")).select("key", "probe", "end.*")
    moved = ended.select("key", block, off, F.lit(None).cast(pts.schema["value"].dataType).alias("value"), "probe", "onward")
    # Written down: the points come from joins, and the rows are read for their counts and for the minima.
    rows = cut(pts.unionByName(moved))
    crowds = rows.groupBy("key", "b").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > crowded_rows).drop("_n")
    if crowds.isEmpty():
        found = _block_minima(rows)
    else:
        crowds = cut(crowds)
        found = _block_minima(rows.join(crowds, ["key", "b"], "left_anti")).unionByName(_crowded_minima(rows.join(crowds, ["key", "b"], "left_semi")))
    return found.filter(F.col("value").isNotNull()).groupBy("key", "us").agg(F.min("value").alias("value"))


def _running_minima(rows: DataFrame, keys: list[str], name: str, value: str, upto: str, onward: str, own: bool) -> DataFrame:
    """Smallest value of the rows before and behind each row by ``name``, with rows beside it if ``own``."""
    here = Window.partitionBy(*keys)
    reach = (Window.unboundedPreceding, Window.currentRow if own else -1)
    ahead, back = here.orderBy(name), here.orderBy(F.col(name).desc())
    spans = [w.rangeBetween(*reach) if own else w.rowsBetween(*reach) for w in (ahead, back)]
    return rows.withColumn(upto, F.min(value).over(spans[0])).withColumn(onward, F.min(value).over(spans[1]))


def _block_minima(rows: DataFrame) -> DataFrame:
    found = _running_minima(rows, ["key", "b"], "off", "value", "_upto", "_onward", True).filter(F.col("probe").isNotNull())
    return found.select("key", F.col("probe").alias("us"), F.when(F.col("onward"), F.col("_onward")).otherwise(F.col("_upto")).alias("value"))


def _crowded_minima(rows: DataFrame) -> DataFrame:
    placed = rows.withColumn("sec", F.expr(f"off div {_SECOND}"))
    fine = _running_minima(placed, ["key", "b", "sec"], "off", "value", "_upto", "_onward", True).filter(F.col("probe").isNotNull())
    seconds = placed.groupBy("key", "b", "sec").agg(F.min("value").alias("_sec"))
    coarse = _running_minima(seconds, ["key", "b"], "sec", "_sec", "_earlier", "_later", False).drop("_sec")
    best = F.when(F.col("onward"), F.least("_onward", "_later")).otherwise(F.least("_upto", "_earlier"))
    return fine.join(coarse, ["key", "b", "sec"]).select("key", F.col("probe").alias("us"), best.alias("value"))
