"""Mixing sources to target weights by whole-document repetition."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evcat.llm.folders import broadcast_if_bytes, written

SEED = "mix-1"
_DRAW_DIGITS = 13  # hexadecimal digits of the draw; 52 bits, exact in a double


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """Target size of each source from rows (source, size): source, source_size, target.

    Sources take the weights in code-point order, null last, starting over when they run out. Their targets share the
    total size by weight; a target stops at ``max_repeat`` times its source's size, and what is left over is shared by
    weight among the others until none is above. That fixed point is ``min(cap, level * weight)`` for one level: with
    the sources in the order of cap / weight, the level that results if all sources before one are capped is largest
    at the first source that is not. One row per source is ordered; documents are not.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    weighted = sums.withColumn("weight", F.element_at(cycle, F.pmod(rank - 1, F.lit(len(weights))).cast("int") + 1)).withColumn(
        "cap", F.col("source_size") * max_repeat
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - before) / onward
    return (
        weighted.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))
    )


def draw(key: Column, seed: str = SEED) -> Column:
    """Number in [0, 1) that depends on the key and the seed alone, so reruns agree."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, _DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**_DRAW_DIGITS))


def mix_sources(
    docs: DataFrame, size: Column, *, id_col: str = "doc_id", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), max_repeat: int = 3,
    seed: str = SEED,
) -> DataFrame:
    """Copies of each document that bring every source near its target.

    Returns one row per input row: ``doc`` (the row as a struct, so that no column name clashes), size, source_size,
    target, copies. The rate of a source is target / size; a document gets floor(rate) copies, and one more if its draw is
    below the fraction. Null sizes count as 0, a source of size 0 has rate 0, rows with equal ids get equal draws, and a
    null id draws from the row's hash. The empty table gives an empty result.
    """
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"),
        docs[f"`{source_col}`"].alias("source"),
        F.coalesce(size, F.lit(0)).cast("bigint").alias("size"),
        F.coalesce(docs[f"`{id_col}`"].cast("string"), F.xxhash64(*[docs[f"`{c}`"] for c in docs.columns]).cast("string")).alias("key"),
    )
    targets = written(source_targets(rows.select("source", "size"), weights, max_repeat), "mix-targets")
    small = broadcast_if_bytes(targets.withColumnRenamed("source", "of_source"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    return rows.join(small, F.col("source").eqNullSafe(F.col("of_source"))).select(
        "doc", "size", "source_size", "target", (whole + (draw(F.col("key"), seed) < rate - whole).cast("bigint")).alias("copies")
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The mixed documents themselves: each row as often as it was taken."""
    return mixed.filter("copies > 0").select(F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"), "doc").select("doc.*")
