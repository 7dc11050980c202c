"""Unique slugs: base, base-1, base-2, ... filling the first free number.

Free numbers are kept as ranges (start, length), however wide a gap between two taken numbers is.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evcat.operators.ordered import add_last_given, add_previous, add_row_number, add_running_sum

# Taken numbers of more than 18 digits lie beyond any number that could be reached by filling gaps.
_SUFFIX = r"-([1-9][0-9]{0,17})$"


def _used_numbers(bases: DataFrame, taken: DataFrame) -> DataFrame:
    """(base, n) for every taken slug that is a batch base (n = 0) or a batch base plus ``-n``."""
    whole = taken.select(F.col("slug").alias("base"), F.lit(0).cast("bigint").alias("n"))
    suffix = "^(.*)" + _SUFFIX
    numbered = taken.filter(F.col("slug").rlike(suffix)).select(
        F.regexp_extract("slug", suffix, 1).alias("base"),
        F.regexp_extract("slug", suffix, 2).cast("bigint").alias("n"),
    )
    return whole.unionByName(numbered).join(bases, "base", "left_semi").distinct()


def assign_slugs(new: DataFrame, existing: DataFrame, base: str = "base_slug", order: str = "seq") -> DataFrame:
    """Add ``slug`` to new rows, in ``order``; ``existing`` has a column ``slug``.

    A number that would spell another base of the batch ("x" + "-1" against a title "x 1") stays
    reserved for that base, so slugs are unique whatever the order of the rows.
    """
    bases = new.select(F.col(base).alias("base")).distinct()
    reserved = bases.select(F.col("base").alias("slug")).filter(F.col("slug").rlike(_SUFFIX))
    own = _used_numbers(bases, existing.select("slug").filter("slug IS NOT NULL"))
    other = _used_numbers(bases, reserved).filter("n > 0")
    used = add_previous(own.unionByName(other).distinct(), ["base"], ["n"], "n", "prev")
    # Free numbers below the highest used one: ranges, and how many free numbers lie before each.
    first = F.coalesce("prev", F.lit(-1)) + 1
    gaps = used.select("base", first.alias("start"), (F.col("n") - first).alias("length")).filter("length > 0")
    gaps = add_running_sum(gaps, ["base"], ["start"], "length", "upto").withColumn("before", F.col("upto") - F.col("length"))
    last = used.groupBy("base").agg(F.max("n").alias("top"), (F.max("n") + 1 - F.count("n")).alias("n_gaps"))
    ranked = add_row_number(new.withColumn("base", F.col(base)), ["base"], [order], "k")
    # The k-th row of a base takes the range that begins last among those with fewer than k free numbers before them.
    ranges = gaps.select("base", (F.col("before") + 1).alias("k"), F.lit(0).alias("kind"), F.struct("start", "before").alias("range"))
    asked = ranked.select("base", "k", F.lit(1).alias("kind"), F.lit(None).cast(ranges.schema["range"].dataType).alias("range"))
    placed = add_last_given(ranges.unionByName(asked), ["base"], ["k", "kind"], "range", "given").filter("kind = 1").select("base", "k", "given")
    numbered = ranked.join(placed, ["base", "k"], "left").join(last, "base", "left")
    n_gaps = F.coalesce("n_gaps", F.lit(0))
    free = F.when(F.col("k") <= n_gaps, F.col("given.start") + F.col("k") - F.col("given.before") - 1)
    n = F.coalesce(free, F.coalesce("top", F.lit(-1)) + F.col("k") - n_gaps)
    slug = F.when(n == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), n.cast("string")))
    return numbered.withColumn("slug", slug).drop("base", "k", "given", "top", "n_gaps")
