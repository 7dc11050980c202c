"""Which titles contain which: substring joins without comparing all pairs, over all times or within reach of half days."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SIZES = (32, 16, 8, 4, 2, 1)


def _grams(c: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(c) - (size - 1))
    cut = F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.substring(c, i, F.lit(size)))))
    return F.when(F.length(c) >= size, cut)


def contained_titles(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """All pairs (inner, outer) of distinct titles where outer contains inner.

    Both frames have one column ``title``. An inner title is looked up by one of its fragments:
    the longest fragment size it has room for, and of those the one found in the fewest outer
    titles. Outer titles offer all their fragments (as hashes). A fragment common to many titles is therefore
    chosen only when the inner title has nothing rarer, and every candidate is checked.
    """
    ins = inner.select(F.col("title").alias("inner")).filter("inner <> ''").distinct()
    outs = outer.select(F.col("title").alias("outer")).filter("outer <> ''").distinct()
    outs = outs.withColumn("outer_id", F.xxhash64("outer"))
    size = F.lit(0)
    for s in reversed(_SIZES):
        size = F.when(F.length("inner") >= s, F.lit(s)).otherwise(size)
    sized = ins.withColumn("size", size)
    # At most one row per fragment size; sizes no inner title uses are not spelled out.
    used = [row["size"] for row in sized.select("size").distinct().collect()]
    sizes = [s for s in _SIZES if s in used]
    if not sizes:
        return sized.select("inner", F.col("inner").alias("outer"))
    own = F.coalesce(*[F.when(F.col("size") == s, _grams(F.col("inner"), s)) for s in sizes])
    inner_grams = sized.select("inner", F.explode(own).alias("gram"))
    every = F.flatten(F.array_compact(F.array(*[_grams(F.col("outer"), s) for s in sizes])))
    # Only numbers are exploded; the text is looked up again for the few candidates.
    outer_grams = outs.select("outer_id", F.explode(every).alias("gram"))

    spread = outer_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        inner_grams.join(spread, "gram", "left")
        .groupBy("inner")
        # A fragment found nowhere settles the title: it is contained in nothing.
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("pick"))
        .filter("pick.n > 0")
        .select("inner", F.col("pick.gram").alias("gram"))
    )
    candidates = rarest.join(outer_grams, "gram").select("inner", "outer_id")
    return candidates.join(outs, "outer_id").filter(F.contains("outer", "inner")).select("inner", "outer").distinct()


def _placed(c: Column, size: int) -> Column:
    """Fragments of one size with their places, counted from 0."""
    starts = F.sequence(F.lit(1), F.length(c) - (size - 1))
    cut = F.transform(starts, lambda i: F.struct(F.xxhash64(F.substring(c, i, F.lit(size))).alias("gram"), (i - 1).alias("at")))
    return F.when(F.length(c) >= size, cut)


def titles_in_reach(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer, half): outer contains inner, and stands in the half day ``half``, beside or equal to one of inner's half days.

    Both frames have title and half (number of the half day). An inverted index is keyed by (fragment, half day), so titles only meet where
    their times do: the rows written grow with the meetings, not with how often a title was used before. An inner title is looked up by its
    rarest fragment. The fragment's places leave out titles with too little room before or behind it; the rest is checked on the texts.
    """
    ins = inner.select(F.col("title").alias("inner"), "half").filter("inner <> ''").distinct()
    outs = outer.select(F.col("title").alias("outer"), "half").filter("outer <> ''").distinct().withColumn("outer_id", F.xxhash64("outer"))
    size = F.lit(0)
    for s in reversed(_SIZES):
        size = F.when(F.length("inner") >= s, F.lit(s)).otherwise(size)
    sized = ins.select("inner").distinct().withColumn("size", size)
    used = [row["size"] for row in sized.select("size").distinct().collect()]  # at most one row per fragment size
    sizes = [s for s in _SIZES if s in used]
    if not sizes:
        return ins.select("inner", F.col("inner").alias("outer"), "half")
    own = F.coalesce(*[F.when(F.col("size") == s, _placed(F.col("inner"), s)) for s in sizes])
    inner_grams = sized.select("inner", F.explode(own).alias("g")).groupBy("inner", "g.gram").agg(F.min("g.at").alias("at"))
    every = F.flatten(F.array_compact(F.array(*[_placed(F.col("outer"), s) for s in sizes])))
    titles = outs.select("outer", "outer_id").distinct()
    placed = titles.select("outer_id", F.length("outer").alias("room"), F.explode(every).alias("g"))
    index = placed.groupBy("outer_id", "room", "g.gram").agg(F.min("g.at").alias("first"), F.max("g.at").alias("last"))
    spread = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        inner_grams.join(spread, "gram", "left")
        .groupBy("inner")
        # A fragment found nowhere settles the title: it is contained in nothing.
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "at")).alias("pick"))
        .filter("pick.n > 0")
        .select("inner", F.col("pick.gram").alias("gram"), F.col("pick.at").alias("at"), F.length("inner").alias("need"))
    )
    near = F.explode(F.sequence(F.col("half") - 1, F.col("half") + 1)).alias("half")
    probes = ins.select("inner", near).distinct().join(rarest, "inner")
    chosen = index.join(rarest.select("gram").distinct(), "gram", "left_semi")
    dated = chosen.join(outs.select("outer_id", "half"), "outer_id")
    room = (F.col("last") >= F.col("at")) & (F.col("room") - F.col("first") >= F.col("need") - F.col("at"))
    met = probes.join(dated, ["gram", "half"]).filter(room).select("inner", "outer_id", "half")
    return met.join(titles, "outer_id").filter(F.contains("outer", "inner")).select("inner", "outer", "half")
