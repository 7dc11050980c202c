"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text is read as words. Every window of WINDOW words keeps the smallest hash of its GRAM-word sequences, so
two equal windows always keep the same hash. Kept hashes of documents and benchmark items are joined; only
windows whose own hash was met are then extended to their full words and compared exactly. An item of fewer
words than a window is one window as a whole, and its kept hash is the hash of all its words.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evcat.llm.folders import broadcast_if_bytes, written

WINDOW, GRAM = 13, 6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ("_k1", "_k2")


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _GAPS), ""), F.array().cast("array<string>"))


def text_key(text: Column) -> list[Column]:
    """128-bit key of a text. What a text contains depends on the text alone, so copies share their findings."""
    return [F.xxhash64(text).alias(KEY[0]), F.xxhash64(F.lit(1), text).alias(KEY[1])]


def _paired(df: DataFrame, name: str, left: str, right: str, shift: int, merge) -> DataFrame:
    """Column ``name``: element i of ``left`` merged with element i + shift of ``right``; partial at the end."""
    later = F.slice(right, F.lit(shift + 1), F.greatest(F.size(right), F.lit(0)))
    return df.withColumn(name, F.zip_with(left, later, merge))


def _powers(limit: int) -> list[int]:
    return [1 << i for i in range(limit.bit_length()) if 1 << i <= limit]


def _folded(df: DataFrame, source: str, name: str, length: int, merge) -> DataFrame:
    """Column ``name``: every ``length`` neighbours of ``source`` merged, by doubling. Each step is a column of its own, so that it is evaluated once."""
    steps = _powers(length)
    have = {1: source}
    for p in steps[1:]:
        have[p] = f"{name}_{p}"
        df = _paired(df, have[p], have[p // 2], have[p // 2], p // 2, merge)
    done, at = steps[-1], have[steps[-1]]
    for p in reversed(steps[:-1]):
        if length - done >= p:
            df = _paired(df, f"{name}_{done + p}", at, have[p], done, merge)
            done, at = done + p, f"{name}_{done + p}"
    return df.withColumnRenamed(at, name) if at != source else df.withColumn(name, F.col(source))


def kept_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds ``fp_<m>`` for each window length m: the kept hash of the window at each word.

    Columns ``words`` and ``hashes`` are expected. Windows that run over the end are cut, which can only add hashes.
    """
    keep = [*df.columns, *[f"fp_{m}" for m in lengths]]
    for m in lengths:
        if m == WINDOW:
            df = _folded(df, "hashes", "gram", GRAM, lambda a, b: F.xxhash64(a, b))
            df = _folded(df, "gram", f"fp_{m}", WINDOW - GRAM + 1, lambda a, b: F.least(a, b))
        else:
            df = _folded(df, "hashes", f"whole_{m}", m, lambda a, b: F.xxhash64(a, b))
            df = df.withColumn(f"fp_{m}", F.transform(f"whole_{m}", lambda x: F.xxhash64(x, F.lit(m))))
    return df.select(*keep)


def _read(df: DataFrame, text: Column, *columns: Column) -> DataFrame:
    words = df.select(*columns, words_of(text).alias("words"))
    return words.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def _windows(df: DataFrame, m: int, wanted: Column | None = None) -> DataFrame:
    """One row per complete window of m words: start, its kept hash and its text; all or those with a wanted hash."""
    starts = F.sequence(F.lit(1), F.size("words") - m + 1)
    if wanted is not None:
        starts = F.filter(starts, lambda i: F.array_contains(wanted, F.element_at(f"fp_{m}", i)))
    others = [c for c in df.columns if c not in ("words", "hashes", "wanted") and not c.startswith("fp_")]
    picked = df.filter(F.size("words") >= m).withColumn("start", F.explode(starts))
    text = F.array_join(F.slice("words", F.col("start"), F.lit(m)), " ")
    return picked.select(*others, (F.col("start") - 1).alias("start"), F.lit(m).alias("m"), F.element_at(f"fp_{m}", F.col("start")).alias("fp"), text.alias("span"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def covered(windows: Column) -> Column:
    """Number of words inside at least one of the windows (array of structs start, m)."""
    first = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("total"))

    def add(acc: Column, w: Column) -> Column:
        end = F.greatest(acc["end"], w["start"] + w["m"])
        return F.struct(end.alias("end"), (acc["total"] + end - F.greatest(acc["end"], w["start"])).cast("bigint").alias("total"))

    return F.aggregate(F.array_sort(windows), first, add, lambda acc: acc["total"])


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, list[int]]:
    """Windows of all items (item, m, fp, span) as a written table, and the window lengths that occur.

    Items without a word have no window; a null id is kept and counts as the id ''. Repeated items change nothing.
    """
    read = _read(items, F.col(text_col), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item")).filter(F.size("words") > 0)
    sizes = read.select(F.least(F.size("words"), F.lit(WINDOW)).alias("m")).distinct()
    lengths = sorted(r["m"] for r in sizes.collect())  # at most WINDOW different numbers
    if not lengths:
        return written(items.select(F.lit("").alias("item"), F.lit(0).alias("m"), F.lit(0).cast("bigint").alias("fp"), F.lit("").alias("span")).filter("false"), "items"), []
    parts = []
    for m in lengths:
        of_length = read.filter(F.size("words") >= m if m == WINDOW else F.size("words") == m)
        parts.append(_windows(kept_hashes(of_length, [m]), m).select("item", "m", "fp", "span").distinct())
    return written(_union(parts), "items"), lengths


def overlaps(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Texts that share a window with an item: key columns, n_hit (words inside such windows), items (sorted ids).

    Texts without a shared window, null or without words give no row; an empty table on either side gives none at all.
    """
    spans, lengths = item_windows(items, item_id_col, item_text_col)
    text = F.col(f"`{text_col}`")
    source = docs.select(text.alias("text")).filter("text IS NOT NULL")
    if not lengths:
        nothing = source.select(*text_key(F.col("text")), F.lit(0).cast("bigint").alias("n_hit"), F.array().cast("array<string>").alias("items"))
        return nothing.filter("false")
    shortest = min(lengths)
    # 1. Kept hashes of both sides meet.
    prints = kept_hashes(_read(source, F.col("text"), *text_key(F.col("text"))).filter(F.size("words") >= shortest), lengths)
    found = F.array_distinct(F.concat(*[F.col(f"fp_{m}") for m in lengths]) if len(lengths) > 1 else F.col(f"fp_{lengths[0]}"))
    met = prints.select(*KEY, F.explode(found).alias("fp")).join(broadcast_if_bytes(written(spans.select("fp").distinct(), "prints")), "fp")
    wanted = written(met.groupBy(*KEY).agg(F.collect_set("fp").alias("wanted")), "met")
    # 2. Met hashes are extended to whole windows and compared word by word.
    again = source.select("text", *text_key(F.col("text"))).join(broadcast_if_bytes(wanted), list(KEY))
    extended = kept_hashes(_read(again, F.col("text"), *KEY, F.col("wanted")), lengths)
    hits = _union([_windows(extended, m, F.col("wanted")) for m in lengths])
    matched = hits.join(broadcast_if_bytes(spans), ["m", "fp", "span"])
    return matched.groupBy(*KEY).agg(
        covered(F.collect_set(F.struct("start", "m"))).alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items")
    )


def contamination(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Each row of ``docs`` as a struct ``doc`` with n_words, n_hit, items and contaminated.

    A document is contaminated when some word is hit and 20 * n_hit >= n_words. Null texts have no words. Rows are kept as they
    are, so repeated ids, null ids and extra columns of any name do no harm.
    """
    found = written(overlaps(docs, items, text_col=text_col, item_id_col=item_id_col, item_text_col=item_text_col), "overlaps")
    text = docs[f"`{text_col}`"]
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), *text_key(text))
    joined = rows.join(broadcast_if_bytes(found), list(KEY), "left")
    n_words = F.size(words_of(F.col("doc")[text_col])).cast("bigint")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return joined.select("doc", n_words.alias("n_words"), n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )
