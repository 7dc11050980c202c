"""N-gram Jaccard join as a T-occurrence search, and the groups that its links form.

Two sets are similar when their overlap reaches T; the search merges inverted lists and counts. Lists are ordered from
rare to common: n-grams of one document, of a few (short lists), of many (long lists). Two similar sets share a member of
both prefixes (the first ``n - T + 1`` members in that order), so

* n-grams of one document need no list, and a document whose prefix consists of them is done,
* short lists are merged by a join, which gives the pairs whose first common n-gram is short,
* long lists are never merged pair by pair (the skip of DivideSkip). They only matter to documents with too few other
  members. Those fall into classes of equal long members and equal size; pairs of classes are probed with the long
  members alone, and classes that are linked already are not probed again.

Pairs pass a parity bitmap, which bounds their difference from below, and then an exact overlap by binary probing. How many
documents an n-gram has is counted over all documents, in packed key ranges.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evcat.llm import blocks as B
from evcat.llm import words as W
from evcat.llm.components import components
from evcat.llm.folders import broadcast_if_bytes, written
from evcat.session import cut

SIZE, NUMERATOR, DENOMINATOR = 5, 75, 100
LONG_LIST = 33  # documents from which a list counts as long
STAR_ROUNDS = 2
LABEL_STEPS = 2
BLOCK_BYTES = 8 << 20  # a block's sets take a multiple of its text


def shingle_sets(texts: list[list[bytes]], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text; a shorter text is one n-gram as a whole."""
    hashes, bounds = W.hashed(texts)
    rolling = W.Rolling(hashes, W.FIRST_BASE)
    starts = np.arange(max(0, len(hashes) - size + 1))
    grams = rolling(starts, starts + size)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            sets.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            sets.append(rolling(np.array([a]), np.array([b])) ^ np.uint64(b - a))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def prefix_size(n: np.ndarray | int) -> np.ndarray | int:
    """Members of which a similar set must share one: n - ceil(share * n) + 1."""
    return n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1


def parity_bitmap(members: np.ndarray) -> bytes:
    """Bit per cell: odd number of members. About two bits per member, a power of two in all."""
    bits = 1 << max(6, int(2 * len(members) - 1).bit_length())
    cells = (members & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=bits) & 1).astype(np.uint8)).tobytes()


def difference_floor(a: bytes, b: bytes) -> int:
    """Smallest possible symmetric difference of two sets by their bitmaps; the larger folds onto the smaller."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.unpackbits(x ^ y).sum())


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common members, the smaller set probed into the larger."""
    small, large = sorted((a, b), key=len)
    large = np.sort(large)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return int((large[at] == small).sum())


_PIECE = 1 << 20  # bytes of text whose words are held as objects at one time


def _sets_of(column: pa.ChunkedArray, size: int) -> Iterator[np.ndarray]:
    """N-gram set of each text of a block."""
    texts, held = [], 0
    for text in (t for chunk in column.chunks for t in W.utf8(chunk)):
        texts.append(W.lower_blank_words(text))
        held += len(text or b"")
        if held >= _PIECE:
            yield from shingle_sets(texts, size)
            texts, held = [], 0
    yield from shingle_sets(texts, size)


def _requests(source: DataFrame, size: int, bits: int, ranges: int) -> DataFrame:
    """Per block and key range the packed cells (leading hash bits) of all its sets."""

    def block_cells(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cells = [members >> np.uint64(64 - bits) for members in _sets_of(table.column("text"), size)]
        cells = np.sort(np.concatenate([np.zeros(0, np.uint64), *cells]))
        at = B.cut_at(cells, bits, ranges)
        full = [r for r in range(ranges) if at[r] < at[r + 1]]
        packed = [B.pack_sorted(cells[at[r] : at[r + 1]]) for r in full]
        return pa.table(
            {"block": pa.array([key[0].as_py()] * len(full), pa.int32()), "part": pa.array(full, pa.int32()), "cells": pa.array(packed, pa.binary())}
        )

    return source.groupBy("block").applyInArrow(block_cells, "block int, part int, cells binary")


def _answers(requests: DataFrame) -> DataFrame:
    """Per block the cells that more than one document has, and which of them are long lists."""

    def counted(table: pa.Table) -> pa.Table:
        lists = [B.unpack_sorted(x.as_py()) for x in table.column("cells")]
        cells, counts = np.unique(np.concatenate(lists), return_counts=True)
        shared, long = cells[counts > 1], counts[counts > 1] >= LONG_LIST
        out_cells, out_long = [], []
        for cells in lists:
            own = np.unique(cells)
            at = np.minimum(np.searchsorted(shared, own), max(len(shared) - 1, 0))
            hit = shared[at] == own if len(shared) else np.zeros(len(own), bool)
            out_cells.append(B.pack_sorted(own[hit]))
            out_long.append(np.packbits(long[at[hit]] if len(shared) else hit[hit]).tobytes())
        return pa.table({"block": table.column("block"), "part": table.column("part"), "cells": pa.array(out_cells, pa.binary()), "long": pa.array(out_long, pa.binary())})

    return requests.groupBy("part").applyInArrow(counted, "block int, part int, cells binary, long binary")


_SETS = "doc_id bigint, key bigint, sid bigint, n bigint, n_single bigint, n_short bigint, members array<bigint>, bitmap binary"


def _ordered_sets(source: DataFrame, answers: DataFrame, size: int, bits: int) -> DataFrame:
    """One row per document: set id, set size, and, where its prefix holds shared n-grams, the members from rare to common."""

    def block_sets(docs: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known.column("part").to_numpy()) if known.num_rows else []
        cells, long = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        for i in order:
            cells.append(B.unpack_sorted(known.column("cells")[int(i)].as_py()))
            flags = np.unpackbits(np.frombuffer(known.column("long")[int(i)].as_py(), np.uint8))
            long.append(flags[: len(cells[-1])].astype(bool))
        cells, long = np.concatenate(cells), np.concatenate(long)
        rows = []
        seen = set()
        for members in _sets_of(docs.column("text"), size):
            n = len(members)
            sid = xxhash.xxh3_64_intdigest(members.tobytes()) - (1 << 63)
            if not n or sid in seen:
                rows.append((sid, n, None, None, None, None))
                continue
            seen.add(sid)
            grade = np.zeros(n, np.int8)
            if len(cells):
                own = members >> np.uint64(64 - bits)
                at = np.minimum(np.searchsorted(cells, own), len(cells) - 1)
                grade = np.where(cells[at] == own, 1 + long[at].astype(np.int8), np.int8(0))
            n_single, n_short = int((grade == 0).sum()), int((grade == 1).sum())
            if n_single >= prefix_size(n):
                rows.append((sid, n, n_single, n_short, None, None))
            else:
                ordered = members[np.argsort(grade, kind="stable")]
                rows.append((sid, n, n_single, n_short, ordered.view(np.int64), parity_bitmap(members)))
        sid, n, n_single, n_short, ordered, bitmap = zip(*rows) if rows else [()] * 6
        return pa.table(
            {
                "doc_id": docs.column("doc_id"), "key": docs.column("key"), "sid": pa.array(sid, pa.int64()), "n": pa.array(n, pa.int64()),
                "n_single": pa.array(n_single, pa.int64()), "n_short": pa.array(n_short, pa.int64()),
                "members": pa.array(ordered, pa.list_(pa.int64())), "bitmap": pa.array(bitmap, pa.binary()),
            }
        )

    return source.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(block_sets, _SETS)


def _similar(a: Column, b: Column, common: Column) -> Column:
    return DENOMINATOR * common >= NUMERATOR * (a + b - common)


def _reachable() -> Column:
    """Pairs that could be similar if the n-gram they met at (``rank`` in either order) and all after it were common.

    That holds for every similar pair at its first common n-gram, so each list may drop the others.
    """
    return _similar(F.col("n_a"), F.col("n_b"), F.least(F.col("n_a") - F.col("rank_a"), F.col("n_b") - F.col("rank_b")))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of set ids whose sets (sid, n, members, bitmap) are similar by the overlap of ``members``."""
    floor = F.arrow_udf(lambda a, b: pa.array([difference_floor(x.as_py(), y.as_py()) for x, y in zip(a, b)], pa.int64()), "bigint")
    probe = F.arrow_udf(
        lambda a, b: pa.array([overlap(x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)) for x, y in zip(a, b)], pa.int64()), "bigint"
    )
    side = lambda s, *more: sets.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), F.col("h").alias(f"h_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in more])
    sized = pairs.join(side("a", "bitmap"), "a").join(side("b", "bitmap"), "b")
    ceiling = F.floor((F.col("h_a") + F.col("h_b") - floor("bitmap_a", "bitmap_b")) / 2)
    likely = written(sized.filter(_similar(F.col("n_a"), F.col("n_b"), ceiling)).select("a", "b"), "likely")
    full = likely.join(side("a", "members"), "a").join(side("b", "members"), "b")
    return written(full.filter(_similar(F.col("n_a"), F.col("n_b"), probe("members_a", "members_b"))).select("a", "b"), "links")


def _short_links(sets: DataFrame) -> DataFrame:
    """Links whose first common n-gram has a short list."""
    prefix = F.expr(f"slice(members, cast(n_single + 1 AS int), cast(least(n_short, {_prefix_sql()} - n_single) AS int))")
    postings = sets.filter("n_short > 0").select("sid", "n", "n_single", F.posexplode(prefix).alias("at", "gram"))
    postings = postings.select("sid", "n", (F.col("n_single") + F.col("at")).alias("rank"), "gram")
    left, right = postings.toDF("a", "n_a", "rank_a", "gram"), postings.toDF("b", "n_b", "rank_b", "gram")
    pairs = left.join(right, "gram").filter(F.col("a") < F.col("b")).filter(_reachable())
    return _verified(written(pairs.select("a", "b").distinct(), "short-pairs"), sets.withColumn("h", F.col("n")))


def _prefix_sql() -> str:
    return f"(n - (({NUMERATOR} * n + {DENOMINATOR - 1}) div {DENOMINATOR}) + 1)"


def _long_links(sets: DataFrame) -> DataFrame:
    """Links that long lists alone decide, up to links that follow from others.

    Sets with the same long members and the same size are one class: whatever is linked to one of them by long members is linked to
    all. Classes are probed against the class of each of their lists with the most long members; the next rounds leave out that class and lists that hold one
    component only. What is left after the rounds is paired within its lists.
    """
    heavy = sets.filter(f"n_single + n_short < {_prefix_sql()}").withColumn(
        "long", F.expr("slice(members, cast(n_single + n_short + 1 AS int), cast(n - n_single - n_short AS int))")
    )
    of_class = written(heavy.select("sid", "n", "long", F.xxhash64("n", "long").alias("cid")), "classes")
    bitmap = F.arrow_udf(lambda a: pa.array([parity_bitmap(x.values.to_numpy(zero_copy_only=False).view(np.uint64)) for x in a], pa.binary()), "binary")
    one = of_class.groupBy("cid").agg(F.first("n").alias("n"), F.first("long").alias("members"), F.min("sid").alias("first"), F.count(F.lit(1)).alias("sids"))
    classes = written(one.select(F.col("cid").alias("sid"), "n", "members", "first", "sids", F.size("members").cast("bigint").alias("h"), bitmap("members").alias("bitmap")), "class-sets")
    prefix = F.expr(f"slice(members, 1, cast({_prefix_sql()} - (n - h) AS int))")
    active = classes.select(F.col("sid").alias("cid"), "n", "h", F.col("sid").alias("comp"), F.posexplode(prefix).alias("at", "gram"))
    active = active.select("cid", "n", "h", (F.col("n") - F.col("h") + F.col("at")).alias("rank"), "comp", "gram")
    fields = ("cid", "n", "h", "rank", "comp")
    links, tested = [], None
    for turn in range(STAR_ROUNDS + 1):
        # The class with the most long members is the least edited one, and links to most of its kind.
        center = F.min(F.struct((-F.col("h")).alias("fewer"), *fields)).alias("c")
        lists = active.groupBy("gram").agg(center, F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
        active = written(active.join(lists, "gram"), "active")
        if active.isEmpty():
            break
        if turn < STAR_ROUNDS:
            met = active.select(*[F.col(f"c.{f}").alias(f"{f}_a") for f in fields], *[F.col(f).alias(f"{f}_b") for f in fields])
            # Any list may link to its first class, so that most are linked before pairs are formed.
            met = met.filter(_similar(F.col("n_a"), F.col("n_b"), F.least("h_a", "h_b")))
        else:
            side = lambda s: active.select("gram", *[F.col(f).alias(f"{f}_{s}") for f in fields])
            met = side("a").join(side("b"), "gram").filter("cid_a < cid_b").filter(_reachable())
        met = met.filter(F.col("comp_a") != F.col("comp_b"))
        pairs = met.select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b")).distinct()
        pairs = written(pairs.join(tested, ["a", "b"], "left_anti") if tested is not None else pairs, "long-pairs")
        tested = pairs if tested is None else tested.union(pairs)
        links.append(_verified(pairs, classes))
        if turn == STAR_ROUNDS:
            break
        joined = links[0]
        for more in links[1:]:
            joined = joined.union(more)
        # Classes that lead to the same class are connected; a few steps find nearly all, and a pair missed here is only probed.
        label = written(joined.groupBy(F.col("b").alias("cid")).agg(F.min("a").alias("root")), "labels")
        for _ in range(LABEL_STEPS):
            onward = label.select(F.col("cid").alias("root"), F.col("root").alias("next"))
            label = written(label.join(onward, "root", "left").select("cid", F.coalesce("next", "root").alias("root")), "labels")
        left = active.filter("cid <> c.cid").drop("comp")
        active = left.join(label, "cid", "left").select("cid", "n", "h", "rank", F.coalesce("root", "cid").alias("comp"), "gram")
    own = classes.filter(_similar(F.col("n"), F.col("n"), F.col("h")) & (F.col("sids") > 1)).select(F.col("sid").alias("cid"))
    firsts = classes.select(F.col("sid").alias("cid"), "first")
    touched, across = own, None
    for found in links:
        touched = touched.union(found.select("a")).union(found.select("b"))
        across = found if across is None else across.union(found)
    inner = of_class.select("cid", "sid").join(touched.distinct(), "cid").join(firsts, "cid").select(F.col("first").alias("a"), F.col("sid").alias("b"))
    if across is None:
        return inner
    outer = across.join(firsts.toDF("a", "first_a"), "a").join(firsts.toDF("b", "first_b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    return inner.union(outer)


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Rows (doc_id, key, n, root) of all documents; root names the group, null for an empty set."""
    text = F.col(f"`{text_col}`")
    total = B.text_bytes(docs, text_col)
    ranges, bits = B.block_count(total, BLOCK_BYTES), max(16, total.bit_length() + 3)
    keyed = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    source = keyed.withColumn("block", B.block_of([F.col("doc_id"), F.col("key")], ranges))
    answers = _answers(_requests(source, size, bits, ranges))
    rows = written(_ordered_sets(source, answers, size, bits), "sets")
    # Equal sets of different blocks are one set.
    sets = rows.filter("members IS NOT NULL").groupBy("sid").agg(*[F.first(c).alias(c) for c in ("n", "n_single", "n_short", "members", "bitmap")])
    sets = written(sets, "distinct-sets")
    roots = components(_short_links(sets).union(_long_links(sets))).withColumnsRenamed({"node": "sid"})
    linked = rows.filter("n > 0").select("doc_id", "key", "sid", "n").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid")).drop("sid")
    empty = rows.filter("n = 0").select("doc_id", "key", "n", F.lit(None).cast("bigint").alias("root"))
    return cut(linked.union(empty))


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Per row: doc_id, key (hash of the text), n_shingles, component_id.

    Words are lower-cased (A-Z) ``[^\\x20\\x09-\\x0D]+``; a set holds the distinct ``size``-word n-grams, a shorter text is one n-gram as a
    whole. Sets with a Jaccard similarity of at least 75 % are linked; component_id is the smallest id that links lead to. Null
    and empty texts have an empty set and stand alone. Null ids take part in links but are never the smallest, so a group
    of null ids only, or a null id without a word, has a null component_id. Rows with equal ids are rows of their own. Sets are
    told apart by 64-bit hashes. Other columns are ignored. The empty table gives an empty result.
    """
    rows = _grouped(docs, id_col, text_col, size)
    smallest = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    joined = rows.join(smallest, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return joined.select("doc_id", "key", F.col("n").alias("n_shingles"), "component_id")


def first_of_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group of similar documents does, all columns unchanged.

    The smallest id stays (null ids last, equal ids by the hash of the text). Of rows with the same id and the same text one
    stays. Texts without a word belong to no group and stay, repeated rows among them too.
    """
    rows = _grouped(docs, id_col, text_col, size)
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")
    kept = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("kept")).select("kept.doc_id", "kept.key")
    same = rows.filter("root IS NOT NULL").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("rows"))
    kept = kept.join(same, kept["doc_id"].eqNullSafe(same["doc_id"]) & (kept["key"] == same["key"])).select(kept["doc_id"], kept["key"], "rows")
    alone = rows.filter("root IS NULL").select("doc_id", "key", F.lit(1).cast("bigint").alias("rows")).distinct()
    stay = written(kept.union(alone), "kept").toDF("_id", "_key", "_rows")
    text = docs[f"`{text_col}`"]
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), docs[f"`{id_col}`"].cast("bigint").alias("id"), F.xxhash64(text).alias("key"))
    match = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    once = packed.join(broadcast_if_bytes(stay.filter("_rows = 1")), match, "left_semi").select("doc.*")
    repeated = packed.join(broadcast_if_bytes(stay.filter("_rows > 1")), match, "left_semi").dropDuplicates(["id", "key"])
    return once.unionByName(repeated.select("doc.*"))
