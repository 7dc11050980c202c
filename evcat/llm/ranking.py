"""Ranked lexical search as an exact inner-product search over sparse ball trees.

The score of a document for an item is the inner product of the item's term counts with the document's vector of term values, weight
times impact. An inner product with any item of a block reads only the coordinates of the block's terms, so documents are projected onto them:
that keeps every score and makes the balls smaller. Each task builds ball trees over its projected documents and searches them best-first
for all items of the block, carrying each item's worst kept score from tree to tree. A subtree whose bound |center * q| + radius * |q|, raised by
more than the rounding of doubles can lower it, lies below that score is left out. Scores at leaves are 64-bit integers.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evcat.llm import words as W
from evcat.llm.folders import written

TOP = 10
BLOCK_BYTES = 256 << 10  # text of the items of one block, which a task holds with their terms
TREE_CELLS = 4_000_000  # documents x terms of one tree
TREE_DOCS = 4_096
LEAF = 32
SPREAD = 64  # parts that an item's candidates are first ranked in


@dataclass(frozen=True)
class Block:
    """Items of one block: their terms, and per item the numbers and counts of its terms."""

    ids: list
    numbers: list[int]
    terms: dict[bytes, int]
    queries: list[tuple[np.ndarray, np.ndarray]]


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The distinct items in blocks of bounded size, one at the driver at a time."""
    rows = items.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("text IS NOT NULL").distinct()
    total = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    blocks = -(-total // (block_bytes // 2)) if total > block_bytes else 1
    spread = written(rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))), "items")
    number = 0
    for at in range(blocks):
        ids, numbers, terms, queries = [], [], {}, []
        for row in sorted(spread.filter(F.col("block") == at).collect(), key=lambda r: (r["id"] is None, r["id"], r["text"])):
            words = W.alnum_words(row["text"].encode())
            own = np.array([terms.setdefault(w, len(terms)) for w in words], np.int64)
            ids.append(row["id"])
            numbers.append(number)
            queries.append(np.unique(own, return_counts=True))
            number += 1
        if terms:
            yield Block(ids, numbers, terms, queries)


def _projected(docs: DataFrame, id_col: str, text_col: str, terms: dict[bytes, int]) -> DataFrame:
    """(doc, n, terms, counts) of every document with a term: its length, and the block's terms in it."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = terms.get
        for batch in batches:
            for piece in W.slices(batch, 1):
                ids, sizes, found, counts = [], [], [], []
                for doc, text in zip(piece.column(0).to_pylist(), W.utf8(piece.column(1))):
                    words = W.alnum_words(text)
                    if words:
                        own, times = np.unique(np.array([t for t in map(number, words) if t is not None], np.int32), return_counts=True)
                        ids.append(doc)
                        sizes.append(len(words))
                        found.append(own)
                        counts.append(times)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                    names=["doc", "n", "terms", "counts"],
                )

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.col(f"`{text_col}`").alias("text")).filter("text IS NOT NULL")
    return rows.mapInArrow(project, "doc bigint, n bigint, terms array<int>, counts array<bigint>")


class BallTree:
    """Center, radius and halves of every node over the rows of a matrix; a node's rows are ``order[start:stop]``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.span: list[tuple[int, int]] = []
        self.halves: list[tuple[int, int] | None] = []
        centers, radii = [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            start, stop, parent, side = todo.pop()
            at = len(self.span)
            if parent >= 0:
                self.halves[parent] = (at, self.halves[parent][1]) if side == 0 else (self.halves[parent][0], at)
            own = points[self.order[start:stop]]
            center = own.mean(axis=0)
            away = np.sqrt(np.square(own - center).sum(axis=1))
            self.span.append((start, stop))
            centers.append(center)
            radii.append(float(away.max()))
            if stop - start <= leaf or not radii[-1]:
                self.halves.append(None)
                continue
            # Halved along the line from the farthest point to the point farthest from it.
            first = own[int(away.argmax())]
            second = own[int(np.square(own - first).sum(axis=1).argmax())]
            rank = np.argsort(own @ (second - first), kind="stable")
            self.order[start:stop] = self.order[start:stop][rank]
            middle = (start + stop) // 2
            self.halves.append((-1, -1))
            todo += [(middle, stop, at, 1), (start, middle, at, 0)]
        self.centers, self.radii = np.array(centers), np.array(radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Bound of every inner product in every node (queries x nodes).

        Sums over ``terms`` doubles are off by at most terms * eps of the product of the norms, in the center, the radius and the
        inner product alike; the bound is raised by eight times that.
        """
        size = np.sqrt(np.square(queries).sum(axis=1))[:, None]
        reach = np.sqrt(np.square(self.centers).sum(axis=1)) + self.radii
        slack = 8 * (queries.shape[1] + len(self.order) + 8) * np.finfo(np.float64).eps
        return queries @ self.centers.T + size * self.radii + slack * size * reach + 1


class TopDocuments:
    """The best documents of one item: highest score first, then smallest id, null ids last."""

    def __init__(self, k: int):
        self.k, self.heap = k, []  # worst first

    def worst(self) -> int:
        """Score below which nothing is wanted."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def offer(self, score: int, doc: int | None) -> None:
        entry = (score, doc is not None, 0 if doc is None else -doc)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)

    def rows(self) -> list[tuple[int, int | None]]:
        return [(score, -back if known else None) for score, known, back in self.heap]


def search_tree(tree: BallTree, values: np.ndarray, ids: list, block: Block, bounds: np.ndarray, best: list[TopDocuments]) -> int:
    """Best-first search of all items; returns the number of leaves that were scored."""
    scored = 0
    for q, (terms, counts) in enumerate(block.queries):
        if not len(terms):
            continue
        top, reach = best[q], bounds[q]
        todo = [(-reach[0], 0)]
        while todo and -todo[0][0] >= top.worst():
            node = heapq.heappop(todo)[1]
            halves = tree.halves[node]
            if halves:
                for half in halves:
                    if reach[half] >= top.worst():
                        heapq.heappush(todo, (-reach[half], half))
                continue
            start, stop = tree.span[node]
            rows = tree.order[start:stop]
            scores = values[np.ix_(rows, terms)] @ counts
            scored += 1
            for i in np.flatnonzero(scores >= top.worst()).tolist():
                top.offer(int(scores[i]), ids[rows[i]])
    return scored


def _candidates(vectors: DataFrame, block: Block, weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """(number, doc, score): the best ``k`` documents of each item in each task."""
    terms = len(weights)
    per_tree = max(LEAF, min(TREE_DOCS, TREE_CELLS // max(terms, 1)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = np.zeros((len(block.queries), terms))
        for q, (own, counts) in enumerate(block.queries):
            queries[q, own] = counts
        best = [TopDocuments(k) for _ in block.queries]

        def flush(ids: list, sizes: np.ndarray, rows: np.ndarray, own: np.ndarray, counts: np.ndarray) -> None:
            m = 100 - 75 + (75 * sizes * documents) // length
            values = np.zeros((len(ids), terms), np.int64)
            values[rows, own] = weights[own] * ((1_000_000_000 * counts) // (1000 * counts + 8 * m[rows]))
            tree = BallTree(values.astype(np.float64))
            search_tree(tree, values, ids, block, tree.bounds(queries), best)

        for batch in batches:
            for start in range(0, batch.num_rows, per_tree):
                part = batch.slice(start, per_tree)
                found, times = part.column(2), part.column(3)
                held = np.diff(found.offsets.to_numpy())
                rows = np.repeat(np.arange(part.num_rows), held)
                own, counts = found.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False)
                flush(part.column(0).to_pylist(), part.column(1).to_numpy(), rows, own, counts)
        rows = [(number, doc, score) for number, top in zip(block.numbers, best) for score, doc in top.rows()]
        numbers, docs, scores = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(docs, pa.int64()), pa.array(scores, pa.int64())], names=["number", "doc", "score"])

    return vectors.select("doc", "n", "terms", "counts").mapInArrow(search, "number bigint, doc bigint, score bigint")


def ranked(candidates: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each number, ranked in parts first so that no task gets all candidates of an item."""
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc", "score"), F.lit(SPREAD))
    first = candidates.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("number", "part").orderBy(*order)))
    kept = first.filter(F.col("place") <= k)
    last = kept.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order)))
    return last.filter(F.col("rank") <= k).select("number", "rank", "doc", "score")


def ranked_search(
    docs: DataFrame, items: DataFrame, *, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item with a score above 0.

    Terms are ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. Equal scores go by ascending id, null ids last. Null and
    empty texts, items and tables have no terms and give no rows. Repeated documents are documents of their own; equal items are one
    item, and items of one id with different texts are ranked on their own, each from 1. Other columns are ignored.

    Documents are read once per block of items and written as counts of the block's terms; document frequencies and lengths are sums over all
    of them. A task gives at most ``k`` rows per item.
    """
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for block in item_blocks(items, item_col, item_text_col):
        vectors = written(_projected(docs, id_col, text_col, block.terms), "vectors")
        documents, length = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            continue
        df = np.zeros(len(block.terms), np.int64)
        for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():  # at most the block's terms
            df[row["term"]] = row["df"]
        weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1).astype(np.float64))).astype(np.int64)
        found = ranked(_candidates(vectors, block, weights, documents, length, k), k)
        names = spark.createDataFrame(list(zip(block.numbers, block.ids)), f"number bigint, item_id {kind}")
        out = out.unionByName(found.join(F.broadcast(names), "number").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score"))
    return out
