"""Removal of long passages that repeat across documents, on a compacted de Bruijn graph of token k-mers.

Nodes are the k-mers of NODE words that are smallest (by hash) in some window of SPAN words; every such window has
exactly one, and equal windows have the same one. Edges are the longer token k-mers from one node of a document to
the end of the next. Only nodes of two or more documents matter. Where a node has a single edge out, and the
node it leads to a single edge in, both stand in the same documents; such nonbranching paths are compacted,
so a window within a path needs no look-up of its own: the first document of the path is its first document. Windows
that reach over the end of a path are looked up one by one by 128-bit hashes. Every document then maps paths
and windows back to its own word coordinates and drops the words they cover.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evcat.llm import words as W
from evcat.llm.folders import broadcast_if_bytes, written

SPAN, NODE = 50, 20


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest (leftmost of equals) of every ``width`` neighbours, by doubling."""
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        size += step
    return at


def node_of_window(hashes: np.ndarray, span: int, node: int) -> tuple[np.ndarray, np.ndarray]:
    """For every start of ``span`` words the place of its node, and the hash of the node at each place."""
    count = len(hashes) - node + 1
    rolled = np.zeros(max(count, 0), np.uint64)
    for k in range(node):
        rolled = rolled * np.uint64(W.FIRST_BASE) + hashes[k : count + k]
    rolled = W.mixed(rolled)
    return smallest(rolled, span - node + 1), rolled


def nodes(texts: list[list[bytes]], span: int, node: int) -> dict[str, np.ndarray]:
    """All nodes of some texts: text number, place, node hash, edges before and after (0 at the ends)."""
    hashes, bounds = W.hashed(texts)
    if len(hashes) < span:
        empty = np.zeros(0, np.int64)
        return {"doc": empty, "pos": empty, "node": empty, "before": empty, "after": empty}
    chosen, rolled = node_of_window(hashes, span, node)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    starts = np.arange(len(chosen))
    place = chosen[starts + span <= ends[: len(chosen)]]  # windows within one text
    place = place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place
    doc = np.searchsorted(bounds, place, "right") - 1
    edge = W.Rolling(hashes, W.SECOND_BASE)(place[:-1], place[1:] + node) | np.uint64(1)
    edge[doc[1:] != doc[:-1]] = 0
    none = np.zeros(min(1, len(place)), np.uint64)
    return {
        "doc": doc,
        "pos": place - bounds[doc],
        "node": rolled[place].view(np.int64),
        "before": np.concatenate([none, edge]).view(np.int64),
        "after": np.concatenate([edge, none]).view(np.int64),
    }


def _node_rows(docs: DataFrame, span: int, node: int) -> DataFrame:
    """Rows (doc_id, key, pos, node, before, after) of documents with doc_id, key and text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, 2):
                found = nodes([W.blank_words(t) for t in W.utf8(part.column(2))], span, node)
                owner = pa.array(found["doc"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(owner), part.column(1).take(owner), *[pa.array(found[c]) for c in ("pos", "node", "before", "after")]],
                    names=["doc_id", "key", "pos", "node", "before", "after"],
                )

    return docs.mapInArrow(rows, "doc_id bigint, key bigint, pos bigint, node bigint, before bigint, after bigint")


def paths(pos: np.ndarray, joined_in: np.ndarray, joined_out: np.ndarray, node: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (in words) of the compacted path of each node, nodes in the order of a document."""
    breaks = np.concatenate([[True], ~(joined_out[:-1] & joined_in[1:])])
    number = np.cumsum(breaks) - 1
    first = np.flatnonzero(breaks)
    last = np.concatenate([first[1:], [len(pos)]]) - 1
    return pos[first][number], pos[last][number] + node


def _mask(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words inside any of the stretches."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, ends, -1)
    return np.cumsum(edges[:-1]) > 0


def _kept(words: list[bytes], gone: np.ndarray | None) -> tuple[int, str]:
    kept = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
    return len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def _place(doc_id: int, words: list[bytes], pos: np.ndarray, first: np.ndarray, path_start: np.ndarray, path_end: np.ndarray, span: int, node: int):
    """Covered starts that paths settle, and the starts and hashes of the windows that need a look-up."""
    hashes, _ = W.hashed([words])
    chosen, _ = node_of_window(hashes, span, node)
    starts = np.arange(len(chosen))
    at = np.minimum(np.searchsorted(pos, chosen), len(pos) - 1)
    shared = pos[at] == chosen
    starts, at = starts[shared], at[shared]
    within = (starts >= path_start[at]) & (starts + span <= path_end[at])
    settled = starts[within & (first[at] < doc_id)]
    asked = starts[~within]
    return settled, asked, *[W.Rolling(hashes, base)(asked, asked + span).view(np.int64) for base in (W.FIRST_BASE, W.SECOND_BASE)]


def _settle(docs: DataFrame, span: int, node: int) -> DataFrame:
    """Second reading: documents without shared nodes are finished, the others list covered starts and windows to look up."""
    schema = (
        "doc_id bigint, text binary, n_words bigint, n_removed bigint, kept_sha256 string, "
        "settled array<int>, asked array<int>, hash1 array<bigint>, hash2 array<bigint>"
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, 1):
                out: list[tuple] = []
                ids, found = part.column(0).to_pylist(), part.column(2)
                for i, zipped in enumerate(part.column(1).to_pylist()):
                    words = W.blank_words(W.unzipped(zipped))
                    if not found[i].is_valid:
                        out.append((None, len(words), *_kept(words, None), None, None, None, None))
                        continue
                    shared = found[i].values
                    column = {f: shared.field(f).to_numpy(zero_copy_only=False) for f in ("pos", "first", "joined_in", "joined_out")}
                    start, end = paths(column["pos"], column["joined_in"], column["joined_out"], node)
                    settled, asked, hash1, hash2 = _place(ids[i], words, column["pos"], column["first"], start, end, span, node)
                    out.append((zipped, len(words), None, None, settled.astype(np.int32), asked.astype(np.int32), hash1, hash2))
                text, n, gone, sha, settled, asked, hash1, hash2 = zip(*out)
                numbers, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(text, pa.binary()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                        pa.array(sha, pa.string()), pa.array(settled, numbers), pa.array(asked, numbers), pa.array(hash1, longs), pa.array(hash2, longs),
                    ],
                    names=["doc_id", "text", "n_words", "n_removed", "kept_sha256", "settled", "asked", "hash1", "hash2"],
                )

    return docs.mapInArrow(rows, schema)


def _remover(span: int):
    fields = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()}

    def removed(texts: pa.Array, settled: pa.Array, looked_up: pa.Array) -> pa.Array:
        out: dict[str, list] = {name: [] for name in fields}
        for text, known, more in zip(texts.to_pylist(), settled, looked_up):
            words = W.blank_words(W.unzipped(text))
            lists = [x.values.to_numpy(zero_copy_only=False) for x in (known, more) if x.is_valid]
            starts = np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)
            gone, sha = _kept(words, _mask(len(words), starts, starts + span) if len(starts) else None)
            for name, value in zip(fields, (len(words), gone, sha)):
                out[name].append(value)
        return W.struct_array({name: (out[name], kind) for name, kind in fields.items()})

    return F.arrow_udf(removed, "n_words bigint, n_removed bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, node: int = NODE) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 of the words left.

    A word goes when a window of ``span`` words around it also starts in a document with a smaller id. Windows are judged on the
    input. Null or empty texts have no words; a null id is neither smaller nor has a smaller one; rows with equal ids are not
    compared with each other; other columns are ignored. The empty table gives an empty result.
    """
    text = F.col(f"`{text_col}`")
    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    known = source.filter("doc_id IS NOT NULL AND text IS NOT NULL")

    # Nodes of two or more documents, then the edges at them.
    met = _node_rows(known, span, node).groupBy("node").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    shared = written(met.filter("first < last").select("node", "first"), "shared-nodes")
    places = written(_node_rows(known, span, node).join(broadcast_if_bytes(shared), "node"), "shared-places")
    one = lambda c: (F.min(c) == F.max(c)) & (F.min(c) != 0)
    degree = written(places.groupBy("node").agg(one("before").alias("joined_in"), one("after").alias("joined_out")), "degrees")
    flagged = places.select("doc_id", "key", "pos", "node", "first").join(broadcast_if_bytes(degree), "node")
    lists = flagged.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("pos", "first", "joined_in", "joined_out"))).alias("nodes"))

    # Second reading of the texts, with the shared nodes of each document beside it.
    lists = written(lists, "node-lists").withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    packed = source.withColumn("text", W.zipped(F.col("text")))
    beside = packed.join(lists, (F.col("doc_id") == F.col("_id")) & (F.col("key") == F.col("_key")), "left").select("doc_id", "text", "nodes")
    half = written(_settle(beside, span, node).withColumn("row", F.monotonically_increasing_id()), "half")

    # Windows over the ends of paths. Their first documents are a table, so that a window of very many documents can be split in the join.
    asked = half.filter("text IS NOT NULL").select("doc_id", "row", F.explode(F.arrays_zip("asked", "hash1", "hash2")).alias("w"))
    asked = asked.select("doc_id", "row", "w.asked", "w.hash1", "w.hash2")
    firsts = asked.groupBy("hash1", "hash2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    later = asked.join(written(firsts, "first-documents"), ["hash1", "hash2"]).filter("first < doc_id")
    found = later.groupBy("row").agg(F.collect_set("asked").alias("looked_up"))

    done = half.filter("text IS NULL").select("doc_id", "n_words", "n_removed", "kept_sha256")
    rest = half.filter("text IS NOT NULL").select("row", "doc_id", "text", "settled").join(found, "row", "left")
    cleaned = rest.select("doc_id", _remover(span)("text", "settled", "looked_up").alias("r")).select("doc_id", "r.*")
    return done.unionByName(cleaned)
