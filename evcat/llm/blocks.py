"""Blocks of documents, and packed number lists that travel between blocks and key ranges.

A block is a bounded share of the documents, chosen by hash. Instead of one row per document and key, a block sends one packed list
of its keys to each key range and gets one packed answer back. A task holds one block, or one key range, at a time.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 16 << 20


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0)


def block_count(total_bytes: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(1, -(-total_bytes // block_bytes))


def block_of(keys: list[Column], blocks: int) -> Column:
    """Block number of a row; equal texts of different documents spread over all blocks."""
    return F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")


def pack(values: np.ndarray) -> bytes:
    """Numbers by byte planes: the leading bytes of small numbers are all zero and vanish in compression."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel().astype(np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers as packed differences."""
    return pack(np.diff(values.astype(np.uint64), prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def cut_at(values: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Positions that cut ascending ``bits``-bit numbers into key ranges (``ranges`` + 1 entries)."""
    edges = [-(-(r << bits) // ranges) for r in range(ranges)]
    return np.concatenate([np.searchsorted(values, np.array(edges, np.uint64)), [len(values)]])


def boxed(docs: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, box) for a frame with a ``block`` column: the rows of a block that one task read, compressed as one value."""
    fields = [c for c in docs.columns if c != "block"]

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            place = batch.column("block").to_numpy()
            order = np.argsort(place, kind="stable")
            cuts = np.flatnonzero(np.diff(place[order], prepend=-1))
            rows = batch.select(fields)
            names, boxes = [], []
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                part, sink = rows.take(pa.array(order[a:b])), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                    out.write_batch(part)
                names.append(int(place[order[a]]))
                boxes.append(sink.getvalue().to_pybytes())
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(boxes, pa.binary())], names=["block", "box"])

    return docs.mapInArrow(pack_rows, "block int, box binary")


def unboxed(table: pa.Table) -> list[pa.RecordBatch]:
    """The rows of a block again, one batch per box."""
    return [batch for box in table.column("box") for batch in pa.ipc.open_stream(pa.py_buffer(box.as_py()))]
