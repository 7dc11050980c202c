"""Words, word caches and per-worker objects shared by the operators of this folder."""
from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators of the two word definitions: ASCII blanks, and everything ASCII that is no letter or digit.
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
TO_LOWER = bytes.maketrans(UPPER, LOWER)
_ALNUM = set(range(48, 58)) | set(range(65, 91)) | set(range(97, 123)) | set(range(128, 256))
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
TO_ALNUM = bytes(TO_LOWER[b] if b in _ALNUM else 32 for b in range(256))


def blank_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text; none for null."""
    return text.split() if text else []


def blank_word_array(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The same words of a column of texts one after the other, and where each text starts (one more entry for the end)."""
    raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    solid = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)  # where a word may start or end for another reason than a blank
    edge[offsets] = True
    starts = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]])))
    ends = np.flatnonzero(solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[solid])])
    return words, np.searchsorted(starts, offsets)


def lower_blank_words(text: bytes | None) -> list[bytes]:
    """The same words with A-Z in lower case."""
    return text.translate(TO_LOWER).split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(TO_ALNUM).split() if text else []


class WordCache(dict):
    """Value of each word, computed on first use.

    Memory stays bounded: when ``limit`` words are held they become the old generation, from which words still in use move
    over, and the generation before is dropped.
    """

    def __init__(self, make: Callable[[bytes], Any], limit: int = 300_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, word: bytes) -> Any:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        self[word] = value
        return value

    def drop(self) -> None:
        """Forget all words."""
        self.clear()
        self.old = {}


def worker_object(name: str, key: object, make: Callable[[], Any]) -> Any:
    """Object kept by a Python worker, which serves many tasks: one of each name, so that another model replaces the one before."""
    store = sys.modules.setdefault("_evcat_worker", types.ModuleType("_evcat_worker")).__dict__
    if name not in store or store[name][0] != key:
        store.pop(name, None)
        store[name] = key, make()
    return store[name][1]


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """Texts of an Arrow column as UTF-8 bytes, one at a time."""
    raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for value in raw:
        yield value.as_py()


def struct_array(fields: dict[str, tuple[list, pa.DataType]]) -> pa.StructArray:
    """Struct column from named lists."""
    arrays = [pa.array(values, type=kind) for values, kind in fields.values()]
    return pa.StructArray.from_arrays(arrays, names=list(fields))


def slices(batch: pa.RecordBatch, column: int, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``max_bytes`` of one text column, so that arrays over all words of a piece stay small."""
    start = held = 0
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    for i, size in enumerate(sizes):
        if i > start and held + size > max_bytes:
            yield batch.slice(start, i - start)
            start = i
            held = 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def hashed(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and where each text starts (one more entry for the end)."""
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for x in texts for w in x), np.uint64, int(bounds[-1])), bounds


def mixed(values: np.ndarray) -> np.ndarray:
    """Finalised 64-bit hashes: every bit depends on all bits."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


class Rolling:
    """Hashes of any stretches of a sequence of word hashes."""

    def __init__(self, hashes: np.ndarray, base: int):
        powers = np.full(len(hashes) + 1, base, np.uint64)
        inverse = np.full(len(hashes) + 1, pow(base, -1, 1 << 64), np.uint64)
        powers[0] = inverse[0] = 1
        self.powers = np.cumprod(powers)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(inverse)[:-1], dtype=np.uint64)])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.powers[ends])


FIRST_BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def zipped(text: Column) -> Column:
    """Compressed texts, for rows that must be shuffled with their whole text; null stays null."""

    def shrink(texts: pa.Array) -> pa.Array:
        compressor = zstandard.ZstdCompressor(level=1)
        return pa.array([None if t is None else compressor.compress(t) for t in utf8(texts)], pa.binary())

    return F.arrow_udf(shrink, "binary")(text)


def unzipped(data: bytes | None) -> bytes | None:
    return None if data is None else zstandard.ZstdDecompressor().decompress(data)
