"""Quality rules: counted signals of a text and the bands its compression ratios must lie in."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

from evcat.llm import words as W

BLANKS = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Allowed ratio (compressed / plain bytes) of texts of at least ``from_bytes``."""

    from_bytes: int
    low: float
    high: float


#: Short texts compress badly whatever they say, so the lower limit falls with length. Below the first band nothing is judged.
WHOLE_BANDS = (Band(200, 0.40, 0.95), Band(400, 0.35, 0.88), Band(800, 0.30, 0.78), Band(1_600, 0.25, 0.72), Band(6_400, 0.20, 0.70))
CHUNK_BYTES = 4_096
CHUNK_BAND = Band(CHUNK_BYTES, 0.20, 0.72)
MAX_BAD_CHUNKS = 0.25

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(hashes: np.ndarray, window: int = 8) -> int:
    """Words inside windows whose word sequence stands at two or more places of the text."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    rolled = np.zeros(n, np.uint64)
    for k in range(window):
        rolled = rolled * MULTIPLIER + hashes[k : n + k]
    codes, _ = pd.factorize(rolled)
    again = np.bincount(codes)[codes] > 1
    edges = np.zeros(len(hashes) + 1, np.int64)
    edges[:n] += again
    edges[window : window + n] -= again
    return int((np.cumsum(edges[:-1]) > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def bad_chunks(text: bytes, compressor: zstandard.ZstdCompressor, size: int, band: Band, bands: Sequence[Band] = WHOLE_BANDS) -> float:
    """Share of the chunks whose ratio is outside their band; 0 for a text below the chunk size, which is judged as a whole.

    Chunks cover every byte: the last partial one is judged by the band of its own length, and one too short for any band is
    part of the chunk before it.
    """
    if len(text) < size:
        return 0.0
    starts = list(range(0, len(text) - size + 1, size))
    tail = starts[-1] + size
    if band_of(len(text) - tail, bands):
        starts.append(tail)
    bad = 0
    for start, end in zip(starts, [*starts[1:], len(text)]):
        limits = band if end - start >= size else band_of(end - start, bands)
        bad += not limits.low <= len(compressor.compress(text[start:end])) / (end - start) <= limits.high
    return bad / len(starts)


def band_of(n_bytes: int, bands: Sequence[Band]) -> Band | None:
    fitting = [b for b in bands if b.from_bytes <= n_bytes]
    return fitting[-1] if fitting else None


def quality(
    text: Column, *, bands: Sequence[Band] = WHOLE_BANDS, chunk_band: Band = CHUNK_BAND, chunk_bytes: int = CHUNK_BYTES,
    max_bad_chunks: float = MAX_BAD_CHUNKS, level: int = 3,
) -> Column:
    """Struct of signals and verdict for a text column.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (under 20 words, or over 30 % of the words
    repeated), ratio (null for an empty text), bad_chunk_share, kept. ``kept`` needs the base rules, the whole text's ratio in
    the band of its length, and at most ``max_bad_chunks`` of its chunks, the last partial one counted, outside theirs. A null text
    has no words and fails.
    """

    def judged(texts: pa.Array) -> pa.Array:
        compressor = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
        out: dict[str, list] = {name: [] for name in FIELDS}
        for text in W.utf8(texts):
            text = text or b""
            words = text.split()
            n = len(words)
            repeat = repeated_words(W.hashed([words])[0])
            failed = n < 20 or 100 * repeat > 30 * n
            ratio = len(compressor.compress(text)) / len(text) if text else None
            share = bad_chunks(text, compressor, chunk_bytes, chunk_band, bands)
            band = band_of(len(text), bands)
            inside = band is None or band.low <= ratio <= band.high
            values = (
                n, len(text.translate(None, BLANKS).decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)), repeated_lines(text),
                repeat, failed, ratio, share, not failed and inside and share <= max_bad_chunks,
            )
            for name, value in zip(FIELDS, values):
                out[name].append(value)
        return W.struct_array({name: (out[name], kind) for name, kind in FIELDS.items()})

    names = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.float64(): "double"}
    return F.arrow_udf(judged, ", ".join(f"{name} {names[kind]}" for name, kind in FIELDS.items()))(text)


FIELDS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(), "ratio": pa.float64(), "bad_chunk_share": pa.float64(), "kept": pa.bool_(),
}
