"""Token ids as binary files with Elias-Fano coded document boundaries.

A shard file holds the concatenated ids of consecutive documents, and two monotone sequences in
Elias-Fano form: the document ids and the n + 1 boundaries. Each sequence of n values up to u costs about
n * (2 + log2(u / n)) bits; a select directory gives any boundary without a 64-bit table.

Layout, all numbers little-endian:
    8 bytes  magic
    6 x u64  null ids, documents, ids, bytes per id, first document id, length of the document-id block
    block    Elias-Fano of (document id - first document id), documents with an id only
    u64      length of the boundary block
    block    Elias-Fano of the boundaries
    ids      unsigned, 2 or 4 bytes each
A block is: 4 x u64 (values, low bits, bytes of low part, bytes of high part), low part, high part, select
directory (u64 position of every SELECT_STEP-th set bit of the high part).
"""
from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evcat.llm import words as W

MAGIC = b"EVIDS01\n"
SELECT_STEP = 256
CACHED_WORDS = 250_000  # of each generation of the cache, which lasts for one task: a worker lives on beside those of later stages
JOINED_WORDS = 1 << 18  # of a long text at once
RANGE_KEY_CHARS = 32


class EliasFano:
    """Monotone non-negative integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if not n:
            empty = np.zeros(0, np.uint8)
            return cls(0, 0, empty, empty, np.zeros(0, np.uint64))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)) + np.arange(n, dtype=np.uint64)
        mask = np.zeros(int(ones[-1]) + 1, np.uint8)
        mask[ones.astype(np.int64)] = 1
        return cls(n, low_bits, low, np.packbits(mask, bitorder="little"), ones[::SELECT_STEP].copy())

    def _low(self, start: int, stop: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(stop - start, np.uint64)
        first, last = start * self.low_bits, stop * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : -(-last // 8)], bitorder="little")[first % 8 :][: last - first]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return (bits.reshape(-1, self.low_bits).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.uint64)
        return (ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low_bits) | self._low(0, self.n)

    def select(self, i: int) -> int:
        """Value i, read from one stretch of the high part."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block, rank = divmod(i, SELECT_STEP)
        at = int(self.samples[block])
        stop = int(self.samples[block + 1]) if block + 1 < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[at // 8 : stop // 8 + 1], bitorder="little")
        one = at // 8 * 8 + int(np.flatnonzero(bits[at % 8 :])[rank]) + at % 8
        return (one - i) << self.low_bits | int(self._low(i, i + 1)[0])

    def stretch(self, block: int) -> np.ndarray:
        """The up to SELECT_STEP values from one entry of the directory on, read from their stretch of the high part."""
        first = block * SELECT_STEP
        count = min(SELECT_STEP, self.n - first)
        at = int(self.samples[block])
        stop = int(self.samples[block + 1]) if block + 1 < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[at // 8 : stop // 8 + 1], bitorder="little")
        ones = np.flatnonzero(bits[at % 8 :])[:count] + at
        return (ones.astype(np.uint64) - np.arange(first, first + count, dtype=np.uint64)) << np.uint64(self.low_bits) | self._low(first, first + count)

    def __iter__(self) -> Iterator[int]:
        for block in range(len(self.samples)):
            yield from self.stretch(block).tolist()

    def to_bytes(self) -> bytes:
        head = struct.pack("<4Q", self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> EliasFano:
        n, low_bits, n_low, n_high = struct.unpack_from("<4Q", data)
        low = np.frombuffer(data, np.uint8, n_low, 32)
        high = np.frombuffer(data, np.uint8, n_high, 32 + n_low)
        return cls(n, low_bits, low, high, np.frombuffer(data, "<u8", -1, 32 + n_low + n_high) if n else np.zeros(0, np.uint64))


class Shard:
    """One shard file: ``ids(i)`` of its i-th document, offsets by select."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token-id shard")
        self.n_null, self.n_docs, self.n_ids, self.width, first, size = struct.unpack_from("<4QqQ", view, 8)
        at = 8 + 48
        self.first, self.known = first, EliasFano.from_bytes(view[at : at + size])
        at += size
        (size,) = struct.unpack_from("<Q", view, at)
        self.bounds = EliasFano.from_bytes(view[at + 8 : at + 8 + size])
        self.flat = np.frombuffer(view, f"<u{self.width}", self.n_ids, at + 8 + size)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.first + self.known.select(i - self.n_null)

    def ids(self, i: int) -> np.ndarray:
        return self.flat[self.bounds.select(i) : self.bounds.select(i + 1)]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, offset in the shard and ids of each document, one after the other."""
        bounds, known = iter(self.bounds), iter(self.known)
        start = next(bounds)
        for i, end in enumerate(bounds):
            yield None if i < self.n_null else self.first + next(known), start, self.flat[start:end]
            start = end


def shard_bytes(doc_ids: list[int | None], sizes: list[int], ids: bytes, width: int) -> bytes:
    """File content for documents in ascending id order, null ids first."""
    known = [d for d in doc_ids if d is not None]
    first = known[0] if known else 0
    docs = EliasFano.encode(np.array([d - first for d in known], np.uint64)).to_bytes()
    bounds = EliasFano.encode(np.concatenate([[0], np.cumsum(sizes)])).to_bytes()
    head = MAGIC + struct.pack("<4QqQ", len(doc_ids) - len(known), len(doc_ids), len(ids) // width, width, first, len(docs))
    return head + docs + struct.pack("<Q", len(bounds)) + bounds + ids


class WordEncoder:
    """Ids of a word as little-endian bytes.

    The tokenizer cuts at white space, and between a letter or digit and an ASCII sign, so words and their trailing
    signs are encoded once and cached. After any other character (a control character is one piece with the signs that
    follow) and where a special token may stand, words are encoded whole.
    """

    SIGNS = b"".join(bytes([b]) for b in range(33, 127) if not chr(b).isalnum())
    # Letters of Latin-1 and Cyrillic (to U+045F), of which normalising changes nothing but the case, and signs: on bytes.
    FORM = r"\A(?P<core>(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xd0[\x80-\xbf]|\xd1[\x80-\x9f])+)(?P<signs>[!-/:-@\[-`{-~]*)\z"
    SMALL = "[a-z\u00df-\u00f6\u00f8-\u00ff\u0430-\u045f]+"  # one piece for the merges

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs one task per core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.layout = "H" if self.width == 2 else "I"
        self.words = W.WordCache(self._word, CACHED_WORDS)
        self.small = re.compile(self.SMALL).fullmatch
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # the characters the model has for bytes
        self.byte_level = {i: as_bytes.pre_tokenize_str(chr(i))[0][0] for i in range(128, 0x460) if self.small(chr(i))}

    def _whole(self, word: bytes) -> list[int]:
        return self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.small(text):
            ids = [t.id for t in self.model.tokenize(text if word.isascii() else text.translate(self.byte_level))]
        else:
            core = word.rstrip(self.SIGNS)
            plain, signs = core.lower() if core.isascii() else core, word[len(core) :]  # a mark may join the small letter and not the capital
            if b"<|" not in word and core[-1:].isalnum() and plain != word:
                # Other forms of a word find its ids in the same cache.
                return self.words[plain] + (self.words[signs] if signs else b"")
            ids = self._whole(word)
        return struct.pack(f"<{len(ids)}{self.layout}", *ids)

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text; the distinct words of all are taken apart together. Null counts as empty."""
        words, bounds = W.blank_word_array(texts)
        coded = words.dictionary_encode()
        form = pc.extract_regex(coded.dictionary, self.FORM)  # null for words of another form, which stay whole
        core, signs = (pc.struct_field(form, name).cast(pa.string()) for name in ("core", "signs"))
        core = pc.coalesce(pc.utf8_lower(core).cast(pa.binary()), coded.dictionary)
        parts = pa.concat_arrays([core, pc.fill_null(signs, "").cast(pa.binary())]).dictionary_encode()
        known = list(map(self.words.__getitem__, parts.dictionary.to_numpy(zero_copy_only=False)))
        ids = np.frombuffer(b"".join(known), f"<u{self.width}")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // self.width
        first = np.cumsum(sizes) - sizes
        codes, pairs = coded.indices.to_numpy(), parts.indices.to_numpy().reshape(2, -1).T

        def joined(codes: np.ndarray) -> bytes:
            part = pairs[codes].ravel()
            n = sizes[part]
            return ids[np.arange(n.sum()) + np.repeat(first[part] - (np.cumsum(n) - n), n)].tobytes()

        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield b"".join(joined(codes[i : min(i + JOINED_WORDS, end)]) for i in range(start, end, JOINED_WORDS))

    def encode(self, text: bytes | None) -> bytes:
        return next(self.encode_all(pa.array([text], pa.binary())))


def encoder(path: str) -> WordEncoder:
    return W.worker_object("word_encoder", path, lambda: WordEncoder(path))


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _put(folder: str, name: str, content: bytes) -> None:
    """Write under a temporary name, then rename: a repeated or lost task leaves no half file."""
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    draft = f"{root}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(content)
    store.move(draft, f"{root}/{name}")


def write_token_ids(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 8_000_000, shard_docs: int = 200_000
) -> None:
    """Encode whole texts, append ``end_id`` to each, and write shards in ascending id order to a new shared folder.

    Null texts count as empty, documents with a null id come first, rows with equal ids follow each other in the
    order of their texts. ``shard_ids`` and ``shard_docs`` bound what a task holds before it writes (a longer document
    makes a longer shard). Other columns are ignored. ``folder/manifest`` gets one row per shard.
    """
    # The bounds of the ranges are sampled at the driver, so their keys are short; the order inside a range is by the whole text.
    ordered = (
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange("doc_id", F.left("text", F.lit(RANGE_KEY_CHARS)))
        .sortWithinPartitions("doc_id", "text")
    )

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end = np.array([end_id], f"<u{enc.width}").tobytes()
        part = TaskContext.get().partitionId()
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        held = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, doc_ids, held, number
            name = f"part-{part:06d}-{number:05d}.evids"
            sizes = [len(x) // enc.width for x in ids]
            _put(f"{folder}/shards", name, shard_bytes(doc_ids, sizes, b"".join(ids), enc.width))
            row = pa.RecordBatch.from_pydict({"shard": [name], "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([sum(sizes)], pa.int64())})
            ids, doc_ids, held, number = [], [], 0, number + 1
            return row

        try:
            for batch in batches:
                for block in W.slices(batch, 1):
                    for doc_id, own in zip(block.column(0).to_pylist(), enc.encode_all(block.column(1))):
                        ids.append(own + end)
                        doc_ids.append(doc_id)
                        held += len(ids[-1]) // enc.width
                        if held >= shard_ids or len(ids) >= shard_docs:
                            yield flush()
            if ids:
                yield flush()
        finally:
            enc.words.drop()

    ordered.mapInArrow(shards, "shard string, n_docs bigint, n_ids bigint").write.parquet(f"{folder}/manifest")


def read_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the written files: doc_id, start (ids before it), n_tokens, ids_crc32 (ids as 32-bit little-endian)."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    starts = manifest.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("shard_start"))
    schema = "shard string, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint"
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(content.as_py())
                ids, offsets, sizes, crcs = [], [], [], []
                for doc_id, offset, own in shard.documents():
                    ids.append(doc_id)
                    offsets.append(offset)
                    sizes.append(len(own))
                    crcs.append(zlib.crc32(own.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * shard.n_docs), *[pa.array(values, pa.int64()) for values in (ids, offsets, sizes, crcs)]],
                    names=["shard", "doc_id", "offset", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.evids").load(f"{folder}/shards")
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content").mapInArrow(documents, schema)
    return rows.join(starts, "shard").select("doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
