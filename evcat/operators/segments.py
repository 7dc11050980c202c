"""Search index in segments: block-coded postings with skip entries, one segment per batch of changes, merged on demand.

A key is a term of the search tokens or a short fragment of a searched field. Its postings are rows of at most ``BLOCK`` sorted document ids with
their first and last id. Documents are dealt by ranges of their id; the blocks of a range are sorted by key, so a look-up reads the pages of its
keys and skips the blocks outside the range that all its keys share. A batch adds a segment with the changed documents and the list of their ids,
beside each the terms and texts its keys come from; an id that a later segment lists is void in the earlier ones. ``merge`` writes one segment from
the lists, without void and deleted documents.
"""
from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evcat.functions.stem import query_terms
from evcat.session import cut

BLOCK = 128
GRAM = 3
PHRASE_FIELDS = ("title", "short_description", "community_name")
# The ids of a block are the lines of one text; as rows of lists they cost more than the rest of the index.
_COLUMNS = ["key", "first", "last", "size", "docs"]
_POSTINGS = "key string, first string, last string, size int, docs string"
_TEXTS = "array<struct<field: string, text: string>>"
_DOCUMENTS = f"doc string, gone boolean, terms array<string>, texts {_TEXTS}"
# Characters of texts times bytes of ids in a piece of a batch; its postings take about three times that in memory.
_PIECE = 1 << 24


def _joined(starts: np.ndarray, lines: pa.Array) -> pa.Array:
    """Stretches of lines, given by their starts, as one text each."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(lines)), pa.int32()), lines), "\n")


def _ids(text: Column) -> Column:
    """The ids of a block as a list."""
    ids = F.split(text, "\n")
    plain = lambda d: F.replace(F.replace(d, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
    return F.when(F.contains(text, F.lit("%")), F.transform(ids, plain)).otherwise(ids)


def _sliced(codes: np.ndarray, owners: np.ndarray, keys: Callable[[np.ndarray], pa.Array], docs: pa.Array) -> pa.RecordBatch:
    """Numbered keys and the places of their documents in ``docs`` as blocks, one key after the other; a document counts once for a key."""
    bits = len(docs).bit_length()
    if codes.max(initial=0) >> (63 - bits):
        numbers, codes = np.unique(codes, return_inverse=True)
        named = lambda found: keys(numbers[found])
    else:
        named = keys
    pairs = np.sort(codes << bits | owners)
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]
    codes, members = pairs >> bits, pairs & ((1 << bits) - 1)
    new_key = np.diff(codes, prepend=-1) != 0
    place = np.arange(len(codes))
    within = place - np.maximum.accumulate(np.where(new_key, place, 0))
    starts = np.flatnonzero(within % BLOCK == 0)
    ends = np.append(starts[1:], len(codes))
    key = named(codes[new_key]).take(pa.array(np.cumsum(new_key)[starts] - 1))
    first, last = (docs.take(pa.array(members[n])) for n in (starts, ends - 1))
    lines = pc.replace_substring(pc.replace_substring(docs, "%", "%25"), "\n", "%0A").take(pa.array(members))
    return pa.RecordBatch.from_arrays([key, first, last, pa.array(ends - starts, pa.int32()), _joined(starts, lines)], _COLUMNS)


def _term_keys(terms: pa.Array) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], pa.Array]]:
    """Numbers and documents of all terms, and the keys of numbers."""
    coded = pc.list_flatten(terms).dictionary_encode()
    given = coded.is_valid().to_numpy(zero_copy_only=False)
    codes = coded.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    owners = pc.list_parent_indices(terms).to_numpy(zero_copy_only=False)
    return codes[given], owners[given], lambda found: pc.binary_join_element_wise("=", coded.dictionary.take(pa.array(found)), "")


def _fragment_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], pa.Array]]:
    """Numbers and documents of all fragments of one to GRAM characters, and the keys of numbers.

    Characters are digits from 1, so that a fragment is a number of GRAM digits, zeros at the end of a short one, behind its field.
    """
    flat, parents = pc.list_flatten(texts), pc.list_parent_indices(texts).to_numpy(zero_copy_only=False)
    field = flat.field("field").dictionary_encode()
    strings = [b.decode("utf-8", "replace") for b in flat.field("text").cast(pa.binary()).fill_null(b"").to_pylist()]
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    points = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
    alphabet, digits = np.unique(points, return_inverse=True)
    digits, base = np.append(digits + 1, np.zeros(GRAM, np.int64)), len(alphabet) + 1
    owner, left = np.repeat(parents, lengths), np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))
    code = np.repeat(field.indices.to_numpy(zero_copy_only=False).astype(np.int64), lengths)
    codes, owners = [], []
    for n in range(GRAM):
        code = code * base + digits[n : n + len(points)]
        inside = left > n
        codes.append(code[inside] * base ** (GRAM - 1 - n))
        owners.append(owner[inside])
    letters = pa.array(["", *map(chr, alphabet.tolist())], pa.string())

    def keys(found: np.ndarray) -> pa.Array:
        signs = [letters.take(pa.array(found // base**n % base)) for n in reversed(range(GRAM))]
        fragment = pc.binary_join_element_wise(*signs, "")
        return pc.binary_join_element_wise(field.dictionary.take(pa.array(found // base**GRAM)), fragment, ":")

    return np.concatenate(codes), np.concatenate(owners), keys


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of documents whose postings take a bounded space; a document is not divided."""
    texts = batch.column("texts")
    sizes = pc.binary_length(pc.list_flatten(texts).field("text")).fill_null(0).to_numpy(zero_copy_only=False)
    chars = np.bincount(pc.list_parent_indices(texts).to_numpy(zero_copy_only=False), sizes, len(batch))
    space = np.cumsum((chars + 8) * (pc.binary_length(batch.column("doc")).to_numpy(zero_copy_only=False) + 8))
    starts = np.flatnonzero(np.diff(space // _PIECE, prepend=-1))
    for start, end in zip(starts, np.append(starts[1:], len(batch))):
        yield batch.slice(start, end - start)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their terms and texts, sorted by document, as blocks per piece."""
    for batch in batches:
        for piece in _pieces(batch):
            for numbered in (_term_keys(piece.column("terms")), _fragment_keys(piece.column("texts"))):
                if len(numbered[0]):
                    yield _sliced(*numbered, piece.column("doc"))


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks; neighbours of one key are put together while they fit into one block."""
    for batch in batches:
        if not len(batch):
            continue
        key, first, last, size, docs = (batch.column(c) for c in _COLUMNS)
        starts, current, room = [], None, 0
        for n, (code, count) in enumerate(zip(key.dictionary_encode().indices.to_pylist(), size.to_pylist())):
            if code != current or count > room:
                starts.append(n)
                current, room = code, BLOCK
            room -= count
        starts = np.array(starts)
        ends = pa.array(np.append(starts[1:], len(batch)) - 1)
        sizes = pa.array(np.add.reduceat(size.to_numpy(zero_copy_only=False), starts), pa.int32())
        yield pa.RecordBatch.from_arrays([key.take(pa.array(starts)), first.take(pa.array(starts)), last.take(ends), sizes, _joined(starts, docs)], _COLUMNS)


def phrase_keys(phrase: str) -> list[str] | None:
    """Fragments that every text LIKE %phrase% holds; None where the pattern does not fix any."""
    if "\\" in phrase:
        return None
    pieces = [p for p in re.split("[%_]", phrase.lower()) if p]
    found = [p[i : i + GRAM] for p in pieces for i in range(max(1, len(p) - GRAM + 1))]
    return list(dict.fromkeys(found)) or None


class SearchIndex:
    """Segments below ``root``; the highest version of the manifest names the live ones in their order."""

    def __init__(self, spark: SparkSession, root: str, fields: Sequence[str] = PHRASE_FIELDS, files: int | None = None):
        self.spark, self.root, self.fields = spark, root, tuple(fields)
        self.files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.createDataFrame([], "segment string, place int").write.mode("ignore").parquet(f"{root}/manifest/version=0")

    # --- Segments ---------------------------------------------------------------------------
    def _manifest(self) -> DataFrame:
        return self.spark.read.schema("segment string, place int, version int").parquet(f"{self.root}/manifest")

    def _version(self) -> int:
        """Folders of the manifest are its versions; an empty one has no row, so the list of folders counts."""
        paths = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.root}/manifest/version=*").select("path")
        return paths.select(F.max(F.regexp_extract("path", "version=([0-9]+)", 1).cast("int"))).first()[0]

    def live(self) -> list[str]:
        version = self._version()
        return [r["segment"] for r in self._manifest().filter(F.col("version") == version).orderBy("place").collect()]

    def _publish(self, segments: list[str]) -> None:
        rows = self.spark.createDataFrame([(s, n) for n, s in enumerate(segments)], "segment string, place int").coalesce(1)
        rows.write.parquet(f"{self.root}/manifest/version={self._version() + 1}")

    def _path(self, segment: str, part: str) -> str:
        return f"{self.root}/segments/{segment}/{part}"

    def _write(self, documents: DataFrame) -> str:
        """A segment of documents with what their keys come from, and of the ids it speaks for with ``gone`` for those deleted.

        Postings are never rows of their own: sorted documents become blocks where they lie, and blocks stay in the range of their documents.
        """
        segment = uuid.uuid4().hex
        # Cut first: ranging samples its input, which would be computed twice.
        documents = cut(documents)
        documents.write.option("compression", "zstd").parquet(self._path(segment, "listed"))
        kept = documents.filter("NOT gone AND doc IS NOT NULL").select("doc", "terms", "texts")
        blocks = kept.repartitionByRange(self.files, "doc").sortWithinPartitions("doc").mapInArrow(_blocks, _POSTINGS)
        filled = blocks.sortWithinPartitions("key", "first").mapInArrow(_filled, _POSTINGS)
        filled.write.option("compression", "zstd").parquet(self._path(segment, "postings"))
        return segment

    def add(self, changed: DataFrame, gone: DataFrame | None = None) -> None:
        """Index new and changed documents (id, search_tokens and the fields; one row per id), and drop those of ``gone`` (id)."""
        given = [F.struct(F.lit(f).alias("field"), F.lower(F.col(f)).alias("text")) for f in self.fields]
        documents = changed.select(F.col("id").alias("doc"), F.lit(False).alias("gone"), F.col("search_tokens").alias("terms"), F.array(*given).cast(_TEXTS).alias("texts"))
        if gone is not None:
            documents = documents.unionByName(gone.select(F.col("id").alias("doc"), F.lit(True).alias("gone")), allowMissingColumns=True)
        self._publish([*self.live(), self._write(documents)])

    def merge(self) -> None:
        """All live segments as one; void and deleted documents are left out."""
        segments = self.live()
        if len(segments) < 2:
            return
        documents = self._valid(self._listed(segments, schema=_DOCUMENTS), segments).filter("NOT gone")
        self._publish([self._write(documents.drop("place"))])

    # --- Look-ups ---------------------------------------------------------------------------
    def _read(self, segments: list[str], keys: Sequence[str] | None) -> DataFrame:
        out = None
        for place, segment in enumerate(segments):
            rows = self.spark.read.schema(_POSTINGS).parquet(self._path(segment, "postings"))
            if keys is not None:
                rows = rows.filter(F.col("key").isin(*keys))
            rows = rows.withColumns({"place": F.lit(place), "docs": _ids(F.col("docs"))})
            out = rows if out is None else out.unionByName(rows)
        return out

    def _listed(self, segments: list[str], after: int = 0, schema: str = "doc string, gone boolean") -> DataFrame:
        out = None
        for place, segment in list(enumerate(segments))[after:]:
            rows = self.spark.read.schema(schema).parquet(self._path(segment, "listed")).withColumn("place", F.lit(place))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _valid(self, found: DataFrame, segments: list[str]) -> DataFrame:
        """Rows (place, doc, ...) whose document no later segment lists. Only the later segments are read, which are small beside the first."""
        if len(segments) < 2:
            return found
        later = self._listed(segments, 1).groupBy(F.col("doc").alias("_doc")).agg(F.max("place").alias("_newest"))
        joined = found.join(later, found["doc"] == F.col("_doc"), "left")
        return joined.filter(F.col("_newest").isNull() | (F.col("_newest") <= F.col("place"))).drop("_doc", "_newest")

    def with_all(self, *groups: Sequence[str]) -> DataFrame:
        """(id): documents that hold every key of one of the groups."""
        wanted = [(n, key) for n, keys in enumerate(groups) for key in dict.fromkeys(keys)]
        segments, none = self.live(), self.spark.createDataFrame([], "id string")
        if not segments or not wanted:
            return none
        sizes = {n: sum(g == n for g, _ in wanted) for n, _ in wanted}
        named = F.broadcast(self.spark.createDataFrame(wanted, "group int, key string"))  # the keys of one search
        blocks = self._read(segments, list(dict.fromkeys(key for _, key in wanted)))
        headers = blocks.groupBy("place", "key").agg(F.min("first").alias("first"), F.max("last").alias("last"))
        shared = (
            headers.join(named, "key")
            .groupBy("place", "group")
            .agg(F.count(F.lit(1)).alias("keys"), F.max("first").alias("low"), F.min("last").alias("high"))
            .filter("low <= high")
            .collect()  # a row per segment and group
        )
        reach = [
            (F.col("place") == r["place"]) & (F.col("group") == r["group"]) & (F.col("last") >= r["low"]) & (F.col("first") <= r["high"])
            for r in shared
            if r["keys"] == sizes[r["group"]]
        ]
        if not reach:
            return none
        skipped = reach[0]
        for more in reach[1:]:
            skipped = skipped | more
        size = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("group"))
        docs = blocks.join(named, "key").filter(skipped).select("place", "group", F.explode("docs").alias("doc"))
        full = docs.groupBy("place", "group", "doc").agg(F.count(F.lit(1)).alias("keys")).filter(F.col("keys") == size)
        return self._valid(full.select("place", "doc"), segments).select(F.col("doc").alias("id")).distinct()

    def candidates(self, q: str, stemmed: bool = True) -> DataFrame | None:
        """(id): all documents that the keyword search for ``q`` can find, to be checked on their fields; None where only a scan can tell."""
        fragments = phrase_keys(q)
        if fragments is None:
            return None
        return self.with_all([f"={t}" for t in query_terms(q, stemmed)], *[[f"{field}:{g}" for g in fragments] for field in self.fields])
