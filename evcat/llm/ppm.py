"""Language-model scores by prediction by partial matching over bytes, beside a word base line.

The model is a byte-context trie: counts of every byte after contexts of 0 to ORDER bytes of the training texts. A byte is coded
at the longest context that was met; at each context that lacks the byte an escape is paid (method C: distinct bytes over
total plus distinct), and bytes the longer context had are excluded from the counts below. Because every byte that follows a
context also follows its suffixes, exclusion needs only two numbers per context.

Documents are read in blocks. A block asks once for each of its distinct (ORDER + 1)-grams and words: the requests give the
corpus counts, the trie is built in shards by the last context bytes, and every block gets back one code length per gram it asked
for. So no task holds more than a block, a shard, or a key range, and all texts are counted and scored whole.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evcat.llm import blocks as B
from evcat.llm import words as W
from evcat.llm.folders import written

ORDER = 5
END = 0xFF  # never part of UTF-8; ends a text and fills the context before it
END_WORD = xxhash.xxh3_64_intdigest(b"")  # no word is empty
SHARDS = 256
_PIECE = 2 << 20


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(order + 1)-byte codes of every byte and the end of each text, and where each text starts among them."""
    lead = bytes([END]) * order
    flat = np.frombuffer(b"".join(lead + t + bytes([END]) for t in texts), np.uint8).astype(np.uint64)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    codes = np.zeros(max(0, len(flat) - order), np.uint64)
    for k in range(order + 1):
        codes = codes << np.uint64(8) | flat[k : len(codes) + k]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    # Codes that end in the lead of a text are none of its bytes.
    wanted = np.arange(starts[-1]) + np.repeat(np.arange(len(texts)) * order, sizes)
    return codes[wanted], starts


def _pieces(texts: list[bytes]) -> list[tuple[int, int]]:
    cuts, held = [0], 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= _PIECE:
            cuts.append(i + 1)
            held = 0
    if cuts[-1] < len(texts):
        cuts.append(len(texts))
    return list(zip(cuts[:-1], cuts[1:]))


def _merged(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all lists in ascending order, and the place of every listed key among them."""
    at, met = pd.factorize(np.concatenate([np.zeros(0, np.uint64), *keys]))
    turn = np.argsort(met)
    rank = np.empty(len(turn), np.int64)
    rank[turn] = np.arange(len(turn))
    return met[turn], rank[at]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and their summed counts."""
    distinct, at = _merged(keys)
    return distinct, np.bincount(at, weights=np.concatenate([np.zeros(0), *counts]), minlength=len(distinct)).astype(np.int64)


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in ascending order and how often each occurs."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1]]))
    return codes[first], np.diff(first, append=len(codes))


def _counted(codes: np.ndarray, teaches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in ascending order and how often each teaches."""
    distinct, n = _runs(codes)
    spared, m = _runs(codes[~teaches])
    n[np.searchsorted(distinct, spared)] -= m
    return distinct, n


def gram_counts(texts: list[bytes], learns: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of the texts, ascending, with their counts in the texts that teach."""
    keys, counts = [], []
    for a, b in _pieces(texts):
        codes, starts = grams(texts[a:b], order)
        distinct, n = _counted(codes, np.repeat(learns[a:b], np.diff(starts)))
        keys.append(distinct)
        counts.append(n)
    return _summed(keys, counts)


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and of its end, and where each text starts among them."""
    hashes, bounds = W.hashed([W.blank_words(t) for t in texts])
    starts = bounds + np.arange(len(bounds))
    keys = np.full(int(starts[-1]), END_WORD, np.uint64)
    inside = np.ones(len(keys), bool)
    inside[starts[1:] - 1] = False
    keys[inside] = hashes
    return keys, starts


def word_counts(texts: list[bytes], learns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for a, b in _pieces(texts):
        codes, starts = word_keys(texts[a:b])
        distinct, n = _counted(codes, np.repeat(learns[a:b], np.diff(starts)))
        keys.append(distinct)
        counts.append(n)
    return _summed(keys, counts)


def listed(texts: list[bytes], keys_of: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Distinct keys of the texts, ascending; per piece, the places of its own distinct keys among them, which of these each key is, and where each text starts."""
    own, found = [], []
    for a, b in _pieces(texts):
        keys, starts = keys_of(texts[a:b])
        at, met = pd.factorize(keys)
        own.append(met)
        found.append((at.astype(np.int32), starts))
    distinct, places = _merged(own)
    cuts = np.cumsum([0, *map(len, own)])
    return distinct, [(places[i:j], at, starts) for i, j, (at, starts) in zip(cuts[:-1], cuts[1:], found)]


def by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ascending keys by their part (a hash), and the part of each key."""
    part = (W.mixed(keys) % np.uint64(parts)).astype(np.int64)
    return np.argsort(part, kind="stable"), part


class Trie:
    """Counts of a shard: all grams whose context ends in the same two bytes, with the two lowest orders of the corpus."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int):
        """``codes`` distinct grams with training counts (0: only asked for); ``pairs`` 256 x 256 counts (byte before, byte)."""
        self.order, self.codes = order, codes
        single = pairs.sum(axis=0)
        before, byte = (codes >> np.uint64(8) & np.uint64(255)).astype(np.int64), (codes & np.uint64(255)).astype(np.int64)
        # Per order: count of the byte; total, distinct bytes, and what those bytes count one order below, of its context.
        self.count = {0: single[byte], 1: pairs[before, byte]}
        self.total = {0: np.full(len(codes), single.sum()), 1: pairs.sum(axis=1)[before]}
        self.kinds = {0: np.full(len(codes), (single > 0).sum()), 1: (pairs > 0).sum(axis=1)[before]}
        self.below = {1: ((pairs > 0) * single).sum(axis=1)[before]}
        lower = self.count[1]
        for k in range(2, order + 1):
            own = codes & np.uint64((1 << 8 * (k + 1)) - 1)
            entries, first, at = np.unique(own, return_index=True, return_inverse=True)
            n = np.bincount(at, weights=counts, minlength=len(entries))
            contexts, of = np.unique(entries >> np.uint64(8), return_inverse=True)
            sums = lambda w, of=of, size=len(contexts): np.bincount(of, weights=w, minlength=size)
            total, kinds, below = sums(n), sums(n > 0), sums((n > 0) * lower[first])
            self.count[k], self.total[k], self.kinds[k], self.below[k] = n[at], total[of][at], kinds[of][at], below[of][at]
            lower = self.count[k]

    def log10(self) -> np.ndarray:
        """log10 probability of the last byte of every gram after its context."""
        result, open_ = np.zeros(len(self.codes)), np.ones(len(self.codes), bool)
        lost_total, lost_kinds = np.zeros(len(self.codes)), np.zeros(len(self.codes))
        for k in range(self.order, -1, -1):
            total, kinds = self.total[k] - lost_total, self.kinds[k] - lost_kinds
            met = open_ & (self.total[k] > 0)
            found = met & (self.count[k] > 0)
            result[found] += np.log10(self.count[k][found] / (total[found] + kinds[found]))
            escaped = met & ~found
            paid = escaped & (kinds > 0)
            result[paid] += np.log10(kinds[paid] / (total[paid] + kinds[paid]))
            open_ &= ~found
            if k:
                lost_total, lost_kinds = np.where(escaped, self.below[k], 0), np.where(escaped, self.kinds[k], 0)
        result[open_] -= np.log10(256 - self.kinds[0][open_])
        return result


def _texts(batches: list[pa.RecordBatch]) -> tuple[list[bytes], np.ndarray]:
    texts = [(t or b"").translate(W.TO_LOWER) for batch in batches for t in W.utf8(batch.column("text"))]
    held = [np.asarray(batch.column("held_out").to_numpy(zero_copy_only=False), bool) for batch in batches]
    return texts, ~np.concatenate([np.zeros(0, bool), *held])


GRAM, WORD = 0, 1


def _requests(boxes: DataFrame, parts: int, order: int) -> DataFrame:
    def asked(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        texts, learns = _texts(B.unboxed(table))
        rows = []
        for kind, (keys, counts) in ((GRAM, gram_counts(texts, learns, order)), (WORD, word_counts(texts, learns))):
            turn, part = by_part(keys, parts)
            cuts = np.searchsorted(part[turn], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                own = turn[cuts[p] : cuts[p + 1]]
                rows.append((key[0].as_py(), kind, p, B.pack_sorted(keys[own]), B.pack(counts[own])))
        block, kind, part, keys, counts = zip(*rows)
        return pa.table(
            {
                "block": pa.array(block, pa.int32()), "kind": pa.array(kind, pa.int32()), "part": pa.array(part, pa.int32()),
                "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary()),
            }
        )

    return boxes.groupBy("block").applyInArrow(asked, "block int, kind int, part int, keys binary, counts binary")


def _lists(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    keys = [B.unpack_sorted(x.as_py()) for x in table.column("keys")]
    return keys, [B.unpack(x.as_py()).astype(np.int64) for x in table.column("counts")]


def _corpus_grams(requests: DataFrame) -> DataFrame:
    """Distinct grams of the corpus with their training counts."""

    def summed(table: pa.Table) -> pa.Table:
        codes, counts = _summed(*_lists(table))
        return pa.table({"part": pa.array(np.full(len(codes), table.column("part")[0].as_py(), np.int32)), "code": codes.view(np.int64), "n": counts})

    return requests.filter(f"kind = {GRAM}").groupBy("part").applyInArrow(summed, "part int, code bigint, n bigint")


def _word_answers(requests: DataFrame) -> DataFrame:
    """Corpus counts of the words of each block; one more row per part, without a block, with its number of learnt words and tokens."""

    def summed(table: pa.Table) -> pa.Table:
        keys, counts = _lists(table)
        distinct, totals = _summed(keys, counts)
        answers = [B.pack(totals[np.searchsorted(distinct, k)]) for k in keys]
        n, part = table.num_rows, table.column("part")[0].as_py()
        return pa.table(
            {
                "block": pa.array([*table.column("block").to_pylist(), None], pa.int32()), "kind": pa.array([WORD] * (n + 1), pa.int32()),
                "part": pa.array([part] * (n + 1), pa.int32()), "values": pa.array([*answers, None], pa.binary()),
                "words": pa.array([None] * n + [int((totals > 0).sum())], pa.int64()), "tokens": pa.array([None] * n + [int(totals.sum())], pa.int64()),
            }
        )

    schema = "block int, kind int, part int, values binary, words bigint, tokens bigint"
    return requests.filter(f"kind = {WORD}").groupBy("part").applyInArrow(summed, schema)


def _code_lengths(corpus: DataFrame, pairs: np.ndarray, order: int) -> DataFrame:
    """log10 probability of every gram, from the trie in shards."""

    def built(table: pa.Table) -> pa.Table:
        codes = table.column("code").to_numpy().view(np.uint64)
        trie = Trie(codes, table.column("n").to_numpy(), pairs, order)
        return pa.table({"part": table.column("part"), "code": table.column("code"), "log10": trie.log10()})

    shard = F.pmod(F.xxhash64(F.shiftright("code", 8).bitwiseAND(F.lit(0xFFFF))), F.lit(SHARDS))
    return corpus.groupBy(shard.alias("shard")).applyInArrow(built, "part int, code bigint, log10 double")


def _gram_answers(requests: DataFrame, lengths: DataFrame) -> DataFrame:
    def looked_up(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"block": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), "values": pa.array([], pa.binary())})
        codes = known.column("code").to_numpy().view(np.uint64)
        turn = np.argsort(codes)
        codes, values = codes[turn], known.column("log10").to_numpy()[turn].astype("<f4")
        answers = [values[np.searchsorted(codes, B.unpack_sorted(x.as_py()))].tobytes() for x in asked.column("keys")]
        return pa.table({"block": asked.column("block"), "kind": asked.column("kind"), "part": asked.column("part"), "values": pa.array(answers, pa.binary())})

    asked = requests.filter(f"kind = {GRAM}").select("block", "kind", "part", "keys")
    return asked.groupBy("part").cogroup(lengths.groupBy("part")).applyInArrow(looked_up, "block int, kind int, part int, values binary")


def _scored(boxes: DataFrame, answers: DataFrame, parts: int, order: int, n_train: int, n_words: int) -> DataFrame:
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    floor = n_train + 1 * (n_words + 1)

    def of_kind(table: pa.Table, kind: int, decode) -> np.ndarray:
        rows = [i for i, k in enumerate(table.column("kind").to_pylist()) if k == kind]
        part = table.column("part").to_pylist()
        return np.concatenate([np.zeros(0), *[decode(table.column("values")[i].as_py()) for i in sorted(rows, key=part.__getitem__)]])

    def score(docs: pa.Table, known: pa.Table) -> pa.Table:
        batches = B.unboxed(docs)
        texts, learns = _texts(batches)
        codes, in_codes = listed(texts, lambda piece: grams(piece, order))
        words, in_words = listed(texts, word_keys)
        lengths, counts = np.zeros(len(codes)), np.zeros(len(words), np.int64)
        lengths[by_part(codes, parts)[0]] = of_kind(known, GRAM, lambda x: np.frombuffer(x, "<f4"))
        counts[by_part(words, parts)[0]] = of_kind(known, WORD, B.unpack)
        base = np.log10((counts + 1) / floor)
        columns: list[list] = [[] for _ in range(4)]
        for places, at, starts in in_words:
            columns[0].append(np.diff(starts))
            columns[1].append(np.add.reduceat((counts[places] > 0).astype(np.int64)[at], starts[:-1]))
            columns[2].append(np.add.reduceat(base[places][at], starts[:-1]))
        for places, at, starts in in_codes:
            columns[3].append(np.add.reduceat(lengths[places][at], starts[:-1]))
        tokens, seen, base_score, score = (np.concatenate([np.zeros(0), *c]) for c in columns)
        ids = pa.chunked_array([x.column("doc_id") for x in batches], pa.int64()).combine_chunks()
        values = [ids, ~learns, tokens.astype(np.int64), seen.astype(np.int64), np.full(len(texts), n_train), base_score, score]
        return pa.table([pa.array(v, k) if not isinstance(v, pa.Array) else v for v, k in zip(values, kinds)], names=names)

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return boxes.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)


def lm_scores(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts are read with A-Z in lower case, null as empty. The base line is the add-one word model: tokens are the words
    ``[^\\x20\\x09-\\x0D]+`` and one end per text, counted in the texts that are not held out. ``score`` is the log10 probability of all
    bytes of the text and its end under the byte model pretrained on the same texts. A null ``held_out`` counts as false. Rows with
    equal or null ids are rows of their own; other columns are ignored. Without training texts every byte costs log10(256).
    Code lengths travel in single precision. The empty table gives an empty result.
    """
    if not 2 <= order <= 7:
        raise ValueError("order must be 2 to 7: a gram is one 64-bit number")
    parts = B.block_count(B.text_bytes(docs, text_col))
    source = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(f"`{text_col}`").alias("text"),
        B.block_of([F.col(f"`{id_col}`"), F.col(f"`{text_col}`")], parts).alias("block"),
    )
    boxes = B.boxed(source, parts)
    requests = written(_requests(boxes, parts, order), "lm-requests")
    corpus = written(_corpus_grams(requests), "lm-grams")
    pairs = np.zeros((256, 256), np.int64)
    last = F.col("code").bitwiseAND(F.lit(0xFFFF))
    for row in corpus.groupBy(last.alias("pair")).agg(F.sum("n").alias("n")).collect():  # at most 65,536 rows
        pairs[row["pair"] >> 8, row["pair"] & 255] = row["n"]
    words = written(_word_answers(requests), "lm-words")
    sums = words.filter("block IS NULL").agg(F.sum("tokens"), F.sum("words")).first()
    answers = _gram_answers(requests, _code_lengths(corpus, pairs, order)).union(words.filter("block IS NOT NULL").select("block", "kind", "part", "values"))
    return _scored(boxes, answers, parts, order, sums[0] or 0, sums[1] or 0)
