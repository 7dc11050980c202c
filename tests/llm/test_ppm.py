"""Byte model against a plain trie; word base line by its formula."""
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evcat.llm import blocks as B
from evcat.llm import ppm
from tests.llm.conftest import frame


class PlainModel:
    def __init__(self, texts, order):
        self.order, self.after = order, defaultdict(Counter)
        for t in texts:
            b = b"\xff" * order + t + b"\xff"
            for i in range(order, len(b)):
                for k in range(order + 1):
                    self.after[b[i - k : i]][b[i]] += 1

    def byte(self, context, byte):
        excluded, total = set(), 0.0
        for k in range(len(context), -1, -1):
            seen = self.after.get(context[len(context) - k :])
            if not seen:
                continue
            live = {b: n for b, n in seen.items() if b not in excluded}
            n, kinds = sum(live.values()), len(live)
            if byte in live:
                return total + math.log10(live[byte] / (n + kinds))
            if kinds:
                total += math.log10(kinds / (n + kinds))
            excluded |= set(seen)
        return total - math.log10(256 - len(excluded))

    def text(self, t):
        b = b"\xff" * self.order + t + b"\xff"
        return sum(self.byte(b[i - self.order : i], b[i]) for i in range(self.order, len(b)))


def lowered(text):
    return (text or "").encode().translate(ppm.W.TO_LOWER)


def compare(df, rows, held, order):
    model = PlainModel([lowered(t) for i, t, _, _ in rows if not held(i)], order)
    counts = Counter(w for i, t, _, _ in rows if not held(i) for w in [*lowered(t).split(), b""])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t, _, _ in rows:
        words = [*lowered(t).split(), b""]
        base = sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in words)
        want.append((i, held(i), len(words), sum(counts[w] > 0 for w in words), n, base, model.text(lowered(t))))
    held_column = F.when(F.col("doc_id").isNotNull(), F.pmod(F.col("doc_id"), F.lit(4)) == 1)
    got = [tuple(r) for r in ppm.lm_scores(df, held_column, order=order).collect()]
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[2], r[5])), sorted(want, key=lambda r: (str(r[0]), r[2], r[5]))):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-6)


def held(i):
    return i is not None and i % 4 == 1


@pytest.mark.parametrize("order", [2, 5])
def test_scores(spark, monkeypatch, planted_rows, order):
    monkeypatch.setattr(B, "block_count", lambda total: 5)
    rows = planted_rows[:90]
    compare(frame(spark, rows).repartition(3), rows, held, order)


def test_awkward(spark, awkward_rows):
    rows = [r for r in awkward_rows if len(r[1] or "") < 5000]
    compare(frame(spark, rows), rows, held, 3)


def test_long_text_is_scored_whole(awkward):
    got = {r["doc_id"]: r for r in ppm.lm_scores(awkward, F.lit(False)).collect()}
    assert got[6]["n_tokens"] == 60_001 and got[6]["score"] < -1000


def test_nothing_to_learn_from(spark, empty):
    one = frame(spark, [(1, "abc", None, None)])
    row = ppm.lm_scores(one, F.lit(True)).first()
    assert (row["train_tokens"], row["n_known"]) == (0, 0)
    assert row["score"] == pytest.approx(-4 * math.log10(256), rel=1e-6)
    assert ppm.lm_scores(empty, F.lit(False)).count() == 0


def test_probabilities_of_a_context_sum_to_one(spark):
    texts = [b"abracadabra", b"abrakadabra", b"banana"]
    order = 3
    codes, counts = ppm.gram_counts(texts, ppm.np.ones(3, bool), order)
    pairs = ppm.np.zeros((256, 256), ppm.np.int64)
    for c, n in zip(codes.tolist(), counts.tolist()):
        pairs[c >> 8 & 255, c & 255] += n
    for context in (b"abr", b"bra", b"ana", b"zzz", b"zab"):
        asked = ppm.np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], ppm.np.uint64)
        known = ppm.np.isin(codes, asked, invert=True)
        n = ppm.np.concatenate([counts[known], [counts[codes == a].sum() for a in asked]])
        trie = ppm.Trie(ppm.np.concatenate([codes[known], asked]), n, pairs, order)
        assert (10 ** trie.log10()[-256:]).sum() == pytest.approx(1)


def test_packed_numbers():
    for values in ([], [0], [3, 1 << 63, (1 << 64) - 1], list(range(5000))):
        a = ppm.np.array(values, ppm.np.uint64)
        assert B.unpack(B.pack(a)).tolist() == values
        assert B.unpack_sorted(B.pack_sorted(a)).tolist() == values


@pytest.mark.parametrize("keys_of", [lambda piece: ppm.grams(piece, 5), ppm.word_keys])
def test_places_of_all_pieces_lead_back_to_the_keys(keys_of, monkeypatch):
    monkeypatch.setattr(ppm, "_PIECE", 12)
    texts = [b"a b a", b"", b"b c b  d", b"a", b"\xc3\xa9 a b a", b"d d d d d d d d d d"]
    distinct, pieces = ppm.listed(texts, keys_of)
    assert len(pieces) > 1
    keys, starts = keys_of(texts)
    assert distinct.tolist() == sorted(set(keys.tolist()))
    assert ppm.np.concatenate([distinct[places][at] for places, at, _ in pieces]).tolist() == keys.tolist()
    assert sum(int(s[-1]) for _, _, s in pieces) == starts[-1]


def test_only_texts_that_teach_are_counted():
    texts, learns = [b"ab ab", b"ab c", b""], ppm.np.array([True, False, True])
    words, counts = ppm.word_counts(texts, learns)
    assert words.tolist() == sorted(words.tolist())
    named = {ppm.xxhash.xxh3_64_intdigest(w): w for w in (b"ab", b"c", b"")}
    assert {named[k]: n for k, n in zip(words.tolist(), counts.tolist())} == {b"ab": 2, b"c": 0, b"": 2}
    assert ppm.gram_counts([], ppm.np.zeros(0, bool), 5)[0].tolist() == []
