"""Toxic spans by a linear-chain conditional random field over the words of a document.

Labels are given per document, so words are labelled first: of all traits (the word itself, its beginnings and endings), those that mark
toxic documents and hardly any other are taken one after the other until the toxic documents are explained; the words of toxic
documents that carry a chosen trait are the toxic ones. The field is trained on these words. It has weights for the traits of a word and of its two
neighbours and for the change of tags; forward-backward gives every word its probability of being toxic. A document's score is a logistic
function of its highest probability and of the expected number of toxic words, fitted on labelled documents the field has not seen.
"""
from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evcat.llm import words as W

SAMPLE_ROWS = 1_200  # labelled documents of each label that the model is fitted on
CHAIN = 64  # words of a stretch; stretches are joined exactly
BEGINNINGS, ENDINGS = (3, 4, 5, 6, 7), (3, 5)
MIN_DOCS, MIN_PRECISION, OWN_DOCS = 2, 0.95, 8  # of a trait that labels words
PENALTY_CLEAN = 20  # toxic documents that a clean one weighs up
TRAIT_DOCS = 3  # documents that a trait with a weight stands in
CONTEXT_DOCS = 20  # the same for a trait of a neighbour
STEPS, RATE, PENALTY, LEAST_WEIGHT = 40, 0.3, 1e-3, 0.01
HELD_BACK = 4  # every so many-th sampled document fits the score instead of the field

_WORD = re.compile(r"[^\W\d_]+")


def traits(word: str) -> list[str]:
    """The word, and its beginnings and endings where it is longer."""
    out = ["=" + word]
    out += ["^" + word[:k] for k in BEGINNINGS if len(word) > k]
    out += ["$" + word[-k:] for k in ENDINGS if len(word) > k]
    return out


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text) if text else []


def kind_of(words: list[str]) -> int:
    """Smallest hash of the runs of four words: copies and near copies nearly always share it, other texts do not."""
    return min((zlib.crc32(" ".join(words[i : i + 4]).encode()) for i in range(max(1, len(words) - 3))), default=0)


def choose_traits(toxic: list[list[str]], clean: list[list[str]]) -> set[str]:
    """Traits that explain the toxic documents.

    Greedily the trait that marks most kinds of documents not yet explained, discounted by clean documents. Copies are one kind, so rare words
    of a copied text are not chosen once traits that different documents have in common explain it. In the end traits are added that mark
    one in a hundred kinds on their own, explained or not.
    """
    in_clean: Counter = Counter()
    for doc in clean:
        in_clean.update({t for w in set(doc) for t in traits(w)})
    marked: dict[str, set[int]] = defaultdict(set)
    for doc in toxic:
        kind = kind_of(doc)
        for t in {t for w in set(doc) for t in traits(w)}:
            marked[t].add(kind)
    left = {kind_of(doc) for doc in toxic}
    own = max(OWN_DOCS, len(left) // 100)
    scale = max(1.0, len(left)) / max(1.0, len(clean))  # as if both labels had as many documents
    good = {}
    for t, kinds in marked.items():
        false = in_clean[t] * scale
        if len(kinds) >= MIN_DOCS and len(kinds) >= MIN_PRECISION * (len(kinds) + false):
            good[t] = false
    chosen: set[str] = set()
    worth = lambda t, n: (PENALTY_CLEAN * good[t] - n, len(t), t)  # noqa: E731  smallest first
    queue = [(worth(t, len(marked[t])), len(marked[t])) for t in good]
    heapq.heapify(queue)
    while queue:
        (_, _, t), counted = heapq.heappop(queue)
        new = marked[t] & left
        if len(new) < MIN_DOCS:
            continue
        if len(new) < counted:  # counted before others were chosen: look again
            heapq.heappush(queue, (worth(t, len(new)), len(new)))
            continue
        chosen.add(t)
        left -= new
    return chosen | {t for t, false in good.items() if t[0] != "$" and len(marked[t]) >= own + PENALTY_CLEAN * false}


def _stretches(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of at most CHAIN words in text order: document, first word and size of each."""
    counts = -(-lengths // CHAIN)
    doc = np.repeat(np.arange(len(lengths)), counts)
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    return doc, np.repeat(np.cumsum(lengths) - lengths, counts) + inside * CHAIN, np.minimum(CHAIN, lengths[doc] - inside * CHAIN)


def ratios(odds: np.ndarray, lengths: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word: weight of tag 1 against tag 0 before it, up to it and after it, and the factor of its own tag 1.

    ``odds`` are the log-odds of tag 1 of each word, ``change`` the 2 x 2 log-weights of neighbouring tags; the tag before a document is
    0. With two tags a forward or backward vector is one ratio. Documents are cut into stretches that are walked side by side, longest
    first; the 2 x 2 product of each stretch carries the ratios exactly from stretch to stretch.
    """
    (s00, s01), (s10, s11) = np.exp(change).tolist()
    lift = np.exp(np.clip(odds, -30, 30))
    doc, first, size = _stretches(lengths)
    order = np.argsort(-size, kind="stable")
    begin = first[order]
    live = [int(k) for k in np.searchsorted(-size[order], -np.arange(CHAIN), "left")]  # stretches with a word at each step
    a, d = np.ones(len(doc)), np.ones(len(doc))
    b, c = np.zeros(len(doc)), np.zeros(len(doc))
    for t, k in enumerate(live):
        if not k:
            break
        own = lift[begin[:k] + t]
        a0, b0, c0, d0 = a[:k], b[:k], c[:k], d[:k]
        a1, b1 = a0 * s00 + b0 * s10, (a0 * s01 + b0 * s11) * own
        c1, d1 = c0 * s00 + d0 * s10, (c0 * s01 + d0 * s11) * own
        scale = 1 / (a1 + b1 + c1 + d1)
        a[:k], b[:k], c[:k], d[:k] = a1 * scale, b1 * scale, c1 * scale, d1 * scale
    back = np.empty(len(doc), np.int64)
    back[order] = np.arange(len(doc))
    products = list(zip(doc.tolist(), a[back].tolist(), b[back].tolist(), c[back].tolist(), d[back].tolist()))
    enter, leave = np.empty(len(doc)), np.empty(len(doc))
    ratio, current = 0.0, -1
    for r, (i, pa_, pb, pc, pd) in enumerate(products):
        ratio = ratio if i == current else 0.0
        enter[r], current = ratio, i
        ratio = (pb + ratio * pd) / (pa_ + ratio * pc)
    current = -1
    for r in range(len(products) - 1, -1, -1):
        i, pa_, pb, pc, pd = products[r]
        ratio = ratio if i == current else 1.0
        leave[r], current = ratio, i
        ratio = (pc + pd * ratio) / (pa_ + pb * ratio)
    prior, ahead, behind = np.empty(len(odds)), np.empty(len(odds)), np.empty(len(odds))
    ratio = enter[order]
    for t, k in enumerate(live):
        if not k:
            break
        at, held = begin[:k] + t, ratio[:k]
        prior[at] = held
        ratio[:k] = lift[at] * (s01 + held * s11) / (s00 + held * s10)
        ahead[at] = ratio[:k]
    ratio = leave[order]
    for t in range(CHAIN - 1, -1, -1):
        k = live[t]
        at = begin[:k] + t
        behind[at] = ratio[:k]
        own = lift[at] * ratio[:k]
        ratio[:k] = (s10 + s11 * own) / (s00 + s01 * own)
    return prior, ahead, behind, lift


def marginals(odds: np.ndarray, lengths: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Probability of tag 1 of every word."""
    _, ahead, behind, _ = ratios(odds, lengths, change)
    both = ahead * behind
    return both / (1 + both)


def _changes(odds: np.ndarray, lengths: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of tag 1 of every word, and the expected number of each change of tags."""
    prior, ahead, behind, lift = ratios(odds, lengths, change)
    both, own = ahead * behind, lift * behind
    step = np.exp(change)
    pairs = np.stack([np.full(len(own), step[0, 0]), step[0, 1] * own, step[1, 0] * prior, step[1, 1] * prior * own])
    return both / (1 + both), (pairs / pairs.sum(axis=0)).sum(axis=1).reshape(2, 2)


@dataclass(frozen=True)
class Model:
    """Weights of a trait for its word, for the word after and for the word before; log-weights of tag changes; weights of the score."""

    weights: dict[str, tuple[float, float, float]]
    bias: float
    change: np.ndarray
    score: np.ndarray

    def of_word(self, word: str) -> tuple[float, float, float]:
        own = before = after = 0.0
        for found in map(self.weights.get, traits(word)):
            if found:
                own, before, after = own + found[0], before + found[1], after + found[2]
        return own, before, after


def shifted(values: np.ndarray, lengths: np.ndarray, by: int) -> np.ndarray:
    """Value of the word before (1) or after (-1) in the same document, else 0."""
    out = np.roll(values, by)
    ends = np.cumsum(lengths)
    edge = (ends - lengths)[lengths > 0] if by == 1 else ends[lengths > 0] - 1
    out[edge] = 0
    return out


def summary(marks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: 1, log-odds of its highest probability, and the log of the expected number of toxic words."""
    out = np.zeros((len(lengths), 3))
    out[:, 0] = 1
    some = np.flatnonzero(lengths > 0)
    best, expected = np.zeros(len(lengths)), np.zeros(len(lengths))
    if len(some):
        starts = (np.cumsum(lengths) - lengths)[some]
        best[some] = np.maximum.reduceat(marks, starts)
        expected[some] = np.add.reduceat(np.where(marks > 0.1, marks, 0.0), starts)
    best = np.clip(best, 1e-4, 1 - 1e-4)
    out[:, 1] = np.log(best / (1 - best))
    out[:, 2] = np.log1p(expected)
    return out


def _adam(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    x, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return x


def fit(texts: list[str], labels: list[int]) -> Model:
    """Model of documents with labels 1 (toxic) and 0; deterministic."""
    docs = [[w.lower() for w in words_of(t)] for t in texts]
    fitted = [i for i in range(len(docs)) if i % HELD_BACK] if len(docs) >= 4 * HELD_BACK else list(range(len(docs)))
    chosen = choose_traits([docs[i] for i in fitted if labels[i]], [docs[i] for i in fitted if not labels[i]])
    number: dict[str, int] = {}
    places = [np.array([number.setdefault(w, len(number)) for w in doc], np.int64) for doc in docs]
    vocabulary = list(number)
    found = [traits(w) for w in vocabulary]
    toxic_word = np.array([bool(chosen.intersection(f)) for f in found], bool)

    df: Counter = Counter()
    for i in fitted:
        df.update({t for w in set(docs[i]) for t in found[number[w]]})
    used = [t for t, n in df.items() if n >= TRAIT_DOCS]
    at = {t: k for k, t in enumerate(used)}
    near = {t: k for k, t in enumerate(t for t in used if df[t] >= CONTEXT_DOCS)}
    word_of, trait_of = [np.array(x, np.int64) for x in (zip(*[(w, at[t]) for w, f in enumerate(found) for t in f if t in at]) if at else ((), ()))]
    near_word, near_trait = [np.array(x, np.int64) for x in (zip(*[(w, near[t]) for w, f in enumerate(found) for t in f if t in near]) if near else ((), ()))]
    flat = np.concatenate([np.zeros(0, np.int64), *[places[i] for i in fitted]])
    lengths = np.array([len(places[i]) for i in fitted], np.int64)
    truth = toxic_word[flat] & np.repeat(np.array([bool(labels[i]) for i in fitted], bool), lengths)
    earlier = shifted(truth.astype(np.int8), lengths, 1)
    seen = np.array([[np.sum((earlier == p) & (truth == q)) for q in (0, 1)] for p in (0, 1)], float)
    n, m, words = len(at), len(near), len(vocabulary)

    def word_weights(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.bincount(word_of, x[trait_of], words) if n else np.zeros(words)
        before, after = [np.bincount(near_word, part[near_trait], words) if m else np.zeros(words) for part in (x[n : n + m], x[n + m : n + 2 * m])]
        return own, before, after

    def odds_of(x: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        own, before, after = word_weights(x)
        return x[n + 2 * m] + own[flat] + shifted(before[flat], lengths, 1) + shifted(after[flat], lengths, -1)

    def gradient(x: np.ndarray) -> np.ndarray:
        p, expected = _changes(odds_of(x, flat, lengths), lengths, x[-4:].reshape(2, 2))
        off = p - truth
        g = np.empty(len(x))
        sums = [np.bincount(flat, o, words) for o in (off, shifted(off, lengths, -1), shifted(off, lengths, 1))]
        g[:n] = np.bincount(trait_of, sums[0][word_of], n) if n else 0
        g[n : n + m] = np.bincount(near_trait, sums[1][near_word], m) if m else 0
        g[n + m : n + 2 * m] = np.bincount(near_trait, sums[2][near_word], m) if m else 0
        g[n + 2 * m] = off.sum()
        g[-4:] = (expected - seen).ravel()
        return g / max(1, truth.sum()) + PENALTY * x

    x = _adam(gradient, n + 2 * m + 5, STEPS, RATE) if len(flat) and truth.any() else np.zeros(n + 2 * m + 5)
    if not truth.any():
        x[n + 2 * m] = -10.0
    held = [i for i in range(len(docs)) if i not in set(fitted)] or fitted
    flat_held = np.concatenate([np.zeros(0, np.int64), *[places[i] for i in held]])
    lengths_held = np.array([len(places[i]) for i in held], np.int64)
    signs = summary(marginals(odds_of(x, flat_held, lengths_held), lengths_held, x[-4:].reshape(2, 2)), lengths_held)
    want = np.array([labels[i] for i in held], float)

    def score_gradient(s: np.ndarray) -> np.ndarray:
        return signs.T @ (1 / (1 + np.exp(-signs @ s)) - want) / max(1, len(want)) + PENALTY * s

    score = _adam(score_gradient, signs.shape[1], 300, 0.1) if len(want) else np.array([-1.0, 0.0, 0.0])
    weights = {}
    for t, k in at.items():
        sides = (float(x[k]), float(x[n + near[t]]) if t in near else 0.0, float(x[n + m + near[t]]) if t in near else 0.0)
        if max(map(abs, sides)) > LEAST_WEIGHT:
            weights[t] = sides
    return Model(weights, float(x[n + 2 * m]), x[-4:].reshape(2, 2), score)


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Model from labelled documents (``labels``: id, 0 or 1).

    At most about ``sample_rows`` ids of each label are taken, by a hash of the id, so the driver holds a bounded number of texts, whole. Null
    ids, null labels, and ids with both labels teach nothing; a null text counts as empty; of rows with one id the first text in order counts.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)")
    one = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("high")).filter("label = high")
    counts = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.lit(11), F.col("id")), F.lit(1 << 40))
    limit = F.lit(0)
    for label, n in counts.items():
        limit = F.when(F.col("label") == label, F.lit(int((1 << 40) * min(1.0, sample_rows / n)))).otherwise(limit)
    picked = one.filter(place < limit).select("id", "label", place.alias("place"))  # rows x labels, whatever the table
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(picked), "id").groupBy("place", "id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["place"], str(r["id"])))
    return fit([r["text"] for r in rows], [r["label"] for r in rows])


class Tagger:
    """Scores texts with a model; weights of each word are looked up once."""

    def __init__(self, model: Model):
        self.model = model
        self.weights = W.WordCache(lambda word: model.of_word(word.lower()))

    def marks(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(x) for x in words], np.int64)
        sides = np.array([self.weights[w] for x in words for w in x], np.float64).reshape(-1, 3)
        odds = self.model.bias + sides[:, 0] + shifted(sides[:, 1], lengths, 1) + shifted(sides[:, 2], lengths, -1)
        return marginals(odds, lengths, self.model.change), lengths

    def scored(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Score of each text, and its toxic spans: first and past-the-end character, probability."""
        marks, lengths = self.marks([words_of(t) for t in texts])
        scores = 1 / (1 + np.exp(-summary(marks, lengths) @ self.model.score))
        spans, end = [], 0
        for text, size in zip(texts, lengths.tolist()):
            own = marks[end : end + size]
            end += size
            hit = set(np.flatnonzero(own >= 0.5).tolist())
            found: list[tuple[int, int, float]] = []
            last = -2
            for place, match in enumerate(_WORD.finditer(text)) if hit else ():
                if place in hit:
                    if last == place - 1:  # neighbouring words are one span
                        start, _, p = found.pop()
                        found.append((start, match.end(), max(p, float(own[place]))))
                    else:
                        found.append((match.start(), match.end(), float(own[place])))
                    last = place
            spans.append(found)
        return scores, spans


_FIELDS = "score double, predicted int, spans array<struct<start: bigint, end: bigint, probability: double>>"


def toxicity(text: Column, model: Model) -> Column:
    """Struct (score, predicted, spans) of a text column.

    Words are runs of letters of any alphabet, whatever their case; the whole text is one chain. ``score`` is between 0 and 1, ``predicted`` is 1 from 0.5 on, ``spans`` are
    the stretches of words with a probability of one half or more, by character offsets from 0. Null is read as empty; a text without a word
    has the score of a document without any sign of toxicity.
    """
    key = (repr(model.score), model.bias, len(model.weights))

    def scored(texts: pa.Array) -> pa.Array:
        tagger = W.worker_object("toxic", key, lambda: Tagger(model))
        scores, spans, held, size = [], [], [], 0

        def flush() -> None:
            nonlocal held, size
            if held:
                found, marked = tagger.scored(held)
                scores.extend(found.tolist())
                spans.extend(marked)
            held, size = [], 0

        for value in W.utf8(texts):
            held.append((value or b"").decode("utf-8", "replace"))
            size += len(held[-1])
            if size >= 1 << 18:
                flush()
        flush()
        span = pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64(), "probability": pa.float64()}))
        rows = [[{"start": a, "end": b, "probability": p} for a, b, p in found] for found in spans]
        return W.struct_array({"score": (scores, pa.float64()), "predicted": ([int(s >= 0.5) for s in scores], pa.int32()), "spans": (rows, span)})

    return F.arrow_udf(scored, _FIELDS)(text)
