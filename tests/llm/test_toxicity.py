"""Field against enumeration of all taggings, held-out accuracy, and awkward texts."""
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evcat.llm import toxicity as T
from evcat.llm.queries import QUERIES


def by_enumeration(odds, change):
    """Probability of tag 1 of each word, and expected changes, from the weight of every tagging."""
    n, total = len(odds), 0.0
    marks, pairs = np.zeros(n), np.zeros((2, 2))
    for tags in itertools.product((0, 1), repeat=n):
        weight = math.exp(sum(o for o, t in zip(odds, tags) if t) + sum(change[p][q] for p, q in zip((0, *tags), tags)))
        total += weight
        marks += weight * np.array(tags)
        for p, q in zip((0, *tags), tags):
            pairs[p, q] += weight
    return marks / total, pairs / total


@pytest.mark.parametrize("chain", [1, 2, 3, 64])
def test_marginals_equal_enumeration(chain, monkeypatch):
    monkeypatch.setattr(T, "CHAIN", chain)
    rng = np.random.default_rng(3)
    lengths = np.array([0, 5, 1, 9, 0, 2, 10])
    odds, change = rng.normal(0, 2, lengths.sum()), rng.normal(0, 1, (2, 2))
    marks, changes = T._changes(odds, lengths, change)
    want, pairs, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        m, p = by_enumeration(odds[at : at + n], change)
        want, pairs, at = [*want, *m], pairs + p, at + n
    assert np.allclose(marks, want) and np.allclose(T.marginals(odds, lengths, change), want)
    assert np.allclose(changes, pairs)


def test_no_word_at_all():
    none = np.zeros(0)
    assert len(T.marginals(none, np.array([0, 0]), np.zeros((2, 2)))) == 0
    assert T.summary(none, np.array([0, 0])).shape == (2, 3)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = QUERIES["op11_toxicity"](spark, sf).join(labels, "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in rows if r["toxic"] == 1], [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) >= 0.8 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.03 * len(clean)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


@pytest.fixture(scope="module")
def model():
    clean = [f"the {a} went to the {b} and saw a {c}" for a in ("cat", "dog", "man", "cook", "queen", "boy") for b in ("house", "river", "hill", "lake") for c in ("boat", "tree", "fish")]
    toxic = [t.replace("saw a", f"saw a vile{end}") for t, end in zip(clean, itertools.cycle(("ness", "ling", "dom", "ty", "hood")))]
    return T.fit(clean + toxic, [0] * len(clean) + [1] * len(toxic))


def test_spans_and_unseen_forms(model):
    tagger = T.Tagger(model)
    texts = ["the cat saw a VILENESSES tree", "Vileness! vileling", "the man went to the river", "", "12 !?"]
    scores, spans = tagger.scored(texts)
    assert scores[0] > 0.5 and [texts[0][a:b] for a, b, _ in spans[0]] == ["VILENESSES"]
    assert [texts[1][a:b] for a, b, _ in spans[1]] == ["Vileness! vileling"]
    assert scores[2] < 0.5 and not spans[2] and scores[3] == scores[4] < 0.5


def test_a_toxic_word_anywhere_in_a_long_text(model):
    tagger = T.Tagger(model)
    for at in (0, 63, 64, 5_000, 9_999):
        words = ["the river"] * 10_000
        words[at] = "saw a vileness boat"
        scores, spans = tagger.scored([" ".join(words)])
        assert scores[0] > 0.5 and len(spans[0]) == 1


def test_awkward_rows(awkward, awkward_rows, model):
    rows = awkward.select("doc_id", "text", T.toxicity(F.col("text"), model).alias("t")).select("doc_id", "text", "t.*").collect()
    assert len(rows) == len(awkward_rows)
    tagger = T.Tagger(model)
    for r in rows:
        scores, spans = tagger.scored([r["text"] or ""])
        assert r["score"] == pytest.approx(scores[0]) and len(r["spans"]) == len(spans[0])


def test_labels_with_nulls_and_conflicts(spark, awkward, empty):
    schema = "doc_id bigint, toxic int, label string, place int, text string"
    labels = spark.createDataFrame([(None, 1, "l", 1, "t"), (4, None, "l", 1, "t"), (6, 0, "l", 1, "t"), (6, 1, "l", 1, "t"), (7, 0, "l", 1, "t"), (7, 0, "l", 1, "t"), (12, 1, "l", 1, "t")], schema)
    learnt = T.learn(awkward, labels)
    assert learnt.score.shape == (3,)
    nothing = T.learn(empty, labels.limit(0))
    assert nothing.weights == {}
    assert empty.select(T.toxicity(F.col("text"), nothing)).count() == 0
    assert all(r[0]["predicted"] == 0 for r in awkward.select(T.toxicity(F.col("text"), nothing)).collect())


def test_copies_count_as_one_kind():
    copied = ["one odd rare text that is copied and copied again".split()] * 5
    other = [f"a{i} b{i} vile c{i} d{i}".split() for i in range(5)]
    chosen = T.choose_traits(copied + other, [f"a{i} e{i}".split() for i in range(10)])
    assert chosen & set(T.traits("vile")) and not chosen & {t for w in copied[0] for t in T.traits(w)}
