"""Ranked search against scores computed one by one, and the bounds of the ball tree."""
import math
import random
from collections import Counter

import numpy as np
import pytest

from evcat.llm import ranking as R
from evcat.llm import words as W


def brute(docs, items, k):
    """(item id, text) -> [(rank, doc_id, score)], from the definition alone."""
    counts = [(i, Counter(W.alnum_words((t or "").encode()))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    total, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    for item, text in {(i, t) for i, t in items if t is not None}:
        wanted, scores = Counter(W.alnum_words(text.encode())), []
        for doc, c in counts:
            n = sum(c.values())
            m = 100 - 75 + (75 * n * total) // length
            score = sum(
                q * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in wanted.items() if t in c
            )
            if score > 0:
                scores.append((-score, doc is None, doc))
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out[item, text] = [(rank, doc, -score) for rank, (score, _, doc) in enumerate(scores[:k], 1)]
    return out


def check(spark, docs, items, k=R.TOP, **columns):
    table = spark.createDataFrame([(i, t, "w", 3) for i, t in docs], "doc_id bigint, text string, terms string, n int")
    wanted = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, rank int")
    got = {}
    for r in R.ranked_search(table.repartition(3), wanted, k=k).collect():
        got.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    want = {}
    for (item, _), rows in brute(docs, items, k).items():
        if rows:
            want.setdefault(item, []).extend(rows)
    order = lambda rows: sorted(rows, key=lambda r: (r[0], -r[2], r[1] is None, r[1] or 0))
    assert {i: order(r) for i, r in got.items()} == {i: order(r) for i, r in want.items()}


@pytest.mark.parametrize("leaf, trees, block", [(32, 4096, 1 << 18), (2, 40, 300)])
def test_planted_documents(spark, planted_rows, leaf, trees, block, monkeypatch):
    monkeypatch.setattr(R, "LEAF", leaf)
    monkeypatch.setattr(R, "TREE_DOCS", trees)
    monkeypatch.setattr(R.item_blocks, "__defaults__", (block,))
    rng = random.Random(4)
    docs = [(i, t) for i, t, _, _ in planted_rows]
    items = [(n, " ".join(rng.choice(docs)[1].split()[: rng.randrange(1, 40)])) for n in range(12)]
    check(spark, docs, items)
    check(spark, docs, items, k=3)


def test_awkward_documents_and_items(spark, awkward_rows):
    docs = [(i, t) for i, t, _, _ in awkward_rows]
    items = [(1, None), (2, ""), (3, "one"), (4, "a a A b"), (4, "a a A b"), (4, "same id"), (None, "Ünï 日本語 ß"), (5, "no such words anywhere zq"), (6, "same same same id w1 w2 v3")]
    check(spark, docs, items)


def test_ties_go_to_the_smallest_id(spark):
    docs = [(i, "x y") for i in (9, 3, 7, 3, 12, 1, None, 4, 8, 20, 21, 22)] + [(50, "z"), (51, "q")]
    check(spark, docs, [(1, "x"), (2, "y y x"), (3, "z")])


def test_empty_tables(spark):
    check(spark, [], [(1, "a")])
    check(spark, [(1, None), (2, "--")], [(1, "a")])
    check(spark, [(1, "a")], [])


def test_a_term_in_every_document_weighs_little(spark):
    check(spark, [(i, "the " * (i + 1)) for i in range(30)], [(1, "the")])


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(8)
    centers = rng.integers(0, 10**9, (6, 50)) * (rng.random((6, 50)) < 0.2)
    points = (centers[rng.integers(0, 6, 600)] + rng.integers(0, 10**6, (600, 50))).astype(np.int64)
    queries = rng.integers(0, 3, (5, 50)).astype(float)
    tree = R.BallTree(points.astype(float), 16)
    bounds = tree.bounds(queries)
    for node, (start, stop) in enumerate(tree.span):
        exact = points[tree.order[start:stop]] @ queries.T.astype(np.int64)
        assert (exact.max(axis=0) <= bounds[:, node]).all()
    block = R.Block([0] * 5, list(range(5)), {}, [(np.flatnonzero(q), q[q > 0].astype(np.int64)) for q in queries])
    best = [R.TopDocuments(3) for _ in range(5)]
    leaves = sum(h is None for h in tree.halves)
    assert R.search_tree(tree, points, list(range(600)), block, bounds, best) < 5 * leaves
    for q, top in zip(queries, best):
        scores = points @ q.astype(np.int64)
        want = sorted(range(600), key=lambda i: (-scores[i], i))[:3]
        assert [d for _, d in sorted(top.rows(), key=lambda r: (-r[0], r[1]))] == want
