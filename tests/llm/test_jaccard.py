"""Groups against all pairs, with every kind of list."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evcat.llm import jaccard as J
from evcat.llm.components import components
from tests.llm.conftest import frame, prose


def shingles(text):
    words = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute_groups(rows):
    """(doc_id, n, smallest id reachable) per row, by testing all pairs."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return sorted(((r[0], len(s), least[find(i)]) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def found(df):
    return sorted((tuple(r) for r in J.similar_groups(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def near_copies(seed, groups=6, copies=25, edits=(0, 1, 2, 3, 6)):
    """Families of edited copies, some around a common passage that fills most of the text."""
    rng, rows = random.Random(seed), []
    passage = prose(rng, 60).split()
    for g in range(groups):
        base = prose(rng, rng.randrange(20, 120)).split() if g % 2 else passage + prose(rng, 12).split()
        for _ in range(copies):
            words = list(base) if rng.random() < 0.7 else passage + prose(rng, rng.randrange(4, 22)).split()
            for _ in range(rng.choice(edits)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows) * 3 % 1009, " ".join(words), "en", "a"))
    return rows


@pytest.mark.parametrize("long_list", [2, 4, 10, 1000])
@pytest.mark.parametrize("seed", [1, 2])
def test_groups_do_not_depend_on_which_lists_are_long(spark, monkeypatch, seed, long_list):
    monkeypatch.setattr(J, "LONG_LIST", long_list)
    rows = near_copies(seed)
    assert found(frame(spark, rows).repartition(3)) == brute_groups(rows)


def test_rounds_after_the_stars(spark, monkeypatch):
    monkeypatch.setattr(J, "LONG_LIST", 3)
    monkeypatch.setattr(J, "STAR_ROUNDS", 1)
    rows = near_copies(7, groups=4, edits=(4, 6, 8))
    assert found(frame(spark, rows)) == brute_groups(rows)


def test_planted(planted, planted_rows):
    assert found(planted) == brute_groups(planted_rows)


def test_awkward(awkward, awkward_rows):
    assert found(awkward) == brute_groups(awkward_rows)


def test_empty(empty):
    assert found(empty) == []
    assert J.first_of_groups(empty).columns == empty.columns and J.first_of_groups(empty).count() == 0


def test_one_of_each_group_stays(awkward, awkward_rows, planted, planted_rows):
    for df, rows in ((awkward, awkward_rows), (planted, planted_rows)):
        kept = J.first_of_groups(df)
        assert kept.columns == df.columns
        want = sorted({r for r in brute_groups(rows) if r[1] and r[0] == r[2]}, key=str)
        ids = sorted((r["doc_id"] for r in kept.collect() if shingles(r["text"])), key=str)
        assert ids == sorted((r[0] for r in want), key=str)
        assert sum(not shingles(r["text"]) for r in kept.collect()) == sum(not shingles(r[1]) for r in rows)


def test_group_of_null_ids_keeps_one(spark):
    text = "a b c d e f g"
    kept = J.first_of_groups(frame(spark, [(None, text, "en", "a"), (None, text, "en", "a"), (None, text.upper(), "en", "a")])).collect()
    assert len(kept) == 1


def test_bounds():
    rng = np.random.default_rng(3)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        common = len(np.intersect1d(a, b))
        assert J.overlap(a, b) == common
        assert J.difference_floor(J.parity_bitmap(a), J.parity_bitmap(b)) <= len(a) + len(b) - 2 * common
    for n in range(1, 500):
        # Fewer than the smallest overlap remain after the prefix.
        assert n - J.prefix_size(n) < -(-75 * n // 100) and J.prefix_size(n) >= 1


def test_components_of_paths_and_cycles(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(200, 300), (300, 200), (400, 400)]
    got = dict((r["node"], r["root"]) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    want = {i: 1 for i in range(1, 61)} | {100 + i: 100 for i in range(7)} | {200: 200, 300: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).filter(F.lit(True)).count() == 0
