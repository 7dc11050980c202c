"""Repeated passages, benchmark overlap and licences against plain definitions."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evcat.llm import licenses as L
from evcat.llm import repeats as R
from evcat.llm import winnow as N
from evcat.llm import words as W
from tests.llm.conftest import frame, prose


# --- repeated passages -----------------------------------------------------------------------
def removed(rows, span):
    first = {}
    for doc_id, text, _, _ in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - span + 1):
            if doc_id is not None:
                key = tuple(words[i : i + span])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text, _, _ in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - span + 1):
            if doc_id is not None and first[tuple(words[i : i + span])] < doc_id:
                gone.update(range(i, i + span))
        kept = [w for p, w in enumerate(words) if p not in gone]
        out.append((doc_id, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def result(df, **options):
    return sorted((tuple(r) for r in R.remove_repeats(df, **options).collect()), key=str)


def test_repeats_planted(planted, planted_rows):
    assert result(planted) == removed(planted_rows, R.SPAN)


@pytest.mark.parametrize("span, node", [(4, 2), (10, 4), (12, 12)])
def test_repeats_of_short_spans(spark, span, node):
    """Few words, so that nodes branch, loop and overlap all the time."""
    rng = random.Random(span)
    rows = [(i // 2 if i % 9 else None, " ".join(rng.choices("a b c d".split(), weights=(9, 3, 2, 1), k=rng.randrange(0, 70))), "en", "a") for i in range(60)]
    assert result(frame(spark, rows).repartition(4), span=span, node=node) == removed(rows, span)


def test_repeats_awkward(awkward, awkward_rows):
    rows = [r for r in awkward_rows if len(r[1] or "") < 5000]
    assert result(awkward.filter("coalesce(length(text), 0) < 5000")) == removed(rows, R.SPAN)
    long = {r[0]: r for r in result(awkward)}
    assert long[6][2] == 0 and long[7][2] in (0, 60_000)


def test_repeats_empty(empty):
    assert result(empty) == []


def test_smallest_is_leftmost():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 7, 31):
        values = rng.integers(0, 5, 200).astype(np.uint64)
        assert R.smallest(values, width).tolist() == [i + int(values[i : i + width].argmin()) for i in range(200 - width + 1)]


def test_rolling_hashes_tell_order_and_length():
    words = np.array([5, 7, 5, 7, 7, 5], np.uint64)
    rolling = W.Rolling(words, W.FIRST_BASE)
    at = lambda a, b: int(rolling(np.array([a]), np.array([b]))[0])
    assert at(0, 2) == at(2, 4) and at(0, 2) != at(4, 6) and at(0, 2) != at(0, 3)


# --- benchmark overlap ------------------------------------------------------------------------
def words_of(text):
    return W.alnum_words((text or "").encode())


def overlap(rows, items):
    windows = {}
    for item, text in items:
        words = words_of(text)
        m = min(13, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            windows.setdefault(tuple(words[i : i + m]), set()).add(item)
    out = []
    for doc_id, text, _, _ in rows:
        words, hit, met = words_of(text), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(words) - m + 1):
                if (found := windows.get(tuple(words[i : i + m]))) is not None:
                    hit.update(range(i, i + m))
                    met |= found
        out.append((doc_id, len(words), len(hit), sorted(str(x) if x is not None else "" for x in met), bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=str)


def contaminated(docs, items):
    rows = N.contamination(docs, items).select("doc.doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_overlap_planted(spark, planted, planted_rows):
    rng = random.Random(8)
    items = [(i, " ".join((r[1] or "").split()[3 : 3 + rng.choice([5, 13, 20, 40])])) for i, r in enumerate(planted_rows[::9])]
    items += [(100, "w1"), (101, "w1 w1"), (102, "W1, w2!"), (103, None), (104, ""), (105, "..."), (10, items[0][1]), (106, prose(rng, 60)), (None, "v7"), (100, "w1")]
    table = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc", F.lit(1))
    assert contaminated(planted, table) == overlap(planted_rows, items)


def test_overlap_awkward(spark, awkward, awkward_rows):
    items = [(1, "a a a"), (2, "one"), (3, awkward_rows[7][1]), (4, "ünï cödé"), (5, awkward_rows[9][1] + " more"), (6, "x")]
    rows = [r for r in awkward_rows if len(r[1] or "") < 5000]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    assert contaminated(awkward.filter("coalesce(length(text), 0) < 5000"), table) == overlap(rows, items)


def test_overlap_without_short_items(spark, planted, planted_rows):
    items = [(i, " ".join((r[1] or "").split()[:30])) for i, r in enumerate(planted_rows[:40]) if len((r[1] or "").split()) > 14]
    assert contaminated(planted, spark.createDataFrame(items, "item_id bigint, text string")) == overlap(planted_rows, items)


def test_overlap_of_empty_tables(spark, empty, planted, planted_rows):
    items = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert contaminated(empty, items) == []
    assert contaminated(planted, items.limit(0)) == overlap(planted_rows, [])


def test_no_python_in_the_plan(planted, spark):
    items = spark.createDataFrame([(1, "w1 w2 w3")], "item_id bigint, text string")
    plan = N.contamination(planted, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- licences -----------------------------------------------------------------------------------
def test_automaton_runs_and_places():
    rng = random.Random(1)
    for _ in range(200):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(0, 9))] for _ in range(rng.randrange(1, 4))]
        automaton, places = L.SuffixAutomaton(sequences), {}
        for n, s in enumerate(sequences):
            for i in range(len(s)):
                for j in range(i + 1, len(s) + 1):
                    places.setdefault(tuple(s[i:j]), set()).add((n, j))
        text = [rng.randrange(4) for _ in range(20)]
        longest = [max(n for n in range(end + 1) if not n or tuple(text[end - n : end]) in places) for end in range(1, 21)]
        want = [(e, n) for e, n in enumerate(longest, 1) if n >= 2 and (e == 20 or longest[e] != n + 1)]
        got = automaton.runs(text, 2)
        assert [(e, n) for e, n, _ in got] == want
        assert all(automaton.ends[s] == places[tuple(text[e - n : e])] for e, n, s in got)


LICENCE_TEXTS = [
    ("Released under the MIT License.", "mit", "mit"),
    ("licensed UNDER the Apache License, Version 2.0", "apache-2", "apache-2"),
    ("apache license version 2", "apache-2", "apache-2"),
    ("Licensed under CC BY-NC 4.0, cc by nc", "cc-by-nc", "cc-by-nc"),
    ("This work is licensed under the GNU General Public License, version 3.", "", "gpl-3"),
    ("licensed under the GNU General Public License, version 2", "", "gpl-2"),
    ("All rights reserved.", "", "all-rights-reserved"),
    ("Permission is hereby granted, free of charge, to anybody obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
     "without any restriction, including the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies", "", "mit"),
    ("the general public and the version of the license", "", ""),
    ("under the mit licence", "", ""), ("", "", ""), (None, "", ""),
]


def test_licence_labels(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(LICENCE_TEXTS)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["s"]["base_labels"], r["s"]["labels"]) for r in rows.select("doc_id", L.scan(F.col("text")).alias("s")).collect()}
    assert got == {i: (base, full) for i, (_, base, full) in enumerate(LICENCE_TEXTS)}


def test_licence_places(awkward, planted, spark):
    texts = ["mit under the mit license under the mit license", "x cc-by-nc; CC BY NC apache license version 2", "é under the mit license", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").unionByName(awkward.select("doc_id", "text")).unionByName(planted.select("doc_id", "text"))
    for r in rows.select("text", L.scan(F.col("text")).alias("s")).collect():
        words, places = words_of(r["text"]), []
        for phrase in L.PHRASES:
            p = phrase.encode().split()
            places += [i for i in range(len(words)) if words[i : i + len(p)] == p]
        s = r["s"]
        assert (s["n_words"], s["n_base"], s["first_word"], s["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert 0 <= s["score"] <= 1 and set(filter(None, s["base_labels"].split(","))) <= set(filter(None, s["labels"].split(",")))


def test_licence_spans_point_into_the_document(spark):
    text = "word " * 50 + "Released under the MIT License and more"
    found = spark.createDataFrame([(text,)], "text string").select(L.scan(F.col("text")).alias("s")).first()["s"]["spans"]
    assert [(s["label"], s["start"], s["end"], s["share"]) for s in found] == [("mit", 50, 55, 1.0)]


def test_licences_of_empty_table(empty):
    assert empty.select(L.scan(F.col("text")).alias("s")).count() == 0
