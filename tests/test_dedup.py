import random

import pytest
from pyspark.sql import functions as F

from evcat.operators import dedup
from evcat.operators.ordered import add_previous, add_row_number, first_within
from evcat.operators.titles import contained_titles, titles_in_reach

HOUR = 3600 * 1_000_000
REACH = 12 * HOUR


def test_row_number_and_previous_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(30)}", i, rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long, v int")
    got = {(r.k, r.o): r for r in add_previous(add_row_number(df, ["k"], ["o"], "rn"), ["k"], ["o"], "v", "prev").collect()}
    assert len(got) == len(rows)
    seen: dict = {}
    for k, o, v in rows:
        n, prev = seen.get(k, (0, None))
        assert (got[k, o].rn, got[k, o].prev) == (n + 1, prev)
        seen[k] = (n + 1, v)


def test_global_row_number(spark):
    df = spark.range(1000).withColumn("x", F.pmod(F.col("id") * 7919, F.lit(1009)))
    got = add_row_number(df, [], ["x"], "rn").orderBy("x").collect()
    assert [r.rn for r in got] == list(range(1, 1001))


@pytest.mark.parametrize("grain", [1, HOUR // 4])
def test_first_within_equals_brute_force(spark, grain):
    rng = random.Random(grain)
    span = 4 * 24 * HOUR // grain
    pts = [(rng.choice("ab"), rng.randrange(-span, span) * grain, v) for v in range(300)]
    probes = [(rng.choice("abc"), rng.randrange(-span, span) * grain) for _ in range(300)] + [(p[0], p[1] + REACH) for p in pts[:50]]
    got = first_within(
        spark.createDataFrame(pts, "key string, us long, value long"),
        spark.createDataFrame(probes, "key string, us long"),
        12 * 3600,
    ).collect()
    want = {}
    for k, us in set(probes):
        hits = [v for pk, pu, v in pts if pk == k and abs(pu - us) <= REACH]
        if hits:
            want[k, us] = min(hits)
    assert {(r.key, r.us): r.value for r in got} == want


@pytest.mark.parametrize("crowded_rows", [0, 20])
def test_crowded_blocks_are_split_by_seconds(spark, crowded_rows):
    rng = random.Random(crowded_rows)
    near = [(-1, 0, 1)[rng.randrange(3)] * REACH + rng.randrange(-3, 3) * 1_000_000 + rng.randrange(3) for _ in range(200)]
    pts = [("a", us, v) for v, us in enumerate(near)] + [("b", 5, 7), (None, 5, 1), ("b", None, 1)]
    probes = [("a", rng.choice(near) + rng.choice([-2 * REACH, -REACH, 0, REACH, 2 * REACH]) + rng.randrange(-2, 2)) for _ in range(200)]
    probes += [("b", 5 - REACH), ("b", 5 + REACH), ("b", 6 + REACH), (None, 5), ("b", None)]
    got = first_within(
        spark.createDataFrame(pts, "key string, us long, value long"), spark.createDataFrame(probes, "key string, us long"), 12 * 3600, crowded_rows
    ).collect()
    want = {}
    for k, us in set(probes):
        hits = [v for pk, pu, v in pts if None not in (k, us, pu) and pk == k and abs(pu - us) <= REACH]
        if hits:
            want[k, us] = min(hits)
    assert len(got) == len(want) and {(r.key, r.us): r.value for r in got} == want


def test_first_within_computes_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(rows):
        for batch in rows:
            seen.add(batch.num_rows)
            yield batch

    pts = spark.range(50).selectExpr("'a' AS key", "id AS us", "id AS value").mapInArrow(counted, "key string, us long, value long")
    assert first_within(pts, spark.createDataFrame([("a", 3)], "key string, us long"), 12 * 3600).first()["value"] == 0
    assert seen.value == 50


def test_contained_titles_equals_brute_force(spark):
    rng = random.Random(5)
    titles = {"".join(rng.choice("ab ") for _ in range(rng.randrange(1, 12))).strip() for _ in range(200)} - {""}
    titles |= {t + " and a much longer tail of thirty-two plus " + t for t in list(titles)[:20]}
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    got = {(r.inner, r.outer) for r in contained_titles(df, df).collect()}
    assert got == {(i, o) for i in titles for o in titles if i in o}


def sequential(rows):
    kept, out = [], {}
    for title, us, url, seq, publishable in sorted(rows, key=lambda r: r[3]):
        dup = next((k for k in kept if url and k[2] == url), None) or next(
            (k for k in kept if title in k[0] and abs(k[1] - us) <= REACH), None
        )
        out[seq] = dup[3] if dup else None
        if not dup and publishable:
            kept.append((title, us, url, seq))
    return out


@pytest.mark.parametrize("seed,halves", [(1, 16), (2, 1), (3, 2), (4, 3)])
def test_batch_duplicates_equals_the_sequential_rule(spark, seed, halves):
    rng = random.Random(seed)
    titles = ["meetup", "meetup one", "big meetup one", "talk", "talk night", "x" * 40, "solo"]
    rows = []
    order = list(range(150))
    rng.shuffle(order)
    for seq in order:
        title = rng.choice(titles)
        us = rng.choice([rng.randrange(0, 8 * 24) * HOUR, rng.randrange(0, 3) * 24 * HOUR])
        url = rng.choice(["", f"u{rng.randrange(20)}", f"only{seq}"])
        rows.append((title, us, url, seq, rng.random() < 0.8))
    df = spark.createDataFrame(rows, "title string, us long, url string, seq long, publishable boolean")
    got = {r.seq: r.dup_of for r in dedup.batch_duplicates(df, halves).collect()}
    assert got == sequential(rows)


def test_ten_hour_steps_keep_first_and_third(spark):
    rows = [("same", h * HOUR, "", i, True) for i, h in enumerate((0, 10, 20))]
    df = spark.createDataFrame(rows, "title string, us long, url string, seq long, publishable boolean")
    got = {r.seq: r.dup_of for r in dedup.batch_duplicates(df).collect()}
    assert got == {0: None, 1: 0, 2: None}


def kept_one_by_one(rows):
    """The rule row by row: (seq, title, us) kept, in order of seq."""
    kept = []
    for seq, title, us in rows:
        if not any(title in t and abs(us - u) <= REACH for _, t, u in kept):
            kept.append((seq, title, us))
    return {seq for seq, _, _ in kept}


@pytest.mark.parametrize("halves", [1, 4, dedup.BLOCK_HALVES])
def test_a_hot_title_over_many_blocks(spark, halves):
    rng = random.Random(6)
    rows = [(n, rng.choice(["hot talk"] * 8 + ["hot", "talk", "a hot talk in town"]), rng.randrange(0, 60 * 24) * HOUR) for n in range(900)]
    df = spark.createDataFrame([(n, t, u, "", True) for n, t, u in rows], "seq long, title string, us long, url string, publishable boolean")
    got = dedup.batch_duplicates(df, halves).filter("dup_of IS NULL").collect()
    assert {r.seq for r in got} == kept_one_by_one(rows)


def test_titles_meet_only_within_reach(spark):
    history = [("rust meetup lucknow", h) for h in range(2_000)] + [("rust meetup", h) for h in range(5_000, 5_400)]
    outer = spark.createDataFrame(history, "title string, half long")
    inner = spark.createDataFrame([("rust meetup", 1_000), ("meetup", 1_001), ("go meetup", 1_000), ("rust meetup", 9_000), ("", 1_000)], "title string, half long")
    got = {tuple(r) for r in titles_in_reach(inner, outer).collect()}
    assert got == {("rust meetup", "rust meetup lucknow", h) for h in (999, 1_000, 1_001)} | {("meetup", "rust meetup lucknow", h) for h in (1_000, 1_001, 1_002)}
    assert titles_in_reach(inner.limit(0), outer).count() == 0


def test_titles_in_reach_equals_brute_force(spark):
    rng = random.Random(12)
    draw = lambda n: {("".join(rng.choice("ab ") for _ in range(rng.randrange(1, 40))).strip(), rng.randrange(-4, 5)) for _ in range(n)}
    ins, outs = draw(150), draw(250)
    outs |= {(t[:20] + i + t[20:], h) for (t, h), (i, _) in zip(list(outs), list(ins))}
    got = {tuple(r) for r in titles_in_reach(*[spark.createDataFrame(sorted(x), "title string, half long") for x in (ins, outs)]).collect()}
    assert got == {(i, o, h) for i, g in ins for o, h in outs if i and o and i in o and abs(g - h) <= 1}
