"""Targets against round-by-round sharing; copies against targets."""
import pytest
from pyspark.sql import functions as F

from evcat.llm import mixing

def size():
    return F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))



def shared_in_rounds(sizes, weights=(1, 2, 3), most=3):
    """Share by weight; whoever is above the cap stays there and the rest shares the excess, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = [s for s in names if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        target = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if target[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else target[s] for s in names}
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 100, "b": 1, "c": 1, None: 5}, {"a": 0, "b": 7}, {chr(97 + i): (i * 37) % 11 for i in range(12)}, {"Z": 5, "a": 50, "é": 1}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(shared_in_rounds(sizes))


def test_mix_of_awkward_documents(awkward, awkward_rows):
    rows = mixing.mix_sources(awkward, size()).select("doc.doc_id", "doc.text", "doc.size", F.col("size").alias("n"), "source_size", "target", "copies").collect()
    assert len(rows) == len(awkward_rows)
    for r in rows:
        assert r["n"] == len((r["text"] or "").encode().split()) and 0 <= r["copies"] <= 3
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert r["copies"] in (int(rate), int(rate) + 1)
    again = mixing.mix_sources(awkward.repartition(3), size()).select("doc.doc_id", "copies").collect()
    assert sorted((r[0] or 0, r[1]) for r in again) == sorted((r["doc_id"] or 0, r["copies"]) for r in rows)


def test_repeated_rows_keep_their_columns(planted):
    mixed = mixing.mix_sources(planted, size())
    out = mixing.repeated(mixed)
    assert out.columns == planted.columns
    assert out.count() == mixed.agg(F.sum("copies")).first()[0]


def test_large_sources_come_near_their_target(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 3 > 0, "x").otherwise("y").alias("source"))
    sums = mixing.mix_sources(docs, F.lit(3)).groupBy("target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert all(abs(r["taken"] / r["target"] - 1) < 0.03 for r in sums)


def test_empty_mix(empty):
    assert mixing.mix_sources(empty, size()).count() == 0
