"""The written search index against a scan, over updates, deletes and merges."""
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evcat.functions import stem
from evcat.operators import catalogue as cat
from evcat.operators import segments
from evcat.operators.segments import SearchIndex, phrase_keys

SCHEMA = "id string, title string, short_description string, community_name string, search_tokens array<string>"
WORDS = ["rust", "meetup", "ai", "Cloud", "go", "Künste", "b%c", "x_y", "data"]


def document(rng, n):
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 4)))
    fields = [rng.choice([text(), None]) for _ in range(3)]
    tokens = sorted({w for f in fields if f for w in f.lower().split()}) if rng.random() < 0.9 else None
    return (f"d{n}", *fields, tokens)


def scanned(df, q):
    return {r["id"] for r in df.filter(cat.keyword(q, stemmed=False)).collect()}


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("block", [2, 128])
def test_index_equals_a_scan_after_every_step(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(segments, "BLOCK", block)
    rng = random.Random(block)
    index, current = SearchIndex(spark, str(tmp_path / "i"), files=2), {}
    assert index.with_all(["=rust"]).count() == 0
    steps = [range(0, 60), range(30, 80), range(10, 20)]
    for n, step in enumerate([*steps, None]):
        if step is None:
            index.merge()
            assert len(index.live()) == 1
        else:
            batch = {f"d{i}": document(rng, i) for i in step}
            gone = [f"d{i}" for i in range(n * 3, n * 3 + 5) if f"d{i}" not in batch]
            current = {k: v for k, v in (current | batch).items() if k not in gone}
            index.add(spark.createDataFrame(list(batch.values()), SCHEMA), spark.createDataFrame([(g,) for g in gone], "id string"))
        docs = spark.createDataFrame(list(current.values()), SCHEMA)
        for q in ("rust meetup", "st me", "b%c", "KÜNSTE") if n >= 2 else ():
            named = {r["id"] for r in index.candidates(q, stemmed=False).collect()}
            assert named <= set(current)
            want = scanned(docs, q)
            assert want == named & want, q
            assert {i for i in named if i in want} == want


def test_merged_index_has_no_void_documents(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "i"), files=2)
    index.add(spark.createDataFrame([("a", "old title", None, None, ["old"]), ("b", "stays", None, None, ["stays"])], SCHEMA))
    index.add(spark.createDataFrame([("a", "new title", None, None, ["new"])], SCHEMA), spark.createDataFrame([("b",)], "id string"))
    assert index.with_all(["=old"]).count() == 0 and index.with_all(["=stays"]).count() == 0
    index.merge()
    rows = index._read(index.live(), None).collect()
    assert {d for r in rows for d in r["docs"]} == {"a"} and not any(r["key"] == "=old" for r in rows)
    assert [r["doc"] for r in index._listed(index.live()).collect()] == ["a"]


def test_keys_of_a_look_up_are_pushed_to_the_files(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "i"), files=4)
    index.add(spark.createDataFrame([document(random.Random(n), n) for n in range(200)], SCHEMA))
    plan = index._read(index.live(), ["=rust"])._jdf.queryExecution().toString()
    assert "In(key, [=rust])" in plan or "EqualTo(key,=rust)" in plan
    assert all("/segments/" in f for f in index._read(index.live(), ["=rust"]).inputFiles())


def test_patterns_that_fix_nothing_need_a_scan():
    assert phrase_keys("%") is None and phrase_keys("a\\%") is None and phrase_keys("") is None
    assert phrase_keys("ab%cdef") == ["ab", "cde", "def"]
    assert stem.query_terms("ab cd", stemmed=False) == ["ab", "cd"]


def test_blocks_are_made_from_documents_not_from_rows_of_postings(spark, tmp_path, monkeypatch):
    written = []
    keep = segments.cut
    monkeypatch.setattr(segments, "cut", lambda df: written.append(keep(df)) or written[-1])
    monkeypatch.setattr(segments, "BLOCK", 4)
    index = SearchIndex(spark, str(tmp_path / "i"), files=2)
    index.add(spark.range(20).select(F.format_string("d%02d", "id").alias("id"), F.lit("same title").alias("title"), F.lit(None).cast("string").alias("short_description"),
                                     F.lit("").alias("community_name"), F.array(F.lit("same")).alias("search_tokens")))
    assert written[0].count() == 20  # one row per document, whatever the number of its keys
    blocks = index._read(index.live(), ["=same"]).orderBy("first").collect()
    assert [d for r in blocks for d in r["docs"]] == [f"d{n:02}" for n in range(20)]
    assert all(r["size"] == len(r["docs"]) <= 4 and (r["first"], r["last"]) == (r["docs"][0], r["docs"][-1]) for r in blocks)


def test_merge_and_additions_read_documents_and_never_postings(spark, tmp_path, monkeypatch):
    index = SearchIndex(spark, str(tmp_path / "i"), files=2)
    ids = ["a%0Ab", "a\nb", "%25", "", "é", None]
    index.add(spark.createDataFrame([(i, "Old title", None, "x", ["old", None]) for i in ids], SCHEMA))
    index.add(spark.createDataFrame([("%25", "new", None, None, None)], SCHEMA), spark.createDataFrame([("é",)], "id string"))
    with monkeypatch.context() as m:
        m.setattr(index, "_read", lambda *a: pytest.fail("postings are read"))
        index.merge()
    found = {key: {r["id"] for r in index.with_all([key]).collect()} for key in ("=old", "title:new", "title:old", "title:d t", "community_name:x")}
    left = {"a%0Ab", "a\nb", ""}
    assert found == {"=old": left, "title:new": {"%25"}, "title:old": left, "title:d t": left, "community_name:x": left}
    assert all(r["size"] == len(r["docs"]) and (r["first"], r["last"]) == (r["docs"][0], r["docs"][-1]) for r in index._read(index.live(), None).collect())


@pytest.mark.parametrize("piece", [1, 2000, 1 << 24])
def test_blocks_hold_every_key_of_every_document(monkeypatch, piece):
    monkeypatch.setattr(segments, "_PIECE", piece)
    monkeypatch.setattr(segments, "BLOCK", 3)
    rng = random.Random(piece)
    wide = "".join(map(chr, range(0x4E00, 0x5200)))
    fields = ["title", "note"]
    texts = ["", None, "ab", "abab", "é𝔘x", *["".join(rng.choices("ab é𝔘\0", k=rng.randrange(9))) for _ in range(20)], wide]
    rows = [(f"d{n:02}", [{"field": f, "text": rng.choice(texts) if n else wide} for f in fields], rng.choices(["t", "u", None], k=2)) for n in range(30)]
    docs, given, terms = (pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.string(), pa.list_(pa.struct({"field": pa.string(), "text": pa.string()})), pa.list_(pa.string()))))
    batch = pa.RecordBatch.from_arrays([docs, terms, given], ["doc", "terms", "texts"])
    want = set()
    for doc, some, words in rows:
        want |= {(f"={w}", doc) for w in words if w}
        want |= {(f"{t['field']}:{t['text'][i : i + k]}", doc) for t in some if t["text"] for k in (1, 2, 3) for i in range(len(t["text"]) - k + 1)}
    for found in (list(segments._blocks([batch.slice(0, 11), batch.slice(11)])), list(segments._filled(segments._blocks([batch])))):
        got = [(r["key"], doc) for b in found for r in b.to_pylist() for doc in r["docs"].split("\n")]
        assert len(got) == len(want) and set(got) == want
        assert all(r["size"] <= 3 and r["docs"].split("\n")[0] == r["first"] <= r["last"] for b in found for r in b.to_pylist())


def test_numbers_of_keys_too_large_to_stand_beside_documents():
    docs = pa.array(["a", "b", "c"])
    (found,) = [segments._sliced(np.array([1 << 61, 5, 1 << 61, 1 << 61]), np.array([2, 1, 0, 0]), lambda n: pa.array(map(str, n.tolist())), docs)]
    assert [(r["key"], r["docs"]) for r in found.to_pylist()] == [("5", "b"), (str(1 << 61), "a\nc")]
