"""Counted signals by brute force, and the compression bands."""
import base64
import random
import string

from pyspark.sql import functions as F

from evcat.llm import quality as Q


def signals(text):
    text = text or ""
    words = text.encode().split()
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 8)} if len(words) < 3000 else set()
    lines = [x for x in text.encode().split(b"\n") if x.split()]
    seen, repeated = set(), 0
    for line in lines:
        repeated += line in seen
        seen.add(line)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), repeated, len(inside), failed


def judge(df):
    return df.select("doc_id", "text", Q.quality(F.col("text")).alias("q")).select("doc_id", "text", "q.*").collect()


def test_signals(awkward, planted):
    for r in judge(awkward) + judge(planted):
        if len(r["text"] or "") < 20_000:
            assert tuple(r[2:8]) == signals(r["text"]), r["text"]
            assert not (r["kept"] and r["base_failed"])


def test_bands(spark):
    rng = random.Random(1)
    prose = " ".join("".join(rng.choices(string.ascii_lowercase[:14], k=rng.randrange(2, 9))) for _ in range(900))
    noise = " ".join(base64.b64encode(rng.randbytes(45)).decode() for _ in range(300))
    varied = " ".join(f"{i} item of the very same list" for i in range(2000))
    rows = judge(spark.createDataFrame([(1, prose), (2, noise), (3, varied)], "doc_id bigint, text string"))
    kept = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in rows}
    assert kept == {1: (True, False), 2: (False, False), 3: (False, False)}


def test_chunks_catch_what_the_whole_hides():
    rng = random.Random(4)
    prose = " ".join("".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(3000)).encode()
    compressor = Q.zstandard.ZstdCompressor(level=3)
    assert Q.bad_chunks(prose, compressor, Q.CHUNK_BYTES, Q.CHUNK_BAND) == 0
    assert Q.bad_chunks(prose + b"spam " * 3000, compressor, Q.CHUNK_BYTES, Q.CHUNK_BAND) > Q.MAX_BAD_CHUNKS
    assert Q.bad_chunks(b"short", compressor, Q.CHUNK_BYTES, Q.CHUNK_BAND) == 0


def test_junk_tail_shorter_than_a_chunk(spark):
    rng = random.Random(7)
    names = ["".join(rng.choices(string.ascii_lowercase, k=rng.randrange(2, 9))) for _ in range(800)]
    prose = " ".join(rng.choices(names, k=4000)).encode()[: 2 * Q.CHUNK_BYTES]
    junk = b" ".join(base64.b64encode(rng.randbytes(45)) for _ in range(80))
    compressor = Q.zstandard.ZstdCompressor(level=3)
    share = lambda text: Q.bad_chunks(text, compressor, Q.CHUNK_BYTES, Q.CHUNK_BAND)
    one = prose[: Q.CHUNK_BYTES]
    assert share(one) == share(prose) == share(prose[:-1]) == share(one + prose[:1000]) == 0
    assert share(one + junk[: Q.CHUNK_BYTES - 1]) == 0.5 and share(one + junk[:2000]) == 0.5
    assert share(prose + junk[:2000]) == 1 / 3
    # Too short for a band of its own, and then part of the chunk before.
    assert share(one + b"\0" * 199) == 0 and share(b" " * Q.CHUNK_BYTES + junk[:199]) == 1
    texts = [(1, prose[:-1].decode()), (2, (one + junk[: Q.CHUNK_BYTES - 1]).decode()), (3, (junk[: Q.CHUNK_BYTES - 1] + b" " + one).decode())]
    rows = judge(spark.createDataFrame(texts, "doc_id bigint, text string"))
    assert {r["doc_id"]: (r["kept"], r["base_failed"]) for r in rows} == {1: (True, False), 2: (False, False), 3: (False, False)}


def test_bands_by_length():
    assert Q.band_of(10, Q.WHOLE_BANDS) is None
    assert Q.band_of(200, Q.WHOLE_BANDS).low == 0.40
    assert Q.band_of(10**9, Q.WHOLE_BANDS).low == 0.20


def test_empty_table(empty):
    assert judge(empty) == []
