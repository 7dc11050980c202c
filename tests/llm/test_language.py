"""Held-out accuracy and awkward texts."""
from pyspark.sql import functions as F

from evcat.llm import language as L
from evcat.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op7_language"](spark, sf).join(truth, "doc_id").filter("held_out").collect()
    right = [r["lang"] == r["lang_pred"] for r in rows]
    assert sum(right) / len(right) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["rejected"] for r in rows) <= 0.01 * len(rows)


def test_awkward_texts(awkward):
    dictionaries = L.learn(awkward)
    assert set(dictionaries) == {"en", "de"} or set(dictionaries) == {"en", "de", "c"}
    rows = awkward.select("doc_id", "text", L.identify(F.col("text"), dictionaries).alias("l")).select("doc_id", "text", "l.*").collect()
    for r in rows:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang"] == "und") == (not lettered)
        assert 0 <= r["score"] <= 1
        assert r["rejected"] or lettered


def test_labels_are_never_read_for_a_prediction(awkward):
    dictionaries = L.learn(awkward)
    told = awkward.select("text", L.identify(F.col("text"), dictionaries)["lang"].alias("l")).collect()
    other = awkward.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.lit(0)).select("text", L.identify(F.col("text"), dictionaries)["lang"].alias("l")).collect()
    assert sorted(told, key=str) == sorted(other, key=str)


def test_nothing_learnt_and_one_language(spark, empty):
    assert L.learn(empty) == {}
    one = spark.createDataFrame([("guten tag",), ("123",), (None,)], "text string")
    assert [tuple(r[0]) for r in one.select(L.identify(F.col("text"), {})).collect()] == [("und", 0.0, True)] * 3
    assert [r[0]["lang"] for r in one.select(L.identify(F.col("text"), {"de": b"guten tag und"})).collect()] == ["de", "und", "und"]


def test_narrow_margin_is_rejected(spark):
    same = {"a": b"alpha beta gamma " * 20, "b": b"alpha beta gamma " * 20}
    rows = spark.createDataFrame([("delta epsilon zeta " * 40,), ("delta",)], "text string").select(L.identify(F.col("text"), same).alias("l")).collect()
    assert [r["l"]["rejected"] for r in rows] == [True, False]


HEADER = " ".join(f"this notice stands in front of every text of part {n} and says nothing about its language or content" for n in range(6))


def test_a_shared_header_does_not_decide(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    headed = docs.withColumn("text", F.concat(F.lit(HEADER[:630] + "\n"), "text"))
    dictionaries = L.learn(headed.filter("doc_id % 4 <> 2"))
    rows = headed.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang", L.identify(F.col("text"), dictionaries).alias("l")).select("doc_id", "lang", "l.lang", "l.rejected").toDF("doc_id", "lang", "named", "rejected").collect()
    held = [r for r in rows if r["doc_id"] % 4 == 2]
    assert sum(r["lang"] == r["named"] for r in held) >= 0.97 * len(held)
    assert sum(r["rejected"] for r in rows) <= 0.01 * len(rows)


def test_excerpts_come_from_the_whole_text(spark):
    word = lambda part, n: part + "".join("abcdefghij"[int(c)] for c in str(n))
    rows = [(i, "en", " ".join(word(part, i * 400 + n) for part in ("front", "tail") for n in range(400))) for i in range(200)]
    content = L.learn(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"))["en"]
    assert content.count(b"front") > 1000 and content.count(b"tail") > 1000


def test_repeated_rows_and_null_ids_teach_once(spark):
    rows = [(None, "en", "one text of many rows")] * 3000 + [(7, "en", "another text")] * 3000 + [(1, "de", "ein anderer satz hier")]
    dictionaries = L.learn(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"), sample_rows=2_000)
    assert sorted(len(v) for v in dictionaries.values()) == [len(b"ein anderer satz hier"), len(b"one text of many rows another text")]


def test_every_answer_equals_compressing_one_by_one(spark, awkward):
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    dictionaries = L.learn(docs)
    for r in docs.unionByName(awkward.select("doc_id", "text", "lang")).select("text", L.identify(F.col("text"), dictionaries).alias("l")).collect():
        code = L.letters(r["text"] or "").encode()
        level, sizes = 19 if len(code) < 256 else 6, {}
        for lang, content in dictionaries.items():
            shape = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(content), source_size=2048, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = 0
            for at in range(0, len(code), 2048):
                made = zstandard.ZstdCompressor(compression_params=shape, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
                sizes[lang] += len(made.compress(code[at : at + 2048]))
        if not any(c.isalpha() for c in code.decode()):
            assert tuple(r["l"]) == ("und", 0.0, True)
            continue
        first, second = sorted(sizes.values())[:2]
        assert r["l"]["lang"] == min(sizes, key=sizes.get) and r["l"]["score"] == 1 - first / second
        assert r["l"]["rejected"] == (1 - first / second < 0.01 and len(code) >= 200)


def test_empty_table_has_no_rows(empty):
    assert empty.select(L.identify(F.col("text"), {"en": b"some words"})).count() == 0
