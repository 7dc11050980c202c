"""Token counts and token-id files."""
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evcat.llm import token_counts, token_ids
from evcat.llm import words as W
from evcat.llm.folders import new_folder
from evcat.llm.token_ids import SELECT_STEP, EliasFano, Shard, WordEncoder, shard_bytes
from tests.llm.conftest import frame

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def whole_text_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [0, 3, 3, 9, 1 << 40], list(range(1000)), [7] * 700])
def test_elias_fano_round_trip(values):
    coded = EliasFano.from_bytes(memoryview(EliasFano.encode(np.array(values, np.uint64)).to_bytes()))
    assert coded.decode().tolist() == values
    assert [coded.select(i) for i in range(len(values))] == values
    assert list(coded) == values


def test_elias_fano_random_and_small():
    rng = random.Random(3)
    values = np.cumsum([rng.choice([0, 1, 5, 900, 100_000]) for _ in range(5 * SELECT_STEP + 17)])
    coded = EliasFano.encode(values)
    assert coded.decode().tolist() == values.tolist()
    assert all(coded.select(i) == values[i] for i in range(len(values))) and list(coded) == values.tolist()
    n, top = len(values), int(values[-1])
    assert len(coded.low) + len(coded.high) <= n * (2 + np.log2(top / n) + 1) / 8 + 16
    with pytest.raises(IndexError):
        coded.select(n)


def test_shard_gives_each_document():
    docs = [[1, 2, 3], [], [70_000], [4] * 1000]
    flat = b"".join(np.array(d, "<u4").tobytes() for d in docs)
    shard = Shard(shard_bytes([None, -5, 3, 3], [len(d) for d in docs], flat, 4))
    assert [shard.doc_id(i) for i in range(4)] == [None, -5, 3, 3]
    assert [(d, at, ids.tolist()) for d, at, ids in shard.documents()] == [(None, 0, docs[0]), (-5, 3, docs[1]), (3, 3, docs[2]), (3, 4, docs[3])]
    assert [shard.ids(i).tolist() for i in range(4)] == docs


def test_word_encoder_equals_whole_text(awkward_rows):
    encoder = WordEncoder(WORDS)
    extra = ["A.B it's IT'S. 'll we'll! x' <|startoftext|>. é É. ́a a_b c_ 5% 5.5% \x1c z\u0085y ﬁ İ", "ΑΣ. Σ", "tab\tnew\nline\x0bv\x0cf\rr"]
    for text in [t for _, t, _, _ in awkward_rows if t is not None and len(t) < 5000] + extra:
        ids = np.frombuffer(encoder.encode(text.encode()), f"<u{encoder.width}").tolist()
        assert ids + [2] == whole_text_ids(text), text


def test_every_byte_before_every_sign():
    from tokenizers import Tokenizer

    encoder, whole = WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    signs = [chr(b) for b in range(33, 127) if not chr(b).isalnum()]
    texts = [f"{before}{chr(b)}{sign}{after}" for b in range(256) for sign in signs for before, after in (("a", ""), ("", " b"), ("a", ".x"))]
    rng = random.Random(8)
    letters = [chr(b) for b in range(256)] + list("aéÉßΣςİıﬁ\u0301\u200b\u2028") + signs
    texts += ["".join(rng.choices(letters, k=rng.randrange(1, 30))) for _ in range(5_000)]
    for text in texts:
        ids = np.frombuffer(encoder.encode(text.encode()), f"<u{encoder.width}").tolist()
        assert ids == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_capitals_before_marks_and_all_plain_letters():
    from tokenizers import Tokenizer

    encoder, whole = WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    letters = [chr(i) for i in range(0x41, 0x530) if chr(i).isalpha()]
    texts = [f"{before}{c}{after}" for c in letters for before, after in (("", ""), ("x", ",."), ("", "y'"))]
    texts += [f"{before}{c}{mark}{after}" for c in "THJWYAkiIß" for mark in "\u0300\u0307\u0308\u030a\u030c\u0331" for before, after in (("", "x"), ("a", "1,"), ("", ""))]
    for text in texts:
        ids = np.frombuffer(encoder.encode(text.encode()), f"<u{encoder.width}").tolist()
        assert ids == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_of_a_block_are_looked_up_once():
    looked_up = []

    class Counted(W.WordCache):
        def __getitem__(self, word):
            looked_up.append(word)
            return super().__getitem__(word)

    encoder = WordEncoder(WORDS)
    encoder.words = Counted(encoder._word, 100)
    texts = ["Été word Word, (word) x1", None, "", "word. WORD été! x1 word " * 1000]
    got = [np.frombuffer(ids, f"<u{encoder.width}").tolist() + [2] for ids in encoder.encode_all(pa.array(["left out", *texts]).slice(1))]
    assert got == [whole_text_ids(t) for t in texts]
    assert sorted(looked_up) == sorted([b"", b"!", b",", b".", b"(word)", b"(word", b")", b"word", b"x1", "été".encode()])


def test_long_texts_are_joined_in_pieces(monkeypatch):
    monkeypatch.setattr(token_ids, "JOINED_WORDS", 3)
    text = "one Two, three. 4 five\tsix! Seven"
    assert np.frombuffer(WordEncoder(WORDS).encode(text.encode()), "<u2").tolist() + [2] == whole_text_ids(text)


def test_word_array_cuts_at_blanks_and_texts():
    rng = random.Random(4)
    for n in range(60):
        texts = [None if rng.random() < 0.2 else bytes(rng.choices(b"ab\xc3 \t\n\x0b\x0c\r\x1c\x00", k=rng.randrange(0, 9))) for _ in range(n)]
        for kind in (pa.binary(), pa.large_binary()):
            words, bounds = W.blank_word_array(pa.array([b"x", *texts, b"y z"], kind).slice(1, n))
            words = words.to_pylist()
            assert [words[a:b] for a, b in zip(bounds[:-1], bounds[1:])] == [W.blank_words(t) for t in texts] and bounds[-1] == len(words)


def written_and_read(spark, docs, **options):
    folder = new_folder(spark, "test-ids")
    token_ids.write_token_ids(docs, folder, WORDS, 2, **options)
    return [tuple(r) for r in token_ids.read_token_ids(spark, folder).collect()]


@pytest.mark.parametrize("options", [{}, {"shard_ids": 50}, {"shard_docs": 1}])
def test_files_round_trip(spark, awkward, awkward_rows, options):
    got = sorted(written_and_read(spark, awkward, **options), key=lambda r: r[1])
    order = sorted(awkward_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for doc_id, text, _, _ in order:
        ids = np.array(whole_text_ids(text), "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_empty_table_of_ids(spark, empty):
    assert written_and_read(spark, empty) == []


def greedy(word, vocabulary, longest):
    n = 0
    while word:
        k = next(k for k in range(min(longest, len(word)), 0, -1) if word[:k] in vocabulary)
        word, n = word[k:], n + 1
    return n


def test_token_counts_equal_greedy_matching(spark, awkward, awkward_rows):
    vocabulary = set(token_counts.load_vocabulary(BYTES))
    longest = max(map(len, vocabulary))
    c = token_counts.count_tokens(F.col("text"), BYTES)
    got = sorted((r[0] or -99, r[1], r[2]) for r in awkward.select("doc_id", c.alias("c")).select("doc_id", "c.n_words", "c.n_tokens").collect())
    want = []
    for doc_id, text, _, _ in awkward_rows:
        words = (text or "").encode().split()
        counts = {w: greedy(b" " + w, vocabulary, longest) for w in set(words)}
        want.append((doc_id or -99, len(words), sum(counts[w] for w in words)))
    assert got == sorted(want)


def test_longest_match_on_small_vocabularies():
    rng = random.Random(2)
    for _ in range(40):
        vocabulary = [bytes([b]) for b in range(256)] + [bytes(rng.choices(b"abc", k=rng.randrange(2, 7))) for _ in range(12)]
        automaton = token_counts.LongestMatch(vocabulary)
        for _ in range(40):
            word = bytes(rng.choices(b"abcd", k=rng.randrange(0, 15)))
            assert automaton.count(word) == greedy(word, set(vocabulary), 7)


def test_vocabulary_needs_all_bytes():
    with pytest.raises(ValueError):
        token_counts.LongestMatch([b"a", b"b"])


def test_words_are_forgotten_when_a_task_ends(spark):
    written_and_read(spark, frame(spark, [(i, f"alpha beta{i} gamma", None, None) for i in range(50)]))

    def held(batches):
        import gc

        import pyarrow as pa

        for _ in batches:
            caches = [x for x in gc.get_objects() if type(x).__name__ == "WordCache" and x.limit == token_ids.CACHED_WORDS]
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(len(x) + len(x.old) for x in caches)], pa.int64())})

    assert {r["n"] for r in spark.range(0, 64, 1, 64).mapInArrow(held, "n bigint").collect()} == {0}


def test_another_model_replaces_the_one_before():
    made = [W.worker_object("test-model", key, lambda key=key: [key]) for key in (1, 1, 2)]
    assert made == [[1], [1], [2]] and made[0] is made[1]
    store = W.sys.modules["_evcat_worker"].__dict__
    assert [v for k, v in store.items() if "test-model" in str(k)] == [(2, [2])]
