"""Language by compression: the dictionary that shortens a text most names its language."""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evcat.llm import words as W

UNKNOWN = "und"
DICTIONARY_BYTES, COMMON_BYTES = 64 << 10, 16 << 10
EXCERPT_CHARS = 600
SAMPLE_ROWS = 256  # labelled documents per language that excerpts are taken from, more than fill the dictionary
RUN = 4  # words of a run that counts as shared
CHUNK_BYTES = 2_048
LEVEL, SHORT_LEVEL, SHORT_BYTES = 6, 19, 256
MIN_MARGIN, MARGIN_BYTES = 0.01, 200

_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-case letters, each run of anything else as one blank."""
    return _NO_LETTERS.sub(" ", text.lower()).strip()


def _excerpt(text: Column, seed: Column, chars: int) -> Column:
    """A stretch of the text at a place chosen by hash, anywhere in the whole text."""
    places = F.greatest(F.length(text) - chars, F.lit(0)) + 1
    return F.substring(text, (F.pmod(F.xxhash64(F.lit(3), seed), places) + 1).cast("int"), F.lit(chars))


def _runs(words: list[str]) -> list[tuple[str, ...]]:
    return [tuple(words[i : i + RUN]) for i in range(len(words) - RUN + 1)]


def build(excerpts: dict[str, list[str]], size: int = DICTIONARY_BYTES, common_size: int = COMMON_BYTES) -> dict[str, bytes]:
    """Dictionaries from the excerpts of each language.

    Runs of words that stand in excerpts of two languages (headers, licences) say nothing about a language: they are put into every dictionary
    alike, so that they cost the same under each. Runs that an earlier excerpt of the language has are left out.
    """
    words = {g: [letters(x).split() for x in texts] for g, texts in excerpts.items()}
    home: dict[tuple[str, ...], str] = {}
    shared = set()
    for g, texts in words.items():
        for run in (r for x in texts for r in _runs(x)):
            if home.setdefault(run, g) != g:
                shared.add(run)
    common, common_seen, own = [], set(), {}
    for g, texts in words.items():
        seen: set[tuple[str, ...]] = set()
        own[g] = []
        for x in texts:
            runs = _runs(x)
            passage, repeated = np.zeros(len(x), bool), np.zeros(len(x), bool)
            for i, run in enumerate(runs):
                if run in shared:
                    passage[i : i + RUN] = True
                elif run in seen:
                    repeated[i : i + RUN] = True
            if any(run in shared and run not in common_seen for run in runs):
                common += [w for w, hit in zip(x, passage) if hit]
            common_seen.update(run for run in runs if run in shared)
            seen.update(runs)
            own[g] += [w for w, hit in zip(x, passage | repeated) if not hit]
    both = " ".join(common).encode()[:common_size]
    made = {g: b" ".join(part for part in (" ".join(ws).encode()[: size - len(both)], both) if part) for g, ws in own.items()}
    return {g: content for g, content in made.items() if content}


def learn(
    labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, excerpt_chars: int = EXCERPT_CHARS
) -> dict[str, bytes]:
    """Raw-content dictionary of each language, the language with most rows first.

    Made from at most about four times ``sample_rows`` distinct documents per language, chosen by a hash of id and text; each gives one stretch of
    ``excerpt_chars`` characters, at a place anywhere in its whole text that the hash chooses. The driver holds languages x rows x excerpt. Rows
    without label or text teach nothing; repeated rows teach once.
    """
    text = F.col(f"`{text_col}`")
    seed = F.xxhash64(F.lit(7), F.col(f"`{id_col}`"), text)
    rows = labelled.select(F.col(f"`{lang_col}`").alias("lang"), _excerpt(text, seed, excerpt_chars).alias("text"), F.pmod(seed, F.lit(1 << 40)).alias("h"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Four times the rows wanted are expected below the limit, so too few are practically excluded.
    limit = F.coalesce(*[F.when(F.col("lang") == g, F.lit(int((1 << 40) * min(1.0, 4 * sample_rows / n)))) for g, n in counts.items()]) if counts else F.lit(0)
    picked = rows.filter(F.col("h") < limit).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    by_lang: dict[str, list[str]] = {g: [] for g in sorted(counts, key=lambda g: (-counts[g], g))}
    for row in sorted(picked, key=lambda r: (r["h"], r["text"])):
        by_lang[row["lang"]].append(row["text"])
    return build({g: texts for g, texts in by_lang.items() if any(letters(x) for x in texts)})


def compressors(dictionaries: dict[str, bytes], level: int) -> list[zstandard.ZstdCompressor]:
    made = []
    for content in dictionaries.values():
        shape = zstandard.ZstdCompressionParameters.from_level(
            level, dict_size=len(content), source_size=CHUNK_BYTES, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.append(zstandard.ZstdCompressor(compression_params=shape, dict_data=raw))
    return made


def lengths(text: bytes, made: list[zstandard.ZstdCompressor]) -> list[int]:
    """Compressed length of the whole text under each dictionary, chunk by chunk so that the text cannot teach itself."""
    chunks = [text[k : k + CHUNK_BYTES] for k in range(0, len(text), CHUNK_BYTES)]
    return [sum(len(c.compress(x)) for x in chunks) for c in made]


def identify(text: Column, dictionaries: dict[str, bytes]) -> Column:
    """Struct (lang, score, rejected) of a text column.

    The language is the one whose dictionary gives the shortest code; ties go to the language with more training rows. ``score``
    is 1 - shortest / second shortest code, between 0 and 1. ``und`` with score 0 for null, for texts without a letter, and
    when nothing was learnt. With a single language there is no second code and the score is 1. ``rejected``: unknown, or a
    margin below MIN_MARGIN on at least MARGIN_BYTES of letters; shorter texts are too short to judge a margin by.
    """

    def identified(texts: pa.Array) -> pa.Array:
        langs, scores, rejected = [], [], []
        key = hash(tuple(dictionaries.items()))
        normal, short = W.worker_object("lang", key, lambda: (compressors(dictionaries, LEVEL), compressors(dictionaries, SHORT_LEVEL)))
        names = list(dictionaries)
        for value in W.utf8(texts):
            plain = letters(value.decode("utf-8", "replace")) if value else ""
            if not names or not any(map(str.isalpha, plain)):
                lang, score, narrow = UNKNOWN, 0.0, True
            else:
                code = plain.encode()
                sizes = np.array(lengths(code, short if len(code) < SHORT_BYTES else normal))
                best = int(sizes.argmin())
                second = int(np.delete(sizes, best).min()) if len(sizes) > 1 else 0
                lang, score = names[best], 1 - int(sizes[best]) / second if second else 1.0
                narrow = score < MIN_MARGIN and len(code) >= MARGIN_BYTES
            langs.append(lang)
            scores.append(score)
            rejected.append(narrow)
        return W.struct_array({"lang": (langs, pa.string()), "score": (scores, pa.float64()), "rejected": (rejected, pa.bool_())})

    return F.arrow_udf(identified, "lang string, score double, rejected boolean")(text)
