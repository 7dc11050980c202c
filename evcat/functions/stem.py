"""Search terms: lower-cased words without stop words, optionally stemmed.

Splitting and stop words are column expressions. The English stemmer (the published Porter2
rules) works on distinct words of an Arrow batch.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from evcat import config as C

_SPLIT = r"[^\p{L}\p{N}]+"
# The published exception lists and suffix tables of the English stemmer.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
_KEEP = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"),
    ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"),
    ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"),
    ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
)
_STEP3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"),
    ("ical", "ic"), ("ful", ""), ("ness", ""),
)
_STEP4 = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous",
    "ive", "ize", "al", "er", "ic",
)
_V = "[aeiouy]"
_REGION = re.compile(f"{_V}[^aeiouy](.*)$")
_SHORT_END = re.compile(f"(?:[^aeiouy]{_V}[^aeiouywxY]|^{_V}[^aeiouy])$")


def _regions(w: str) -> tuple[int, int]:
    head = re.match("gener|commun|arsen", w)
    found = None if head else _REGION.search(w)
    r1 = head.end() if head else (found.start(1) if found else len(w))
    inner = _REGION.search(w[r1:])
    return r1, r1 + inner.start(1) if inner else len(w)


def stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = re.sub("^y|(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_V, w[:-2]):
        w = w[:-1]
    if w in _KEEP:
        return w
    # past and progressive forms
    if w.endswith(("eed", "eedly")):
        if len(w) - (3 if w.endswith("eed") else 5) >= r1:
            w = re.sub("(?:eed|eedly)$", "ee", w)
    else:
        cut = re.match(f"(.*{_V}.*?)(?:ingly|edly|ing|ed)$", w)
        if cut:
            w = cut.group(1)
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif _SHORT_END.search(w) and r1 >= len(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    w = _swap(w, _STEP2, r1, r2, second=True)
    w = _swap(w, _STEP3, r1, r2, second=False)
    for end in (*_STEP4, "ion"):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _SHORT_END.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def _swap(w: str, table: tuple, r1: int, r2: int, second: bool) -> str:
    for end, new in table:
        if w.endswith(end):
            return w[: -len(end)] + new if len(w) - len(end) >= r1 else w
    if second:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            return w[:-1]
        if w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            return w[:-2]
    elif w.endswith("ative") and len(w) - 5 >= r2:
        return w[:-5]
    return w


# Stems a task remembers at most.
_KNOWN_WORDS = 1 << 18


@F.arrow_udf(ArrayType(StringType()))
def _stem_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each distinct word of a batch is stemmed once, and remembered for the batches after it; the lists stay Arrow columns."""
    known: dict[str, str] = {}
    for lists in batches:
        coded = pc.list_flatten(lists).dictionary_encode()
        if len(known) > _KNOWN_WORDS:
            known.clear()
        words = coded.dictionary.to_pylist()
        for word in words:
            if word not in known:
                known[word] = stem(word)
        stems = pa.array([known[word] for word in words], pa.string()).take(coded.indices)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        places = pa.array(np.append(0, ends), pa.int32())
        yield pa.ListArray.from_arrays(places, stems, mask=pc.is_null(lists) if lists.null_count else None)


def words_of(c: Column) -> Column:
    """Distinct lower-cased words without stop words."""
    words = F.array_distinct(F.filter(F.split(F.lower(c), _SPLIT), lambda w: w != ""))
    return F.array_except(words, F.array(*[F.lit(w) for w in C.STOP_WORDS]))


def terms(c: Column, stemmed: bool = True) -> Column:
    words = words_of(F.coalesce(c, F.lit("")))
    return F.array_distinct(_stem_words(words)) if stemmed else words


def query_terms(q: str, stemmed: bool = True) -> list[str]:
    """The same rule for one search literal, on the driver."""
    words = [w for w in re.split(r"[\W_]+", q.lower()) if w and w not in C.STOP_WORDS]
    return list(dict.fromkeys(stem(w) if stemmed else w for w in words))
