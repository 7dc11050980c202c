"""Text, URL and key expressions. Every function maps Columns to a Column and stays in the JVM."""
from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from evcat import config as C

# White space of any kind, spelled out: a Unicode-aware ``\s`` is many times slower. Fixed values.
_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def strip_ws(c: Column) -> Column:
    """Remove white space of any kind at both ends (SQL ``trim`` removes spaces only)."""
    return F.trim(c, F.lit(_BLANKS))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row.

    A rule that mentions a long expression in several branches would otherwise evaluate it in each.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*cs: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in cs])


def spaced_words(low: Column) -> Column:
    """Words of a lower-cased text with one space before and after each; letters of any script
    and the underscore belong to words. `` python `` inside it is the whole word."""
    return F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}_]+", " "), F.lit(" "))


def any_contains(c: Column, words: Sequence[str]) -> Column:
    """True when the text contains one of a fixed list of words; null text counts as empty.

    One pass over the text for all words.
    """
    if not words:
        return F.lit(False)
    return F.coalesce(c.rlike("|".join(rf"\Q{word}\E" for word in words)), F.lit(False))


def strip_html(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def collapse_whitespace(c: Column) -> Column:
    """Runs of two or more blanks become one space; single line breaks survive."""
    return strip_ws(F.regexp_replace(c, f"[{WS}]{{2,}}", " "))


def clean_text(c: Column, max_chars: int = C.MAX_DESCRIPTION_CHARS) -> Column:
    return F.left(collapse_whitespace(strip_html(c)), F.lit(max_chars))


def norm(c: Column) -> Column:
    """Lower-case, stripped, never null: the form titles are compared in."""
    return F.coalesce(strip_ws(F.lower(c)), F.lit(""))


# --- URLs -----------------------------------------------------------------------------------
def strip_tracking(c: Column, repair_query: bool = False) -> Column:
    """Drop utm_*, fbclid and gclid parameters.

    Removing the first parameter leaves ``/p&id=1``, as the defined output does;
    ``repair_query`` turns that first ``&`` back into ``?``.
    """
    out = F.regexp_replace(F.regexp_replace(c, C.TRACKING_PARAMS, ""), r"[?&]+$", "")
    if repair_query:
        out = F.when(F.contains(out, F.lit("?")), out).otherwise(F.regexp_replace(out, r"^([^&]*)&", r"$1?"))
    return out


def absolute_url(url: Column, base: Column, repair_query: bool = False) -> Column:
    def resolve(u: Column) -> Column:
        joined = F.concat(F.regexp_replace(base, "/+$", ""), u)
        full = (
            F.when(u.startswith("http://") | u.startswith("https://"), u)
            .when(u.startswith("//"), F.concat(F.lit("https:"), u))
            .when((base != "") & u.startswith("/"), joined)
        )
        return let(full, lambda f: F.when(f.isNull(), u).otherwise(strip_tracking(f, repair_query)))

    return let(strip_ws(url), resolve)


def url_origin(c: Column) -> Column:
    """``scheme://authority`` or an empty string."""
    return F.coalesce(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1), F.lit(""))


def url_authority(c: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)), F.lit(""))


def url_path(c: Column) -> Column:
    """Lower-cased path without trailing slashes."""
    rest = F.regexp_replace(F.regexp_replace(c, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?", ""), r"(?s)[?#].*$", "")
    return F.coalesce(F.regexp_replace(F.lower(rest), "/+$", ""), F.lit(""))


def urls_in_text(c: Column) -> Column:
    """Distinct URLs of a text in order of appearance, without trailing punctuation."""
    found = F.regexp_extract_all(c, F.lit(f"(https?://[^{WS}" + C.URL_END + "]+)"), F.lit(1))
    trimmed = F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:/]+$", ""))
    return F.array_distinct(F.filter(trimmed, lambda u: u != ""))


def is_listing_url(c: Column) -> Column:
    return F.coalesce(c.rlike(C.LISTING_URL), F.lit(False))


def is_event_url(c: Column) -> Column:
    """http(s) scheme and a host."""
    return F.coalesce(c.rlike(r"^(?i:https?)://[^/?#]+"), F.lit(False))


# --- Keys -----------------------------------------------------------------------------------
def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def snapshot_key(source_id: Column, url_hash: Column, version: str = C.SNAPSHOT_VERSION) -> Column:
    return F.concat(F.lit("snapshots/"), source_id, F.lit(f"/{version}:"), url_hash, F.lit(".raw"))


def _fold_table() -> tuple[str, str]:
    """Accented Latin letters and their base letter, from the Unicode decomposition rule.

    Combining marks have no counterpart and are therefore deleted by ``translate``.
    """
    source, target = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFKD", chr(code))
        base = parts[0]
        if len(parts) > 1 and base.isascii() and all(unicodedata.combining(p) for p in parts[1:]):
            source.append(chr(code))
            target.append(base)
    marks = [chr(code) for code in range(0x0300, 0x0370)]
    return "".join(source + marks), "".join(target)


_FOLD_FROM, _FOLD_TO = _fold_table()
# Latin letters and punctuation whose ASCII form is not their base letter.
_FOLD_WORDS = (
    ("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"),
    ("ø", "o"), ("Ø", "O"), ("ł", "l"), ("Ł", "L"), ("ð", "d"),
    ("Ð", "D"), ("þ", "th"), ("Þ", "Th"), ("ı", "i"), ("‘", "'"), ("’", "'"),
)


def ascii_fold(c: Column) -> Column:
    out = F.translate(c, _FOLD_FROM, _FOLD_TO)
    for char, plain in _FOLD_WORDS:
        out = F.replace(out, F.lit(char), F.lit(plain))
    return out


def slugify(c: Column, max_chars: int = C.MAX_SLUG_CHARS) -> Column:
    """URL slug. Scripts other than Latin leave nothing; see ``slug_or_id``."""
    quoted = F.regexp_replace(c, "'+", "-")
    entities = F.replace(F.replace(quoted, F.lit("&amp;"), F.lit("&")), F.lit("&#39;"), F.lit("'"))
    plain = F.regexp_replace(F.lower(ascii_fold(entities)), "'+", "")
    numbers = F.regexp_replace(plain, r"(?<=[0-9]),(?=[0-9])", "")
    dashed = F.regexp_replace(numbers, "[^a-z0-9]+", "-")
    return F.regexp_replace(F.left(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit(max_chars)), "-+$", "")


def slug_or_id(title: Column, id_: Column) -> Column:
    """Slug of the title, or an id-based one where the title has no Latin letter or digit."""
    return F.coalesce(blank_to_null(slugify(title)), F.concat(F.lit("event-"), F.left(id_, F.lit(12))))


# --- Places ---------------------------------------------------------------------------------
def normalize_city(c: Column, region: C.Region = C.Region()) -> Column:
    elsewhere = blank_to_null(strip_ws(c))
    return F.when(F.contains(F.lower(c), F.lit(region.key)), F.lit(region.city)).otherwise(elsewhere)


def normalize_locality(c: Column) -> Column:
    return blank_to_null(strip_ws(c))


def plain_title(c: Column, max_chars: int = 120) -> Column:
    """Preview title: tags removed, stripped, cut; never empty."""
    cleaned = F.left(strip_ws(F.regexp_replace(c, "<[^>]+>", "")), F.lit(max_chars))
    return F.coalesce(blank_to_null(cleaned), F.lit("(untitled)"))
