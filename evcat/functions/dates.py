"""Date expressions. ``now`` is always passed in, so a run can be repeated."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from evcat import config as C
from evcat.functions import text as T
from evcat.functions.text import let, norm
from evcat.session import instant

# Written forms that are read as they stand.
_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?\s?(?:Z|[+-]\d{2}:\d{2})?$"
_OFFSET = r"(?:Z|[+-]\d{2}:\d{2})$"
_WRITTEN = (
    "d MMM yyyy", "d MMM yyyy h:mm a", "d MMM yyyy HH:mm",
    "d MMMM yyyy", "d MMMM yyyy h:mm a", "d MMMM yyyy HH:mm",
    "MMM d, yyyy", "MMM d, yyyy h:mm a", "MMM d, yyyy HH:mm",
    "MMMM d, yyyy", "MMMM d, yyyy h:mm a", "MMMM d, yyyy HH:mm",
    "yyyy/MM/dd", "yyyy/MM/dd HH:mm",
)


# Month names and day names as written, and words between the parts of a date.
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
_DAY_NAME = r"\b(mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\b"
_FILLERS = r"\b(?:at|on|of|and)\b"
_CLOCK = r"\b(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\.\d{1,6})? ?(am|pm)?\b ?(z\b|utc\b|gmt\b|[+-]\d{2}:?\d{2}\b)?"
# Capitals after a clock that are no other part of a date: a zone name without a known offset.
_ZONE_NAME = rf"^(.*?(?:\d:\d{{2}}|\d ?(?i:[ap]\.?m\b)).*?)\b(?!(?i:{_MONTH}\b|{_DAY_NAME}|(?:[ap]m|at|on|of|and|utc|gmt)\b))[A-Z]{{2,5}}\b(?! ?[+-]\d)"
_COMPACT = r"(?<!\d)(\d{4})(\d{2})(\d{2})"


def parse_datetime(c: Column, zone: str = C.DISPLAY_ZONE, now: datetime | None = None) -> Column:
    """Read a free-form date; no zone means ``zone``; unreadable means null. Result is UTC.

    ISO forms and common written forms come first. With ``now`` also looser ones are read: day names, hours without minutes, any
    order of clock and date, numeric dates (month first where both readings are possible), dates and clocks without separators, and
    partial dates, whose missing year, month or day is that of ``now`` (the last day of a shorter month). A day name without a day
    means the next such day from there. A zone name without a known offset is ignored.
    """
    tidy = F.regexp_replace(F.regexp_replace(F.trim(c), r"\s+", " "), r"(?i)\b(\d{1,2})(?:st|nd|rd|th)\b", "$1")

    def read(text: Column) -> Column:
        written = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in _WRITTEN])
        known = (
            F.when(~text.rlike(_ISO), F.to_utc_timestamp(written, zone))
            .when(text.rlike(_OFFSET), F.try_to_timestamp(text))
            .otherwise(F.to_utc_timestamp(F.try_to_timestamp(text), zone))
        )
        return known if now is None else F.coalesce(known, T.let(_loose_text(text), lambda t: _loose_date(t, zone, now)))

    return let(tidy, read)


def _loose_text(text: Column) -> Column:
    """Lower case, without unknown zone names, fillers and commas; every clock as h:mm, no date in one number."""
    out = F.lower(F.regexp_replace(text, _ZONE_NAME, "$1"))
    for pattern, by in (
        (_COMPACT + r"[t ]?(\d{2})(\d{2})(\d{2})(?:\.\d{1,6})?(?!\d)", "$1-$2-$3 $4:$5:$6 "), (_COMPACT + r"[t ]?(\d{2})(\d{2})(?!\d)", "$1-$2-$3 $4:$5 "),
        (_COMPACT + r"t(\d{2})(?![\d:])", "$1-$2-$3 $4:00 "), (_COMPACT + r"(?:t(?=\d)|(?!\d))", "$1-$2-$3 "),
        (r"\b([ap])\.m\.?", "$1m"), (r"\b(\d{1,2}) ?(am|pm)\b", "$1:00 $2"), (r":(\d{2}):00 (am|pm)", ":$1 $2"), (r"(\d{4}-\d{1,2}-\d{1,2})t(?=\d)", "$1 "),
        (_FILLERS, " "), (r"\bist\b", " "), (r",|(?<=[a-z])\.|[()]", " "), (r"\s+", " "),
    ):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def _number(text: Column, pattern: str, group: int) -> Column:
    """A matched group as a number; null without a match."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found.cast("int"))


def _loose_date(text: Column, zone: str, now: datetime) -> Column:
    """Date from lower-case text of one date in any of the forms, and at most one clock."""
    day_text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _CLOCK, " "), _DAY_NAME, " "), r"\s+", " "))
    day_name = F.regexp_extract(text, "^.*" + _DAY_NAME, 1)
    clock = F.regexp_extract(text, _CLOCK, 0)
    half, offset = F.regexp_extract(text, _CLOCK, 4), F.regexp_extract(text, _CLOCK, 5)
    raw_hour = _number(text, _CLOCK, 1)
    hour = F.when(half == "", raw_hour).when(raw_hour.between(1, 12), raw_hour % 12 + F.when(half == "pm", 12).otherwise(0))

    def month(t: Column, pattern: str, group: int) -> Column:
        place = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.left(F.regexp_extract(t, pattern, group), F.lit(3)))
        return F.when(place > 0, place.cast("int"))

    def full_year(t: Column, pattern: str, group: int) -> Column:
        """Four digits, or two within fifty years of now."""
        year = _number(t, pattern, group)
        century = now.year - now.year % 100
        near = year + century
        near = F.when(near >= now.year + 50, near - 100).when(near < now.year - 50, near + 100).otherwise(near)
        return F.when(F.length(F.regexp_extract(t, pattern, group)) > 2, year).otherwise(near)

    iso, day_first = r"^(\d{4})[-/. ](\d{1,2})[-/. ](\d{1,2})$", rf"^(\d{{1,2}})[- ]?{_MONTH}(?:[- ]?'?(\d{{4}}|\d{{2}}))?$"
    month_first, numeric = rf"^{_MONTH} ?(\d{{1,2}})(?: (\d{{4}}))?$", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})$"
    month_year, year_only, day_only = rf"^{_MONTH}(?:[- ](\d{{4}}))?$", r"^(\d{4})$", r"^(\d{1,2})$"
    two_numbers, last_day = r"^(\d{4}|\d{1,2})[-/](\d{4}|\d{1,2})$", 31

    def parts(t: Column) -> Column:
        a, b = _number(t, numeric, 1), _number(t, numeric, 2)
        american = a <= 12
        first, second = _number(t, two_numbers, 1), _number(t, two_numbers, 2)
        this = lambda n: F.lit(n).cast("int")
        part = lambda y, m, d, exact: F.struct(y.alias("y"), m.alias("m"), d.alias("d"), F.lit(exact).alias("exact"))
        return (
            F.when(t.rlike(iso), part(_number(t, iso, 1), _number(t, iso, 2), _number(t, iso, 3), True))
            .when(t.rlike(numeric), part(full_year(t, numeric, 3), F.when(american, a).otherwise(b), F.when(american, b).otherwise(a), True))
            .when(t.rlike(day_first), part(F.coalesce(full_year(t, day_first, 3), this(now.year)), month(t, day_first, 2), _number(t, day_first, 1), True))
            .when(t.rlike(month_first), part(F.coalesce(_number(t, month_first, 3), this(now.year)), month(t, month_first, 1), _number(t, month_first, 2), True))
            .when(t.rlike(month_year), part(F.coalesce(_number(t, month_year, 2), this(now.year)), month(t, month_year, 1), this(now.day), False))
            .when(t.rlike(year_only), part(_number(t, year_only, 1), this(now.month), this(now.day), False))
            .when(t.rlike(two_numbers) & (first > last_day), part(full_year(t, two_numbers, 1), second, this(now.day), False))
            .when(t.rlike(two_numbers) & (second > last_day), part(full_year(t, two_numbers, 2), first, this(now.day), False))
            .when(t.rlike(two_numbers), part(this(now.year), first, second, True))
            .when(t.rlike(day_only) & (_number(t, day_only, 1) > last_day), part(full_year(t, day_only, 1), this(now.month), this(now.day), False))
            .when(t.rlike(day_only), part(this(now.year), this(now.month), _number(t, day_only, 1), True))
            .when((t == "") & ((clock != "") | (day_name != "")), part(this(now.year), this(now.month), this(now.day), False))
        )

    def moment(p: Column) -> Column:
        last = F.day(F.last_day(F.try_make_timestamp(p["y"], p["m"], F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date")))
        day = F.when(p["exact"], p["d"]).otherwise(F.least(p["d"], last))
        second = F.coalesce(_number(text, _CLOCK, 3), F.lit(0))
        local = F.try_make_timestamp(
            p["y"], p["m"], day, F.when(clock == "", F.lit(0)).otherwise(hour), F.coalesce(_number(text, _CLOCK, 2), F.lit(0)), second
        )
        # From a date without a day on to the day named.
        weekday = F.array_position(F.array(*[F.lit(d) for d in _DAYS]), F.left(day_name, F.lit(3))).cast("int") - 1
        ahead = F.when(~p["exact"] & (day_name != ""), F.pmod(weekday - F.weekday(local), F.lit(7))).otherwise(0)
        local = local + F.make_interval(days=ahead.cast("int"))
        minutes = F.when(
            offset.rlike(r"^[+-]"),
            F.concat(F.left(offset, F.lit(1)), F.lit("1")).cast("int") * (F.substring(offset, 2, 2).cast("int") * 60 + F.right(offset, F.lit(2)).cast("int")),
        ).otherwise(0)
        return F.when(offset == "", F.to_utc_timestamp(local, zone)).otherwise(local - F.make_interval(mins=minutes))

    more_clocks = F.size(F.regexp_extract_all(text, F.lit(_CLOCK), 0)) > 1
    return F.when(~more_clocks, T.let(T.let(day_text, parts), moment))


def half_day_label(c: Column) -> Column:
    """``yyyy-MM-dd-00`` or ``-12``; empty when there is no date."""
    half = F.when(F.hour(c) >= 12, F.lit("-12")).otherwise(F.lit("-00"))
    return F.coalesce(F.concat(F.date_format(c, "yyyy-MM-dd"), half), F.lit(""))


def dedupe_key(title: Column, start_at: Column, organizer: Column) -> Column:
    """Exact-match key: hash of title, half day and organizer."""
    return F.sha2(F.concat_ws("|", norm(title), half_day_label(start_at), norm(organizer)), 256)


def tba_start(now: datetime) -> Column:
    """Stand-in start for events without a date; 29 February falls back to the 28th."""
    return instant(now) + F.expr("INTERVAL 1 YEAR")


def expiry(date_tba: Column, end_at: Column, now: datetime) -> Column:
    return F.when(date_tba, instant(now) + F.expr("INTERVAL 30 DAYS")).when(
        end_at.isNotNull(), end_at + F.expr("INTERVAL 48 HOURS")
    )


def month_window(day: Column, months: int = 4) -> Column:
    """Array of 'Month YYYY' labels for the month of ``day`` and the following ones."""
    first = F.trunc(day.cast("date"), "MM")
    steps = F.sequence(first, F.add_months(first, F.lit(months - 1)), F.expr("INTERVAL 1 MONTH"))
    return F.transform(steps, lambda m: F.date_format(m, "MMMM yyyy"))


def month_expression(day: Column, months: int = 4) -> Column:
    return F.array_join(F.transform(month_window(day, months), lambda m: F.concat(F.lit('"'), m, F.lit('"'))), " OR ")


def display_time(c: Column, zone: str = C.DISPLAY_ZONE) -> Column:
    return F.from_utc_timestamp(c.cast("timestamp"), zone)


def display_date_label(c: Column, zone: str = C.DISPLAY_ZONE) -> Column:
    """e.g. ``1 Jun 2026, 11:00 am``"""
    local = display_time(c, zone)
    return F.concat(F.date_format(local, "d MMM yyyy, h:mm "), F.lower(F.date_format(local, "a")))


def display_clock(c: Column, zone: str = C.DISPLAY_ZONE) -> Column:
    """e.g. ``11:00 am``"""
    local = display_time(c, zone)
    return F.concat(F.date_format(local, "hh:mm "), F.lower(F.date_format(local, "a")))


def display_day_label(c: Column, zone: str = C.DISPLAY_ZONE) -> Column:
    """e.g. ``Mon, Jun 01, 2026``"""
    return F.date_format(display_time(c, zone), "EEE, MMM dd, yyyy")


def form_input(c: Column, zone: str = C.DISPLAY_ZONE) -> Column:
    """Value for a date-time form field, in display time."""
    return F.coalesce(F.date_format(display_time(c, zone), "yyyy-MM-dd'T'HH:mm"), F.lit(""))


def compact_utc(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")


def iso_utc(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
