from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evcat import config as C
from evcat.functions import dates as D
from evcat.functions import html as H
from evcat.functions import rules as R
from evcat.functions import stem
from evcat.functions import text as T


def values(spark, rows, build):
    """Apply ``build(col)`` to each string and return the results in order."""
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r.out for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def test_text(spark):
    assert values(spark, ["  a b ", "x", None], T.strip_ws) == ["a b", "x", None]
    assert values(spark, ["<b>a</b>   b\nc "], T.clean_text) == ["a b\nc"]
    assert values(spark, [" AbC ", None], T.norm) == ["abc", ""]
    assert values(spark, ["Old LUCKNOW city", " Delhi ", " ", None], T.normalize_city) == ["Lucknow", "Delhi", None, None]
    assert values(spark, [" Gomti Nagar ", ""], T.normalize_locality) == ["Gomti Nagar", None]
    assert values(spark, ["<i>x</i>", " ", "<b></b>"], T.plain_title) == ["x", "(untitled)", "(untitled)"]


def test_urls(spark):
    assert values(
        spark,
        ["http://x/p?id=1&utm_source=a#f", "http://x/p?utm_source=a&id=1", "http://x/?FBCLID=2", "http://x/a?b=1&gclid=3&c=2"],
        T.strip_tracking,
    ) == ["http://x/p?id=1", "http://x/p&id=1", "http://x/", "http://x/a?b=1&c=2"]
    assert values(spark, ["http://x/p?utm_source=a&id=1", "http://x/p?a=1"], lambda c: T.strip_tracking(c, True)) == [
        "http://x/p?id=1", "http://x/p?a=1",
    ]
    assert values(spark, ["//cdn/x", "/x", "x", " https://a/b ", "", None], lambda c: T.absolute_url(c, F.lit("http://b/"))) == [
        "https://cdn/x", "http://b/x", "x", "https://a/b", "", None,
    ]
    assert values(spark, ["https://a.b:8/c", "mailto:x"], T.url_origin) == ["https://a.b:8", ""]
    assert values(spark, ["https://lu.ma/", "https://x.io/events/", "https://lu.ma/abc", "HTTP://WWW.Meetup.com"], T.is_listing_url) == [
        True, True, False, True,
    ]
    assert values(spark, ["https://a/b", "ftp://a", "http://", None], T.is_event_url) == [True, False, False, False]
    assert values(spark, ["see https://a/b, (https://a/b) http://c/d/."], T.urls_in_text) == [["https://a/b", "http://c/d"]]


def test_slugs_and_keys(spark):
    assert values(
        spark,
        ["Lucknow Cloud Day – Demo Meetup", "Café & Crème: 1,000 straßen!", "It's", "a" * 300],
        T.slugify,
    ) == ["lucknow-cloud-day-demo-meetup", "cafe-creme-1000-strassen", "it-s", "a" * 280]
    assert values(spark, ["日本"], lambda c: T.slug_or_id(c, F.lit("0123456789abcdef"))) == ["event-0123456789ab"]
    assert values(spark, ["abc"], T.content_hash) == ["ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"]
    assert values(spark, ["h"], lambda c: T.snapshot_key(F.lit("s"), c)) == [f"snapshots/s/{C.SNAPSHOT_VERSION}:h.raw"]


def test_parse_datetime(spark):
    rows = [
        "2026-05-15 10:00", "2026-05-15T10:00:00+05:30", "nope", "15th May 2026", "May 15, 2026 10:00 am",
        "2026-06-01T11:00:00Z", "", None,
    ]
    t = datetime
    want = [t(2026, 5, 15, 4, 30), t(2026, 5, 15, 4, 30), None, t(2026, 5, 14, 18, 30), t(2026, 5, 15, 4, 30), t(2026, 6, 1, 11), None, None]
    assert values(spark, rows, lambda c: D.parse_datetime(c).cast("timestamp_ntz")) == want


FORMS = [
    "15/05/2026", "05/06/2026", "5/6/26", "06-07-2026", "6.7.2026", "13.07.2026", "Tue 5pm May 5 2026", "Sat 6 June 2026 6pm", "Saturday, 6 June 2026 at 6:30 PM",
    "June 6", "6 June", "Jun 6, 2026, 10 am", "6 Jun 2026, 6 p.m.", "June 2026", "June", "2026", "18:30", "6pm", "2026-6-7", "2026.06.07 18:00", "7-Jun-2026", "7Jun2026",
    "Wed, Jun 10, 2026 7:15 PM", "2026-06-06 18:00:30 +0200", "June 6th, 2026 at 7pm IST", "Thursday 11 June 2026", "2026/06/07 6:00 pm", "Sept 3 2026 12am", "Dec 31 12:05 pm",
    "30 Feb 2026", "32 June 2026", "June 6 2026 25:00", "nope", "", "call 5 times", "6 June 2026 - 8 June 2026", "10:00 - 12:00", "31/31/2026",
]


def test_loose_dates_agree_with_a_reader_of_its_own(spark):
    from datetime import timedelta

    from dateutil import parser, tz

    now = datetime(2026, 1, 31)
    got = values(spark, FORMS, lambda c: D.parse_datetime(c, now=now).cast("timestamp_ntz"))
    for form, found in zip(FORMS, got):
        try:
            read = parser.parse(form.replace(" IST", ""), default=now) if form else None
        except (ValueError, OverflowError):
            read = None
        if read is not None:
            read = (read.astimezone(tz.UTC) if read.tzinfo else read - timedelta(hours=5, minutes=30)).replace(tzinfo=None)
        assert found == read, form


PARTIAL_FORMS = [
    "Friday", "Friday 6pm", "fri 18:00", "6pm friday", "Saturday", "Sat, 6pm", "Mon", "wednesday", "Friday, 6:30 PM EST", "Friday at 6pm IST", "Friday May", "Friday 2026", "Friday 15 May", "Fri 15", "15",
    "Friday and Saturday 6pm", "20260515", "20260515T183000", "20260515T1830", "20260515T18", "20260515 18:30", "20260515T18:30", "20260515T183000Z", "20260515T183000+0530", "202605151830", "20260515183000", "20261315",
    "20260230", "20260515 6pm", "2026-05", "2026-5", "2026/05", "05/2026", "12-2026", "2026-05 6pm", "2026-13", "13/2026", "5/15", "5-15", "1/2", "5/15 6pm", "15/5", "2/31", "5/0", "31/31", "5/32", "99-05", "99",
    "May 15 2026 6pm EST", "6pm EST May 15 2026", "MAY 15 2026 6PM EST", "18:00 15 MAY 2026 EST", "6pm FRI", "6PM MAY 15 2026", "May 15 2026 18:00 PST", "2026-05-15 18:00 CEST", "2026-05-15T18:00 EST", "18:30 EST", "10am GMT",
    "May 15 2026 6 p.m. ET", "Friday EST", "May 15 2026 EST", "May 15 2026 6pm est", "EST 15 May 2026", "15 May 2026 18:00 hello", "May 15 2026 6pm EST PST", "2026-06-06 18:00:30 -0300 (BRST)",
]


def test_partial_and_compact_dates_agree_with_a_reader_of_its_own(spark):
    from datetime import timedelta

    from dateutil import parser, tz

    for now in (datetime(2026, 1, 31), datetime(2024, 2, 29)):
        got = values(spark, PARTIAL_FORMS, lambda c: D.parse_datetime(c, now=now).cast("timestamp_ntz"))
        for form, found in zip(PARTIAL_FORMS, got):
            try:
                # Names of zones are no offsets here, whatever the zone of the machine.
                read = parser.parse(form.replace(" IST", ""), default=now, tzinfos=lambda name, offset: tz.tzoffset(None, offset) if offset is not None else None)
            except (ValueError, OverflowError):
                read = None
            if read is not None:
                read = (read.astimezone(tz.UTC) if read.tzinfo else read - timedelta(hours=5, minutes=30)).replace(tzinfo=None)
            assert found == read, form



def test_date_forms(spark):
    def at(build):
        return values(spark, ["2026-05-15 13:10:00", None], lambda c: build(c.cast("timestamp_ntz")))

    assert at(D.half_day_label) == ["2026-05-15-12", ""]
    assert at(D.compact_utc)[0] == "20260515T131000Z"
    assert at(D.display_date_label)[0] == "15 May 2026, 6:40 pm"
    assert at(D.display_clock)[0] == "06:40 pm"
    assert at(D.form_input) == ["2026-05-15T18:40", ""]
    assert at(lambda c: D.month_expression(c))[0] == '"May 2026" OR "June 2026" OR "July 2026" OR "August 2026"'
    now = datetime(2024, 2, 29)
    assert at(lambda c: D.tba_start(now))[0] == datetime(2025, 2, 28)
    assert at(lambda c: D.expiry(c.isNull(), c, now).cast("timestamp_ntz")) == [datetime(2026, 5, 17, 13, 10), datetime(2024, 3, 30)]


PAGE = """<head><meta property="og:image" content="/a/logo.svg"><meta name="twitter:image" content="//cdn/x/banner-1200.jpg?utm_source=q">
<META NAME='description' CONTENT=' Hello there '><meta property="og:description" content="other">
<script type="application/ld+json"> {"@graph": [{"@type": ["Thing", "Event"], "image": [{"url": "https://v/clip.mp4"}, ["img.png"]]}]} </script>
<script type='application/ld+json'>{broken</script></head>"""


def test_page_metadata(spark):
    url = F.lit("https://site.org/page")
    assert values(spark, [PAGE, "x"], H.meta_description) == ["Hello there", None]
    assert values(spark, [PAGE], H.meta_images) == [["/a/logo.svg", "//cdn/x/banner-1200.jpg?utm_source=q"]]
    assert values(spark, [PAGE], H.first_meta_image) == ["/a/logo.svg"]
    assert values(spark, [PAGE, "x"], H.json_ld_images) == [["https://v/clip.mp4", "img.png"], []]
    assert values(spark, [PAGE, "x"], lambda c: H.best_image(c, url)) == ["https://cdn/x/banner-1200.jpg", None]
    blocks = values(spark, [PAGE], H.json_ld_blocks)[0]
    assert len(blocks) == 2 and blocks[1] == "{broken"
    assert values(spark, ["https://a/banner-1200.jpg", "http://a/logo.svg"], H.image_score) == [17, -4]
    assert values(spark, ["data:x", "a.MP4", "", "a.png"], H.looks_like_image) == [False, False, False, True]


def test_json_ld_event(spark):
    rows = [
        '{"a": {"@type": "Event"}}', '[{"@type": ["X", "Event"]}]', '{"@type": "EventSeries"}', '{broken "@type": "Event"',
        '{"text": "\\"@type\\": \\"Event\\""}', "{}\n\n" * 6 + '{"@type": "Event"}', None,
    ]
    assert values(spark, rows, H.json_ld_has_event) == [True, True, False, False, False, False, False]


def test_page_kind(spark):
    long = F.lit("x" * 300)
    none = F.lit(None).cast("string")
    rows = {
        "https://lu.ma/abc": "detail",
        "https://lu.ma/": "detail",
        "https://www.meetup.com/find/": "listing",
        "https://www.meetup.com/g/events/1": "detail",
        "https://unstop.com/hackathons/x": "listing",
        "https://unstop.com/hackathons/x/y": "detail",
        "https://gdg.community.dev/events/details/a/": "detail",
        "https://gdg.community.dev/gdg-lucknow/": "listing",
        "https://community.cncf.io/x": "listing",
        "https://www.commudle.com/communities/a/events/b": "detail",
        "https://www.commudle.com/communities/a": "listing",
        "https://fossunited.org/c/lucknow": "listing",
        "https://fossunited.org/c/lucknow/2026": "detail",
        "https://other.org/x": "detail",
    }
    assert values(spark, list(rows), lambda c: H.page_kind(c, none, long)) == list(rows.values())
    assert values(spark, ["https://other.org/x"], lambda c: H.page_kind(c, none, F.lit("ten chars."))) == ["noise"]
    assert values(spark, ["https://www.meetup.com/find/"], lambda c: H.page_kind(c, F.lit('{"@type":"Event"}'), long)) == ["detail"]


def test_titles(spark):
    rows = ["abc", '{"a":1}', "function x", "Page text:", "Abcd", " -webkit-box", "y" * 601, None]
    assert values(spark, rows, H.valid_title) == [False, False, False, False, True, False, False, False]


def test_garbage(spark):
    words = "lorem ipsum dolor "
    rows = ["x" * 100, "Access denied " + words * 20, words * 15, words * 15 + " workshop", words * 40, "var const function( window.__ 1" + "1 " * 300]
    assert values(spark, rows, R.garbage_reason) == ["too_short", "error_page", "no_event_signal", None, None, "js_soup"]
    assert values(spark, ["1 " * 1200 + "window.__", "am " * 900 + "window.__"], R.needs_external_lookup) == [True, False]


def test_heuristic_extraction(spark):
    page = F.lit("https://p/x")
    rows = [
        "hi\nEvent: Big Day \nmore https://a/b, https://c/Register?x).",
        "tiny\n  First long line  \nin Lucknow, http://only/one.",
        "ab",
    ]
    got = values(spark, rows, lambda c: R.heuristic_extraction(c, page))
    assert [(g.title, g.registration_url, g.city, g.confidence, g.not_an_event) for g in got] == [
        ("Big Day", "https://c/Register?x", None, 0.35, False),
        ("First long line", "http://only/one", "Lucknow", 0.35, False),
        (None, "https://p/x", None, 0.0, True),
    ]


def test_classification(spark):
    rows = ["Python & open-source AI hackathon for students", "Node.js conf in Lucknow", "éai festival", "Generative summit"]
    none = F.lit(None).cast("string")
    got = values(spark, rows, lambda c: R.classification(c, none, none, F.lit("GDG Lucknow")))
    assert [(g.event_type, g.topics, g.audience, g.local_relevance) for g in got] == [
        ("hackathon", ["Python", "AI/ML", "Open Source"], ["developers", "students"], 0.85),
        ("conference", ["Web Development"], ["developers"], 0.95),
        ("fest", [], ["developers"], 0.85),
        ("conference", ["AI/ML"], ["developers"], 0.85),
    ]


def test_relevance(spark):
    rows = [
        ("offline", None, "Gomti Nagar", None, 0.95), ("online", None, None, "GDG Lucknow", 0.90), ("online", None, None, None, 0.50),
        ("hybrid", None, None, "x lucknow", 0.85), ("meetup", None, None, None, 0.3), ("offline", "Delhi", None, None, 0.1),
        (None, "Lucknow", None, None, 1.0), ("OFFLINE", "variety hall", None, None, 0.90),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, mode string, city string, venue string, org string, want double")
    none = F.lit(None).cast("string")
    args = [F.col("mode"), F.col("city"), none, F.col("venue"), F.col("org"), none]
    strict = R.relevance(*args, C.Region(word_boundary=True))
    got = df.select("i", "want", R.relevance(*args).alias("got"), strict.alias("strict")).orderBy("i").collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert got[-1].strict == 0.1


def test_scores(spark):
    assert values(spark, ["0.85", "0.70", "0.69", "0.0", None], lambda c: R.publish_threshold(c.cast("double"))) == [0.60, 0.68, 0.75, 0.68, 0.68]
    one = F.lit(1.0)
    assert values(spark, ["0.99"], lambda c: F.round(R.publish_score(c.cast("double"), F.lit(0.8), one, one, one), 6)) == [0.9575]
    none = F.lit(None).cast("string")
    some = F.lit("x")
    assert values(spark, ["t"], lambda c: R.completeness(c, some, some, none, none, none, none)) == [1.0]
    assert values(spark, [""], lambda c: F.round(R.completeness(c, some, some, none, some, some, some), 6)) == [round(2 / 3 + 0.3, 6)]
    assert values(spark, ["t"], lambda c: R.parse_confidence(c, none, some, none, some)) == [0.5]


def test_submission_rules(spark):
    status = [(404, "x"), (200, "<TITLE>404 oops"), (200, "fine"), (0, "")]
    df = spark.createDataFrame(status, "s int, t string")
    assert [r[0] for r in df.select(R.dead_page(F.col("s"), F.col("t"))).collect()] == ["http_404", "not_found_or_expired", None, None]
    pairs = spark.createDataFrame([(0.1, 0.8), (0.8, 0.9), (0.1, 0.1), (0.3, 0.5)], "spam double, tech double")
    assert [r[0] for r in pairs.select(R.triage(F.col("spam"), F.col("tech"))).collect()] == ["approve", "reject", "reject", "human_review"]


@pytest.mark.parametrize(
    "word,want",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("agreed", "agre"), ("hopping", "hop"),
        ("hoping", "hope"), ("happy", "happi"), ("by", "by"), ("relational", "relat"), ("generously", "generous"),
        ("electricity", "electr"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("skies", "sky"), ("knightly", "knight"),
        ("consolation", "consol"), ("meetups", "meetup"), ("conferences", "confer"), ("controlling", "control"),
    ],
)
def test_stem(word, want):
    assert stem.stem(word) == want


def test_search_terms(spark):
    assert values(spark, ["The Meetups: running, RUN and runs!"], stem.terms) == [["meetup", "run"]]
    assert stem.query_terms("the Meetup of runners") == ["meetup", "runner"]
    assert values(spark, ["Foo_bar foo"], lambda c: stem.terms(c, stemmed=False)) == [["foo", "bar"]]


def test_words_are_stemmed_once_per_task_and_lists_keep_their_nulls(monkeypatch):
    import pyarrow as pa

    from evcat.functions import stem

    asked, rule = [], stem.stem
    monkeypatch.setattr(stem, "stem", lambda w: asked.append(w) or rule(w))
    lists = [pa.array([["running", "news"], None, []]), pa.array([["x"], ["skies", "running"]]).slice(1), pa.array([], pa.list_(pa.string()))]
    got = [out.to_pylist() for out in stem._stem_words.func(iter(lists))]
    assert got == [[["run", "news"], None, []], [["sky", "run"]], []]
    assert sorted(asked) == ["news", "running", "skies"]
