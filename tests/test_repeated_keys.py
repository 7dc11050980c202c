"""Repeated keys, ties, far numbers and ordered sums."""
import random
from datetime import datetime

from pyspark.sql import functions as F

from evcat import schemas
from evcat.functions import html as H
from evcat.operators import dedup, discovery, lifecycle, ordered, slugs, tables
from evcat.plans import ingest as ing
from evcat.sources import pages as pg

NOW = datetime(2026, 5, 1)


def test_a_patch_given_twice_counts_once_and_the_last_one_wins(spark):
    rows = spark.createDataFrame([("a", "old", 1), ("b", "old", 2)], "id string, title string, n int")
    patches = spark.createDataFrame([("a", "one", 2), ("a", "two", 1), ("a", None, 3)], "id string, title string, seq int")
    for shuffled in (patches, patches.orderBy("seq"), patches.orderBy(F.desc("seq"))):
        got = sorted(tuple(r) for r in tables.patch(rows, shuffled.filter("title IS NOT NULL"), ["title"], order=("seq",)).collect())
        assert got == [("a", "one", 1), ("b", "old", 2)]
    assert tables.patch(rows, patches.drop("seq"), ["title"]).count() == 2


def test_two_status_changes_of_one_source(spark):
    sources = spark.createDataFrame([("s", "active", 0.7, True)], "id string, status string, trust_score double, enabled boolean")
    changes = spark.createDataFrame([("s", "whitelisted", 1), ("s", "blacklisted", 2), ("s", "unheard of", 3)], "id string, status string, seq int")
    assert [tuple(r) for r in lifecycle.set_source_status(sources, changes, ("seq",)).collect()] == [("s", "blacklisted", 0.0, False)]


def test_two_answers_and_two_verdicts_for_one_url(spark):
    submitted = spark.createDataFrame([("https://x.org/a",), ("https://x.org/b",)], "event_url string")
    answers = spark.createDataFrame([("https://x.org/a", 200, "fine"), ("https://x.org/a", 200, "fine"), ("https://x.org/b", 404, "")], "event_url string, status_code int, page_text string")
    verdicts = spark.createDataFrame([("https://x.org/a", True, 0.9), ("https://x.org/a", False, 0.2)], "event_url string, is_tech_event boolean, confidence double")
    got = sorted(tuple(r) for r in discovery.gate(submitted, answers, verdicts).collect())
    assert got == [("https://x.org/a", True, "tech_event"), ("https://x.org/b", False, "http_404")]


def test_last_occurrence_of_an_external_id_wins_whatever_the_row_order(spark):
    at = datetime(2026, 5, 1)
    rows = [("r1", "e", "first", at, 0, "k1"), ("r1", "e", "second", at, 1, "k0"), ("r2", None, "other", at, 0, "k2")]
    schema = "id string, external_id string, raw_payload_json string, fetched_at timestamp, place int, row_key string"
    rest = {"source_id": "s", "extraction_method": "hybrid", "confidence": 0.5, "route": "published", **{f: None for f in (*ing._TEXT_FIELDS, "canonical_url")}}
    for order in (rows, rows[::-1]):
        routed = spark.createDataFrame(order, schema).withColumns({c: F.lit(v).cast("double" if c == "confidence" else "string") for c, v in rest.items()})
        routed = routed.withColumn("topics", F.array().cast("array<string>"))
        out = ing.raw_event_rows(routed, NOW)
        assert out.columns == [f.split()[0] for f in schemas.RAW_EVENTS.split(", ")]
        assert sorted(tuple(r) for r in out.select("id", "raw_payload_json").collect()) == [("r1", "second"), ("r2", "other")]


def test_running_sums_and_last_given_values(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), i, rng.choice([1, 5, 9]), rng.choice([None, None, f"g{i}"])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, v int, g string").repartition(5)
    total, last, want_sum, want_last = {}, {}, {}, {}
    for k, i, v, g in rows:
        total[k] = want_sum[i] = total.get(k, 0) + v
        last[k] = want_last[i] = g if g is not None else last.get(k)
    assert {r["i"]: r["s"] for r in ordered.add_running_sum(df, ["k"], ["i"], "v", "s").collect()} == want_sum
    assert {r["i"]: r["l"] for r in ordered.add_last_given(df, ["k"], ["i"], "g", "l").collect()} == want_last


def test_slugs_fill_gaps_between_far_numbers(spark):
    new = spark.createDataFrame([(i, "event" if i % 2 else "talk") for i in range(40)], "seq int, base_slug string")
    taken = ["event", "event-3", "event-20260515", "event-9999999999", "event-" + "9" * 30, "talk-2", "talk-x", "other-1"]
    existing = spark.createDataFrame([(t,) for t in taken], "slug string")
    used, want = set(taken), {}
    for i in range(40):
        base = "event" if i % 2 else "talk"
        n = 0
        while (slug := base if n == 0 else f"{base}-{n}") in used:
            n += 1
        used.add(slug)
        want[i] = slug
    assert {r["seq"]: r["slug"] for r in slugs.assign_slugs(new, existing).collect()} == want


def test_explicit_null_is_not_free(spark):
    body = '{"results":[{"_id":"1","is_free":null},{"_id":"2"},{"_id":"3","is_free":true},{"_id":"4","is_free":false}]}'
    pages = spark.createDataFrame([("s", "u", body, NOW)], "source_id string, url string, html_or_json string, fetched_at timestamp")
    raw = pg.static_adapter(pages)
    from evcat.functions import rules as R

    got = {r["external_id"]: r["free"] for r in raw.select("external_id", R.parse_payload(F.col("payload"))["is_free"].alias("free")).collect()}
    assert got == {"1": False, "2": True, "3": True, "4": False}


def test_extraction_text_is_spaced_json(spark):
    import json

    rows = [("https://x.org/ä", 'a "b" \\ c\n', None), ("https://x.org/", None, None), ("u", "m", "p")]
    df = spark.createDataFrame(rows, "url string, meta string, poster string")
    got = [r[0] for r in df.select(H.extraction_text(F.col("url"), F.col("meta"), F.col("poster"), F.lit(None).cast("string"), F.lit("text"))).collect()]
    for (url, meta, poster), text in zip(rows, got):
        given = {k: v for k, v in (("meta_description", meta), ("poster_url", poster)) if v}
        head = json.dumps({"page_url": url, "metadata": given}, ensure_ascii=False) + "\n\n" if given else ""
        assert text == head + "text"


def test_url_comes_before_a_catalogue_title(spark):
    """A row whose URL was published earlier in the batch belongs to that event, although its title lies in a catalogue title."""
    start = datetime(2026, 6, 1, 10)
    events = spark.createDataFrame([("c", "Rust night of the year", start, "https://x.org/c", NOW)], "id string, title string, start_at timestamp, canonical_url string, created_at timestamp")
    rows = [("r1", "r1", "Go evening", start, "https://x.org/a", 1), ("r2", "r2", "Rust night", start, "https://x.org/a", 2), ("r3", "r3", "Rust night", start, "https://x.org/z", 3)]
    scored = spark.createDataFrame(rows, "row_key string, id string, title string, start_at timestamp, canonical_url string, seq int").withColumns(
        {"route": F.lit(None).cast("string"), "reason": F.lit(None).cast("string"), "publishable": F.lit(True), "fetched_at": F.timestamp_seconds("seq")}
    ).drop("seq")
    routed = {r["row_key"]: r for r in ing.route(scored, events).collect()}
    assert routed["r1"]["route"] == "published" and routed["r1"]["match"] is None
    assert routed["r2"]["match"] == routed["r1"]["event_id"]
    assert routed["r3"]["match"] == "c"
    assert dedup.match_catalogue(spark.createDataFrame([("rust night", 0, "https://x.org/c")], "title string, us bigint, url string"), events).first()["by_url"]
