import re
from datetime import datetime, timedelta
from hashlib import sha256

from pyspark.sql import functions as F

from evcat import config as C
from evcat import schemas
from evcat.plans import queries as Q
from evcat.streaming import changes, streams

DAY = datetime(2026, 1, 1)
PAGE = "source_id string, url string, html_or_json string, fetched_at timestamp"
SNAP = "source_id string, url_hash string, schema_version string, page_hash string, stored_at timestamp"


def digest(text):
    return sha256(text.encode()).hexdigest()


def test_unchanged_pages_are_skipped_across_runs(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    stored = spark.createDataFrame(
        [("s", digest("a"), C.SNAPSHOT_VERSION, digest("old"), DAY - timedelta(9)), ("s", digest("a"), C.SNAPSHOT_VERSION, digest("x"), DAY), ("s", digest("b"), "v0", digest("x"), DAY)],
        SNAP,
    )
    sources = spark.createDataFrame([("s", "{}"), ("t", '{"always_refresh":true}'), ("t", "{}")], "id string, config_json string")

    def arrive(rows):
        spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(folder)
        arriving = spark.readStream.schema(PAGE).parquet(folder)
        changes.unchanged_skipped(arriving, stored, sources, out, str(tmp_path / "cp")).awaitTermination()
        rows = spark.read.schema(changes.PRINT).parquet(out).collect()
        return sorted((str(r.source_id), str(r.url), r.fetched_at.day if r.fetched_at else 0) for r in rows)

    d = [DAY + timedelta(n) for n in range(5)]
    first = [("s", "a", "x", d[1]), ("s", "b", "x", d[1]), ("s", "b", "y", d[3]), ("s", "b", "x", d[2]), ("s", "b", "x", d[2]), ("t", "a", "x", d[1]), (None, None, None, None)]
    # a equals its snapshot, b has none of this version and changes once, an always refreshed source passes, so does a null page once.
    want = [("None", "None", 0), ("s", "b", 2), ("s", "b", 4), ("t", "a", 2)]
    assert arrive(first) == want
    assert arrive([("s", "a", "x", d[4]), ("s", "b", "y", d[4]), ("t", "a", "x", d[4]), (None, None, None, None)]) == sorted(want + [("t", "a", 5)])
    assert arrive([("s", "a", "z", d[4])]) == sorted(want + [("t", "a", 5), ("s", "a", 5)])


def test_unchanged_pages_of_an_empty_stream(spark, tmp_path):
    spark.createDataFrame([], PAGE).write.parquet(str(tmp_path / "in"))
    none = spark.createDataFrame([], "id string, config_json string")
    arriving = spark.readStream.schema(PAGE).parquet(str(tmp_path / "in"))
    changes.unchanged_skipped(arriving, spark.createDataFrame([], SNAP), none, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.schema(changes.PRINT).parquet(str(tmp_path / "out")).count() == 0


def small_store(spark, tmp_path):
    return streams.Store(spark, str(tmp_path / "store"), {"events": "id STRING, title STRING"}, fan=2, buckets=8)


def test_store_merges_runs_and_forgets_deleted_rows(spark, tmp_path):
    store = small_store(spark, tmp_path)
    model = {}
    assert store.current("events").count() == 0

    def add(batch, rows, gone=()):
        frame = spark.createDataFrame(rows, "id string, title string")
        store.add("events", frame, batch, gone=spark.createDataFrame([(g,) for g in gone], "id string") if gone else None)

    for batch in range(7):
        rows = [(str(k), f"{batch}") for k in range(batch, 40, batch + 1)]
        gone = [str(k) for k in range(41) if k % 11 == batch]
        rows = [r for r in rows if r[0] not in gone]
        add(batch, rows, gone)
        add(batch, rows, gone)  # a repeated batch replaces itself
        model.update(rows)
        for g in gone:
            model.pop(g, None)
        got = {r.id: r.title for r in store.current("events").collect()}
        assert got == model
    assert store.runs("events", 0, 7) == [(0, 3), (4, 5), (6, 6)]
    assert store.runs("events", 0, 4) == [(0, 3)] and store.runs("events", 0, 3) == [(0, 1), (2, 2)]
    assert store._rows("events", [(0, 3)]).filter("deleted").count() == 0
    add(9, [("7", "left out")])  # numbers may be left out
    assert store.current("events").filter("id = '7'").first().title == "left out"
    assert store.current("events", before=9).filter("id = '7'").count() == int("7" in model)


def test_store_reads_the_buckets_of_the_keys_only(spark, tmp_path):
    store = small_store(spark, tmp_path)
    store.add("events", spark.range(400).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("title")), 0)
    whole = len(store._rows("events", store.runs("events", 0, 9)).inputFiles())
    one = store.current("events", keys=spark.createDataFrame([("17",)], "id string"))
    assert [r.id for r in one.collect()] == ["17"]
    scan = one._jdf.queryExecution().executedPlan().toString()
    assert whole == 8 and re.search(r"PartitionFilters: \[[^\]]*bucket", scan)
    assert store.current("events", keys=spark.createDataFrame([], "id string")).count() == 0


def test_late_and_null_times_are_counted(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "c")
    schema = "name string, at timestamp"
    for row in [("a", DAY), ("a", DAY - timedelta(60)), ("a", DAY - timedelta(3)), (None, None), ("a", DAY - timedelta(60))]:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(folder)
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    streams.daily_counts(arriving, "at", F.col("name"), out, str(tmp_path / "cp"), late="5 days").awaitTermination()
    late = {(r.day, r["count"]) for r in streams.late_counts(spark, out).groupBy("day").agg(F.sum("count").alias("count")).collect()}
    assert late == {(DAY - timedelta(60), 2)}
    got = {(r.name, r.day, r["count"]) for r in streams.read_daily_counts(spark, out).collect()}
    assert got == {("a", DAY, 1), ("a", DAY - timedelta(3), 1), ("a", DAY - timedelta(60), 2), (None, None, 1)}


def test_arrival_in_slices_keeps_nulls_and_empty_tables(spark, tmp_path):
    rows = [(n, DAY + timedelta(hours=n) if n else None) for n in range(10)]
    spark.createDataFrame(rows, "k long, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([], "k long, ts timestamp").write.parquet(str(tmp_path / "none.parquet"))
    seen = {}
    for name in ("events", "none"):
        stream = Q._stream(spark, str(tmp_path), name, "ts")
        got = seen.setdefault(name, [])
        streams._start(stream, str(tmp_path / f"cp-{name}"), "append", lambda df, n, got=got: got.extend(r.k for r in df.collect())).awaitTermination()
    assert sorted(seen["events"]) == list(range(10)) and seen["none"] == []


def test_tables_of_the_catalogue_have_keys_and_buckets(spark, tmp_path):
    store = streams.Store(spark, str(tmp_path / "s"))
    for name in streams.TABLES:
        assert store.current(name).count() == 0
    assert set(store.KEYS) == set(streams.TABLES) and schemas.EVENTS


def test_keys_of_a_run_are_distinct_and_unused_columns_are_not_read(spark, tmp_path):
    store = streams.Store(spark, str(tmp_path / "s"), {"moderation": "id STRING, reason STRING, notes STRING"}, fan=9)
    row = lambda *r: spark.createDataFrame(list(r), "id string, reason string, notes string")
    store.add("moderation", row(("a", "x", "n"), ("a", "x", "n"), ("b", "x", "n"), (None, "x", "n"), (None, "x", "n")), 0, gone=row(("b", "", "")))
    assert store._rows("moderation", [(0, 0)]).count() == 3
    one = store.current("moderation")
    assert sorted(r["id"] or "" for r in one.collect()) == ["", "a"]
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    store.add("moderation", row(("a", "y", "m")), 1)
    two = store.current("moderation").select("id", "reason")
    assert {tuple(r) for r in two.collect()} == {("a", "y"), (None, "x")}
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert not any("notes" in read for read in re.findall(r"ReadSchema: [^\n]*", plan))
