"""The engine's tables as views over the star-schema, event, document and page test tables."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evcat import config as C
from evcat.functions import stem
from evcat.functions import text as T
from evcat.session import configure

NOW = datetime(1998, 1, 1)
EVENTS_NOW = datetime(2024, 1, 15)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(
        nation, customer["c_nationkey"] == nation["n_nationkey"]
    )


def _mode() -> Column:
    first = F.left("o_orderpriority", F.lit(1))
    return F.when(first.isin("1", "2"), "offline").when(first == "3", "online").when(first == "4", "hybrid")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as catalogue events; every column the listing queries use."""
    title = F.concat("c_mktsegment", F.lit(" "), "o_orderpriority")
    two_days, four_days = F.expr("INTERVAL 2 DAYS"), F.expr("INTERVAL 4 DAYS")
    done = F.col("o_orderstatus") == "F"
    url = F.concat(F.lit("https://events.example.org/e/"), F.col("o_orderkey").cast("string"))
    return _orders(spark, sf_dir).select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(T.slugify(title), F.lit("-"), F.col("o_orderkey").cast("string")).alias("slug"),
        title.alias("title"),
        F.when(F.col("o_totalprice") >= 100000, F.concat(F.lit("<p>Order of "), "c_name", F.lit(" in "), "n_name", F.lit("</p>"))).alias("description"),
        F.when(F.col("o_totalprice") >= 300000, F.concat(F.lit("Big "), F.lower("c_mktsegment"))).alias("short_description"),
        F.col("o_orderdate").alias("start_at"),
        F.when(done, F.col("o_orderdate") + two_days).alias("end_at"),
        F.lit(C.DISPLAY_ZONE).alias("timezone"),
        F.lit(C.Region().city).alias("city"),
        F.col("n_name").alias("locality"),
        F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("Hall "), "n_name")).alias("venue_name"),
        F.lit(None).cast("string").alias("address"),
        F.lit(None).cast("double").alias("lat"),
        F.lit(None).cast("double").alias("lng"),
        _mode().alias("mode"),
        F.when(F.col("c_mktsegment") == "BUILDING", "workshop").when(F.col("c_mktsegment") == "MACHINERY", "hackathon").otherwise("meetup").alias("event_type"),
        F.array("c_mktsegment", "o_orderpriority").alias("topics"),
        F.array(F.lit("developers")).alias("audience"),
        F.col("c_name").alias("organizer_name"),
        F.col("c_mktsegment").alias("community_name"),
        F.lit("generic").alias("source_platform"),
        url.alias("canonical_url"),
        F.when(F.col("o_totalprice") < 250000, F.concat(url, F.lit("/register"))).alias("registration_url"),
        F.when(F.col("o_totalprice") >= 200000, F.concat(url, F.lit(".png"))).alias("poster_url"),
        F.lit(None).cast("string").alias("banner_color"),
        F.lit("unknown").alias("price_type"),
        (F.col("o_totalprice") < 50000).alias("is_free"),
        (F.col("o_totalprice") >= 400000).alias("is_featured"),
        F.lit(False).alias("is_cancelled"),
        (F.col("c_acctbal") < 2000).alias("is_student_friendly"),
        (F.col("o_orderstatus") == "P").alias("date_tba"),
        F.lit(0.95).alias("relevance_score"),
        F.lit(0.8).alias("publish_score"),
        F.lit(None).cast("string").alias("raw_event_id"),
        F.when(F.col("c_acctbal") >= 1000, F.col("o_orderdate") - F.expr("INTERVAL 30 DAYS")).alias("published_at"),
        F.when(done, F.col("o_orderdate") + four_days).alias("expires_at"),
        stem.terms(F.concat_ws(" ", title, "c_name", "n_name"), stemmed=False).alias("search_tokens"),
        F.col("o_orderdate").alias("updated_at"),
        (F.col("o_orderdate") - F.expr("INTERVAL 40 DAYS")).alias("created_at"),
    )


# The same view for the SQL check.
CATALOGUE_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS id,
  regexp_replace(lower(c_mktsegment || ' ' || o_orderpriority), '[^a-z0-9]+', '-', 'g') || '-' || CAST(o_orderkey AS VARCHAR) AS slug,
  c_mktsegment || ' ' || o_orderpriority AS title,
  CASE WHEN o_totalprice >= 100000 THEN '<p>Order of ' || c_name || ' in ' || n_name || '</p>' END AS description,
  CASE WHEN o_totalprice >= 300000 THEN 'Big ' || lower(c_mktsegment) END AS short_description,
  o_orderdate AS start_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 2 DAY END AS end_at,
  n_name AS locality,
  CASE WHEN c_acctbal > 5000 THEN 'Hall ' || n_name END AS venue_name,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'offline' WHEN '2' THEN 'offline' WHEN '3' THEN 'online' WHEN '4' THEN 'hybrid' END AS mode,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'workshop' WHEN 'MACHINERY' THEN 'hackathon' ELSE 'meetup' END AS event_type,
  [c_mktsegment, o_orderpriority] AS topics,
  c_name AS organizer_name, c_mktsegment AS community_name,
  'https://events.example.org/e/' || CAST(o_orderkey AS VARCHAR) AS canonical_url,
  CASE WHEN o_totalprice < 250000 THEN 'https://events.example.org/e/' || CAST(o_orderkey AS VARCHAR) || '/register' END AS registration_url,
  CASE WHEN o_totalprice >= 200000 THEN 'https://events.example.org/e/' || CAST(o_orderkey AS VARCHAR) || '.png' END AS poster_url,
  o_totalprice < 50000 AS is_free, o_totalprice >= 400000 AS is_featured, c_acctbal < 2000 AS is_student_friendly,
  o_orderstatus = 'P' AS date_tba,
  CASE WHEN c_acctbal >= 1000 THEN o_orderdate - INTERVAL 30 DAY END AS published_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 4 DAY END AS expires_at,
  o_orderdate AS updated_at, o_orderdate - INTERVAL 40 DAY AS created_at,
  o_totalprice, c_custkey, c_acctbal, n_nationkey
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as crawl sources."""
    balance = F.col("s_acctbal")
    crawled = F.expr("TIMESTAMP_NTZ'1998-01-01 00:00:00'") - F.make_interval(hours=F.col("s_nationkey"))
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"),
        F.col("s_name").alias("name"),
        F.when(balance < 3000, "static").otherwise("generic").alias("platform"),
        F.concat(F.lit("https://events.example.org/e/"), F.col("s_suppkey").cast("string")).alias("base_url"),
        (balance >= 500).alias("enabled"),
        F.when(balance < 1500, "blacklisted").when(balance > 8500, "whitelisted").otherwise("active").alias("status"),
        F.lit("generic").alias("crawl_strategy"),
        F.when(balance > 2500, '{"watchlist":true,"max_items":1}').otherwise('{"max_items":1}').alias("config_json"),
        F.when(balance > 6000, 6).when(balance > 4000, 0).otherwise(12).alias("crawl_interval_hours"),
        F.when(balance < 1500, 0.0).when(balance > 5000, 0.9).otherwise(0.7).alias("trust_score"),
        F.when(balance < 9000, crawled).alias("last_crawled_at"),
        F.when(balance < 9000, crawled).alias("last_success_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_failure_at"),
        F.when(balance < 2000, 3).otherwise(0).alias("consecutive_failures"),
        F.expr("TIMESTAMP_NTZ'1997-01-01 00:00:00'").alias("created_at"),
    )


SOURCES_SQL = """
SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name,
  CASE WHEN s_acctbal < 3000 THEN 'static' ELSE 'generic' END AS platform,
  'https://events.example.org/e/' || CAST(s_suppkey AS VARCHAR) AS base_url,
  s_acctbal >= 500 AS enabled,
  CASE WHEN s_acctbal < 1500 THEN 'blacklisted' WHEN s_acctbal > 8500 THEN 'whitelisted' ELSE 'active' END AS status,
  s_acctbal > 2500 AS watched,
  CASE WHEN s_acctbal > 6000 THEN 6 WHEN s_acctbal > 4000 THEN 0 ELSE 12 END AS crawl_interval_hours,
  CAST(CASE WHEN s_acctbal < 1500 THEN 0.0 WHEN s_acctbal > 5000 THEN 0.9 ELSE 0.7 END AS DOUBLE) AS trust_score,
  CASE WHEN s_acctbal < 9000 THEN TIMESTAMP '1998-01-01 00:00:00' - INTERVAL (s_nationkey) HOUR END AS last_crawled_at,
  CASE WHEN s_acctbal < 2000 THEN 3 ELSE 0 END AS consecutive_failures, s_acctbal
FROM supplier
"""


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw events: payload title and URL; labels give a model title and the status."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    payload = F.to_json(F.struct(F.col("text").alias("title"), F.concat(F.lit("https://docs.example.org/"), F.col("doc_id").cast("string")).alias("url")))
    extracted = F.to_json(F.struct(F.concat(F.lit("<b>Doc "), F.col("doc_id").cast("string"), F.lit("</b>")).alias("title"), F.col("source").alias("community_name")))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("source_id"),
        F.when(F.col("lang") != "en", F.col("doc_id").cast("string")).alias("external_id"),
        payload.alias("raw_payload_json"),
        F.when(F.col("quality") == 1, extracted).alias("ai_extracted_json"),
        F.when(F.col("quality") == 1, "ai").otherwise("deterministic").alias("extraction_method"),
        F.when(F.col("quality") == 1, 0.9).otherwise(0.35).alias("extraction_confidence"),
        F.timestamp_seconds(F.lit(883612800) + F.col("n_chars")).cast("timestamp_ntz").alias("seen_at"),
        F.when(F.col("toxic") == 1, "moderation").when(F.col("quality") == 1, "published").when(F.col("quality") == 0, "rejected").otherwise("pending").alias("pipeline_status"),
    )


def moderation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as moderation rows."""
    return read(spark, sf_dir, "labels").select(
        F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("id"),
        F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "event").otherwise("raw_event").alias("entity_type"),
        F.col("doc_id").cast("string").alias("entity_id"),
        F.when(F.col("toxic") == 1, "url_noise").otherwise("low_confidence").alias("reason"),
        F.lit("low").alias("severity"),
        F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "pending").otherwise("approved").alias("status"),
        F.lit(None).cast("string").alias("ai_verdict"),
        F.lit(None).cast("string").alias("notes"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
        F.timestamp_seconds(F.lit(883612800) + F.col("doc_id")).cast("timestamp_ntz").alias("created_at"),
    )


RAW_SQL = """
SELECT CAST(d.doc_id AS VARCHAR) AS id, source AS source_id, CASE WHEN lang <> 'en' THEN CAST(d.doc_id AS VARCHAR) END AS external_id,
  text AS p_title, 'https://docs.example.org/' || CAST(d.doc_id AS VARCHAR) AS p_url,
  CASE WHEN quality = 1 THEN '<b>Doc ' || CAST(d.doc_id AS VARCHAR) || '</b>' END AS x_title,
  CASE WHEN quality = 1 THEN source END AS x_community,
  CASE WHEN quality = 1 THEN 'ai' ELSE 'deterministic' END AS extraction_method,
  CAST(CASE WHEN quality = 1 THEN 0.9 ELSE 0.35 END AS DOUBLE) AS extraction_confidence,
  make_timestamp(CAST((883612800 + n_chars) * 1000000 AS BIGINT)) AS seen_at,
  CASE WHEN toxic = 1 THEN 'moderation' WHEN quality = 1 THEN 'published' WHEN quality = 0 THEN 'rejected' ELSE 'pending' END AS pipeline_status
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""
MODERATION_SQL = """
SELECT 'm' || CAST(doc_id AS VARCHAR) AS id, CASE WHEN quality = 0 AND toxic = 1 THEN 'event' ELSE 'raw_event' END AS entity_type,
  CAST(doc_id AS VARCHAR) AS entity_id, CASE WHEN toxic = 1 THEN 'url_noise' ELSE 'low_confidence' END AS reason,
  CASE WHEN quality = 0 OR toxic = 1 THEN 'pending' ELSE 'approved' END AS status,
  make_timestamp(CAST((883612800 + doc_id) * 1000000 AS BIGINT)) AS created_at
FROM labels
"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_of(read(spark, sf_dir, "pages"))


def pages_of(table: DataFrame) -> DataFrame:
    """Web pages, one source per site; works for a stream as well."""
    return table.select(
        T.url_authority(F.col("url")).alias("source_id"),
        "url",
        F.col("html").alias("html_or_json"),
        F.timestamp_seconds(F.lit(883612800) + F.col("page_id")).alias("fetched_at"),
        F.lit(200).alias("status_code"),
        F.lit("detail").alias("page_type"),
    )


def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source per site of the pages table."""
    return pages(spark, sf_dir).select("source_id").distinct().select(
        F.col("source_id").alias("id"),
        F.lit("generic").alias("platform"),
        F.concat(F.lit("https://"), "source_id").alias("base_url"),
        F.lit(0.7).alias("trust_score"),
        F.lit("{}").alias("config_json"),
    )


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON pages of a static source per nation: one event object and one stray item each."""
    event = F.struct(
        F.col("o_orderkey").cast("string").alias("_id"),
        F.concat("c_mktsegment", F.lit(" "), "o_orderpriority").alias("title"),
        F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("start_at"),
        _mode().alias("mode"),
        F.when(F.col("o_totalprice") >= 100000, F.concat(F.lit("Order of "), "c_name")).alias("description"),
        F.concat(F.lit("https://events.example.org/e/"), F.col("o_orderkey").cast("string"), F.lit("?utm_source=feed")).alias("canonical_url"),
        F.when(F.col("c_acctbal") > 2000, C.Region().city).alias("city"),
        F.col("n_name").alias("locality"),
        F.when(F.col("c_acctbal") > 5000, F.col("c_name")).alias("organizer_name"),
        (F.col("o_totalprice") < 50000).alias("is_free"),
        F.array("c_mktsegment", "o_orderpriority").alias("topics"),
    )
    body = F.concat(F.lit('{"results":['), F.to_json(event), F.lit(',"stray"]}'))
    return _orders(spark, sf_dir).select(
        F.col("n_name").alias("source_id"),
        F.concat(F.lit("https://events.example.org/list/"), F.col("o_orderkey").cast("string")).alias("url"),
        body.alias("html_or_json"),
        F.timestamp_seconds(F.lit(883612800) + F.col("o_orderkey")).alias("fetched_at"),
        F.lit(200).alias("status_code"),
        F.lit("api_response").alias("page_type"),
    )


def nation_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as static sources with rising trust."""
    return read(spark, sf_dir, "nation").select(
        F.col("n_name").alias("id"),
        F.lit("static").alias("platform"),
        F.lit("https://events.example.org").alias("base_url"),
        F.round(F.lit(0.5) + F.col("n_nationkey") * 0.02, 2).alias("trust_score"),
        F.lit("{}").alias("config_json"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events as duplicate candidates; "click u1" is contained in "click u12"."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat("event_type", F.lit(" u"), F.col("user_id").cast("string")).alias("title"),
        F.col("ts").alias("start_at"),
        F.lit("").alias("canonical_url"),
        F.col("ts").alias("created_at"),
    )


def candidates_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as duplicate candidates (title, us); pending ones have no start."""
    start = F.when(F.col("o_orderstatus") != "P", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    return _orders(spark, sf_dir).select(F.lower(F.concat("c_mktsegment", F.lit(" "), "o_orderpriority")).alias("title"), start.alias("us"))
