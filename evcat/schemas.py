"""Table schemas as DDL strings."""
from __future__ import annotations

PAGES = (
    "source_id STRING, url STRING, html_or_json STRING, fetched_at TIMESTAMP, "
    "status_code INT, page_type STRING"
)
STATIC_EVENT = (
    "_id STRING, title STRING, start_at STRING, end_at STRING, mode STRING, description STRING, "
    "canonical_url STRING, registration_url STRING, city STRING, locality STRING, "
    "venue_name STRING, community_name STRING, organizer_name STRING, is_free BOOLEAN, "
    "event_type STRING, topics ARRAY<STRING>"
)
SOURCES = (
    "id STRING, name STRING, platform STRING, base_url STRING, enabled BOOLEAN, status STRING, "
    "crawl_strategy STRING, config_json STRING, crawl_interval_hours INT, trust_score DOUBLE, "
    "last_crawled_at TIMESTAMP, last_success_at TIMESTAMP, last_failure_at TIMESTAMP, "
    "consecutive_failures INT, created_at TIMESTAMP"
)
RAW_EVENTS = (
    "id STRING, source_id STRING, external_id STRING, raw_payload_json STRING, "
    "ai_extracted_json STRING, extraction_method STRING, extraction_confidence DOUBLE, "
    "ai_flags ARRAY<STRING>, seen_at TIMESTAMP, processed BOOLEAN, pipeline_status STRING"
)
EXTRACTIONS = (
    "raw_event_id STRING, title STRING, description STRING, start_at STRING, end_at STRING, "
    "timezone STRING, city STRING, locality STRING, venue_name STRING, address STRING, "
    "mode STRING, event_type STRING, topics ARRAY<STRING>, audience ARRAY<STRING>, "
    "organizer_name STRING, community_name STRING, registration_url STRING, price_type STRING, "
    "is_free BOOLEAN, is_student_friendly BOOLEAN, confidence DOUBLE, "
    "missing_fields ARRAY<STRING>, not_an_event BOOLEAN"
)
EVENTS = (
    "id STRING, slug STRING, title STRING, description STRING, short_description STRING, "
    "start_at TIMESTAMP, end_at TIMESTAMP, timezone STRING, city STRING, locality STRING, "
    "venue_name STRING, address STRING, lat DOUBLE, lng DOUBLE, mode STRING, event_type STRING, "
    "topics ARRAY<STRING>, audience ARRAY<STRING>, organizer_name STRING, community_name STRING, "
    "source_platform STRING, canonical_url STRING, registration_url STRING, poster_url STRING, "
    "banner_color STRING, price_type STRING, is_free BOOLEAN, is_featured BOOLEAN, "
    "is_cancelled BOOLEAN, is_student_friendly BOOLEAN, date_tba BOOLEAN, relevance_score DOUBLE, "
    "publish_score DOUBLE, raw_event_id STRING, published_at TIMESTAMP, expires_at TIMESTAMP, "
    "search_tokens ARRAY<STRING>, updated_at TIMESTAMP, created_at TIMESTAMP"
)
CRAWL_RUNS = (
    "id STRING, source_id STRING, celery_task_id STRING, started_at TIMESTAMP, "
    "finished_at TIMESTAMP, status STRING, pages_fetched INT, events_found INT, events_new INT, "
    "events_published INT, events_queued INT, error_summary STRING, created_at TIMESTAMP"
)
MODERATION = (
    "id STRING, entity_type STRING, entity_id STRING, reason STRING, severity STRING, "
    "status STRING, ai_verdict STRING, notes STRING, resolved_at TIMESTAMP, created_at TIMESTAMP"
)
SUBMISSIONS = (
    "id STRING, submission_type STRING, submitter_name STRING, submitter_email STRING, "
    "event_url STRING, poster_key STRING, community_name STRING, community_url STRING, "
    "community_description STRING, notes STRING, status STRING, created_at TIMESTAMP"
)
SNAPSHOTS = (
    "source_id STRING, url_hash STRING, schema_version STRING, page_hash STRING, body STRING, "
    "stored_at TIMESTAMP"
)
